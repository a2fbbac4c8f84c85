"""Documents with nulls, empty, long and repeated texts, and columns that clash."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, stats string, "
    "words string, kept boolean, text_key string, _row string, id string"
)


def prose(seed, n):
    rng = random.Random(seed)
    parts = ["the", "on", "er", "tion", "ñe", "éa", "ble", "And", "st.", "of", "re,", "ou", "in\n"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


LONG = prose(99, 30_000)
BASE = prose(5, 120)
EDITED = BASE.replace(BASE.split()[60], "other", 1)
PERSONAL = (
    "mail a.b@c.de..x@y.zz and 1.2.3.4.5.6.7.8 or 999.1.1.1, card 4539 1488 0343 6467 and "
    "4539-1488-0343-6468, call +49 (30) 123-4567 or +1 23. é@é x@y z@w-.q.\U0001F600 k@l.m " + "1 " * 3000
)


def texts():
    out = [None, "", "   \n\t ", "word", "MIT License", BASE, BASE.upper(), EDITED, BASE, PERSONAL, LONG]
    out += [LONG + " tail", "Apache  License and the general-public (LICENSE). MIT license mit LICENSE"]
    out += ["xx Licensed under CC BY-NC 4.0 yy", "same line\nsame line\n\nother\nsame line", "é É ſ K ß"]
    out += [prose(i, 20 + 7 * i) for i in range(30)]
    return out


def rows():
    made = [(i, t) for i, t in enumerate(texts())]
    made += [(5, BASE), (None, BASE), (None, None), (None, prose(3, 41)), (1000, prose(3, 41))]
    return [(i, t, "en", f"src{k % 3}", len(t or ""), "s", "w", True, "k", "r", "i") for k, (i, t) in enumerate(made)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def save(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


def labels(spark, n=40):
    return spark.createDataFrame(
        [(i, None if i % 11 == 0 else int(i % 3 > 0), int(i % 4 == 0), "x") for i in range(n)],
        "doc_id bigint, quality int, toxic int, text string",
    )


def benchmark(spark):
    words = BASE.split()
    items = [(1, " ".join(words[10:40])), (2, "Word"), (3, None), (4, " ,. "), (None, " ".join(words[50:64]))]
    items += [(5, " ".join(words[20:33])), (5, " ".join(words[20:33])), (6, "general public")]
    return spark.createDataFrame(items, "item_id bigint, text string")


def embeddings(spark, n=260, width=12):
    """Vectors with nulls and odd numbers in them, ties, copies, other lengths and clashing columns."""
    rng = random.Random(7)
    made = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(n)]
    rows = [(i, v, i % 5, "x", 1) for i, v in enumerate(made)]
    rows += [(n + i, made[20], 1, "x", 1) for i in range(40)]
    rows += [(20, made[20], 0, "x", 1), (None, made[3], 1, "x", 1), (100, [1e3] * width, 3, "y", 2)]
    rows += [(400, None, 1, "x", 1), (420, [0.5, None], 1, "x", 1), (440, [float("nan")] * 3, 1, "x", 1)]
    rows += [(460, [float("-inf"), 1.0], 1, "x", 1), (480, [], 2, "x", 1), (500, [0.0] * width, 2, "x", 1)]
    rows += [(520, made[5][:4], 3, "x", 1), (540, made[9] + [2.0, -3.0], 4, "x", 1), (600, made[8], None, "x", 1)]
    rows += [(-100, made[40], 3, "x", 1), (700, [-x for x in made[0]], 0, "x", 1)]
    return spark.createDataFrame(
        rows, "vec_id bigint, embedding array<float>, label int, id string, rank int"
    ).repartition(3)
