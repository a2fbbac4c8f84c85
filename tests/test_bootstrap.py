import random

import duckdb
import pandas as pd

from pyspark.sql import functions as F

from helpers import opinions
from reviewlens.operators import bootstrap
from reviewlens.plans.oracle import _PARTS

SEEDS = "屏幕"
B1 = [
    ("屏幕", "n", "好", "a"),
    ("外观", "n", "好", "a"),
    ("外观", "n", "漂亮", "a"),
    ("外观", "n", "看", "v"),
    ("做工", "n", "漂亮", "a"),
    ("价格", "n", "贵", "a"),
    ("机", "n", "好", "a"),
    ("屏幕", "n", "非常漂亮", "a"),
    ("续航", "n", "非常漂亮", "a"),
]


def run(spark, df, threshold=3, seeds=SEEDS):
    labelled = bootstrap.bootstrap(df, seeds)
    labels = {
        (r.pId, r.pairNo): r.label for r in bootstrap.label_pairs(df, labelled).collect()
    }
    vocabulary = lambda d: {(r.pId, r.name): r.freq for r in d.collect()}
    return (
        labels,
        vocabulary(bootstrap.feature_words(labelled, threshold)),
        vocabulary(bootstrap.sentiment_words(labelled, threshold)),
    )


def test_hand_worked_case(spark):
    df = opinions(spark, B1)
    labels, features, sentiments = run(spark, df)
    assert [labels[1, i] for i in range(9)] == [-1, -1, -1, 1, -1, 0, 1, 1, 1]
    assert features == {(1, "屏幕"): 2} and sentiments == {}
    _, features, sentiments = run(spark, df, threshold=0)
    assert features == {(1, "屏幕"): 2, (1, "外观"): 3, (1, "做工"): 1}
    assert sentiments == {(1, "好"): 2, (1, "漂亮"): 2}
    labels = [r.label for r in bootstrap.seed_pass(df, SEEDS).orderBy("pairNo").collect()]
    assert labels == [-1, 0, 0, 0, 0, 0, 1, 1, 0]


def by_sql(made, seeds, threshold):
    """Labels and word counts of the products by the SQL that the queries are compared with."""
    sides = pd.DataFrame(
        [
            (p, i, f, fp, s, sp, 2 <= len(f) <= 4, 1 <= len(s) <= 3, any(x in f for x in seeds))
            for p, pairs in made.items()
            for i, (f, fp, s, sp) in enumerate(pairs)
        ],
        columns=["pid", "pno", "f", "fpos", "s", "spos", "fok", "sok", "seed"],
    )
    db = duckdb.connect()
    db.register("sides", sides)
    db.register("short_sides", sides[sides.fok & sides.sok])
    parts = [_PARTS[p] for p in ("edges", "reach", "by_edge", "labelled", "marked")]
    head = "WITH RECURSIVE " + ", ".join(parts)
    # a seed feature with a sentiment of invalid length is rejected, and so is an invalid feature
    labels = db.execute(head + " SELECT pid, pno, label FROM marked").fetchall()
    learned = db.execute(
        head + f""" SELECT pid, f, sum(n) FROM labelled
        WHERE NOT seed AND (by_side = 'f' OR label = -1) GROUP BY ALL HAVING sum(n) > {threshold}
        UNION ALL SELECT pid, f, count(*) FROM sides WHERE fok AND seed GROUP BY ALL"""
    ).fetchall()
    felt = db.execute(
        head + f""" SELECT pid, s, sum(n) FROM labelled
        WHERE by_side = 's' OR label = -1 GROUP BY ALL HAVING sum(n) > {threshold}"""
    ).fetchall()
    return ({(p, i): l for p, i, l in labels}, {(p, w): n for p, w, n in learned}, {(p, w): n for p, w, n in felt})


def test_random_products_agree_with_sql(spark):
    rng = random.Random(3)
    made = {}
    for p in range(60):
        n = rng.randint(1, 60)
        alphabet = "abcdefgh"[: rng.randint(3, 8)]
        make = lambda longest: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
        made[p] = [(make(5), rng.choice("nvad"), make(4), rng.choice("aaav")) for _ in range(n)]
    df = None
    for p, pairs in made.items():
        part = opinions(spark, pairs, p)
        df = part if df is None else df.unionByName(part)
    df = df.repartition(7)
    labels, features, sentiments = run(spark, df, threshold=2, seeds="ab|c")
    assert (labels, features, sentiments) == by_sql(made, ["ab", "c"], 2)


def test_words_without_a_tag_never_match(spark):
    df = opinions(
        spark,
        [("屏幕", None, "好", "a"), ("外观", None, "好", "a"), ("做工", "n", "好", None), ("屏幕", "n", "漂亮", None)],
    )
    labels, _, _ = run(spark, df)
    # a seed needs no tag; a feature reached from a sentiment does, and so does the sentiment of a seed
    assert labels == {(1, 0): -1, (1, 1): 1, (1, 2): -1, (1, 3): 1}


def test_products_do_not_share_words(spark):
    df = opinions(spark, B1[:1], 1).unionByName(opinions(spark, B1[1:2], 2))
    labels, _, _ = run(spark, df)
    assert labels == {(1, 0): -1, (2, 0): 0}


def test_accepted_opinions_nest_in_order(spark):
    df = opinions(spark, B1).withColumn("sId", F.when(F.col("pairNo") > 2, 3).otherwise(0))
    accepted = bootstrap.accepted_opinions(df, bootstrap.bootstrap(df, SEEDS))
    row = bootstrap.nest_opinions(accepted).first()
    assert [
        (s.sId, [(o.feature.cont, o.sentiment.cont) for o in s.sFeaSenPairs]) for s in row.cFeaSenPairs
    ] == [(0, [("屏幕", "好"), ("外观", "好"), ("外观", "漂亮")]), (3, [("做工", "漂亮")])]
