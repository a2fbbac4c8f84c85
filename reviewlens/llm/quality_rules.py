"""Operator 9: a decision list of threshold rules learned from labelled statistics.

Sequential covering: a rule is grown one threshold at a time by information gain on two
thirds of the labelled rows, cut back to its best prefix on the other third, and kept while
it is precise enough there; the rows it covers are set aside and the next rule is grown. The
list is emitted as one ordered ``when ... when ... otherwise`` expression.

Defined cases: a null or empty text has no words and statistics of 0, so it fails the base
rule; without labels of both classes the list is empty and only the base rule rejects; a
repeated row gets its own result; unlabelled rows and null labels are not learned from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.native import blank_words, every, let, whole
from reviewlens.session import stage

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Places of a gram share a long with the top bits of its hash; a text has fewer than 2^30 words.
_PLACE_BITS = 30


def _repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    The windows' hashes are sorted as plain longs with the place in the low bits, which leaves
    a few places whose neighbours look alike; only those are compared by the whole hash.
    """
    n = F.size(hashes)

    def gram(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + j) for j in range(3)])

    def packed(i: Column) -> Column:
        high = F.shiftleft(F.shiftright(gram(i), _PLACE_BITS), _PLACE_BITS)
        return high.bitwiseOR(i.cast("long"))

    def alike(a: Column, b: Column) -> Column:
        same = F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS)
        return F.coalesce(same, F.lit(False))

    def places(keys: Column) -> Column:
        near = F.filter(
            keys,
            lambda x, i: alike(x, F.get(keys, i - 1)) | alike(x, F.get(keys, i + 1)),
        )
        low = F.lit((1 << _PLACE_BITS) - 1).cast("long")
        return F.transform(
            near,
            lambda x: let(
                x.bitwiseAND(low).cast("int"),
                lambda p: F.struct(gram(p).alias("h"), p.alias("p")),
            ),
        )

    def count(found: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(a["h"] == b["h"], F.lit(False))

        twice = F.filter(
            found,
            lambda x, i: same(x, F.get(found, i - 1)) | same(x, F.get(found, i + 1)),
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["p"])),
            start,
            lambda a, p: F.struct(
                p.alias("last"),
                (a["n"] + F.least(F.lit(3), p - a["last"]).cast("long")).alias("n"),
            ),
            lambda a: a["n"],
        )

    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), packed)
    counted = let(
        F.sort_array(windows), lambda keys: let(F.sort_array(places(keys)), count)
    )
    return F.when(n >= 4, counted).otherwise(F.lit(0).cast("long"))


def _count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def statistics(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and one struct ``stats`` of counts per row, in one pass over the text."""
    content = whole(text)

    def counts(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        by_hash = let(
            hashes,
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                _repeated_words(h).alias("n_repeat_words"),
                F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
            ),
        )
        return F.struct(
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            by_hash.alias("by_hash"),
        )

    lines = F.filter(F.split(content, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    read = docs.select(
        *keep,
        let(blank_words(text), counts).alias("_w"),
        of_lines.alias("_l"),
        _count_of(content, SYMBOLS).alias("_n_symbols"),
        _count_of(content, "A-Z").alias("_n_upper"),
        _count_of(content, "!?").alias("_n_marks"),
        _count_of(content, "0-9").alias("_n_digits"),
    )
    return read.select(
        *read.columns[: len(keep)],
        F.struct(
            F.col("_w.by_hash.n_words").alias("n_words"),
            F.col("_w.word_chars").alias("word_chars"),
            F.col("_n_symbols").alias("n_symbols"),
            F.col("_l.n_dup_lines").alias("n_dup_lines"),
            F.col("_w.by_hash.n_repeat_words").alias("n_repeat_words"),
            F.col("_w.by_hash.n_distinct").alias("n_distinct"),
            F.col("_l.n_lines").alias("n_lines"),
            F.col("_n_upper").alias("n_upper"),
            F.col("_n_marks").alias("n_marks"),
            F.col("_n_digits").alias("n_digits"),
        ).alias("stats"),
    )


def _share(a: str, b: str, stats: str) -> Column:
    return F.col(f"{stats}.{a}") / F.greatest(F.col(f"{stats}.{b}"), F.lit(1))


def features(stats: str = "stats") -> dict[str, Column]:
    """What the rules may look at; all finite for every text."""
    return {
        "n_words": F.col(f"{stats}.n_words").cast("double"),
        "mean_word": _share("word_chars", "n_words", stats),
        "symbols_per_word": _share("n_symbols", "n_words", stats),
        "dup_lines": _share("n_dup_lines", "n_lines", stats),
        "repeated": _share("n_repeat_words", "n_words", stats),
        "distinct": _share("n_distinct", "n_words", stats),
        "upper": _share("n_upper", "word_chars", stats),
        "marks_per_word": _share("n_marks", "n_words", stats),
        "digits": _share("n_digits", "word_chars", stats),
    }


def base_failed(stats: str = "stats") -> Column:
    n = F.col(f"{stats}.n_words")
    repeated = 100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEATED_PERCENT * n
    return (n < MIN_WORDS) | repeated


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, at: Column) -> Column:
        return at > self.threshold if self.above else at <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects a row."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_no(self, stats: str = "stats") -> Column:
        """Number of the first rule that holds, from 1; 0 when none does."""
        at = features(stats)
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = every([c.holds(at[c.feature]) for c in rule])
            out = F.when(holds, k) if out is None else out.when(holds, k)
        return F.lit(0) if out is None else out.otherwise(0)


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    max_conditions: int = 4
    max_rules: int = 12
    min_precision: float = 0.9
    min_covered: int = 5


def learn(labelled: DataFrame, settings: Settings = Settings()) -> DecisionList:
    """Rules for ``bad`` = true from rows of ``doc_id, stats, bad``.

    Every step is one grouped count of all labelled rows by feature and bin; the driver sees
    a count per feature and bin.
    """
    at = features()
    rows = stage(
        labelled.filter("bad is not null").select(
            "bad",
            (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) > 0).alias("grow"),
            *[column.alias(name) for name, column in at.items()],
        ),
        "rule-statistics",
    )
    names = list(at)
    marks = [k / settings.bins for k in range(1, settings.bins)]
    cuts_row = rows.agg(*[F.percentile_approx(n, marks, 100000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(cuts_row[n] or [])) for n in names}

    def bin_of(name: str) -> Column:
        # cuts below the value: the bin b holds values in (cuts[b-1], cuts[b]]
        above = [F.when(F.col(name) > c, 1).otherwise(0) for c in cuts[name]]
        return F.aggregate(F.array(*above), F.lit(0), lambda a, x: a + x) if above else F.lit(0)

    binned = stage(
        rows.select(
            "bad",
            "grow",
            *names,
            F.array(
                *[F.struct(F.lit(k).alias("f"), bin_of(n).alias("b")) for k, n in enumerate(names)]
            ).alias("bins"),
        ),
        "rule-bins",
    )

    def covers(rule: list[Condition]) -> Column:
        return every([c.holds(F.col(c.feature)) for c in rule])

    def counted(left: DataFrame, rule: list[Condition]) -> list[tuple[Condition, int, int]]:
        found = (
            left.filter(F.col("grow") & covers(rule))
            .select("bad", F.explode("bins").alias("x"))
            .groupBy("x.f", "x.b")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )
        out = []
        for k, name in enumerate(names):
            of = {r["b"]: (r["p"], r["n"]) for r in found if r["f"] == k}
            p_all, n_all = (sum(v[j] for v in of.values()) for j in (0, 1))
            p = n = 0
            for b, cut in enumerate(cuts[name]):
                p, n = (s + v for s, v in zip((p, n), of.get(b, (0, 0))))
                out.append((Condition(name, False, cut), p, n))
                out.append((Condition(name, True, cut), p_all - p, n_all - n))
        return out

    def info(p: int, n: int) -> float:
        return math.log2((p + 1e-9) / (p + n + 1e-9))

    learned = DecisionList()
    left = binned
    while len(learned.rules) < settings.max_rules:
        rule: list[Condition] = []
        seen = left.filter("grow").agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
        p0, n0 = seen[0], seen[1]
        if p0 < settings.min_covered or n0 == 0 and not learned.rules:
            break
        while n0 > 0 and len(rule) < settings.max_conditions:
            best = max(
                counted(left, rule),
                key=lambda x: (x[1] * (info(x[1], x[2]) - info(p0, n0)), x[1], x[0].feature),
                default=None,
            )
            if best is None or best[1] * (info(best[1], best[2]) - info(p0, n0)) <= 1e-6:
                break
            rule.append(best[0])
            p0, n0 = best[1], best[2]
        if not rule:
            break
        tests = [rule[: k + 1] for k in range(len(rule))]
        checked = (
            left.filter("not grow")
            .agg(
                *[F.count_if(covers(t) & F.col("bad")).alias(f"p{k}") for k, t in enumerate(tests)],
                *[F.count_if(covers(t) & ~F.col("bad")).alias(f"n{k}") for k, t in enumerate(tests)],
            )
            .first()
        )

        def worth(k: int) -> float:
            p, n = checked[f"p{k}"], checked[f"n{k}"]
            return (p - n) / max(p + n, 1)

        k = max(range(len(tests)), key=lambda j: (worth(j), -j))
        p, n = checked[f"p{k}"], checked[f"n{k}"]
        if p < settings.min_covered / 3 or p < settings.min_precision * (p + n):
            break
        learned.rules.append(tests[k])
        left = left.filter(~covers(tests[k]))
    return learned


def judged(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``stats`` (doc_id, stats) with ``base_failed``, the number of the rejecting ``rule`` and
    ``kept``, by rules learned from ``labels`` (doc_id, quality)."""
    return apply_rules(stats, learn_from(stats, labels, settings))


def learn_from(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DecisionList:
    of = labels.select(
        F.col("doc_id").alias("_labelled"), (F.col("quality") == 0).alias("bad")
    )
    return learn(
        stats.join(of, F.col("doc_id") == F.col("_labelled")).select("doc_id", "stats", "bad"),
        settings,
    )


def apply_rules(stats: DataFrame, rules: DecisionList) -> DataFrame:
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.rule_no()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )
