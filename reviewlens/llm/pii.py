"""Operator 1: personal data by patterns and by contexts learned from them.

Seeds are e-mail and IP addresses, card and phone numbers found by their forms. The two words
before a seed, of any length, make a lexical pattern; an earlier match of the same kind is one
word there. Patterns and the identifier-like strings that follow them form a graph which is scored in rounds: a pattern is worth the share of its strings
that are known, a string is known when a good pattern precedes it, and patterns that stay
good mark further strings as personal data of the seed's kind (``ctx_<kind>``).

Places of regular expressions come from the text between matches: a match starts after all
earlier gaps and matches. The expressions have no repeated groups, so very long runs of
digits or dots neither overflow the stack nor take quadratic time.

Defined cases: null and empty texts have no spans; offsets count code points; overlapping
spans of different kinds all stay; repeated rows each get the same spans; a pattern needs
``min_seeds`` different seeds, so without seeds nothing is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.native import let, whole
from reviewlens.session import stage

#: The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]

# A dot that no domain character follows ends a domain; as an underscore it can still stand
# in the part before the @, and in no domain.
_STRAY_DOT = r"\.(?![A-Za-z0-9-])"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A blank or hyphen that does not stand between two digits ends a number.
_STRAY_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
_CARD = r"[0-9\x20-]{12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Strings of at least eight letters and digits with two digits or more.
_IDENTIFIER = (
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9][A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{7,}+"
)
#: What an earlier match of the same kind counts as in a pattern.
_EARLIER = " [found] "


@dataclass(frozen=True)
class Settings:
    min_seeds: int = 3
    min_pattern: float = 0.7
    min_instance: float = 0.8


def _matches(text: Column, regex: str, kind: str, use: Column) -> Column:
    """Array of ``kind, no, gap, found, pattern`` for the matches of ``regex``."""
    none = F.array().cast("array<struct<kind:string,no:int,gap:int,found:string,pattern:string>>")

    def before(gaps: Column, i: Column) -> Column:
        """The text before match ``i``; earlier matches are one word, so two of them suffice."""
        far = F.when(i > 1, F.lit(_EARLIER)).otherwise("")
        near = F.concat(far, F.get(gaps, i - 1), F.lit(_EARLIER))
        return F.concat(F.when(i > 0, near).otherwise(""), F.get(gaps, i))

    def listed(gaps: Column, found: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("no"),
                F.length(F.get(gaps, i)).alias("gap"),
                m.alias("found"),
                _pattern(before(gaps, i)).alias("pattern"),
            ),
        )

    made = let(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda found: F.when(
            F.size(found) > 0, let(F.split(text, regex, -1), lambda gaps: listed(gaps, found))
        ).otherwise(none),
    )
    return F.when(use, made).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    def total(digits: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            digit = F.substring(digits, i, F.lit(1)).cast("int")
            twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return acc + F.when(i % 2 == 0, twice).otherwise(digit)

        n = F.length(digits)
        whole_sum = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)
        return F.when(n.between(12, 19), whole_sum % 10 == 0).otherwise(False)

    return let(F.reverse(_digits(found)), total)


def _valid(kind: Column, found: Column) -> Column:
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(_IP_VALID))
        .when(kind == "card", _luhn(found))
        .when(kind == "phone", F.length(_digits(found)).between(9, 15))
        .otherwise(F.lit(False))
    )


def _pattern(before: Column) -> Column:
    """The last two words before a match, without case and digits."""
    words = F.substring_index(F.rtrim(F.regexp_replace(before, r"\s+", " ")), " ", -2)
    return F.trim(F.regexp_replace(F.lower(words), r"[0-9]+", "0"))


def text_key(text: Column) -> Column:
    return F.xxhash64(whole(text))


def has_candidates(text: Column) -> Column:
    """False only for texts in which no kind can occur."""
    return whole(text).rlike("[0-9@]")


def matches(docs: DataFrame, text: str = "text") -> DataFrame:
    """All matches with places: ``doc_id, text_key, kind, start, end, found, pattern, valid``.

    Identifier-like strings have the kind ``candidate``.
    """
    content = whole(F.col(text))
    digit = content.rlike("[0-9]")
    at = F.contains(content, F.lit("@"))
    found = F.concat(
        _matches(F.regexp_replace(content, _STRAY_DOT, "_"), _EMAIL, "email", at),
        _matches(content, _IP, "ip", digit),
        _matches(F.regexp_replace(content, _STRAY_SEPARATOR, "\n"), _CARD, "card", digit),
        _matches(content, _PHONE, "phone", digit & F.contains(content, F.lit("+"))),
        _matches(content, _IDENTIFIER, "candidate", digit),
    )
    rows = (
        docs.select("doc_id", text_key(F.col(text)).alias("text_key"), found.alias("all"))
        .select("doc_id", "text_key", F.explode_outer("all").alias("m"))
        .filter("m is not null")
        .select("doc_id", "text_key", "m.*")
        .distinct()
    )
    so_far = (
        Window.partitionBy("doc_id", "text_key", "kind")
        .orderBy("no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    length = F.length("found")
    end = F.sum(F.col("gap") + length).over(so_far)
    return (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - length)
        .select(
            "doc_id",
            "text_key",
            "kind",
            "start",
            "end",
            "found",
            "pattern",
            _valid(F.col("kind"), F.col("found")).alias("valid"),
        )
    )


def learned_patterns(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pattern, kind, score`` of the contexts that precede personal data.

    Edges of the graph are distinct (pattern, string) pairs, so a string repeated in many
    copies counts once, and sums per pattern are made before any shuffle.
    """
    usable = found.filter((F.col("pattern") != "") & (F.col("valid") | (F.col("kind") == "candidate")))
    edges = stage(
        usable.groupBy("pattern", F.sha2("found", 256).alias("instance")).agg(
            F.min(F.when(F.col("valid"), F.col("kind"))).alias("seed")
        ),
        "pii-edges",
    )
    known = edges.filter("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind"))

    def sizes() -> list[tuple]:
        return sorted(map(tuple, known.groupBy("kind").agg(F.count("*")).collect()))

    before = sizes()
    while True:
        totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        hits = (
            edges.join(known, "instance")
            .groupBy("pattern", "kind")
            .agg(F.count("*").alias("known"))
            .filter(F.col("known") >= settings.min_seeds)
        )
        scores = stage(
            hits.join(totals, "pattern")
            .select("pattern", "kind", (F.col("known") / (F.col("n") + 0.5)).alias("score"))
            .filter(F.col("score") >= settings.min_pattern),
            "pii-patterns",
        )
        # a string is likelier personal data the more good patterns precede it
        reached = (
            edges.join(scores, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("p"))
            .filter(F.col("p") >= settings.min_instance)
            .select("instance", "kind")
        )
        known = stage(
            known.unionByName(reached).groupBy("instance").agg(F.min("kind").alias("kind")),
            "pii-known",
        )
        # strings are only added and kinds only go down, so equal counts mean that nothing changed
        now = sizes()
        if now == before:
            return scores
        before = now


def personal_data(
    docs: DataFrame, text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Documents with personal data: ``doc_id, text_key, base, more``.

    ``base`` and ``more`` are arrays of ``start, rank, kind, end`` in order; ``more`` has what
    the contexts found and no base span overlaps.
    """
    found = stage(matches(docs, text), "pii-matches")
    scores = learned_patterns(found, settings)
    best = scores.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("of"))
    rank = F.coalesce(
        *[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)], F.lit(len(KINDS))
    )
    by_form = found.filter("valid").select("doc_id", "text_key", "start", "end", "kind")
    by_context = (
        found.filter("kind = 'candidate'")
        .join(best, "pattern")
        .select("doc_id", "text_key", "start", "end", F.concat(F.lit("ctx_"), "of").alias("kind"))
    )
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    per_doc = (
        by_form.withColumn("form", F.lit(True))
        .unionByName(by_context.withColumn("form", F.lit(False)))
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("form"), span))).alias("base"),
            F.array_sort(F.collect_set(F.when(~F.col("form"), span))).alias("more"),
        )
    )
    free = F.filter(
        "more",
        lambda m: ~F.exists(
            "base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
        ),
    )
    return per_doc.withColumn("more", free)


def shown(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def with_spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of all rows of ``docs`` and their spans ``_base`` and ``_more`` (never null)."""
    found = personal_data(docs, text).select(
        F.col("doc_id").alias("_doc_id"),
        F.col("text_key").alias("_found_key"),
        F.col("base").alias("_base"),
        F.col("more").alias("_more"),
    )
    none = F.array().cast(found.schema["_base"].dataType)
    joined = docs.select(*keep, text_key(F.col(text)).alias("_text_key")).join(
        found,
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text_key") == F.col("_found_key")),
        "left",
    )
    return joined.select(
        *keep,
        F.coalesce("_base", none).alias("_base"),
        F.coalesce("_more", none).alias("_more"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping ones merge."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        to = s["end"].cast("int")
        begin = s["start"].cast("int")
        gap = F.substring(text, acc["at"] + 1, begin - acc["at"])
        more = F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], to).alias("at"),
            F.when(begin >= acc["at"], more).otherwise(acc["out"]).alias("out"),
        )

    joined = F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, joined).otherwise(text)
