"""Operator 13: how far the sources of a language diverge, after equal texts are collapsed.

Equal texts of a language are grouped with the number of copies in each source, so each is
tokenized once: its counts are added for every source by the copies there, and its document
frequency by all copies. Counts are merged inside a task before they are sent on by term. Terms
in few documents are dropped where a term's rows meet, and smoothed shares are worked out in
decimals, so no digit is lost.

Pairs of sources are compared sparsely. With a and b the shares of terms that a source lacks,
the sum over all kept terms of abs(p - q) is V abs(a - b), plus for each side what its own terms
add to that, plus for terms of both what they add beyond. Own terms are summed for all other
sources at once from sorted shares; only terms of both sides are visited in pairs. This runs in cells
of a block of terms with two tiles of sources, whose sums are added up.

Defined cases: null text, lang and source are read as ''; a source without terms counts as a
group with all counts 0; a language without kept terms has pairs of value 0 and no terms;
repeated rows count as copies; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import stage

#: Bytes that end a term become blanks and A-Z become a-z; bytes of other characters stay.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    least_documents: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    terms: int = 50
    #: Entries that a task holds before it sends them on.
    held: int = 400_000
    block_terms: int = 4096
    tile: int = 256


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lowered, and all characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, text, copies``: each distinct text of a language with its number in each source."""
    read = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    ).filter("text <> ''")
    keyed = read.withColumn("key", F.unhex(F.sha2("text", 256)))
    copies = (
        keyed.groupBy("lang", "key", "source")
        .agg(F.count("*").alias("n"))
        .groupBy("lang", "key")
        .agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    )
    texts = keyed.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "key"]).select("lang", "text", "copies")


def counted(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, term, source, n, documents`` of ``collapsed`` texts; a key may have several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in held.items():
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()),
                        pa.array(list(n), pa.binary()).cast(pa.string()),
                        pa.array([source] * size, pa.string()),
                        pa.array(list(n.values()), pa.int64()),
                        pa.array([documents[t] for t in n], pa.int64()),
                    ],
                    names=["lang", "term", "source", "n", "documents"],
                )
            held.clear()

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for row in range(batch.num_rows):
                lang = batch.column(0)[row].as_py()
                found = Counter(terms_of(texts[row].as_py()))
                for copy in batch.column(2)[row].as_py():
                    n, documents = held.setdefault((lang, copy["source"]), (Counter(), Counter()))
                    k = copy["n"]
                    if k == 1:
                        n.update(found)
                        documents.update(found.keys())
                    else:
                        n.update({t: c * k for t, c in found.items()})
                        documents.update(dict.fromkeys(found, k))
                if row % 64 == 63 and sum(len(n) for n, _ in held.values()) > settings.held:
                    yield from sent()
        yield from sent()

    return texts.mapInArrow(count, "lang string, term string, source string, n long, documents long")


def kept_counts(counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, term, source, n`` of the terms in enough documents of their language, written."""
    # tasks have merged their rows already; all that follows needs a term's rows together
    merged = (
        counts.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )
    of_term = merged.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    kept = of_term.filter(F.col("documents") >= settings.least_documents)
    return stage(kept.select("lang", "term", F.inline("sources")), "source-counts")


def share(count: Column, settings: Settings) -> Column:
    """1 + floor(scale * (count + smoothing) / (all_terms + smoothing * kinds)), exactly."""
    up = (count + settings.smoothing).cast("decimal(20,0)") * F.lit(settings.scale).cast("decimal(10,0)")
    down = (F.col("all_terms") + settings.smoothing * F.col("kinds")).cast("decimal(20,0)")
    # in decimals, as the product may pass 64 bits
    return F.when(down > 0, 1 + F.call_function("div", up, down)).cast("long")


def groups(docs: DataFrame, kept: DataFrame, settings: Settings) -> DataFrame:
    """``lang, source, all_terms, kinds, none`` of every occurring group; ``none`` is the share of a missing term.
    Written with ``place``, the number of the source within its language."""
    occurring = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    ).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("all_terms"))
    of_lang = kept.groupBy("lang").agg(F.count_distinct("term").alias("kinds"))
    zero = F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return stage(
        occurring.join(totals, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .select("lang", "source", F.coalesce("all_terms", zero).alias("all_terms"), F.coalesce("kinds", zero).alias("kinds"))
        .withColumn("none", F.coalesce(share(zero, settings), zero))
        .withColumn("place", place.cast("long")),
        "source-groups",
    )


def cell_sums(
    terms: np.ndarray, places: np.ndarray, shares: np.ndarray, left: dict[int, int], right: dict[int, int]
) -> np.ndarray:
    """For the sources of ``left`` and ``right`` (place to the share of a missing term) what the
    given terms add to abs(a - b) for each of them, summed."""
    rows, columns = np.array(list(left), int), np.array(list(right), int)
    a, b = np.array(list(left.values()), np.int64), np.array(list(right.values()), np.int64)
    gap = np.abs(a[:, None] - b[None, :])
    out = np.zeros(gap.shape, np.int64)

    def own(side: np.ndarray, others: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        sums = np.zeros(gaps.shape, np.int64)
        for k, place in enumerate(side):
            p = np.sort(shares[places == place])
            before = np.concatenate([[0], np.cumsum(p)])
            below = np.searchsorted(p, others)
            above = before[-1] - before[below] - (len(p) - below) * others
            sums[k] = above + below * others - before[below] - len(p) * gaps[k]
        return sums

    out += own(rows, b, gap)
    out += own(columns, a, gap.T).T
    at_row, at_column = ({p: k for k, p in enumerate(side)} for side in (rows.tolist(), columns.tolist()))
    order = np.argsort(terms, kind="stable")
    edges = np.flatnonzero(np.diff(terms[order])) + 1
    for of_term in np.split(order, edges) if len(order) else []:
        i = [k for k in of_term.tolist() if places[k] in at_row]
        j = [k for k in of_term.tolist() if places[k] in at_column]
        r, c = [at_row[places[k]] for k in i], [at_column[places[k]] for k in j]
        p, q = shares[i][:, None], shares[j][None, :]
        both = np.abs(p - q) - np.abs(p - b[c][None, :]) - np.abs(a[r][:, None] - q) + gap[np.ix_(r, c)]
        out[np.ix_(r, c)] += both
    return out


CELL = ["lang", "block", "left", "right"]


def pair_sums(shares: DataFrame, groups: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, a, b, extra`` for places a < b of a language: what kept terms add to kinds * abs(a - b).

    ``shares``: lang, term, place, p. ``groups``: lang, place, none, kinds and others.
    """
    tile = F.floor(F.col("place") / settings.tile).cast("long")
    tiles = groups.groupBy("lang").agg((F.max(tile) + 1).alias("tiles"), F.max("kinds").alias("kinds"))
    tiles = stage(tiles.filter("kinds > 0"), "source-tiles")

    def spread(rows: DataFrame) -> DataFrame:
        """Rows with the cells (left, right) that their source's tile takes part in."""
        every = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
        cells = F.transform(
            every, lambda t: F.struct(F.least(t, tile).alias("left"), F.greatest(t, tile).alias("right"))
        )
        return rows.withColumn("cell", F.explode(cells)).select(*rows.columns, "cell.*")

    blocks = F.ceil(F.col("kinds") / settings.block_terms).cast("long")
    block = F.pmod(F.xxhash64("term"), blocks)
    rows = shares.join(tiles, "lang").withColumn("block", block)
    rows = spread(rows).select(*CELL, F.xxhash64("term").alias("term"), "place", "p")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    sources = spread(groups.drop("kinds").join(tiles, "lang").withColumn("block", numbers)).select(*CELL, "place", "none")

    def work(key: tuple, found: pa.Table, members: pa.Table) -> pa.Table:
        lang, _, first, second = (k.as_py() for k in key)
        none = dict(zip(members["place"].to_pylist(), members["none"].to_pylist()))
        left, right = (
            {p: v for p, v in none.items() if p // settings.tile == t} for t in (first, second)
        )
        sums = cell_sums(*[found[c].to_numpy() for c in ("term", "place", "p")], left, right)
        i, j = np.array(list(left), np.int64), np.array(list(right), np.int64)
        a, b = (m.ravel() for m in np.meshgrid(i, j, indexing="ij"))
        use = a < b
        extra = sums.ravel()[use]
        return pa.table(
            [pa.array([lang] * len(extra), pa.string()), pa.array(a[use]), pa.array(b[use]), pa.array(extra)],
            names=["lang", "a", "b", "extra"],
        )

    parts = rows.groupBy(*CELL).cogroup(sources.groupBy(*CELL)).applyInArrow(
        work, "lang string, a long, b long, extra long"
    )
    return parts.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (text, lang, source)."""
    kept = kept_counts(counted(collapsed(docs), settings), settings)
    every = groups(docs, kept, settings)
    with_share = stage(
        kept.join(every.select("lang", "source", "place", "all_terms", "kinds"), ["lang", "source"])
        .withColumn("p", share(F.col("n"), settings))
        .drop("all_terms", "kinds"),
        "source-shares",
    )
    sums = pair_sums(with_share.select("lang", "term", "place", "p"), every, settings)
    both = sums.unionByName(
        sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra")
    )
    one, other = (
        every.select("lang", F.col("place").alias(p), F.col("source").alias(s), F.col("none").alias(n), "kinds")
        for p, s, n in (("a", "source", "none_a"), ("b", "item", "none_b"))
    )
    # the result has a row for each pair of a language's sources, so this join makes no more
    pairs = one.join(other.drop("kinds"), "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    value = F.col("kinds") * F.abs(F.col("none_a") - F.col("none_b")) + F.coalesce("extra", F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    # a language's own shares, over all its sources
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    size = every.groupBy("lang").agg(F.sum("all_terms").alias("all_terms"), F.max("kinds").alias("kinds"))
    usual = of_lang.join(size, "lang").select("lang", "term", share(F.col("n"), settings).alias("q"))
    terms = (
        with_share.join(usual, ["lang", "term"])
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.terms)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
