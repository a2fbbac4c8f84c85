"""Operator 6: benchmark passages in documents, by a prefix-filtered set join.

Every benchmark window (13 consecutive words, or a whole shorter item) is a set of word
shingles. Counts over all documents order the shingles by rarity; a document can only hold a
window if it holds the window's rarest shingle, so documents join on that one alone, and a
window whose rarest shingle occurs nowhere is dropped. The place of the shingle fixes the
place of the window, which has to lie inside the text, and the words there are compared.

Defined cases: null and empty texts have no words and no hits; an item without words has no
window; a benchmark row without an id marks words but is not counted or listed; repeated
items and repeated documents count once and each row gets its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.native import (
    alphanumeric_words,
    covered,
    folded_hash,
    gram_hashes,
    let,
    lower_ascii,
)
from reviewlens.session import stage

WINDOW = 13
SHINGLE = 3
#: A benchmark table of up to so many bytes is broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_BYTES = 64_000_000


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: ``window`` (words joined by a blank), ``len``, ``items`` (ids)."""
    words = F.transform(alphanumeric_words(F.col("text")), lower_ascii)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
    n = F.size("words")
    length = F.least(n, F.lit(size))
    return (
        items.filter(n > 0)
        .select(
            "item",
            "words",
            length.alias("len"),
            F.explode(F.sequence(F.lit(0), n - length)).alias("at"),
        )
        .select(
            "item",
            "len",
            F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ").alias("window"),
        )
        .groupBy("window")
        .agg(F.first("len").alias("len"), F.collect_set("item").alias("items"))
    )


def window_shingles(found: DataFrame) -> DataFrame:
    """A row per window and shingle: ``k`` words at ``offset`` with hash ``h``."""
    hashes = F.transform(F.split("window", " "), folded_hash)
    cut = found.withColumns({"k": F.least(F.col("len"), F.lit(SHINGLE)), "hashes": hashes})
    grams = F.when(F.col("k") == SHINGLE, gram_hashes(F.col("hashes"), SHINGLE))
    for k in range(1, SHINGLE):
        grams = grams.when(F.col("k") == k, gram_hashes(F.col("hashes"), k))
    return cut.select("window", "len", "items", "k", F.posexplode(grams).alias("offset", "h"))


def document_shingles(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (words and other columns) with a row per shingle of ``k`` words.

    The hashes are a column of their own before they become rows: rows are then made in
    generated code, which hands on a reference to the words and copies them for no shingle.
    """
    hashed = docs.withColumn("grams", _grams(k))
    return hashed.select(*docs.columns, F.posexplode_outer("grams").alias("at", "h"))


def _grams(k: int) -> Column:
    return let(F.transform("words", folded_hash), lambda h: gram_hashes(h, k))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _read(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        text_key(F.col(text)).alias("text_key"),
        alphanumeric_words(F.col(text)).alias("words"),
    )


def occurrences(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Places of windows: ``doc_id, text_key, start, end, items``; a place may repeat."""
    shingles = stage(window_shingles(found), "window-shingles")
    sizes = shingles.agg(
        F.sum(F.length("window") + 40 + 20 * F.size("items")).alias("bytes"),
        F.collect_set("k").alias("ks"),
    ).first()
    small = (sizes["bytes"] or 0) <= MAX_BROADCAST_BYTES
    read = _read(docs, text)

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    counts = None
    for k in sizes["ks"] or []:
        known = shingles.filter(F.col("k") == k).select("h").distinct()
        part = (
            document_shingles(read, k)
            .select("h")
            .join(hinted(known), "h")
            .groupBy("h")
            .agg(F.count("*").alias("n"))
            .withColumn("k", F.lit(k))
        )
        counts = part if counts is None else counts.unionByName(part)
    out = None
    if counts is not None:
        frequency = stage(counts, "shingle-counts")
        ranked = shingles.join(hinted(frequency), ["k", "h"], "left").groupBy("window").agg(
            F.min_by(
                F.struct("len", "items", "k", "offset", "h", F.coalesce("n", F.lit(0)).alias("n")),
                F.struct(F.coalesce("n", F.lit(0)), "h", "offset"),
            ).alias("x")
        )
        prefixes = stage(ranked.select("window", "x.*").filter("n > 0"), "window-prefixes")
        for k in sizes["ks"]:
            part = _places(read, prefixes.filter(F.col("k") == k).drop("k", "n"), k, small)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = read.select(
            "doc_id",
            "text_key",
            F.lit(0).alias("start"),
            F.lit(0).alias("end"),
            F.array().cast("array<string>").alias("items"),
        ).limit(0)
    return out


def _places(read: DataFrame, prefixes: DataFrame, k: int, small: bool) -> DataFrame:
    grams = document_shingles(read.withColumn("n_words", F.size("words")), k)
    begin = F.col("at") - F.col("offset")
    if small:
        joined = grams.join(F.broadcast(prefixes), "h")
        words, first = F.col("words"), begin + 1
    else:
        # only the words around the shingle cross the shuffle
        low = F.greatest(F.col("at") - WINDOW, F.lit(0))
        around = grams.withColumn("around", F.slice("words", low + 1, 2 * WINDOW + SHINGLE))
        joined = around.withColumn("low", low).drop("words").join(prefixes, "h")
        words, first = F.col("around"), begin - F.col("low") + 1
    inside = joined.filter((begin >= 0) & (begin + F.col("len") <= F.col("n_words")))
    there = lower_ascii(F.array_join(F.slice(words, first, F.col("len")), " "))
    return inside.filter(there == F.col("window")).select(
        "doc_id", "text_key", begin.alias("start"), (begin + F.col("len")).alias("end"), "items"
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW
) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, items, contaminated`` for every row of ``docs``."""
    places = occurrences(docs, stage(windows(benchmark, size), "windows"), text)
    hits = places.groupBy("doc_id", "text_key").agg(
        covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hits = hits.withColumnsRenamed({"doc_id": "hit_doc_id", "text_key": "hit_text_key"})
    all_docs = _read(docs, text).select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return all_docs.join(
        hits,
        F.col("doc_id").eqNullSafe(F.col("hit_doc_id"))
        & (F.col("text_key") == F.col("hit_text_key")),
        "left",
    ).select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
