"""The corpus pipeline: rules, near duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and its result is written and read back as the next
stage's docs. All but the last return the columns of documents. Texts that a stage changes
get their new length in n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from reviewlens.llm.native import table
from reviewlens.llm.row_places import with_ids
from reviewlens.session import stage

#: Learned rules, tokenizer ids and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _packed_rows(docs: DataFrame) -> Column:
    """All columns in one, so that no name of theirs meets one that a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    stats = stage(quality_rules.statistics(docs, F.col("text"), [_packed_rows(docs)]), "quality-statistics")
    named = stats.select(F.col("_row.doc_id").alias("doc_id"), "stats")
    rules = quality_rules.learn_from(named, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(stats, rules).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the texts with the smallest id, which rows
    without an id come after. Rows of one id with texts that are no duplicates all stay, and so
    do rows without words."""
    found = stage(
        jaccard_join.near_duplicates(docs.select("doc_id", "text"))
        .filter("class is not null")
        .select("doc_id", "class", "component_id", "component_class"),
        "classes",
    )
    own = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("class") == F.col("component_class"))
    firsts = found.filter(own).select(F.col("doc_id").alias("first"), F.col("class").alias("first_class")).distinct()
    # only rows that share an id need their text to tell them apart
    shared = stage(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null"), "shared-ids")
    shared = shared.select(F.col("doc_id").alias("shared"))
    alone = firsts.join(shared, F.col("first").eqNullSafe(F.col("shared")), "left_anti")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("_text"), _packed_rows(docs))
    worded = F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own_rows = with_ids(docs, alone.select("first"))
    kept = own_rows.select(F.col("text").alias("_text"), _packed_rows(docs)).filter(worded).select("_row")
    among = rows.filter(worded).join(shared, F.col("id").eqNullSafe(F.col("shared")), "left_semi")
    among = among.withColumn("class", jaccard_join.text_class(F.col("_text")))
    same = F.col("id").eqNullSafe(F.col("first")) & (F.col("class") == F.col("first_class"))
    among = among.join(firsts, same, "left_semi").dropDuplicates(["id", "class"]).select("_row")
    return kept.unionByName(among).unionByName(rows.filter(~worded).select("_row")).select("_row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")
    )
    # written, so that the planner knows its size before it would shuffle the texts
    bad = stage(bad.distinct(), "contaminated")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        decontaminate.text_key(F.col("text")).alias("key"),
        _packed_rows(docs),
    )
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key"))
    return rows.join(bad, same, "left_anti").select("_row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    possible = pii.has_candidates(F.col("text"))
    rows = docs.filter(possible).select("doc_id", "text", _packed_rows(docs))
    found = pii.with_spans(rows, ["doc_id", "text", "_row"])
    text = pii.masked(F.col("text"), F.array_sort(F.concat("_base", "_more")))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    masked = found.select(row.alias("_row")).select("_row.*")
    return masked.unionByName(docs.filter(~possible))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
