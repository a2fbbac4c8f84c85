"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import (
    decontaminate,
    exact_search,
    hard_negatives,
    jaccard_join,
    licenses,
    packing,
    pii,
    quality_model,
    quality_rules,
    source_audit,
    suffix_tree,
    token_files,
    toxicity,
)
from reviewlens.llm.native import table
from reviewlens.llm.oracle import ORACLE  # noqa: F401
from reviewlens.session import stage


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = stage(
        quality_rules.statistics(docs, F.col("text"), [F.col("doc_id")]), "quality-statistics"
    )
    judged = quality_rules.judged(stats, table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id",
        *[F.col(f"stats.{c}").alias(c) for c in counts],
        "base_failed",
        "kept",
        "rule",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    every = F.array_sort(F.concat("_base", "_more"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.shown(F.col("_base")), 256).alias("base_sha256"),
        pii.shown(every).alias("spans"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read(spark, token_files.write(docs))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "n_links", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    )
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.score_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    )
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), moved)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_quality_model": op3_quality_model,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_packing": op5_packing,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_files": op7_token_files,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_exact_search": op11_exact_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_audit": op13_source_audit,
}
