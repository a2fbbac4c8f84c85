"""Polarity of words, opinions and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.nested import rows_of


def word_polarity(lexicon: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Polarity of every word that has one.

    A word of the lexicon has its own polarity, negative when it is in both lists. Any other
    word takes that of the first word of its synonym group found in the lexicon.
    """
    own = lexicon.filter(F.col("word") != "").groupBy("word").agg(
        F.min("polarity").alias("polarity")
    )
    group_polarity = (
        synonyms.join(own, "word").groupBy("grp").agg(F.min_by("polarity", "pos").alias("polarity"))
    )
    borrowed = (
        synonyms.filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.min("grp").alias("grp"))
        .join(group_polarity, "grp")
        .select("word", "polarity")
        .join(own, "word", "left_anti")
    )
    return own.unionByName(borrowed)


def tuple_degree(polarity: Column, neg_adv: Column) -> Column:
    """Polarity, turned round by a negation; 0 for an unknown word (E5)."""
    return (F.coalesce(polarity, F.lit(0)) * F.when(neg_adv.isNull(), 1).otherwise(-1)).cast("int")


def score_tuples(tuples: DataFrame, polarity: DataFrame) -> DataFrame:
    """Opinions with ``deg_value`` (E5). The dictionary joins without a hint: the planner
    broadcasts it while its measured size allows and shuffles beyond that (E7)."""
    words = polarity.select(F.col("word").alias("_word"), F.col("polarity").alias("_polarity"))
    return (
        tuples.join(words, F.col("sentiment.cont") == F.col("_word"), "left")
        .withColumn("deg_value", tuple_degree(F.col("_polarity"), F.col("neg_adv")))
        .drop("_word", "_polarity")
    )


def comment_degrees(degrees: DataFrame) -> DataFrame:
    """Mean degree of each comment; opinions of degree 0 count."""
    return degrees.groupBy("pId", "cId").agg(
        (F.sum("deg_value") / F.count(F.lit(1))).alias("cDegValue")
    )


def nest_degrees(degrees: DataFrame) -> DataFrame:
    """One row per comment with its score and its scored opinions by clause."""
    one = F.struct(
        "pairNo",
        F.struct(
            "feature",
            "sentiment",
            F.col("neg_adv").alias("negAdv"),
            "relate",
            F.col("deg_value").alias("degValue"),
        ).alias("d"),
    )
    return (
        degrees.repartition("pId", "cId")
        .groupBy("pId", "cId", "sId")
        .agg(
            F.sort_array(F.collect_list(one)).getField("d").alias("sDegrees"),
            F.sum("deg_value").alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
        .groupBy("pId", "cId")
        .agg(
            (F.sum("total") / F.sum("n")).alias("cDegValue"),
            F.sort_array(F.collect_list(F.struct("sId", "sDegrees"))).alias("cDegrees"),
        )
    )


def flat_degrees(nested: DataFrame) -> DataFrame:
    """The nested form as rows."""
    return (
        rows_of(nested, "cDegrees", "s", "pId", "cId")
        .select("pId", "cId", "s.sId", F.inline("s.sDegrees"))
        .withColumnsRenamed({"negAdv": "neg_adv", "degValue": "deg_value"})
    )


def polar(degrees: DataFrame) -> DataFrame:
    """Without the opinions of degree 0."""
    return degrees.filter(F.col("deg_value") != 0)
