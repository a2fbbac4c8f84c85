"""Totals and summary document of every product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.operators.tags import TAG


def product_totals(comment_degrees: DataFrame) -> DataFrame:
    """Scored comments, good comments and their share."""
    good = F.col("cDegValue") > fixed.GOOD_DEGREE
    return (
        comment_degrees.groupBy("pId")
        .agg(
            F.count(F.lit(1)).alias("identifiedCount"),
            F.count_if(good).alias("goodCount"),
        )
        .withColumn("goodRate", F.col("goodCount") / F.col("identifiedCount"))
    )


def product_summary(totals: DataFrame, hot: DataFrame) -> DataFrame:
    """One row per product with its hot tags in rank order.

    Each list holds at most the hot-tag limit, so a product's row stays small.
    """
    tag = F.struct("rank", F.struct(*TAG[1:]).alias("tag"))

    def side(is_pos: bool) -> Column:
        chosen = F.collect_list(F.when(F.col("tIsPos") == is_pos, tag))
        return F.sort_array(chosen).getField("tag")

    lists = hot.groupBy("pId").agg(
        side(True).alias("hotPosTagStatistics"), side(False).alias("hotNegTagStatistics")
    )
    summary = F.struct("identifiedCount", "goodCount", "goodRate")
    return totals.join(lists, "pId", "left").select(
        "pId",
        F.coalesce("hotPosTagStatistics", F.array()).alias("hotPosTagStatistics"),
        F.coalesce("hotNegTagStatistics", F.array()).alias("hotNegTagStatistics"),
        summary.alias("productCommentSummary"),
    )
