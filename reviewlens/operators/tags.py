"""Feature tags and hot tags of every product."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens.session import stage

TAG = ["pId", "tFeature", "tSentiment", "tRate", "tIsPos", "tCount", "tCommentCount"]


def display_word() -> Column:
    """The sentiment as shown, with its negation in front."""
    return F.concat(F.coalesce(F.col("neg_adv.cont"), F.lit("")), F.col("sentiment.cont"))


def _keyed(degrees: DataFrame) -> DataFrame:
    return degrees.select(
        "pId",
        "cId",
        F.col("feature.cont").alias("tFeature"),
        display_word().alias("word"),
        (F.col("deg_value") > 0).alias("good"),
    )


def _word_counts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("pId", "tFeature", "good", "word").agg(F.count(F.lit(1)).alias("n"))


def feature_tags(degrees: DataFrame, features: DataFrame) -> DataFrame:
    """One tag per product feature: rate, dominant word, counts.

    ``degrees`` are opinions of degree other than 0. They are counted per word first, so a
    feature that fills much of the table is only a few counted rows when it is grouped.
    """
    keyed = _keyed(degrees)
    comments = keyed.groupBy("pId", "tFeature").agg(
        F.countDistinct("cId").alias("tCommentCount")
    )
    return _tags(_word_counts(keyed), comments, features)


@dataclass(frozen=True)
class TagCounts:
    """What the tags of a delivery are made of: counted words, and the comments of each feature as
    bitmaps over their dense ids. Both merge with those of other deliveries."""

    words: DataFrame
    comments: DataFrame


def tag_counts(degrees: DataFrame) -> TagCounts:
    """The counts of one delivery as tables. ``degrees`` are opinions of degree other than 0."""
    keyed = _keyed(degrees)
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position("cId")).alias("bitmap")
    comments = keyed.groupBy("pId", "tFeature", F.bitmap_bucket_number("cId").alias("bucket")).agg(bitmap)
    return TagCounts(stage(_word_counts(keyed), "tag-words"), stage(comments, "tag-comments"))


def merged_counts(*parts: TagCounts) -> TagCounts:
    """The counts of all deliveries together; a comment that several have counts once."""
    words = reduce(DataFrame.unionByName, [p.words for p in parts])
    comments = reduce(DataFrame.unionByName, [p.comments for p in parts])
    return TagCounts(
        words.groupBy("pId", "tFeature", "good", "word").agg(F.sum("n").alias("n")),
        comments.groupBy("pId", "tFeature", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")),
    )


def tags_of_counts(counts: TagCounts, features: DataFrame) -> DataFrame:
    """The tags as ``feature_tags`` has them."""
    comments = counts.comments.groupBy("pId", "tFeature").agg(
        F.sum(F.bitmap_count("bitmap")).alias("tCommentCount")
    )
    return _tags(counts.words, comments, features)


def _tags(words: DataFrame, comments: DataFrame, features: DataFrame) -> DataFrame:
    good, n = F.col("good"), F.col("n")
    most_frequent = F.struct(-n, F.col("word"))
    sides = words.groupBy("pId", "tFeature").agg(
        F.sum("n").alias("tCount"),
        F.sum(F.when(good, n).otherwise(0)).alias("good_count"),
        F.min(F.when(good, most_frequent))["word"].alias("good_word"),
        F.min(F.when(~good, most_frequent))["word"].alias("bad_word"),
    )
    rate = F.col("good_count") / F.col("tCount")
    return (
        sides.join(comments, ["pId", "tFeature"])
        .join(
            features.select("pId", F.col("name").alias("tFeature"), "freq"), ["pId", "tFeature"]
        )
        .withColumn("tIsPos", rate >= 0.5)
        .withColumn("tRate", F.when(rate >= 0.5, rate).otherwise(1 - rate))
        .withColumn(
            "tSentiment", F.when(F.col("tIsPos"), F.col("good_word")).otherwise(F.col("bad_word"))
        )
        .select(*TAG, "freq")
    )


def tag_comments(degrees: DataFrame, features: DataFrame) -> DataFrame:
    """The comments behind each tag, one row per side.

    A popular feature has no bound on its comments, so they are rows and not a list.
    """
    names = features.select("pId", F.col("name").alias("tFeature"))
    return (
        degrees.select(
            "pId",
            F.col("feature.cont").alias("tFeature"),
            (F.col("deg_value") > 0).alias("tIsGood"),
            "cId",
        )
        .distinct()
        .join(names, ["pId", "tFeature"], "left_semi")
    )


def hot_tags(tags: DataFrame, limit: int = fixed.HOT_TAGS) -> DataFrame:
    """Tags counted more often than the mean of their side, the best ``limit`` of each."""
    tags = stage(tags, "tags")
    side = ["pId", "tIsPos"]
    means = tags.groupBy(*side).agg(F.avg("tCount").alias("mean"))
    order = Window.partitionBy(*side).orderBy(
        F.desc("tRate"), F.desc("freq"), F.asc("tFeature")
    )
    return (
        tags.join(means, side)
        .filter(F.col("tCount") > F.col("mean"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .drop("mean")
    )
