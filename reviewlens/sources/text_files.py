"""Plain text: word lists and rated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def rated_lines(comments: DataFrame, rating: str, text: str) -> DataFrame:
    """``rating<tab>text`` per comment; blanks round the text go, line breaks become blanks."""
    one_line = F.regexp_replace(F.trim(text), "[\r\n]+", " ")
    return comments.select(F.concat_ws("\t", F.col(rating).cast("string"), one_line).alias("value"))
