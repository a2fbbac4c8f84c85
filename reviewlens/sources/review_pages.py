"""Review pages wrapped in a script callback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import schemas
from reviewlens.functions.text import newlines_marked


_CHARSETS = "spark.sql.legacy.javaCharsets"


def _with_charsets(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that need character sets beyond the Unicode ones. Which sets are allowed
    is settled as the columns are added, so the session's setting is put back at once."""
    spark = df.sparkSession
    before = spark.conf.get(_CHARSETS)
    spark.conf.set(_CHARSETS, "true")
    try:
        return df.withColumns(columns)
    finally:
        spark.conf.set(_CHARSETS, before)


def decoded(pages: DataFrame, content: str, charset: str = "GBK") -> DataFrame:
    """``pages`` with the bytes of ``content`` as text (A10)."""
    return _with_charsets(pages, {content: F.decode(content, charset)})


def encoded(pages: DataFrame, content: str, charset: str = "GBK") -> DataFrame:
    """``pages`` with the text of ``content`` as bytes."""
    return _with_charsets(pages, {content: F.encode(content, charset)})


def callback_json(page: Column) -> Column:
    """The JSON document between the first opening bracket and the closing one."""
    return F.regexp_extract(page, r"(?s)^[^(]*\((.*)\);?\s*$", 1)


def page_comments(pages: DataFrame, page: str, mark_newlines: bool = True) -> DataFrame:
    """One row per comment of each page: position in the page, content and score."""
    parsed = F.from_json(callback_json(F.col(page)), schemas.REVIEW_PAGE)
    keys = [c for c in pages.columns if c != page]
    rows = pages.select(*keys, F.posexplode(parsed["comments"]).alias("pos", "c")).select(
        *keys, "pos", "c.*"
    )
    if mark_newlines:
        rows = rows.withColumn("content", newlines_marked(F.col("content")))
    return rows
