"""From task results to clean comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed
from reviewlens import schemas
from reviewlens.functions import text
from reviewlens.session import stage

_ROW_BITS = (1 << 33) - 1


def successful(raw: DataFrame) -> DataFrame:
    """Task results that succeeded and hold something (B1)."""
    return raw.filter((F.col("status") == "SUCCESS") & (F.col("result") != "false"))


def flatten_results(raw: DataFrame) -> DataFrame:
    """One row per comment of each page, with its place in the page."""
    keys = [c for c in raw.columns if c not in ("status", "result")]
    comments = F.from_json("result", schemas.COMMENT_LIST)
    return (
        successful(raw)
        .select(*keys, F.posexplode(comments).alias("pos", "c"))
        .select(*keys, "pos", "c.*")
    )


def dense_ids(df: DataFrame, order_by: Sequence[str], name: str = "cId", start: int = 0) -> DataFrame:
    """Number the rows start, start + 1, ... in the given order.

    The rows are range-partitioned and written once; a row's number is its place in its
    partition plus the sizes of the partitions before. Only one size per partition is ever
    brought together. ``order_by`` should be unique for a repeatable numbering.
    """
    placed = stage(
        df.sort(*order_by).withColumns(
            {
                "_part": F.spark_partition_id(),
                "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
            }
        ),
        "ordered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_row") + start)
        .drop("_part", "_row", "_before")
    )


class Counter:
    """Numbers that go on from one delivery to the next, kept as a small table."""

    _SCHEMA = "delivery string, first bigint, n bigint"

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        # so that the table exists before the first delivery
        spark.createDataFrame([], self._SCHEMA).write.mode("append").parquet(path)

    def take(self, delivery: str, n: int) -> int:
        """The first of ``n`` numbers for ``delivery``; the same ones when it is run again."""
        taken = self._spark.read.schema(self._SCHEMA).parquet(self._path)
        found = taken.agg(
            F.max(F.when(F.col("delivery") == delivery, F.struct("first", "n"))).alias("own"),
            F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0)).alias("next"),
        ).first()
        if found["own"] and found["own"]["n"] == n:
            return found["own"]["first"]
        row = [(delivery, found["next"], n)]
        self._spark.createDataFrame(row, self._SCHEMA).write.mode("append").parquet(self._path)
        return found["next"]


def counter_ids(df: DataFrame, counter: Counter, delivery: str, name: str = "cId") -> DataFrame:
    """Number the rows of a delivery without gaps, in the order in which they are stored.

    The rows are written once as they come. A row's number is its place in its file plus the
    rows of the files before, so only the counts of the files are brought together and no row
    is sorted or shuffled.
    """
    placed = stage(df, "delivery").select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sizes = stage(placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")), "file-sizes")
    first = counter.take(delivery, sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row for each file that was written
    numbered = placed.join(F.broadcast(offsets), "_file")
    return numbered.withColumn(name, F.col("_before") + F.col("_row") + first).drop("_file", "_row", "_before")


def format_comments(raw: DataFrame, product_id: Column, order_by: Sequence[str]) -> DataFrame:
    """Numbered comments of one product, as in ``schemas.COMMENTS``."""
    numbered = dense_ids(flatten_results(raw), order_by)
    return numbered.select(product_id.cast("long").alias("pId"), "cId", "content", "score")


def repeats_too_much(content: Column, tokenize: text.Tokenizer = text.tokens_precise) -> Column:
    """More than half of the tokens are repetitions."""
    return text.repeat_ratio(tokenize(content)) > fixed.MAX_REPEAT_RATIO


def is_clean(
    content: Column,
    tokenize: text.Tokenizer = text.tokens_precise,
    check_elements: bool = False,
) -> Column:
    """All purge rules on one text, the cheap ones first."""
    clean = text.length_between(content, fixed.CONTENT_LENGTH) & ~text.has_url(content)
    if check_elements:
        clean = clean & text.has_letters_beyond_ascii(content)
    return clean & ~repeats_too_much(content, tokenize)


def purge(
    comments: DataFrame,
    tokenize: text.Tokenizer = text.tokens_precise,
    check_elements: bool = False,
) -> DataFrame:
    """Comments without noise."""
    return comments.filter(is_clean(F.col("content"), tokenize, check_elements))
