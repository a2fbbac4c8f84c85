"""Rows of given ids, filtered where they are read, so that no other row is shuffled."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import stage


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids`` (one column; null equals null).

    Ids are joined with the places of their rows alone. What comes back to the rows is one bit
    for each, in blocks of 4 KB for 32,768 rows of a file. Rows that are not read from files have
    no place and are joined as they are.
    """
    own = F.col("doc_id").eqNullSafe(F.col("_chosen"))
    chosen = ids.toDF("_chosen")
    try:
        places = docs.select("doc_id", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return docs.join(chosen, own, "left_semi")
    number = F.col("row_index") + 1
    bits = (
        places.join(chosen, own, "left_semi")
        .groupBy(F.col("file_path").alias("_file"), F.bitmap_bucket_number(number).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    )
    # written, so that the planner knows its size before it would shuffle the rows
    bits = stage(bits, "chosen-places")
    number = F.col("_metadata.row_index") + 1
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("_metadata.file_path").alias("_path"),
        F.bitmap_bucket_number(number).alias("_number"),
        F.bitmap_bit_position(number).cast("int").alias("_bit"),
    )
    byte = F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("_bit") % 8) == 1
    place = (F.col("_path") == F.col("_file")) & (F.col("_number") == F.col("_bucket"))
    return rows.join(bits, place).filter(is_set).select("_row.*")
