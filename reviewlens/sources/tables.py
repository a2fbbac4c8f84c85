"""Stage tables: scans, sinks and nested columns kept as JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str
) -> DataFrame:
    """Scan of a stored collection; any connector on the class path can be named as ``fmt``."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    df.write.format(fmt).mode("overwrite").options(**options).save(path)


def append_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    **options: str,
) -> None:
    """Add rows to a collection that several products share."""
    df.write.format(fmt).mode("append").options(**options).partitionBy(*partition_by).save(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Write rows in place of those in the same partitions; other partitions stay.

    A delivery that is written again replaces itself, so nothing is there twice.
    """
    writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).save(path)


def json_text(column: str | Column) -> Column:
    """A nested column as JSON text, for export."""
    return F.to_json(column)


def with_json_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: json_text(c) for c in columns})


def from_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text back to its declared type; the store's own row id is dropped."""
    return df.withColumn(column, F.from_json(column, schema)).drop("_id")
