"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "reviewlens", **settings: str) -> SparkSession:
    """A session with the settings the jobs are planned for; a cluster's own settings win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the checkpoint
    folder of the context, else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs then depend on files and not on executors, and the planner sees the real
    size of the table when it chooses a join.
    """
    return staged(df, name, **options)[0]


def staged(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``stage`` for a table that its maker drops again: the table and its folder."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs meanwhile go when it ends, not when the driver collects them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(spark: SparkSession, name: str, path: str) -> None:
    """Forget a table that was written to a path of its own, and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop_folder(spark, path)
