"""Incremental ingest of new task results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlens import schemas
from reviewlens.functions.text import newlines_marked
from reviewlens.operators.comments import flatten_results, purge

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RESULTS = f"{schemas.RAW_COMMENTS}, fetched_at timestamp"


def result_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RESULTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def clean_comments(results: DataFrame) -> DataFrame:
    """Page results to clean comments; the same code serves batch and stream."""
    rows = flatten_results(results)
    return purge(rows.withColumn("content", newlines_marked(F.col("content"))))


def start_ingest(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the clean comments of all files present, each task result once, then stop.

    The ids seen are keyed state, kept on disk beside ``checkpoint`` and never given up, so no
    row is late however old it is, and a batch looks up its own ids and reads nothing of what
    came before. Every batch writes a folder of its own; one that is run again replaces it.
    """
    spark = results.sparkSession
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        clean_comments(batch).write.mode("overwrite").parquet(f"{out}/batch={run}-{number}")

    writer = (
        results.dropDuplicates(["_id"])
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # the query copies the session's settings as it starts
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ON_DISK)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
