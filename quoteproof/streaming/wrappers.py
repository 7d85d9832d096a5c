"""Incremental runs: the batch operators inside Structured Streaming, idempotent by a ledger."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteproof.sources.ledger import Ledger


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _drain(stream: DataFrame, each, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _run(checkpoint: str) -> str:
    """Names a query by its checkpoint, so that two queries' batches of one number are two."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def run_into(stream: DataFrame, transform, checkpoint: str, results: str, key: str) -> None:
    """Drain what is there into a table, exactly once: a batch is one folder, which a repeat of it overwrites, and its keys
    are those that the table's ledger (hidden in the results' folder) does not have yet."""
    run = _run(checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        folder = f"{results}/run={run}/batch_id={batch_id}"
        keys(batch, f"{results}/_ledger", key).append_batch(batch, run, batch_id, lambda new: transform(new).write.mode("overwrite").parquet(folder))

    _drain(stream, each, checkpoint)


def run_once(stream: DataFrame, handle, checkpoint: str, ledger: str, key: str) -> None:
    """Drain what is there into an outward sink: ``handle(rows, batch_id)`` gets the keys that the ledger lacks, then they are
    noted. After a crash between the two a batch is handled again, so the sink must be idempotent by the key."""
    run = _run(checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        keys(batch, ledger, key).append_batch(batch, run, batch_id, lambda new: handle(new, batch_id))

    _drain(stream, each, checkpoint)


def keys(batch: DataFrame, folder: str, key: str) -> Ledger:
    """The ledger of the keys done; a batch reads only the buckets that its keys fall into."""
    return Ledger(batch.sparkSession, folder, batch.select(key).schema, key)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and window; state older than the watermark is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("events"))
