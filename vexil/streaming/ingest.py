"""Streaming ingest and periodic jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import LOG_SCHEMA, Store
from ..sources.vectors import SCHEMA


def read_ndjson(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A record a line; a malformed line fails its batch, and batches before it stay committed."""
    return spark.readStream.schema(SCHEMA).option("mode", "FAILFAST").option("maxFilesPerTrigger", files).json(path)


def ingest(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch as one commit. A batch that is retried after its commit is an upsert of the same rows, so the state is the same."""
    return records.writeStream.foreachBatch(lambda df, _: store.upsert(df) if df.limit(1).count() else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, log_path: str, files: int = 1) -> DataFrame:
    """Changes as they are appended to a folder of a log."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(log_path)


def replicate(changes: DataFrame, target: Store, checkpoint: str, after: int = 0) -> StreamingQuery:
    """Apply a followed log to another store: every change of every kind, in the order of offsets; those up to ``after`` are skipped.

    A batch that is retried after its commit is appended again; the same changes in the same order leave the same state.
    """
    apply = lambda df, _: target.append_log(df.where(F.col("offset") > after).dropDuplicates(["offset", "id"]))
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retrain_when_drifted(records: DataFrame, score: Callable[[DataFrame], DataFrame], retrain: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """After each batch, ``retrain(batch)`` if ``score(batch)`` says needs_retrain."""

    def run(df: DataFrame, _: int) -> None:
        row = score(df).first()
        if row is not None and row["needs_retrain"]:
            retrain(df)

    out = records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
