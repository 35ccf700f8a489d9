"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: A word is a longest run of characters other than blank and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Cut lineage: a table written to the shared folder and read back.
cut = written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python; a batch lies in both processes at once, as Arrow and as objects.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH bytes as well as by rows, unless the session sets a bound. Long texts then need no more memory than short ones."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(BATCH))


def free(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs; they are unreachable by then but wait for a JVM collection."""
    spark.sparkContext._jvm.System.gc()


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def utf8_hash(text: str = "text") -> Column:
    return F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256)
