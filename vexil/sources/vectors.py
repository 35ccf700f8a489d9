"""Sources of vector records: id string, values array<float>, metadata map<string, string>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, values array<float>, metadata map<string,string>"
MAX_K, MAX_DIM = 100, 4096


def read(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of a Parquet collection; columns and predicates prune in the scan."""
    return spark.read.schema(SCHEMA).parquet(path)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's embeddings as vectors, with label, lang and source as columns (promoted metadata, which Parquet filters reach)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.format_string("v-%06d", "vec_id").alias("id"), F.col("embedding").alias("values"), "label")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return e.join(d, "vec_id", "left")


def metadata() -> Column:
    """The promoted columns as a map without nulls."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("label", "lang", "source")])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def generated(spark: SparkSession, n: int, dim: int, prefix: str = "load") -> DataFrame:
    """Synthetic load: ten clusters ten apart, a sine and a sawtooth on top; the prefix shifts all of them."""
    base = float(sum(map(ord, prefix)) % 1000) * 100
    value = lambda i: (F.lit(base) + (F.col("seed") % 10) * 10 + F.sin((F.col("seed") + i).cast("double")) * 0.25 + ((F.col("seed") + i) % 7) / 100).cast("double")
    return spark.range(n).withColumnRenamed("id", "seed").select("seed", F.concat(F.lit(prefix + "-"), F.format_string("%06d", "seed")).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("values"))


def error_code(values: Column, k: Column | int | None = None, max_k: int = MAX_K, max_dim: int = MAX_DIM) -> Column:
    """Name of the first fault of a request, or null."""
    out = F.when(values.isNull() | (F.size(values) == 0), "empty_vector").when(F.size(values) > max_dim, "dimension_too_large")
    if k is not None:
        k = F.lit(k) if isinstance(k, int) else k
        out = out.when(k <= 0, "invalid_k").when(k > max_k, "k_too_large")
    return out
