"""Shards and segments: stable routing, movement, ownership, merging, route signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.ranges import numbered


def fnv64(text: str) -> int:
    h = K.FNV_HIGH << 32 | K.FNV_LOW
    for b in text.encode():
        h = (h ^ b) * ((1 << 40) + K.FNV_TAIL) & (1 << 64) - 1
    return h


def modulo_shard(id_column: Column, shards: int) -> Column:
    return K.unsigned_mod(K.fnv1a(id_column), shards).cast("int")


def rendezvous_shard(id_column: Column, names: list[str]) -> Column:
    """Index of the shard with the greatest score, the first of ties. Scores are unsigned 64-bit, which only numpy has; Arrow carries the hashes over."""
    hashes = np.array([fnv64(n) for n in names], np.uint64)

    @F.pandas_udf("int")
    def winner(hi: pd.Series, lo: pd.Series) -> pd.Series:
        key = hi.to_numpy(np.uint64) << np.uint64(32) | lo.to_numpy(np.uint64)
        v = (key[:, None] ^ hashes[None, :]) + np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return pd.Series((v ^ (v >> np.uint64(31))).argmax(1).astype(np.int32))

    h = K.fnv1a(id_column)
    return winner(h["hi"], h["lo"])


def movement(before: Column, after: Column, new: int, rows: DataFrame) -> DataFrame:
    """keys, moved, moved_to_new: ids whose shard changes, and those that go to shard ``new``."""
    both = rows.select(before.alias("a"), after.alias("b"))
    moved = F.col("a") != F.col("b")
    return both.agg(F.count(F.lit(1)).alias("keys"), F.count_if(moved).alias("moved"), F.count_if(moved & (F.col("b") == new)).alias("moved_to_new"))


def owned(rows: DataFrame, shard: Column, stored: str = "shard") -> DataFrame:
    """Rows that stand on the shard that owns their id now; stale copies go."""
    return rows.where(F.col(stored) == shard)


def migration_delta(source: DataFrame, target: DataFrame) -> DataFrame:
    """id, side of the records that differ; a migration is done when it is empty."""
    checksum = lambda d, side: d.select("id", record_checksum().alias("sum"), F.lit(side).alias("side"))
    both = checksum(source, "source").unionByName(checksum(target, "target"))
    return both.groupBy("id", "sum").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("side")).where("n = 1").select("id", "side")


def migrated(source: DataFrame, target: DataFrame, delta: DataFrame) -> DataFrame:
    """``target`` after one step of a migration: records of the delta go, and the source's own of them come. A step that is run again changes nothing."""
    ids = delta.select("id").distinct()
    kept = target.join(ids, "id", "left_anti").select("id", "values")
    return kept.unionByName(source.join(ids, "id", "left_semi").select("id", "values"))


def collection_checksum(rows: DataFrame, digits: int = 6) -> DataFrame:
    """records, checksum: a sum of record digests, so that partitions and order don't matter and partial sums add up. Digests of 48 bits overflow a long from 65,536 records on, so decimals add them up."""
    scaled = F.array_join(F.transform(F.col("values"), lambda v: F.round(v.cast("double") * 10**digits, 0).cast("long").cast("string")), ",")
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("id"), scaled).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(28,0)")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.pmod(F.sum(digest), F.lit(1_000_000_007)).cast("long").alias("checksum"))


def record_checksum() -> Column:
    values = F.array_join(F.transform(F.col("values"), lambda v: v.cast("double").cast("string")), ",")
    return F.sha2(F.concat_ws("|", F.col("id"), values), 256)


def conflicts(copies: DataFrame) -> DataFrame:
    """id of copies(id, values) that differ between sources."""
    return copies.groupBy("id").agg(F.countDistinct(record_checksum()).alias("n")).where("n > 1").select("id", "n")


def segments(vectors: DataFrame, size: int = 10_000, order: str = "id") -> DataFrame:
    """``vectors`` with segment: runs of ``size`` in order. Ranges are numbered one by one, so no task sorts them all; rows that share a place in it go either way."""
    rows, _ = numbered(vectors, order)
    return rows.withColumn("segment", F.floor(F.col("_at") / size).cast("int")).drop("_at")


def routes(segmented: DataFrame) -> DataFrame:
    return segmented.select("segment", K.sign_signature(F.col("values")).alias("sig")).distinct()


def route(table: DataFrame, q: list[float], least: int = 8, keep: int = 1, reach: int = 2) -> DataFrame:
    """segment, distance of the segments to search: those within ``keep`` bits of the query's signature if at least ``least`` are within ``reach``, else all."""
    sig = sum(1 << i for i, x in enumerate(q[:24]) if x >= 0)
    near = table.groupBy("segment").agg(F.min(F.bit_count(F.col("sig").bitwiseXOR(F.lit(sig).cast("long")))).alias("distance"))
    hits = F.count_if(F.col("distance") <= reach).over(Window.partitionBy(F.lit(0)))  # a row a segment
    return near.withColumn("_hits", hits).where((F.col("_hits") < least) | (F.col("distance") <= keep)).drop("_hits")
