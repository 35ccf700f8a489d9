"""Operations on collections: tiers, backups, vector map, counters, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.ranges import numbered

HOT_HOURS, WARM_HOURS = 24, 7 * 24
MAP_POINTS = 5000


def tier(last_access: Column, now: Column) -> Column:
    """hot up to a day, warm up to a week, else cold; an access to come is hot."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_access.cast("timestamp"))
    hour = 3_600_000_000
    return F.when(age <= HOT_HOURS * hour, "hot").when(age <= WARM_HOURS * hour, "warm").otherwise("cold")


def tier_moves(objects: DataFrame, now: Column) -> DataFrame:
    """key, from_tier, to_tier of objects(key, last_access, tier) that stand in the wrong tier."""
    return objects.select("key", F.col("tier").alias("from_tier"), tier(F.col("last_access"), now).alias("to_tier")).where("from_tier <> to_tier")


def backup_diff(base: DataFrame, now: DataFrame) -> DataFrame:
    """Files(name, bytes, sha256) that an incremental backup copies: new names, or other contents."""
    return now.join(base.select("name", "sha256"), ["name", "sha256"], "left_anti")


def restored(chain: list[DataFrame]) -> DataFrame:
    """Files after restoring manifests in order, base first: the last of each name."""
    rows = chain[0].withColumn("_turn", F.lit(0))
    for i, d in enumerate(chain[1:], 1):
        rows = rows.unionByName(d.withColumn("_turn", F.lit(i)))
    return rows.groupBy("name").agg(F.max_by(F.struct("bytes", "sha256"), "_turn").alias("f")).select("name", "f.bytes", "f.sha256")


def vector_map(vectors: DataFrame, dim: int, digits: int | None = None) -> DataFrame:
    """id, x, y in [0, 1] of a fixed projection to two dimensions; 0.5 where all agree. The extent is one aggregate."""
    side = lambda axis: K.dot(F.col("values"), K.literal([K.projection_weight(d, axis) for d in range(dim)]))
    raw = vectors.where(F.size("values") == dim).select("id", side(0).alias("x"), side(1).alias("y"))
    box = raw.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    unit = lambda v, lo, hi: F.when(F.col(hi) == F.col(lo), 0.5).otherwise((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)))
    out = raw.join(F.broadcast(box)).select("id", unit("x", "x0", "x1").alias("x"), unit("y", "y0", "y1").alias("y"))
    return out if digits is None else out.select("id", F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))


def map_edges(points: DataFrame, digits: int | None = None, most: int = MAP_POINTS) -> DataFrame:
    """source, target, score: each point's nearest other (first by id of ties), once a pair from its lesser id. A map is a page of ``most`` points at most, which is checked."""
    if points.count() > most:
        raise ValueError(f"a map has {most} points at most")
    a, b = points.select(F.col("id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay")), points.select(F.col("id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    d2 = d2 if digits is None else F.round(d2, digits)
    near = a.join(F.broadcast(b), F.col("source") != F.col("target")).withColumn("d2", d2).groupBy("source").agg(F.min(F.struct("d2", "target")).alias("m"))
    score = 1 / (1 + F.sqrt("m.d2"))
    return near.where(F.col("source") < F.col("m.target")).select("source", F.col("m.target").alias("target"), (score if digits is None else F.round(score, digits)).alias("score"))


def counters(shards: DataFrame) -> DataFrame:
    """Totals of shards(shard, vectors, tombstones, ready)."""
    return shards.agg(F.count(F.lit(1)).alias("shards"), F.sum("vectors").alias("vectors"), F.sum("tombstones").alias("tombstones"), F.max("vectors").alias("largest"), F.bool_and("ready").alias("ready"))


def should_rebuild(tombstones: Column, nodes: Column, least: int = 1024, share: float = 0.25) -> Column:
    return (tombstones >= least) & (tombstones >= nodes * share)


def percentiles(rows: DataFrame, value: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """p, value by nearest rank. Ranks are found by sorting ranges, not in one task; rows of a frequent value go to several ranges."""
    known = rows.select(value).where(F.col(value).isNotNull()).withColumn("_tie", F.monotonically_increasing_id())
    own, total = numbered(known, value, "_tie")
    wanted = rows.sparkSession.createDataFrame([(p, max(1, -(-total * p // 100)) - 1) for p in ps] if total else [], "p int, _at long")
    return own.join(F.broadcast(wanted), "_at").select("p", F.col(value).alias("value"))


def backup_verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name, status (missing, corrupt, extra) of files that differ from a manifest(name, bytes, sha256); no row: the backup is whole."""
    a, b = manifest.select("name", "bytes", "sha256"), found.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    differ = (F.col("bytes") != F.col("_bytes")) | (F.col("sha256") != F.col("_sha"))
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(differ, "corrupt")
    return a.join(b, "name", "full").select("name", status.alias("status")).where("status is not null")
