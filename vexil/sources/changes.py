"""Change logs: rows (offset, op, id, values, metadata), op upsert / delete / metadata. The offset is the only order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered

OPS = ("upsert", "delete", "metadata")


def since(log: DataFrame, offset: int) -> DataFrame:
    """Changes after an offset; an offset that was delivered twice counts once."""
    return log.where(F.col("offset") > offset).dropDuplicates(["offset", "id"])


def state(log: DataFrame) -> DataFrame:
    """id, values, metadata, offset: the last record of each id, without deleted ones. Malformed changes (blank id, upsert of no values, unknown op) are skipped.

    A partial aggregate keeps one row a key and task, so a key with many changes doesn't travel.
    """
    values = F.col("values").isNotNull() & (F.size("values") > 0)
    ok = log.where((F.trim("id") != "") & ((F.col("op") == "delete") | ((F.col("op") == "upsert") & values) | ((F.col("op") == "metadata") & F.col("metadata").isNotNull())))
    own = F.struct("offset", "op", "values", "metadata")
    last = ok.groupBy("id").agg(
        F.max(F.when(F.col("op") == "delete", F.col("offset"))).alias("gone"),
        F.max_by(own, F.when(F.col("op") == "upsert", F.col("offset"))).alias("v"),
        F.max_by(F.struct("offset", "metadata"), F.when(F.col("metadata").isNotNull(), F.col("offset"))).alias("m"),
    )
    gone = F.coalesce("gone", F.lit(-1))
    live = last.where(F.col("v").isNotNull() & (F.col("v.offset") > gone))
    return live.select("id", F.col("v.values").alias("values"), F.when(F.col("m.offset") > gone, F.col("m.metadata")).alias("metadata"), F.greatest("v.offset", F.when(F.col("m.offset") > gone, F.col("m.offset"))).alias("offset"))


def insert_faults(batch: DataFrame, table: DataFrame) -> DataFrame:
    """id, fault of a batch that may not be inserted: blank, empty, repeated in the batch, or already there. No row: the batch can be appended whole."""
    rows = batch.select("id", F.when(F.trim("id") == "", "blank_id").when(F.col("values").isNull() | (F.size("values") == 0), "empty_vector").alias("fault"))
    twice = batch.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated").alias("fault"))
    there = batch.select("id").distinct().join(table.select("id"), "id", "left_semi").select("id", F.lit("exists").alias("fault"))
    return rows.where("fault is not null").unionByName(twice).unionByName(there)


def without(table: DataFrame, deleted: DataFrame) -> DataFrame:
    return table.join(deleted.select("id").distinct(), "id", "left_anti")


def missing(deleted: DataFrame, table: DataFrame) -> DataFrame:
    """Ids to delete that are not there, which is an error of the caller."""
    return deleted.select("id").distinct().join(table.select("id"), "id", "left_anti")


def page(vectors: DataFrame, after: str | None, limit: int, ids_only: bool = False) -> DataFrame:
    """Keyset page in order of id, and one row more if there is another page. The filter on id reaches the scan."""
    rows = vectors if after is None else vectors.where(F.col("id") > after)
    rows = rows.select("id") if ids_only else rows.select("id", "values")
    return rows.orderBy("id").limit(limit + 1)


def id_mapping(vectors: DataFrame) -> DataFrame:
    """id, internal: dense numbers from 1 in order of id, from ranges and their sizes."""
    rows, _ = numbered(vectors.select("id"), "id")
    return rows.select("id", (F.col("_at") + 1).alias("internal"))


def reserve(known: DataFrame, ids: DataFrame) -> DataFrame:
    """id, internal of each distinct id asked for: its number if ``known`` has one, else dense new numbers after the greatest, in order of id. A blank id fails them all."""
    if ids.where(F.trim("id") == "").limit(1).count():
        raise ValueError("blank id")
    asked = ids.select("id").distinct()
    last = known.agg(F.coalesce(F.max("internal"), F.lit(0)).alias("_last"))  # one row
    fresh = numbered(asked.join(known.select("id"), "id", "left_anti"), "id")[0].crossJoin(F.broadcast(last))
    old = known.select("id", F.col("internal").cast("long").alias("internal")).join(asked, "id", "left_semi")
    return old.unionByName(fresh.select("id", (F.col("_at") + 1 + F.col("_last")).cast("long").alias("internal")))


def mapping_conflicts(known: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported pairs that contradict known ones on either side."""
    k = known.select(F.col("id").alias("_id"), F.col("internal").alias("_n"))
    by_id = imported.join(k, F.col("id") == F.col("_id")).where(F.col("internal") != F.col("_n"))
    by_n = imported.join(k, F.col("internal") == F.col("_n")).where(F.col("id") != F.col("_id"))
    return by_id.select("id", "internal").unionByName(by_n.select("id", "internal")).distinct()


def latest(log: DataFrame, key: str = "id") -> DataFrame:
    """The last change of each key, deletes included."""
    w = Window.partitionBy(key).orderBy(F.desc("offset"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kv_state(log: DataFrame, prefix: str = "") -> DataFrame:
    """key, value of a key-value log (offset, op put / delete, key, value): the last put of each key that no delete follows. The prefix reaches the scan."""
    own = log.where(F.col("key").startswith(prefix) & F.col("op").isin("put", "delete"))
    last = own.groupBy("key").agg(F.max_by(F.struct("op", "value"), "offset").alias("c"))
    return last.where("c.op = 'put'").select("key", "c.value")
