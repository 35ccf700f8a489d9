"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the whole in proportion to its weight, but no more than ``cap`` times its own size; what is
cut off is dealt to the others by weight until no share is above its cap. A share of 1.4 sizes takes each document once
and a seeded choice of documents, 0.4 of the words, once more. The plan counts the document at the edge with the words that
are missing; in the corpus it is whole or absent, whichever is nearer, so that only whole texts enter it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_or_empty

#: Hex digits of a document's seeded order that name its bucket. Only rows of one bucket a source are sorted together.
BUCKET_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0 by ``key`` (code points, null last), without one task for all: ranges first, then their offsets."""
    parts = cut(sources.repartitionByRange(F.col(key).isNull(), F.col(key)).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last())
    out = parts.join(F.broadcast(before), "_part").withColumn("rank", F.row_number().over(w) - 1 + F.coalesce("_before", F.lit(0)))
    return out.drop("_part", "_n", "_before")


def water_fill(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources(.., source_size, weight)`` with ``target``. Each round is one small aggregate; a round clamps at least one more source, and all that stand above the level at once."""
    total, out = sources.agg(F.sum("source_size")).first()[0] or 0, sources
    goal, most = share * total, F.col("source_size") * F.lit(float(cap))
    level, clamped = None, F.lit(False)
    for _ in range(1 << 16):
        free = F.when(~clamped, F.col("weight"))
        fixed, weight = sources.agg(F.sum(F.when(clamped, most)), F.sum(free)).first()
        new = (goal - (fixed or 0.0)) / weight if weight else None
        if new is None or new == level:
            break
        level = new
        clamped = F.col("weight") * F.lit(level) >= most
    target = most if level is None else F.least(F.col("weight") * F.lit(level), most)
    return out.withColumn("target", target.cast("double"))


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies), part (leading words of one more copy), taken.

    ``weights`` repeat over the sources by code point, null last (null is a source of its own). Null or empty texts have
    size 0 and are taken in whole epochs only. Order within a source is md5(seed:doc_id), then doc_id: reruns agree, and
    rows that repeat an id and size are interchangeable. ``carry`` names further columns to keep.
    """
    kept = [c for c in carry if c not in ("doc_id", "source", "size")]
    sized = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), *kept)
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = cut(sized.withColumn("_order", F.md5(named.cast("binary"))).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS)))
    by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut(ranked(by_source, "source").withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size")
    goals = water_fill(weighed, share, cap).withColumn("_whole", whole).withColumn("_rest", rest)
    # The words of a source before each bucket, and whether what is left to take ends inside it: only then its rows are ordered.
    buckets = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    so_far = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_low", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)))
    buckets = buckets.join(goals.drop("rank", "weight"), buckets["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    edge = (F.col("_low") < F.col("_rest")) & (F.col("_low") + F.col("_sum") > F.col("_rest"))
    buckets = cut(buckets.withColumn("_edge", edge))
    both = docs.join(buckets.withColumnsRenamed({"source": "_s", "_bucket": "_b"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("_s", "_b").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = both.where("_edge").withColumn("_low", F.col("_low") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = both.where("not _edge").unionByName(inside)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_low")))
    out = out.withColumns({"epochs": F.col("_whole").cast("long"), "part": part.cast("long")}).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return out.drop("_order", "_bucket", "_s", "_b", "_sum", "_low", "_edge", "_whole", "_rest")


def mixed(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with each document as often as mix() takes it; a part of one counts as whole from half its words on.

    A source then has its target but for half a document. Rows that repeat an id and text share one of their decisions.
    """
    rid = F.xxhash64(F.col(options.get("doc_id", "doc_id")), F.col(text))
    plan = mix(df.withColumn("_rid", rid), text=text, carry=("_rid",), **options)
    times = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    plan = plan.groupBy("_rid").agg(F.min(times).alias("_times")).where("_times > 0")
    out = df.withColumn("_rid", rid).join(cut(plan), "_rid")
    out = out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(df.columns)
