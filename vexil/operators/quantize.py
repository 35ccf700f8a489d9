"""Scalar, product and permuted product quantization in float arithmetic, in long form (id, dim, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, id_column: str = "id") -> DataFrame:
    return vectors.select(F.col(id_column).alias("id"), F.posexplode("values").alias("dim", "value"))


def train_sq(vectors: DataFrame) -> DataFrame:
    """dim, lo, hi as float. One partial aggregate a task; the result has one row a dimension."""
    return long_form(vectors).groupBy("dim").agg(F.min("value").cast("float").alias("lo"), F.max("value").cast("float").alias("hi"))


def code(value: Column, lo: Column, hi: Column) -> Column:
    """Byte of a value: rounded 255ths of the span, clamped; 0 for an empty span."""
    x = (value.cast("float") - lo) / (hi - lo)
    x = F.greatest(F.lit(0).cast("float"), F.least(F.lit(1).cast("float"), x.cast("float")))
    return F.when(hi - lo <= 0, 0).otherwise(F.floor((x * F.lit(255).cast("float")).cast("float") + F.lit(0.5).cast("float")).cast("int"))


def decoded(c: Column, lo: Column, hi: Column) -> Column:
    # SQL divides floats as doubles; the cast gives the float quotient back.
    return lo + (((hi - lo) * c.cast("float")) / F.lit(255).cast("float")).cast("float")


def encode_sq(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """id, dim, code. The model has a row a dimension (MAX_DIM at most), so it is broadcast."""
    return long_form(vectors).join(F.broadcast(model), "dim").select("id", "dim", code(F.col("value"), F.col("lo"), F.col("hi")).alias("code"))


def packed(codes: DataFrame) -> DataFrame:
    """id, codes: one byte a dimension, in order."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "code")))
    return codes.groupBy("id").agg(F.aggregate(ordered, F.lit(b""), lambda s, x: F.concat(s, byte(x["code"]))).alias("codes"))


def approximate_l2(codes: DataFrame, model: DataFrame, q: list[float]) -> DataFrame:
    """id, distance: squared L2 of ``q`` to the decoded vectors."""
    at = F.element_at(F.lit([float(x) for x in q]), F.col("dim") + 1)
    d = at - decoded(F.col("code"), F.col("lo"), F.col("hi")).cast("double")
    return codes.join(F.broadcast(model), "dim").groupBy("id").agg(F.sum(d * d).alias("distance"))


def product_codes(codes: DataFrame, dim: int, subspaces: int) -> DataFrame:
    """id, subspace, dim, code: equal subspaces, each coded value by value."""
    if subspaces <= 0 or dim % subspaces:
        raise ValueError("the dimension must be a multiple of the subspaces")
    return codes.withColumn("subspace", F.floor(F.col("dim") / (dim // subspaces)).cast("int"))


def permutation(vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """pos, dim: dimensions by variance, greatest first, ties by index. Two passes, as means are taken off first."""
    rows = long_form(vectors).withColumn("value", F.col("value").cast("double"))
    means = rows.groupBy("dim").agg(F.avg("value").alias("mean"))
    v = rows.join(F.broadcast(means), "dim").groupBy("dim").agg(F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).alias("v"))
    v = v if digits is None else v.withColumn("v", F.round("v", digits))
    return v.select((F.row_number().over(Window.orderBy(F.desc("v"), "dim")) - 1).alias("pos"), "dim")  # MAX_DIM rows at most


def permuted_codes(vectors: DataFrame, order: DataFrame, model: DataFrame, dim: int, subspaces: int) -> DataFrame:
    """id, subspace, pos, code."""
    own = encode_sq(vectors, model).join(F.broadcast(order), "dim").select("id", F.col("pos").alias("dim"), "code")
    return product_codes(own, dim, subspaces).withColumnRenamed("dim", "pos")
