"""Vector functions as columns. Vectors are arrays of float; every kernel widens to double."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "inner_product")
NAN = lambda: F.lit(float("nan"))


def literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])


def _fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(NAN())


def squared_l2(a: Column, b: Column) -> Column:
    """NaN where the sizes differ, as in every kernel of two vectors."""
    return _same_size(a, b, _fold(a, b, lambda x, y: (x - y) * (x - y)))


def squared_l2_float(a: Column, b: Column) -> Column:
    """Differences in float arithmetic, squares and sum in double."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("float") - y.cast("float")).cast("double"))
    return _same_size(a, b, F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column, b: Column) -> Column:
    return _same_size(a, b, _fold(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 where either vector is zero."""
    na, nb = norm(a), norm(b)
    return _same_size(a, b, F.when((na == 0) | (nb == 0), 1.0).otherwise(1 - dot(a, b) / (na * nb)))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance(metric: str, a: Column, b: Column, squared: bool = False) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r}: one of {METRICS}")
    if metric == "l2":
        return squared_l2(a, b) if squared else l2(a, b)
    return cosine_distance(a, b) if metric == "cosine" else inner_product_distance(a, b)


def add(a: Column, b: Column) -> Column:
    """Null where the sizes differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def subtract(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def normalize(a: Column) -> Column:
    """Null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def sign_signature(a: Column, bits: int = 24) -> Column:
    """Bit d is set where value d is not negative, for the first ``bits`` values."""
    own = F.transform(F.slice(a, 1, bits), lambda x, i: F.when(x >= 0, F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: FNV-1a: the offset basis in two halves, and the prime 2**40 + 435.
FNV_HIGH, FNV_LOW, FNV_TAIL = 0xCBF29CE4, 0x84222325, 435
_LOW32 = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """struct<hi: long, lo: long>: 32-bit halves of the 64-bit hash of the UTF-8 bytes, which SQL's checked longs can hold."""
    digits = F.hex(F.encode(text, "UTF-8"))
    codes = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")))
    half = lambda v: F.lit(v).cast("long")

    def step(h: Column, byte: Column) -> Column:
        x = h["lo"].bitwiseXOR(byte)
        p = x * FNV_TAIL
        return F.struct((h["hi"] * FNV_TAIL + F.shiftright(p, 32) + F.shiftleft(x, 8)).bitwiseAND(half(_LOW32)).alias("hi"), p.bitwiseAND(half(_LOW32)).alias("lo"))

    return F.aggregate(codes, F.struct(half(FNV_HIGH).alias("hi"), half(FNV_LOW).alias("lo")), step)


def unsigned_mod(h: Column, n: int) -> Column:
    """Remainder of the unsigned 64-bit value in halves."""
    return ((h["hi"] % n) * ((1 << 32) % n) + h["lo"] % n) % n


def encode_cursor(text: Column) -> Column:
    """Unpadded base64url."""
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "=+$", "")


def decode_cursor(text: Column) -> Column:
    """Padded or not."""
    bare = F.regexp_replace(F.translate(text, "-_", "+/"), "=+$", "")
    return F.decode(F.unbase64(F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))), "UTF-8")


def projection_weight(dimension: int, axis: int) -> float:
    """Pseudo-random weight in [-1, 1] / sqrt(dimension + 1) of a dimension on one of two axes: the SplitMix64 finaliser of their combination."""
    mask = (1 << 64) - 1
    x = ((dimension + 1) * 0x9E3779B97F4A7C15 + (axis + 1) * 0xBF58476D1CE4E5B9) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & mask
    x ^= x >> 31
    return ((x & 0xFFFF) / 32767.5 - 1) / math.sqrt(dimension + 1)
