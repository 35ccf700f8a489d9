"""Places in an order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Low bits of monotonically_increasing_id(), which count a partition's rows; its number stands above them.
ROW_BITS = 33


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(``rows`` with ``_at``, their place from 0 in ``order``, and how many there are).

    Rows shuffle once, to ranges, and are written sorted with their place in the range; only the ranges' sizes, one row a
    partition, come to the driver. A value with very many rows is split between ranges if ``order`` names a column that tells
    them apart. Since the ranges are written, a lost executor does not draw them anew.
    """
    spark = rows.sparkSession
    own = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", ROW_BITS)
    before, total = [], 0
    for p, n in sorted(own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    place = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("_before")
    return own.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_at", place).drop("_part", "_before", "_row"), total
