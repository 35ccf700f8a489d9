"""Exact deduplication by two-pass Bloom filtering.

Pass one deals the 8-byte hashes of the texts by their range of values; each task sends its own through a Bloom filter of
``BITS`` bits a hash and keeps those that were there already. The filter's size is set by the rows a task expects, which
``PER_TASK`` bounds, so more rows make more filters and no fuller ones. Pass two looks each row up among the hashes kept: a
row none of whose copies can exist goes straight to the result, and only the rest shuffle, as digests. The hashes are
broadcast while they are ``BROADCAST_ROWS`` at most; more are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8_hash
from .textnum import mix, released

#: Bits and probes of a filter for each hash, hashes a task expects, and hashes (a long each) that are broadcast at most.
BITS, PROBES, PER_TASK, BROADCAST_ROWS = 16, 4, 1 << 20, 1_000_000


class Bloom:
    """Packed bits; ``seen`` says which hashes (all different) may have been there before, and adds them."""

    def __init__(self, bits: int):
        self.bits = np.zeros(bits // 8, np.uint8)
        self.mask = np.uint64(bits - 1)

    def seen(self, h: np.ndarray) -> np.ndarray:
        one, two = mix(h + np.uint64(1)), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        at = [(one + np.uint64(k) * two) & self.mask for k in range(PROBES)]
        places = [((a >> np.uint64(3)).astype(np.int64), np.uint8(1) << (a & np.uint64(7)).astype(np.uint8)) for a in at]
        there = np.logical_and.reduce([(self.bits[i] & bit) != 0 for i, bit in places])
        for i, bit in places:
            np.bitwise_or.at(self.bits, i, bit)
        return there


def possibly_repeated(hashes: DataFrame, rows: int, per_task: int = PER_TASK) -> DataFrame:
    """h of hashes(h) that more than one row has, and a few that only one has."""
    tasks = max(1, -(-rows // per_task))
    bits = 1 << int(np.ceil(np.log2(max(1 << 12, BITS * -(-rows // tasks)))))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, n = np.unique(b["h"].to_numpy(), return_counts=True)
            yield pd.DataFrame({"h": h, "again": n > 1})

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = Bloom(bits)
        for b in batches:
            b = b.groupby("h", as_index=False)["again"].agg(["max", "size"])
            h = b["h"].to_numpy(np.int64)
            there = bloom.seen(h.view(np.uint64)) | b["max"].to_numpy(bool) | (b["size"].to_numpy() > 1)
            yield pd.DataFrame({"h": h[there]})

    parts = hashes.mapInPandas(released(own), "h long, again boolean").repartition(tasks, "h")
    return parts.mapInPandas(released(through), "h long").distinct()


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False, per_task: int = PER_TASK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns of ``df`` (``text`` only with ``with_text``) and keep_id, group_size, kept, text_sha256.

    Null text counts as empty and equals it. Of equal texts the row with the largest id stays; a null id is less than any
    other. Of rows that repeat both text and id one stays, whichever was written last. Columns named like results are
    replaced. The rows that may be repeated are written to the shared folder once, with all columns that are returned.
    """
    rows = df.withColumns({"text_sha256": utf8_hash(text)}).drop("keep_id", "group_size", "kept", *([] if with_text else [text]))
    rows = rows.withColumn("_h", F.xxhash64("text_sha256"))
    maybe = cut(possibly_repeated(rows.select(F.col("_h").alias("h")), df.count(), per_task))
    marks = maybe.select(F.col("h").alias("_h"), F.lit(True).alias("_maybe"))
    few = maybe.limit(broadcast_rows + 1).count() <= broadcast_rows
    flagged = rows.join(F.broadcast(marks) if few else marks, "_h", "left").drop("_h")
    out = [*rows.drop("_h").columns, "keep_id", "group_size", "kept"]
    single = {"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    alone = flagged.where("_maybe is null").withColumns(single)
    some = cut(flagged.where("_maybe").drop("_maybe"))
    some = some.withColumn("_row", F.struct(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("at")))
    groups = some.groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("_row").alias("_last"), F.count(F.lit(1)).alias("group_size"))
    # Only groups of two or more are joined, and from a written table: then a group that holds a third of all rows is split between tasks.
    groups = cut(groups.where("group_size > 1"))
    met = some.join(groups, some["text_sha256"] == groups["_sha"], "left")
    lone = F.col("_sha").isNull()
    met = met.withColumns({
        "keep_id": F.when(lone, F.col(doc_id)).otherwise(F.col("_last.id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        "kept": lone | (F.col("_row") == F.col("_last")),
    })
    return alone.select(out).unionByName(met.select(out))
