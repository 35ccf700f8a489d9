"""Inverted-file index: centroids(cid, c), lists = vectors with cid. Searches join probes to lists by cid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.ranges import numbered
from .search import rounded

SAMPLE = 4096
#: Numbers in all centroids together; they are held in every task.
MAX_NUMBERS = 16_000_000


def evenly(n: int, k: int) -> list[int]:
    """k positions of 0 .. n - 1, both ends included."""
    return [i * (n - 1) // max(k - 1, 1) for i in range(min(k, n))]


def pick(vectors: DataFrame, k: int, order: str = "id") -> DataFrame:
    """cid, c: k vectors evenly spaced in ``order``, a column of unique values. Only that column shuffles, to ranges; the vectors are then picked by it."""
    spark = vectors.sparkSession
    rows, total = numbered(vectors.select(order), order)
    if not total:
        return spark.createDataFrame([], "cid int, c array<double>")
    wanted = spark.createDataFrame([(i, at) for i, at in enumerate(evenly(total, k))], "cid int, _at long")
    chosen = rows.join(F.broadcast(wanted), "_at").select(order, "cid")
    return vectors.select(order, "values").join(F.broadcast(chosen), order).select("cid", F.col("values").cast("array<double>").alias("c"))


def kmeans(vectors: DataFrame, k: int, iterations: int = 8, sample: int = SAMPLE, order: str = "id") -> DataFrame:
    """cid, c: farthest-point start and Lloyd's steps over an even sample of ``sample`` vectors at most, on the driver; an empty cell keeps its centroid."""
    rows = pick(vectors, sample, order).orderBy("cid").collect()
    x = np.array([r["c"] for r in rows], np.float64)
    k = min(k, len(x))
    centers, near = [x[0]], ((x - x[0]) ** 2).sum(1)
    while len(centers) < k:
        centers.append(x[near.argmax()])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    c = np.array(centers)
    for _ in range(iterations):
        own = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        for i in range(k):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
    return vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cid int, c array<double>")


def _centroids(centroids: DataFrame):
    """A broadcast of (cids, matrix), in order of cid; as many as lists, and checked."""
    rows = centroids.select("cid", "c").orderBy("cid").limit(MAX_NUMBERS).collect()
    c = np.array([list(r["c"]) for r in rows], np.float64).reshape(len(rows), -1)
    if c.size > MAX_NUMBERS:
        raise ValueError("too many centroids for one task")
    return centroids.sparkSession.sparkContext.broadcast((np.array([r["cid"] for r in rows], np.int64), c))


def nearest(v: np.ndarray, cids: np.ndarray, c: np.ndarray, most: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cid, squared distance) of the ``most`` nearest centroids of each row, in order of distance, then cid.

    A matrix product finds them, with all that lie within its rounding of the last one; those are measured exactly.
    """
    approximate = (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * v @ c.T
    most = min(most, len(c))
    edge = np.partition(approximate, most - 1, axis=1)[:, most - 1]
    i, j = np.nonzero(approximate <= (edge + 10.0 ** -(digits or 9) + 1e-9 * np.abs(edge))[:, None])
    d = ((v[i] - c[j]) ** 2).sum(1)
    d = d if digits is None else np.floor(d * 10**digits + 0.5) / 10**digits
    order = np.lexsort((cids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < most
    return i[keep], cids[j[keep]], d[keep]


def assign(vectors: DataFrame, centroids: DataFrame, digits: int | None = None) -> DataFrame:
    """Columns of ``vectors``, cid and d2 of the nearest centroid (lowest cid of ties): one matrix product a batch, no shuffle. Rows of another dimension are left out."""
    shared = _centroids(centroids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name not in ("cid", "d2"))
    kept = [c for c in vectors.columns if c not in ("cid", "d2")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cids, c = shared.value
        for b in batches:
            b = b[b["values"].map(len, na_action="ignore") == c.shape[1]]
            if len(b) and len(c):
                _, cid, d = nearest(np.stack(b["values"].to_numpy()).astype(np.float64), cids, c, 1, digits)
                yield b.assign(cid=cid.astype(np.int32), d2=d)

    return vectors.select(kept).mapInPandas(run, f"{fields}, cid int, d2 double")


def upsert(lists: DataFrame, centroids: DataFrame, changed: DataFrame, digits: int | None = None) -> DataFrame:
    """``lists`` after an upsert: only the changed vectors are assigned; those that were elsewhere move."""
    new = assign(changed, centroids, digits)
    return lists.join(changed.select("id").distinct(), "id", "left_anti").select(new.columns).unionByName(new)


def lloyd_step(assigned: DataFrame, digits: int | None = None) -> DataFrame:
    """cid, dim, value: means of the cells, in long form."""
    rows = assigned.select("cid", F.posexplode("values").alias("dim", "v"))
    return rows.groupBy("cid", "dim").agg(rounded(F.avg(F.col("v").cast("double")), digits).alias("value"))


def probes(queries: DataFrame, centroids: DataFrame, most: int, digits: int | None = None) -> DataFrame:
    """qid, q, cid, probe (from 1) of the ``most`` nearest lists."""
    shared = _centroids(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cids, c = shared.value
        for b in batches:
            if len(b) and len(c):
                i, cid, _ = nearest(np.stack(b["q"].to_numpy()).astype(np.float64), cids, c, most, digits)
                place = np.arange(len(i)) - np.searchsorted(i, i) + 1
                yield pd.DataFrame({"qid": b["qid"].to_numpy()[i], "q": b["q"].to_numpy()[i], "cid": cid.astype(np.int32), "probe": place.astype(np.int32)})

    return queries.select("qid", "q").mapInPandas(run, "qid string, q array<double>, cid int, probe int")


def search_lists(lists: DataFrame, probed: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """qid, id, distance (squared), rank. Lists are joined by cid: written with partitionBy('cid'), unprobed ones are not read."""
    met = lists.select("id", "values", "cid").join(probed, "cid")
    d = met.select("qid", "id", rounded(K.squared_l2(F.col("q"), F.col("values")), digits).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)


def search(lists: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, digits: int | None = None) -> DataFrame:
    return search_lists(lists, probes(queries, centroids, max(1, nprobe), digits), k, digits)


def adaptive_probes(lists: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, least: int = 0, most: int = 0, digits: int | None = None) -> DataFrame:
    """As probes(), but each query's number doubles from ``nprobe`` until its lists hold ``least`` (else k) and k candidates, or is ``most``.

    List sizes add up along the probe order, so the stop is found without a loop over searches.
    """
    n = centroids.count()
    most = n if most <= 0 or most > n else most
    least = max(least if least > 0 else k, k)
    ladder, p = [], min(nprobe, most)
    while p < most:
        ladder.append(p)
        p = p * 2 if p else 1
    ladder.append(most)
    sizes = lists.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("qid").orderBy("probe")
    far = probes(queries, centroids, most, digits).join(sizes, "cid", "left").withColumn("have", F.sum(F.coalesce("n", F.lit(0))).over(w))
    enough = F.min(F.when(F.col("probe").isin(ladder) & (F.col("have") >= least), F.col("probe"))).over(Window.partitionBy("qid"))
    return far.withColumn("stop", F.coalesce(enough, F.lit(most))).where(F.col("probe") <= F.col("stop")).select("qid", "q", "cid", "probe")


def without(lists: DataFrame, deleted: DataFrame) -> DataFrame:
    """Lists without tombstoned ids."""
    return lists.join(deleted.select("id").distinct(), "id", "left_anti")


def drift(assigned: DataFrame, threshold: float, digits: int | None = None) -> DataFrame:
    """score (mean squared distance to the nearest centroid), needs_retrain (strictly greater than the threshold)."""
    score = rounded(F.avg("d2"), digits)
    return assigned.agg(score.alias("score")).withColumn("needs_retrain", F.col("score") > threshold)
