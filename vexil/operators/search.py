"""Exact nearest neighbours: single, batch, filtered, several vectors, reranked, merged.

One query is a projection and a TakeOrderedAndProject. A batch broadcasts its queries (their number is checked) and keeps
the best of each task before anything shuffles. Ties always go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.vectors import MAX_DIM, MAX_K

#: Numbers in the vectors of one block of queries; more queries go in several blocks, each a scan.
BLOCK = 4_000_000
#: Distances that a task holds at once.
HELD = 4_000_000


def check(q: list[float], k: int, max_k: int = MAX_K) -> None:
    if not len(q):
        raise ValueError("empty vector")
    if len(q) > MAX_DIM:
        raise ValueError("dimension too large")
    if not 0 < k <= max_k:
        raise ValueError(f"k must be in 1..{max_k}")


def rounded(d: Column, digits: int | None) -> Column:
    return d if digits is None else F.round(d, digits) + F.lit(0.0)  # no -0.0


def knn(vectors: DataFrame, q: list[float], k: int, metric: str = "l2", where: Column | None = None, squared: bool | None = None, digits: int | None = None) -> DataFrame:
    """id, distance of the k nearest. L2 is a root without filter and squared with one, unless ``squared`` says. Other dimensions are skipped."""
    check(q, k)
    squared = where is not None if squared is None else squared
    rows = vectors.where(F.size("values") == len(q))
    rows = rows if where is None else rows.where(where)
    d = K.distance(metric, K.literal(q), F.col("values"), squared=True)
    best = rows.select("id", rounded(F.sqrt(d) if metric == "l2" and not squared else d, digits).alias("distance"))
    return best.where(~F.isnan("distance")).orderBy("distance", "id").limit(k)


def _block_distance(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0)
    if metric == "inner_product":
        return -(q @ v.T)
    n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
    return np.where(n > 0, 1 - (q @ v.T) / np.where(n > 0, n, 1), 1.0)


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return ((q - v) ** 2).sum(1)
    p = (q * v).sum(1)
    if metric == "inner_product":
        return -p
    n = np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))
    return np.where(n > 0, 1 - p / np.where(n > 0, n, 1), 1.0)


def _scan(block: list[tuple[str, list[float], int]], metric: str, root: bool = False, slack: float = 0.0):
    """``slack``: what distances (their roots, with ``root``) that are equal once rounded may be apart."""
    qid = np.array([b[0] for b in block], object)
    q = np.array([b[1] for b in block], np.float64)
    ks = np.array([b[2] for b in block], np.int32)
    most = int(ks.max())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            ids, v = b["id"].to_numpy(), np.stack(b["values"].to_numpy()).astype(np.float64)
            k, step = min(most, len(v)), max(1, HELD // len(v))
            for at in range(0, len(q), step):
                d = _block_distance(q[at : at + step], v, metric)
                edge = np.partition(d, k - 1, axis=1)[:, k - 1]
                edge = (np.sqrt(edge) + slack) ** 2 if root else edge + slack
                i, j = np.nonzero(d <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None])  # ties and rounding stay in
                i += at
                yield pd.DataFrame({"qid": qid[i], "id": ids[j], "distance": _exact(q[i], v[j], metric), "_k": ks[i]})

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, metric: str = "l2", k: int | None = None, squared: bool = False, digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """qid, id, distance, rank. ``queries``: qid, q and k (or ``k`` for all); a null qid becomes ``query-<i>`` by order of q.

    Queries come to the driver in blocks of ``block`` numbers at most and each block scans the vectors once, as one matrix
    product a batch; each task keeps k rows a query and batch. All queries are checked first: one bad one fails the batch.
    """
    rows = queries.select("qid", F.col("q").cast("array<double>").alias("q"), (F.col("k") if k is None else F.lit(k)).cast("int").alias("k"))
    bad = rows.where(F.col("q").isNull() | (F.size("q") == 0) | (F.size("q") > MAX_DIM) | (F.col("k") <= 0) | (F.col("k") > MAX_K) | F.col("k").isNull()).limit(1).count()
    if bad:
        raise ValueError("a query is empty, too long, or has k out of range")
    parts: list[DataFrame] = []
    held: list[tuple[str, list[float], int]] = []
    most = 0
    root, slack = metric == "l2" and not squared, 0.0 if digits is None else 10.0**-digits

    def scan() -> None:
        by_dim: dict[int, list] = {}
        for h in held:
            by_dim.setdefault(len(h[1]), []).append(h)
        for dim, own in by_dim.items():
            parts.append(vectors.where(F.size("values") == dim).select("id", "values").mapInPandas(_scan(own, metric, root, slack), "qid string, id string, distance double, _k int"))
        held.clear()

    for i, r in enumerate(rows.orderBy(F.col("qid").isNull(), "qid", "q").toLocalIterator()):
        name = r["qid"] if r["qid"] is not None else f"query-{i}"
        held.append((str(name), list(r["q"]), r["k"]))
        most = max(most, r["k"])
        if sum(len(h[1]) for h in held) >= block:
            scan()
    if held:
        scan()
    if not parts:
        return vectors.sparkSession.createDataFrame([], "qid string, id string, distance double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    d = F.sqrt("distance") if root else F.col("distance")
    found = found.withColumn("distance", rounded(d, digits)).where(~F.isnan("distance"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= F.col("_k")).select("qid", "id", "distance", "rank")


def knn_multi(vectors: DataFrame, qs: list[list[float]], k: int, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """id, distance: by the least distance to any of the queries; L2 is squared."""
    for q in qs:
        check(q, k)
    rows = vectors.where(F.size("values") == len(qs[0]))
    ds = [K.distance(metric, K.literal(q), F.col("values"), squared=True) for q in qs]
    least = F.least(*ds) if len(ds) > 1 else ds[0]
    return rows.select("id", rounded(least, digits).alias("distance")).orderBy("distance", "id").limit(k)


def knn_reranked(vectors: DataFrame, q: list[float], k: int, candidates: int, score: Column, metric: str = "l2", where: Column | None = None, digits: int | None = None) -> DataFrame:
    """id, distance: the ``candidates`` nearest (k at least), ordered anew by ``score`` (of a column of ``vectors``), then cut to k; distance is the score."""
    check(q, k)
    n = max(k, candidates)
    rows = vectors.where(F.size("values") == len(q))
    rows = rows if where is None else rows.where(where)
    near = rows.withColumn("distance", rounded(K.distance(metric, K.literal(q), F.col("values"), squared=True), digits)).orderBy("distance", "id").limit(n)
    return near.select("id", rounded(score, digits).alias("distance")).orderBy("distance", "id").limit(k)


def merged(results: DataFrame, k: int) -> DataFrame:
    """Of results (id, distance) of several shards: the best of each id, then the k best."""
    return results.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)


def ann_quality(found: DataFrame, exact: DataFrame) -> DataFrame:
    """compared, top1_matches, overlap, recall of two results (qid, id, rank)."""
    both = exact.select("qid", "id", F.col("rank").alias("_exact")).join(found.select("qid", "id", F.col("rank").alias("_found")), ["qid", "id"], "left")
    return both.agg(F.countDistinct("qid").alias("compared"), F.count_if((F.col("_exact") == 1) & (F.col("_found") == 1)).alias("top1_matches"), F.count("_found").alias("overlap"), F.round(F.count("_found") / F.count(F.lit(1)), 6).alias("recall"))
