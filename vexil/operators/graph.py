"""Graph indexes: a table of segments, each a navigable graph over at most ``segment_size`` vectors.

Insertion is sequential by nature, so a segment is built in one task and segments in parallel; a search walks every
segment near its rows, and the tasks' results meet in one ranking. Levels are deterministic (from the slot number), links
choose diverse neighbours, and every hit is scored exactly. Metrics are those of the kernels.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .routing import segments
from .search import knn_batch, rounded

NODES = "segment int, slot int, id string, values array<float>, level int, links array<array<int>>"


@dataclass(frozen=True)
class Profile:
    m: int
    ef_construction: int
    ef_search: int


#: Links, construction beam and search beam of the named profiles.
PROFILES = {"fast": Profile(8, 32, 32), "balanced": Profile(16, 64, 64), "quality": Profile(24, 96, 96), "quality_core": Profile(32, 128, 128)}
MAX_LEVEL = 32
#: Vectors of a segment up to which the distances of all pairs are held while it is built (128 MB).
EXACT = 4096


def distances(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        d = v - q
        return np.einsum("ij,ij->i", d, d)
    p = v @ q
    if metric == "inner_product":
        return -p
    n = np.sqrt(np.einsum("ij,ij->i", v, v)) * math.sqrt(float(q @ q))
    return np.where(n > 0, 1 - p / np.where(n > 0, n, 1), 1.0)


def between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    p = a @ b.T
    if metric == "inner_product":
        return -p
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if metric == "l2":
        return np.maximum(aa[:, None] + bb[None, :] - 2 * p, 0)
    n = np.sqrt(aa)[:, None] * np.sqrt(bb)[None, :]
    return np.where(n > 0, 1 - p / np.where(n > 0, n, 1), 1.0)


def level_of(slot: int, m: int) -> int:
    """Geometric level of a slot, from a hash of its number instead of a random generator."""
    x = (slot + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    u = ((x ^ (x >> 27)) % (1 << 53) + 1) / ((1 << 53) + 1)
    return min(MAX_LEVEL, int(-math.log(u) / math.log(max(2, m))))


class Graph:
    """One segment. ``flat`` keeps all nodes on the ground level: the flat navigable graph."""

    def __init__(self, v: np.ndarray, m: int, ef: int, metric: str, flat: bool = False):
        self.v, self.m, self.ef, self.metric, self.flat = v, m, ef, metric, flat
        self.links: list[list[np.ndarray]] = []
        self.entry = -1
        self.table: np.ndarray | None = None  # distances of all pairs, while a small segment is built
        self.levels: np.ndarray | None = None

    def beam(self, q: np.ndarray, start: list[int], ef: int, level: int, banned: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ``ef`` nearest found, in order. Banned nodes are walked through but not returned."""
        d = distances(self.v[start], q, self.metric)
        seen = set(start)
        todo = [(float(x), s) for x, s in zip(d, start, strict=True)]
        heapq.heapify(todo)
        best = [(-x, -s) for x, s in todo if banned is None or not banned[s]]
        heapq.heapify(best)
        while todo and len(seen) < len(self.v):  # nothing is left to find once all are seen
            x, s = heapq.heappop(todo)
            if len(best) >= ef and x > -best[0][0]:
                break
            near = [int(n) for n in self.links[s][level] if int(n) not in seen]
            if not near:
                continue
            seen.update(near)
            for y, n in zip(distances(self.v[near], q, self.metric).tolist(), near, strict=True):
                if len(best) < ef or y < -best[0][0]:
                    heapq.heappush(todo, (y, n))
                    if banned is None or not banned[n]:
                        heapq.heappush(best, (-y, -n))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-a, -b) for a, b in best)

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, leaving out those nearer to one already chosen than to the node; left-outs fill up."""
        if len(found) <= 1:
            return [n for _, n in found[:most]]
        d, own = np.array([x for x, _ in found]), np.array([n for _, n in found])
        among = self.table[np.ix_(own, own)] if self.table is not None else between(self.v[own], self.v[own], self.metric)
        free, out = np.ones(len(own), bool), []
        for i in range(len(own)):
            if free[i]:
                out.append(i)
                if len(out) == most:
                    break
                free &= ~(among[i] < d)
                free[: i + 1] = False
        rest = [i for i in range(len(own)) if i not in set(out)]
        return own[out + rest[: most - len(out)]].tolist()

    def add(self, s: int) -> None:
        level = 0 if self.flat else level_of(s, self.m)
        self.links.append([np.zeros(0, np.int32) for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = s
            return
        q, start = self.v[s], [self.entry]
        top = len(self.links[self.entry]) - 1
        if self.table is None:
            for lv in range(top, level, -1):
                start = [self.beam(q, start, 1, lv)[0][1]]
        for lv in range(min(top, level), -1, -1):
            if self.table is None:
                found = self.beam(q, start, self.ef, lv)
                start = [n for _, n in found]
            else:  # all distances are known: the beam is exact
                there = np.flatnonzero(self.levels[:s] >= lv)
                d = self.table[s, there]
                near = np.argsort(d, kind="stable")[: self.ef]
                found = list(zip(d[near].tolist(), there[near].tolist(), strict=True))
            most = self.m * (2 if lv == 0 else 1)
            own = self.choose(found, self.m)
            self.links[s][lv] = np.array(own, np.int32)
            for n in own:
                have = np.append(self.links[n][lv], s).astype(np.int32)
                if len(have) > most:
                    d = self.table[n, have] if self.table is not None else distances(self.v[have], self.v[n], self.metric)
                    have = np.array(self.choose(sorted(zip(d.tolist(), have.tolist(), strict=True)), most), np.int32)
                self.links[n][lv] = have
        if level > top:
            self.entry = s

    def build(self) -> Graph:
        if len(self.v) <= EXACT:
            self.table = between(self.v, self.v, self.metric)
            self.levels = np.array([0 if self.flat else level_of(s, self.m) for s in range(len(self.v))])
        for s in range(len(self.v)):
            self.add(s)
        self.table = self.levels = None
        return self

    def search(self, q: np.ndarray, k: int, ef: int, banned: np.ndarray | None = None) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for lv in range(len(self.links[self.entry]) - 1, 0, -1):
            start = [self.beam(q, start, 1, lv)[0][1]]
        return self.beam(q, start, max(ef, k), 0, banned)[:k]


def _building(m: int, ef: int, metric: str, flat: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        g = g[g["values"].map(len) == len(g["values"].iloc[0])]
        graph = Graph(np.stack(g["values"].to_numpy()).astype(np.float64), m, ef, metric, flat).build()
        return pd.DataFrame({"segment": g["segment"].to_numpy(), "slot": np.arange(len(g), dtype=np.int32), "id": g["id"].to_numpy(), "values": g["values"].to_numpy(), "level": [len(x) - 1 for x in graph.links], "links": [[a.tolist() for a in x] for x in graph.links]})

    return run


def build(vectors: DataFrame, m: int = 16, ef: int = 64, metric: str = "l2", segment_size: int = 10_000, flat: bool = False) -> DataFrame:
    """Nodes of all segments: segment, slot, id, values, level, links (of each level). Rows of other dimensions than a segment's first are left out."""
    own = segments(vectors.select("id", "values"), segment_size).select("segment", "id", "values")
    return own.groupBy("segment").applyInPandas(_building(m, ef, metric, flat), NODES)


PACKED = "segment int, dim int, ids array<string>, vectors binary, entry int, sizes binary, links binary, signatures array<long>"


def packed(nodes: DataFrame) -> DataFrame:
    """One row a segment: vectors, and the links of all levels with their numbers, as bytes. Written so, a search reads segments where they lie.

    ``signatures`` are those of the segment's vectors by sign, for routing.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot")
        v = np.stack(g["values"].to_numpy()).astype(np.float32)
        links = [np.asarray(a, np.int32) for x in g["links"] for a in x]
        sizes = np.array([n for x in g["links"] for n in (len(x), *map(len, x))], np.int32)
        sig = np.unique(((v[:, :24] >= 0) << np.arange(min(24, v.shape[1]))).sum(1))
        row = {"segment": g["segment"].iloc[0], "dim": v.shape[1], "ids": g["id"].tolist(), "vectors": v.tobytes(), "entry": int(g["level"].to_numpy().argmax()), "sizes": sizes.tobytes(), "links": np.concatenate([np.zeros(0, np.int32), *links]).tobytes(), "signatures": sig.tolist()}
        return pd.DataFrame([row])

    return nodes.groupBy("segment").applyInPandas(run, PACKED)


def _vectors(r) -> np.ndarray:
    """The vectors of a packed row, decoded where it is quantized."""
    if getattr(r, "lo", None) is None:
        return np.frombuffer(r.vectors, np.float32).reshape(-1, r.dim)
    lo, hi = np.frombuffer(r.lo, np.float32), np.frombuffer(r.hi, np.float32)
    return lo + (hi - lo) * np.frombuffer(r.vectors, np.uint8).reshape(-1, r.dim).astype(np.float32) / np.float32(255)


def quantized(index: DataFrame) -> DataFrame:
    """packed() segments with a byte a value, of the span that each dimension has in its own segment. Searches walk the codes; rescore() makes their distances exact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lows, highs, codes = [], [], []
            for r in b.itertuples(index=False):
                v = _vectors(r)
                lo, hi = v.min(0), v.max(0)
                span = np.where(hi > lo, hi - lo, np.float32(1))
                codes.append(np.floor(np.clip((v - lo) / span, 0, 1) * np.float32(255) + np.float32(0.5)).astype(np.uint8).tobytes())
                lows.append(lo.tobytes())
                highs.append(hi.tobytes())
            yield b.assign(vectors=codes, lo=lows, hi=highs)

    return index.mapInPandas(run, f"{PACKED}, lo binary, hi binary")


def stored(index: DataFrame) -> DataFrame:
    """segment, id, values of packed() segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"segment": np.int32(r.segment), "id": list(r.ids), "values": list(_vectors(r).astype(np.float32))})

    return index.mapInPandas(run, "segment int, id string, values array<float>")


def catalog(index: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """segment, first_id, last_id, nodes, live of packed() segments."""
    ids = index.select("segment", F.explode("ids").alias("id"))
    if deleted is None:
        ids = ids.withColumn("_gone", F.lit(False))
    else:
        ids = ids.join(deleted.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    return ids.groupBy("segment").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("_gone").isNull() | ~F.col("_gone")).alias("live"))


def mergeable(segment_catalog: DataFrame, most: int = 10_000) -> DataFrame:
    """segment of the leading segments whose live nodes fit one segment together; none where fewer than two do. The window holds a row a segment."""
    so_far = segment_catalog.withColumn("_sum", F.sum("live").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)))
    first = segment_catalog.agg(F.min("segment").alias("_first"))
    own = so_far.crossJoin(F.broadcast(first)).where((F.col("_sum") <= most) | (F.col("segment") == F.col("_first")))
    return own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where("_n > 1").select("segment")


def compacted(index: DataFrame, deleted: DataFrame, most: int = 10_000, m: int = 16, ef: int = 64, metric: str = "l2") -> DataFrame:
    """``index`` with the mergeable() segments rebuilt as one without deleted ids, under the number of the first; the others stay as they are.

    No more than ``most`` vectors meet in the task that builds. ``index`` should be written, since it is read twice.
    """
    chosen = mergeable(catalog(index, deleted), most)
    live = stored(index.join(chosen, "segment", "left_semi")).join(deleted.select("id").distinct(), "id", "left_anti")
    one = chosen.agg(F.min("segment").alias("segment"))
    merged = live.select("id", "values").crossJoin(F.broadcast(one)).select("segment", "id", "values").groupBy("segment").applyInPandas(_building(m, ef, metric, False), NODES)
    return index.join(chosen, "segment", "left_anti").unionByName(packed(merged), allowMissingColumns=True)


def candidates(index: DataFrame, queries: list[tuple[str, list[float]]], k: int, ef: int = 64, metric: str = "l2", deleted: DataFrame | None = None, keep: int | None = None, digits: int | None = None) -> DataFrame:
    """qid, id of all the walk meets that can be among the ``k`` best (or tie with them at ``digits``), given how far quantized vectors may be from those they stand for. For rescore()."""
    hits = _walked(index, queries, k, ef, metric, deleted, keep, digits)
    own = Window.partitionBy("qid")
    placed = hits.withColumn("_n", F.row_number().over(own.orderBy("most", "id")))
    edged = placed.withColumn("_edge", F.max(F.when(F.col("_n") <= k, F.col("most"))).over(own))
    return edged.where(F.col("least") <= F.col("_edge") + _slack(digits)).select("qid", "id")


def rescore(hits: DataFrame, vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """qid, id, distance (L2 squared), rank of the ``k`` best of hits(qid, id), measured on the stored vectors; ids that are gone or of another dimension drop out. ``digits`` as in search()."""
    qs = vectors.sparkSession.createDataFrame([(n, [float(x) for x in q]) for n, q in queries], "qid string, _q array<double>")
    near = vectors.select("id", "values").join(hits.select("qid", "id").distinct(), "id").join(qs, "qid")
    d = K.distance(metric, F.col("_q"), F.col("values"), squared=True)
    return _ranked(near.select("qid", "id", d.alias("distance")).where(~F.isnan("distance")), k, digits)


def search_live(index: DataFrame, changed: DataFrame, deleted: DataFrame, queries: list[tuple[str, list[float]]], k: int, ef: int = 64, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """As search(), of an index and what changed since: ``changed`` vectors (new, moved or revived) are scanned exactly and hide the index's own, ``deleted`` ids are nowhere."""
    fresh = changed.select("id", "values").join(deleted.select("id"), "id", "left_anti")
    hidden = deleted.select("id").unionByName(changed.select("id"))
    qs = index.sparkSession.createDataFrame([(n, [float(x) for x in q]) for n, q in queries], "qid string, q array<double>")
    both = search(index, queries, k, ef, metric, hidden, digits=digits).drop("rank").unionByName(knn_batch(fresh, qs, metric, k, squared=True, digits=digits).drop("rank"))
    return _ranked(both, k, digits)


def _unpacked(r, metric: str) -> Graph:
    graph = Graph(_vectors(r).astype(np.float64), 1, 1, metric)
    sizes, links, at, i = np.frombuffer(r.sizes, np.int32).tolist(), np.frombuffer(r.links, np.int32), 0, 0
    while i < len(sizes):
        own = []
        for n in sizes[i + 1 : i + 1 + sizes[i]]:
            own.append(links[at : at + n])
            at += n
        graph.links.append(own)
        i += 1 + sizes[i]
    graph.entry = int(r.entry)
    return graph


def search(index: DataFrame, queries: list[tuple[str, list[float]]], k: int, ef: int = 64, metric: str = "l2", deleted: DataFrame | None = None, keep: int | None = None, digits: int | None = None) -> DataFrame:
    """qid, id, distance (L2 squared), rank, from packed() segments (or nodes, which are packed first); only hits shuffle.

    ``deleted`` ids still lead the walk but are not returned. With ``keep``, a query searches the segments that hold a vector
    whose signs differ from its own in at most that many places, or all if there is none. The queries are few and travel
    with the tasks. With ``digits``, distances are rounded first and ranked so, and those equal then go by id.
    """
    return _ranked(_walked(index, queries, k, ef, metric, deleted, keep, digits), k, digits)


def _slack(digits: int | None) -> float:
    """What distances that are equal once rounded may be apart."""
    return 0.0 if digits is None else 10.0**-digits


def _off(r) -> float:
    """How far a vector of a packed row may be from the one that its codes stand for: half a step in each dimension, and what float arithmetic adds."""
    if getattr(r, "lo", None) is None:
        return 0.0
    lo, hi = np.frombuffer(r.lo, np.float32).astype(np.float64), np.frombuffer(r.hi, np.float32).astype(np.float64)
    return float(np.linalg.norm((hi - lo) / 510) * 1.001 + 1e-6 * np.linalg.norm(np.maximum(np.abs(lo), np.abs(hi))))


def _bounds(d: np.ndarray, off: float, q: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that vectors at most ``off`` from ``v`` can have, whose own is ``d``."""
    if not off:
        return d, d
    if metric == "l2":
        root = np.sqrt(d)
        return np.maximum(root - off, 0) ** 2, (root + off) ** 2
    if metric == "inner_product":
        by = np.full(len(d), off * np.linalg.norm(q))
    else:  # directions of vectors ``off`` apart differ by at most twice that over the length of either
        by = np.minimum(2, 2 * off / np.maximum(np.linalg.norm(v, axis=1), 1e-300))
    return d - by, d + by


def _ranked(hits: DataFrame, k: int, digits: int | None) -> DataFrame:
    near = hits.select("qid", "id", rounded(F.col("distance"), digits).alias("distance"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)


def _walked(index: DataFrame, queries: list[tuple[str, list[float]]], k: int, ef: int, metric: str, deleted: DataFrame | None, keep: int | None, digits: int | None) -> DataFrame:
    """qid, id, distance, least, most (bounds of the distance before quantizing) of what each segment has for the ``k`` best, with all that ties there once rounded."""
    rows = index if "vectors" in index.columns else packed(index)
    if deleted is not None:
        ids = rows.select("segment", F.explode("ids").alias("id")).join(deleted.select("id").distinct(), "id", "left_semi")
        gone = ids.groupBy("segment").agg(F.collect_set("id").alias("gone"))
        rows = rows.join(gone, "segment", "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<string>"))
    asked = [(name, np.array(q, np.float64), sum(1 << i for i, x in enumerate(q[:24]) if x >= 0)) for name, q in queries]
    if keep is not None:
        sigs = F.array(*[F.struct(F.lit(n).alias("qid"), F.lit(s).cast("long").alias("sig")) for n, _, s in asked])
        apart = lambda s: F.array_min(F.transform("signatures", lambda x: F.bit_count(x.bitwiseXOR(s))))
        near = rows.select("segment", F.inline(F.transform(sigs, lambda q: F.struct(q["qid"].alias("qid"), apart(q["sig"]).alias("apart")))))
        routed = near.where(F.col("apart") <= keep).groupBy("segment").agg(F.collect_set("qid").alias("here"))
        none = [n for n, _, _ in asked if n not in {r[0] for r in near.where(F.col("apart") <= keep).select("qid").distinct().collect()}]
        rows = rows.join(F.broadcast(routed), "segment", "left").withColumn("here", F.array_union(F.coalesce("here", F.array().cast("array<string>")), F.array(*map(F.lit, none)).cast("array<string>")))
        rows = rows.where(F.size("here") > 0)
    else:
        rows = rows.withColumn("here", F.lit(None).cast("array<string>"))

    slack = _slack(digits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                graph, ids, off = _unpacked(r, metric), np.asarray(r.ids, object), _off(r)
                gone = np.isin(ids, list(r.gone)) if r.gone is not None else None
                here = None if r.here is None else set(r.here)
                own = [(n, q) for n, q, _ in asked if len(q) == r.dim and (here is None or n in here)]
                out = []
                for n, q in own:
                    found = graph.search(q, max(k, ef), ef, gone)
                    if not found:
                        continue
                    d, at = np.array([x for x, _ in found]), np.array([s for _, s in found])
                    least, most = _bounds(d, off, q, graph.v[at], metric)
                    edge = np.partition(most, k - 1)[k - 1] + slack if len(d) > k else math.inf
                    out.append(pd.DataFrame({"qid": n, "id": ids[at], "distance": d, "least": least, "most": most})[least <= edge])
                if out:
                    yield pd.concat(out, ignore_index=True)

    return rows.drop("signatures").mapInPandas(run, "qid string, id string, distance double, least double, most double")


def edges(nodes: DataFrame) -> DataFrame:
    """segment, level, a, b of all links."""
    return nodes.select("segment", F.col("slot").alias("a"), F.posexplode("links").alias("level", "to")).select("segment", "level", "a", F.explode("to").alias("b"))


def diagnostics(nodes: DataFrame, m: int) -> DataFrame:
    """segment, nodes, max_degree, self_links, double_links, too_many (nodes above their number of links)."""
    e = edges(nodes)
    degree = e.groupBy("segment", "level", "a").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("u"), F.count_if(F.col("a") == F.col("b")).alias("own"))
    per = degree.groupBy("segment").agg(F.max("n").alias("max_degree"), F.sum("own").alias("self_links"), F.sum(F.col("n") - F.col("u")).alias("double_links"), F.count_if(F.col("n") > F.when(F.col("level") == 0, 2 * m).otherwise(m)).alias("too_many"))
    return nodes.groupBy("segment").agg(F.count(F.lit(1)).alias("nodes")).join(per, "segment", "left")


def reachable(nodes: DataFrame) -> DataFrame:
    """segment, nodes, reached: on the ground level, from the entry. A segment is bounded, so one task walks it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot")
        links = [x[0] for x in g["links"]]
        seen, todo = {int(g["level"].to_numpy().argmax())}, [int(g["level"].to_numpy().argmax())]
        while todo:
            for n in links[todo.pop()]:
                if int(n) not in seen:
                    seen.add(int(n))
                    todo.append(int(n))
        return pd.DataFrame({"segment": [g["segment"].iloc[0]], "nodes": [len(g)], "reached": [len(seen)]})

    return nodes.select("segment", "slot", "level", "links").groupBy("segment").applyInPandas(run, "segment int, nodes long, reached long")


