"""The user's view of a collection: which plan answers a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, graph, ivf, search


class Collection:
    """Searches over vectors (id, values, metadata, perhaps namespace). An index answers plain L2 searches; filters and other metrics scan, unless the index has the metric. An index that finds nothing falls back to the scan."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors
        self.lists: DataFrame | None = None
        self.centroids: DataFrame | None = None
        self.nprobe = 1
        self.nodes: DataFrame | None = None
        self.metric = "l2"
        self.ef = 64
        self.changed: DataFrame | None = None
        self.deleted: DataFrame | None = None

    def with_changes(self, changed: DataFrame, deleted: DataFrame) -> Collection:
        """Vectors that are new or other than when the graph was built, and ids that are gone; ``vectors`` must be the state after them."""
        self.changed, self.deleted = changed, deleted
        return self

    def warm(self) -> int:
        """Build the index before the first search; its segments or entries."""
        held = self.nodes if self.nodes is not None else self.lists
        return held.persist().count() if held is not None else 0

    def with_ivf(self, k: int, nprobe: int, iterations: int = 8) -> Collection:
        self.centroids = ivf.kmeans(self.vectors, k, iterations).persist()
        self.lists, self.nprobe = ivf.assign(self.vectors, self.centroids), nprobe
        return self

    def with_graph(self, profile: str = "balanced", metric: str = "l2", segment_size: int = 10_000, flat: bool = False) -> Collection:
        p = graph.PROFILES[profile]
        self.nodes = graph.packed(graph.build(self.vectors, p.m, p.ef_construction, metric, segment_size, flat)).persist()
        self.metric, self.ef = metric, p.ef_search
        return self

    def quantized(self) -> Collection:
        """The graph's segments with a byte a value; hits are measured on the stored vectors."""
        self.nodes = graph.quantized(self.nodes).persist()
        return self

    def search(self, q: list[float], k: int, metric: str = "l2", ids: list[str] | None = None, pairs: dict[str, str] | None = None, text: str | None = None, namespace: str | None = None, where: Column | None = None) -> DataFrame:
        """id, distance."""
        search.check(q, k)
        asked = where
        if ids or pairs or (text and text.strip()):
            own = filters.structured(ids, pairs, text)
            asked = own if asked is None else asked & own
        if namespace:
            own = filters.in_namespace(namespace)
            asked = own if asked is None else asked & own
        if asked is None and self.nodes is not None and metric == self.metric:
            most = min(4 * k, 4 * search.MAX_K) if metric == "l2" else max(20 * k, 100)  # candidates, measured anew on the stored vectors
            beam = max(self.ef, most)
            if self.changed is not None or self.deleted is not None:
                none = self.vectors.select("id", "values").limit(0)
                found = graph.search_live(self.nodes, self.changed if self.changed is not None else none, self.deleted if self.deleted is not None else none, [("q", q)], most, beam, metric)
            else:
                found = graph.search(self.nodes, [("q", q)], most, beam, metric)
            hits = graph.rescore(found, self.vectors, [("q", q)], k, metric)
        elif asked is None and self.lists is not None and metric == "l2":
            spark = self.vectors.sparkSession
            one = spark.createDataFrame([("q", [float(x) for x in q])], "qid string, q array<double>")
            hits = ivf.search(self.lists, self.centroids, one, k, self.nprobe)
        else:
            return search.knn(self.vectors, q, k, metric, asked)
        hits = hits.select("id", (F.sqrt("distance") if metric == "l2" else F.col("distance")).alias("distance")).orderBy("distance", "id")
        found = hits.collect()  # k rows at most
        return hits.sparkSession.createDataFrame(found, hits.schema) if found else search.knn(self.vectors, q, k, metric)

    def search_batch(self, queries: DataFrame, k: int | None = None, metric: str = "l2") -> DataFrame:
        return search.knn_batch(self.vectors, queries, metric, k)
