"""What shows only on many or nearly equal vectors, made small."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from vexil.operators import graph, routing, search


def test_checksum_of_more_records_than_a_long_adds_up(spark):
    n = 140_000
    v = spark.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.lit(0.5).cast("float")).alias("values"))
    total = sum(int(hashlib.sha256(f"{i}|5000".encode()).hexdigest()[:12], 16) for i in range(n))
    assert total >= 1 << 63
    assert tuple(routing.collection_checksum(v, 4).first()) == (n, total % 1_000_000_007)


def twins(spark):
    """40 vectors near the origin's one, of which the farther has the smaller id, by less than rounding to 6 digits shows; one is the very same."""
    rows = [(f"v-{99 - i:02d}", [1.0 + i * 2.0**-23, 0.0]) for i in range(40)]
    return spark.createDataFrame(rows, "id string, values array<float>")


def first_ids(found):
    return [(r["id"], r["distance"]) for r in found.orderBy("rank").collect()]


#: Of the twins, rounded distances are all 0 and the ids decide.
FIRST = [(f"v-{i}", 0.0) for i in range(60, 65)]


def test_graph_search_ranks_rounded_distances(spark):
    index = graph.packed(graph.build(twins(spark), 16, 96, segment_size=40))
    assert first_ids(graph.search(index, [("q", [1.0, 0.0])], 5, 40, digits=6)) == FIRST
    assert [i for i, _ in first_ids(graph.search(index, [("q", [1.0, 0.0])], 5, 40))] == [f"v-{99 - i}" for i in range(5)]


def test_quantized_search_leaves_nothing_out_and_ranks_rounded_distances(spark):
    """50 vectors share their codes with a nearer one, so that no fixed number of candidates does."""
    rows = [(f"a-{i:02d}", [0.5 + (50 - i) * 2e-5, 0.0]) for i in range(50)] + [("lo", [0.0, 0.0]), ("z-hi", [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id string, values array<float>").unionByName(twins(spark))
    index, qs = graph.packed(graph.build(v, 16, 96, segment_size=100)).persist(), [("p", [0.3, 0.0]), ("q", [1.0, 0.0])]
    found = graph.rescore(graph.candidates(graph.quantized(index), qs, 5, 100, digits=6), v, qs, 5, digits=6).persist()
    assert [i for i, _ in first_ids(found.where("qid = 'p'"))] == ["a-49", "a-48", "a-47", "a-46", "a-45"]
    assert first_ids(found.where("qid = 'q'")) == FIRST


def test_bounds_hold_for_all_metrics():
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(500, 8)), rng.normal(size=8)
    v[:3] *= 1e-3
    by = rng.normal(size=v.shape)
    real = v + by / np.linalg.norm(by, axis=1)[:, None] * 0.01
    for metric in ("l2", "inner_product", "cosine"):
        least, most = graph._bounds(graph.distances(v, q, metric), 0.01, q, v, metric)
        d = graph.distances(real, q, metric)
        assert (least <= d + 1e-12).all() and (d <= most + 1e-12).all()


def test_live_search_ranks_rounded_distances(spark):
    """The twins as an index, as what changed since, and half of them each; a deleted one is nowhere."""
    all_ = twins(spark)
    index, none = graph.packed(graph.build(all_, 16, 96, segment_size=40)).persist(), all_.limit(0)
    gone, qs = all_.where("id = 'v-61'").select("id"), [("q", [1.0, 0.0])]
    for changed in (none, all_.coalesce(1), all_.where("int(substr(id, 3)) % 2 = 0").coalesce(1)):
        assert first_ids(graph.search_live(index, changed, gone, qs, 4, 40, digits=6)) == [FIRST[0], *FIRST[2:]]


def test_batch_search_ranks_rounded_distances(spark):
    """Roots as well."""
    v = twins(spark).coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("far", [-1.0, 0.0])], "qid string, q array<double>")
    for squared in (True, False):
        found = search.knn_batch(v, q, k=5, squared=squared, digits=6).persist()
        assert first_ids(found.where("qid = 'q'"))[0][0] == ("v-60" if squared else "v-95")
        want = search.knn_batch(v, q, k=40, squared=squared, digits=6).where("rank <= 5")
        assert first_ids(found.where("qid = 'far'")) == first_ids(want.where("qid = 'far'"))
