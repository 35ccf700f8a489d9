"""Small literal cases, invariants, recall gates, durability and streaming."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.functions import kernels as K
from vexil.operators import filters, graph, ivf, maintenance, quantize, routing, search, text_index
from vexil.plans.collection import Collection
from vexil.sources import changes, store, vectors
from vexil.streaming import ingest


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], m) for i, v, m in rows], vectors.SCHEMA)


def plain(spark, pairs):
    return table(spark, [(i, v, {}) for i, v in pairs])


def ids(df):
    return [r["id"] for r in df.collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_kernels(spark):
    a, b = K.literal([1, 2]), K.literal([1, 5])
    assert one(spark, K.l2(a, b)) == 3 and one(spark, K.squared_l2(a, b)) == 9
    assert one(spark, K.cosine_distance(a, K.literal([0, 0]))) == 1
    assert math.isnan(one(spark, K.cosine_distance(a, K.literal([1, 2, 3])))) and math.isnan(one(spark, K.l2(a, K.literal([1]))))
    assert one(spark, K.norm(K.normalize(K.literal([3, 4])))) == pytest.approx(1)
    assert one(spark, K.normalize(K.literal([0, 0]))) is None and one(spark, K.add(a, K.literal([1]))) is None
    for text in ("", "a", "é", "routing-key-1"):
        h = one(spark, K.fnv1a(F.lit(text)))
        assert h["hi"] << 32 | h["lo"] == routing.fnv64(text)
    assert one(spark, K.encode_cursor(F.lit("a?b>"))) == "YT9iPg" and one(spark, K.decode_cursor(F.lit("YT9iPg=="))) == "a?b>"


def test_single_and_batch(spark):
    v = plain(spark, [("a", (1, 2, 3)), ("b", (1, 2, 4)), ("other", (1, 2))])
    assert ids(search.knn(v, [1, 2, 3.1], 1)) == ["a"]
    qs = spark.createDataFrame([("q1", [1.0, 2.0, 3.1]), (None, [1.0, 2.0, 4.0])], "qid string, q array<double>")
    got = {(r["qid"], r["id"]) for r in search.knn_batch(v, qs, k=1).collect()}
    assert got == {("q1", "a"), ("query-1", "b")}
    for bad in ([], [1.0]):
        with pytest.raises(ValueError):
            search.knn(v, bad, 0)
    with pytest.raises(ValueError):
        search.knn_batch(v, qs, k=101)
    with pytest.raises(ValueError):
        search.knn(v, [1.0], 1, "hamming")


@pytest.mark.parametrize("modulus", [20, 5, 2, 1])
def test_filter_then_rank(spark, modulus):
    v = plain(spark, [(f"v-{i:03d}", (i, 0)) for i in range(200)])
    got = search.knn(v, [0.0, 0.0], 10, where=F.substring("id", 3, 3).cast("int") % modulus == 0).collect()
    assert [r["id"] for r in got] == [f"v-{i * modulus:03d}" for i in range(10)]
    assert got[3]["distance"] == (3 * modulus) ** 2


def test_scales_and_metrics(spark):
    v = plain(spark, [("near", (1, 1)), ("far", (100, 1))])
    assert search.knn(v, [1.0, 4.0], 1).first()["distance"] == 3
    assert search.knn(v, [1.0, 4.0], 1, where=F.lit(True)).first()["distance"] == 9
    assert ids(search.knn(v, [1.0, 0.0], 1, "cosine")) == ["far"] == ids(search.knn(v, [1.0, 0.0], 1, "inner_product"))


def test_multi_and_rerank(spark):
    v = plain(spark, [("near-a", (1, 0.1)), ("near-b", (0.1, 1)), ("far", (9, 9))])
    assert set(ids(search.knn_multi(v, [[1.0, 0.0], [0.0, 1.0]], 2))) == {"near-a", "near-b"}
    assert ids(search.knn_reranked(v, [1.0, 0.0], 3, 3, F.when(F.col("id") == "far", -1.0).otherwise(F.col("distance"))))[0] == "far"


def test_structured(spark):
    v = table(spark, [("raft-hot", (1, 0), {"tier": "hot"}), ("raft-cold", (1, 0), {"tier": "cold"}), ("paxos", (1, 0), {"tier": "hot", "k": ""})])
    c = Collection(v)
    assert ids(c.search([1.0, 0.0], 5, ids=["raft-hot", "raft-cold"], pairs={"tier": "hot"}, text=" RAFT ")) == ["raft-hot"]
    assert ids(v.where(filters.has_metadata({"k": ""}))) == ["paxos"]
    assert ids(filters.with_ids(v, [f"x{i}" for i in range(1001)] + ["paxos"])) == ["paxos"]


def test_text_index(spark):
    rows = spark.createDataFrame([("1", "Distributed systems"), ("2", "other")], "id string, t string")
    p = text_index.text_postings(rows, ["t"])
    assert ids(text_index.search_text(p, "tribut")) == ["1"] and ids(text_index.search_text(p, "t")) == [] and ids(text_index.search_text(p, "!")) == []


def test_merge(spark):
    r = spark.createDataFrame([("b", 1.0), ("c", 3.0), ("a", 1.0), ("d", 2.0), ("same", 9.0), ("same", 1.5)], "id string, distance double")
    assert ids(search.merged(r, 4)) == ["a", "b", "same", "d"]


def test_quantizers(spark):
    v = plain(spark, [("a", (0, 10)), ("b", (10, 20))])
    model = quantize.train_sq(v)
    codes = quantize.encode_sq(plain(spark, [("x", (5, 15)), ("y", (-9, 99))]), model)
    assert {(r["id"], r["dim"]): r["code"] for r in codes.collect()} == {("x", 0): 128, ("x", 1): 128, ("y", 0): 0, ("y", 1): 255}
    assert quantize.approximate_l2(codes.where("id = 'x'"), model, [5.0, 15.0]).first()["distance"] <= 0.01
    assert {r["id"]: bytes(r["codes"]) for r in quantize.packed(codes).collect()} == {"x": b"\x80\x80", "y": b"\x00\xff"}
    with pytest.raises(ValueError):
        quantize.product_codes(codes, 3, 2)


def test_ivf(spark):
    c = spark.createDataFrame([(i, [100.0 * i]) for i in range(4)], "cid int, c array<double>")
    lists = ivf.assign(plain(spark, [(str(n), (x,)) for n, x in enumerate((0, 1, 100, 101, 200, 201, 300, 301))]), c)
    q = spark.createDataFrame([("q", [150.0])], "qid string, q array<double>")
    probed = ivf.adaptive_probes(lists, c, q, 2, 1, least=4, most=4)
    assert [r["id"] for r in ivf.search_lists(lists, probed, 2).orderBy("rank").collect()] == ["3", "2"]
    assert probed.count() == 2 and ivf.evenly(4, 2) == [0, 3]
    near = ivf.probes(spark.createDataFrame([("q", [17.0])], "qid string, q array<double>"), spark.createDataFrame([(i, [10.0 * i]) for i in range(4)], "cid int, c array<double>"), 2)
    assert [r["cid"] for r in near.orderBy("probe").collect()] == [2, 1]
    two = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "cid int, c array<double>")
    a = ivf.assign(plain(spark, [("x", (5,))]), two)
    assert ivf.drift(a, 1.0).first()["needs_retrain"] and not ivf.drift(ivf.assign(plain(spark, [("x", (10,))]), two), 0.0).first()["needs_retrain"]


def uniform(spark, n, dim, seed, scale=None):
    x = np.random.default_rng(seed).random((n, dim)).astype(np.float32) if scale is None else np.random.default_rng(seed).normal(size=(n, dim)) * scale(np.arange(n))[:, None]
    return spark.createDataFrame([(f"v-{i:06d}", [float(y) for y in r]) for i, r in enumerate(x)], "id string, values array<float>").repartition(4), x


def recall(spark, v, found, qs, metric="l2"):
    q = spark.createDataFrame(qs, "qid string, q array<double>")
    return search.ann_quality(found, search.knn_batch(v, q, metric, k=10, squared=True)).first()["recall"]


def queries(dim, n, seed):
    return [(f"q{i}", [float(y) for y in r]) for i, r in enumerate(np.random.default_rng(seed).random((n, dim)))]


def test_hnsw_recall_and_shape(spark):
    v, _ = uniform(spark, 3000, 32, 91)
    nodes = graph.build(v, 16, 96).persist()
    qs = queries(32, 40, 7)
    assert recall(spark, v, graph.search(nodes, qs, 10, 128), qs) >= 0.98
    d = graph.diagnostics(nodes, 16).first()
    assert d["self_links"] == d["double_links"] == d["too_many"] == 0
    r = graph.reachable(nodes).first()
    assert r["reached"] >= 0.99 * r["nodes"]
    gone = v.where("id < 'v-001000'").select("id")
    assert all(r["id"] >= "v-001000" for r in graph.search(nodes, qs, 10, 128, deleted=gone).collect())


def test_routed_search(spark):
    """Segments of different signs: a query reads its own, and finds what a search of all finds."""
    x = np.random.default_rng(6).random((1200, 24)) + 0.1
    signs = np.where(np.arange(24)[None, :] % 6 == np.arange(6)[:, None], -1, 1).repeat(200, 0)
    v = spark.createDataFrame([(f"v-{i:06d}", [float(y) for y in r]) for i, r in enumerate(x * signs)], "id string, values array<float>")
    index = graph.packed(graph.build(v, 16, 96, segment_size=200)).persist()
    qs = [(f"q{i}", [float(y) for y in (x * signs)[i * 60 + 3]]) for i in range(20)] + [("far", [0.5] * 24)]
    routed = graph.search(index, qs, 10, 128, keep=2)
    assert recall(spark, v, routed, qs) >= 0.95 and index.count() == 6
    assert {r["qid"] for r in routed.collect()} == {n for n, _ in qs}


@pytest.mark.parametrize("metric", ["cosine", "inner_product"])
def test_segmented_metric_recall(spark, metric):
    v, _ = uniform(spark, 2000, 32, 84, lambda i: 0.5 + (i % 17) / 8)
    qs = queries(32, 20, 8)
    assert recall(spark, v, graph.search(graph.build(v, 16, 128, metric, 500), qs, 10, 512, metric), qs, metric) >= 0.95


@pytest.mark.parametrize(("profile", "least"), [("fast", 0.5), ("balanced", 0.8), ("quality", 0.85)])
def test_flat_graph_recall(spark, profile, least):
    v, _ = uniform(spark, 512, 3, 5)
    p, qs = graph.PROFILES[profile], queries(3, 20, 9)
    assert recall(spark, v, graph.search(graph.build(v, p.m, p.ef_construction, flat=True), qs, 10, p.ef_search), qs) >= least


def test_collection_plans(spark):
    v, x = uniform(spark, 400, 8, 3)
    v = v.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    q = [float(y) for y in x[5]]
    exact = Collection(v).search(q, 5).collect()
    assert [r["id"] for r in Collection(v).with_ivf(8, 8).search(q, 5).collect()] == [r["id"] for r in exact]
    assert [r["id"] for r in Collection(v).with_graph().search(q, 5).collect()] == [r["id"] for r in exact]
    assert exact[0]["distance"] == 0


def test_routing_moves_few_keys(spark):
    names = ["node-a", "node-b", "node-c", "node-d"]
    keys = spark.range(100_000).select(F.concat(F.lit("routing-key-"), F.col("id").cast("string")).alias("id"))
    m = routing.movement(routing.rendezvous_shard(F.col("id"), names[:3]), routing.rendezvous_shard(F.col("id"), names), 3, keys).first()
    assert m["moved"] == m["moved_to_new"] and 0.2 <= m["moved"] / m["keys"] <= 0.3


def test_map_and_tiers(spark):
    p = maintenance.vector_map(plain(spark, [("a", (1, 0, 2)), ("b", (0, 1, 2)), ("c", (2, 1, 0))]), 3).collect()
    assert len(p) == 3 and all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in p)
    t = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' now, explode(array(timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-01', timestamp_ntz'2023-12-26', timestamp_ntz'2023-12-25')) t")
    assert [r[0] for r in t.select(maintenance.tier(F.col("t"), F.col("now"))).collect()] == ["hot", "hot", "warm", "cold"]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "c"))
    assert s.read().count() == 0
    s.insert(table(spark, [("a", (1, 2), {"k": "1"}), ("b", (3, 4), {})]))
    with pytest.raises(store.Conflict):
        s.insert(table(spark, [("c", (1, 1), {}), ("a", (9, 9), {})]))
    with pytest.raises(store.Conflict):
        s.insert(table(spark, [("d", (1, 1), {}), ("d", (2, 2), {})]))
    assert sorted(ids(s.read())) == ["a", "b"]
    two = s.upsert(table(spark, [("a", (5, 6), {"k": "2"})]))
    s.set_metadata(spark.createDataFrame([("b", {"m": "x"})], "id string, metadata map<string,string>"))
    s.delete(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(KeyError):
        s.delete(spark.createDataFrame([("zz",)], "id string"))
    assert {r["id"]: r["metadata"] for r in s.read().collect()} == {"b": {"m": "x"}}
    assert {r["id"]: list(r["values"]) for r in s.read(two).collect()} == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    full = s.files()
    before = s.read().collect()
    s.compact()
    assert s.read().collect() == before and full.count() == maintenance.restored([full, maintenance.backup_diff(full, full)]).count()
    s.upsert(table(spark, [("a", (7, 7), {})]))
    assert sorted(ids(s.read())) == ["a", "b"]
    blobs = spark.createDataFrame([("n1", bytearray(b"secret"))], "key string, content binary")
    locked = store.encrypted(blobs, "00" * 16).collect()
    assert bytes(locked[0]["content"]) != b"secret"
    assert bytes(store.decrypted(spark.createDataFrame(locked, blobs.schema), "00" * 16).first()["content"]) == b"secret"
    store.export_snapshot(s.read(), str(tmp_path / "snap"))
    assert sorted(ids(store.import_snapshot(spark, str(tmp_path / "snap")))) == ["a", "b"]


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": f"v{i}", "values": [n, i], "metadata": {"n": str(n)}}) for i in range(n, n + 3)))
    s = store.Store(spark, str(tmp_path / "c"))
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(ingest.read_ndjson(spark, str(src)), s, str(tmp_path / "ck")).awaitTermination()
    assert len(s.versions()) == 3 and sorted(ids(s.read())) == [f"v{i}" for i in range(5)]
    s.delete(spark.createDataFrame([("v0",)], "id string"))
    copy = store.Store(spark, str(tmp_path / "copy"))
    ingest.replicate(ingest.follow(spark, str(tmp_path / "c" / "parts"), 100), copy, str(tmp_path / "ck2")).awaitTermination()
    assert routing.migration_delta(s.read(), copy.read()).count() == 0 and copy.read().count() == 4
    s.upsert(table(spark, [("x", (1, 1), {"k": "1"}), ("y", (2, 2), {})]))
    s.set_metadata(spark.createDataFrame([("x", {"m": "2"}), ("v1", {"m": "3"})], "id string, metadata map<string,string>"))
    s.delete(spark.createDataFrame([("y",), ("v2",)], "id string"))
    ingest.replicate(ingest.follow(spark, str(tmp_path / "c" / "parts"), 100), copy, str(tmp_path / "ck2")).awaitTermination()
    state = lambda t: {r["id"]: (list(r["values"]), r["metadata"]) for r in t.read().collect()}
    assert state(copy) == state(s) and state(copy)["x"] == ([1.0, 1.0], {"m": "2"}) and not {"y", "v2"} & set(state(copy))
    seen = []
    ingest.retrain_when_drifted(ingest.read_ndjson(spark, str(src), 10), lambda d: d.agg(F.lit(True).alias("needs_retrain")), lambda d: seen.append(d.count()), str(tmp_path / "ck3")).awaitTermination()
    assert seen == [9]


def test_replay_rules(spark):
    rows = [(1, "upsert", "a", [1.0], {"k": "1"}), (2, "delete", "a", None, None), (3, "upsert", "a", [2.0], None), (4, "metadata", "a", None, {"z": "9"}), (5, "upsert", " ", [1.0], None), (6, "upsert", "b", [], None), (7, "noise", "c", [1.0], None), (8, "metadata", "d", None, {"q": "1"})]
    log = spark.createDataFrame(rows, store.LOG_SCHEMA)
    got = changes.state(log).collect()
    assert [(r["id"], list(r["values"]), r["metadata"], r["offset"]) for r in got] == [("a", [2.0], {"z": "9"}, 4)]


def test_plans_keep_what_matters(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    v = vectors.from_tables(spark, sf)
    assert "TakeOrderedAndProject" in plan(search.knn(v, [0.1] * 64, 5))
    qs = spark.createDataFrame([("q", [0.1] * 64)], "qid string, q array<double>")
    assert "WindowGroupLimit" in plan(search.knn_batch(v, qs, k=5))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan(search.knn(v, [0.1] * 64, 5, where=F.col("label") == 3))
