"""Segments, shards, moves and blobs on a file system."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.operators import graph, routing, search
from vexil.plans.collection import Collection
from vexil.sources import changes, vectors
from vexil.sources.segments import SegmentCatalog
from vexil.sources.shards import COMPLETE, DRAINING, Migration, Shards
from vexil.sources.store import Blobs, Conflict, Store


def rows(spark, n, dim=4, seed=1, start=0):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype(float)
    return spark.createDataFrame([(f"v-{start + i:04d}", x.tolist(), {}) for i, x in enumerate(v)], vectors.SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def index(spark):
    return graph.packed(graph.build(rows(spark, 60), 8, 32, segment_size=20)).persist()


def test_segments_are_published_together(spark, tmp_path, index):
    c = SegmentCatalog(spark, str(tmp_path / "a"))
    with pytest.raises(KeyError):
        c.index()
    first, second = c.stage(index.where("segment = 0")), c.stage(index.where("segment > 0"))
    assert c.versions() == []
    v = c.publish([first, second], 7)
    assert c.publish([first, second], 7) == v and c.index().count() == 3 and c.damaged().count() == 0
    assert ids(c.locations()) == ids(rows(spark, 60)) and c.locations().where("segment = 1").count() == 20
    assert c.unpublish([first]) == v + 1 and c.index().count() == 2 and c.index(v).count() == 3
    assert c.locations().count() == 40


def test_damage_is_found(spark, tmp_path, index):
    c = SegmentCatalog(spark, str(tmp_path / "a"))
    c.publish([c.stage(index)])
    part = c.new_part(c.manifest())
    c.index().withColumn("ids", F.when(F.col("segment") == 1, F.reverse("ids")).otherwise(F.col("ids"))).write.parquet(f"{c.path}/{part}")
    c.publish([part], replace=True)
    assert [(r["segment"], r["fault"]) for r in c.damaged().collect()] == [(1, "digest")]
    with pytest.raises(Conflict):
        c.export_to(SegmentCatalog(spark, str(tmp_path / "b")))


def test_export_and_retry(spark, tmp_path, index):
    a, b = (SegmentCatalog(spark, str(tmp_path / x)) for x in "ab")
    a.publish([a.stage(index)], 11)
    v = a.export_to(b)
    assert a.export_to(b) == v and b.manifest()["offset"] == 11 and b.index().count() == 3
    q = [("q", [0.1, 0.2, 0.3, 0.4])]
    assert [r["id"] for r in graph.search(b.index().drop("digest"), q, 5).orderBy("rank").collect()] == [r["id"] for r in graph.search(index, q, 5).orderBy("rank").collect()]
    other = SegmentCatalog(spark, str(tmp_path / "c"))
    other.publish([other.stage(graph.packed(graph.build(rows(spark, 20, seed=2), 8, 32, segment_size=20)))])
    with pytest.raises(Conflict):
        a.export_to(other)


def test_quantized_segments(spark, index):
    codes = graph.quantized(index)
    assert codes.selectExpr("max(length(vectors)) n").first()["n"] == 20 * 4
    close = graph.stored(codes).alias("a").join(graph.stored(index).alias("b"), "id").selectExpr("max(aggregate(zip_with(a.values, b.values, (x, y) -> abs(x - y)), 0f, (s, x) -> greatest(s, x))) d").first()["d"]
    assert 0 < close < 0.02


def test_compaction_takes_leading_segments(spark, index):
    none, all_ = index.selectExpr("'-' id").limit(0), rows(spark, 60).select("id")
    assert graph.mergeable(graph.catalog(index), 20).count() == 0
    assert graph.compacted(index, none, 20).count() == 3
    assert [r["segment"] for r in graph.mergeable(graph.catalog(index), 40).orderBy("segment").collect()] == [0, 1]
    gone = all_.where("id < 'v-0015'")
    merged = graph.compacted(index, gone, 45)
    assert sorted((r["segment"], r["nodes"]) for r in graph.catalog(merged).collect()) == [(0, 45)]
    assert ids(graph.stored(merged)) == ids(all_.join(gone, "id", "left_anti"))


def test_collection_with_changes(spark):
    v = rows(spark, 80)
    moved = spark.createDataFrame([("v-0003", [9.0] * 4, {}), ("new", [9.0, 9.0, 9.0, 8.0], {})], vectors.SCHEMA)
    gone = v.where("id = 'v-0007'").select("id")
    state = v.join(moved.select("id").unionByName(gone), "id", "left_anti").unionByName(moved)
    c = Collection(state)
    c.nodes = graph.packed(graph.build(v, 8, 64, segment_size=40)).persist()
    c.with_changes(moved, gone)
    assert c.warm() == 2
    for q in ([9.0] * 4, v.where("id = 'v-0007'").first()["values"]):
        want = search.knn(state, list(q), 5).collect()
        got = c.search(list(q), 5).collect()
        assert [r["id"] for r in got] == [r["id"] for r in want]
        assert [r["distance"] for r in got] == pytest.approx([r["distance"] for r in want])
    assert [r["id"] for r in c.quantized().search([9.0] * 4, 2).collect()] == ["v-0003", "new"]


def shards(spark, tmp_path, n=3):
    return Shards([Store(spark, str(tmp_path / f"s{i}")) for i in range(n)], lambda c: routing.modulo_shard(c, n))


def test_batch_over_shards_is_whole_or_undone(spark, tmp_path):
    s = shards(spark, tmp_path)
    assert s.insert(rows(spark, 30)) == [0, 1, 2] and ids(s.read()) == ids(rows(spark, 30))
    assert sum(x.read().count() for x in s.stores) == 30
    last = s.stores[2].read().first()["id"]
    fresh = rows(spark, 20, start=100)
    with pytest.raises(Conflict):
        s.insert(fresh.unionByName(fresh.limit(1).withColumn("id", F.lit(last))))
    assert ids(s.read()) == ids(rows(spark, 30))


def test_migration_goes_on_where_it_stopped(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.insert(rows(spark, 20))
    moves = F.col("id") < "v-0010"
    m = Migration(spark, str(tmp_path / "m"), a, b, moves)
    m.copy()
    a.upsert(spark.createDataFrame([("v-0001", [5.0, 5.0, 5.0, 5.0], {}), ("v-0015", [5.0], {})], vectors.SCHEMA))
    a.delete(rows(spark, 3).where("id = 'v-0002'").select("id"))
    again = Migration(spark, str(tmp_path / "m"), a, b, moves)
    assert again.state()["state"] == DRAINING and again.state()["copied"] == 10
    assert again.run()["state"] == COMPLETE and again.differences().count() == 0
    assert ids(b.read()) == [f"v-{i:04d}" for i in range(10) if i != 2]
    assert Migration(spark, str(tmp_path / "m"), a, b, moves).run()["state"] == COMPLETE


def test_migration_of_a_restless_source(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.insert(rows(spark, 4))
    m = Migration(spark, str(tmp_path / "m"), a, b, F.lit(True), rounds=1)
    m.copy()
    a.upsert(rows(spark, 1, seed=3))
    with pytest.raises(RuntimeError):
        m.run()
    assert m.run()["state"] == COMPLETE


def test_blobs(spark, tmp_path):
    s = Blobs(spark, str(tmp_path / "blobs"))
    s.put("a/x", b"\x00\xff1")
    s.put("a/x", b"two")
    s.put("b", b"")
    assert s.get("a/x") == b"two" and s.get("b") == b""
    assert [(r["key"], r["bytes"], bytes(r["content"])) for r in s.all("a/").collect()] == [("a/x", 3, b"two")]
    s.delete("a/x")
    s.delete("a/x")
    with pytest.raises(KeyError):
        s.get("a/x")
    for bad in ("", "/a", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            s.put(bad, b"")


def test_reserved_numbers(spark):
    known = spark.createDataFrame([("a", 1), ("c", 5)], "id string, internal long")
    asked = spark.createDataFrame([("b",), ("c",), ("b",), ("d",)], "id string")
    assert sorted(tuple(r) for r in changes.reserve(known, asked).collect()) == [("b", 6), ("c", 5), ("d", 7)]
    assert sorted(tuple(r) for r in changes.reserve(known.limit(0), asked).collect()) == [("b", 1), ("c", 2), ("d", 3)]
    with pytest.raises(ValueError):
        changes.reserve(known, spark.createDataFrame([(" ",)], "id string"))
