"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import filters, ivf, maintenance, quantize, routing, search, text_index
from ..sources import changes, vectors
from ..sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
#: The vectors that a multi-vector query asks for, the ids that batch and index queries ask for, and a fixed "now".
ASKED = (3, 17, 42)
EVERY = 100
#: Points of a page of the vector map.
PAGE = 180
NOW = "2024-01-31 00:00:00"
SHARDS = ["node-a", "node-b", "node-c", "node-d"]
DIM = 64
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def base(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.from_tables(spark, sf)


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors times 1 + label, so that the metrics rank differently."""
    return base(spark, sf).withColumn("values", F.transform("values", lambda x: x.cast("double") * (1 + F.col("label"))))


def vector(spark: SparkSession, sf: str, n: int, of: Callable = base) -> list[float]:
    """One stored vector, by its id."""
    return list(of(spark, sf).where(F.col("vec_id") == n).select(F.col("values").cast("array<double>")).first()[0])


def asked(spark: SparkSession, sf: str, of: Callable = base) -> DataFrame:
    return of(spark, sf).where(F.col("vec_id") % EVERY == 0).select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("qid"), F.col("values").alias("q"), (F.col("vec_id") % 7 + 2).cast("int").alias("k"))


@query
def knn_exact_l2(spark, sf):
    return search.knn(base(spark, sf), vector(spark, sf, 7), 10, digits=6)


@query
def knn_exact_cosine(spark, sf):
    return search.knn(scaled(spark, sf), vector(spark, sf, 7, scaled), 10, "cosine", digits=6)


@query
def knn_exact_ip(spark, sf):
    return search.knn(scaled(spark, sf), vector(spark, sf, 7, scaled), 10, "inner_product", digits=6)


@query
def knn_batch_l2(spark, sf):
    return search.knn_batch(base(spark, sf), asked(spark, sf), k=10, digits=6)


@query
def knn_batch_cosine(spark, sf):
    return search.knn_batch(scaled(spark, sf), asked(spark, sf, scaled), "cosine", k=10, digits=6)


@query
def knn_batch_ip(spark, sf):
    return search.knn_batch(scaled(spark, sf), asked(spark, sf, scaled), "inner_product", k=10, digits=6)


@query
def knn_batch_var_k(spark, sf):
    return search.knn_batch(base(spark, sf), asked(spark, sf), digits=6)


@query
def knn_filter_ids(spark, sf):
    ids = [f"v-{i:06d}" for i in range(0, 400, 13)]
    return search.knn(base(spark, sf), vector(spark, sf, 7), 10, where=filters.structured(ids=ids), digits=6)


@query
def knn_candidates(spark, sf):
    ids = base(spark, sf).where("vec_id % 13 = 0 and vec_id < 400").select("id")
    return search.knn(filters.with_ids(base(spark, sf), ids), vector(spark, sf, 7), 10, squared=True, digits=6)


@query
def knn_filter_meta(spark, sf):
    return search.knn(base(spark, sf), vector(spark, sf, 7), 10, where=filters.has_metadata({"label": "3", "lang": "en"}, vectors.metadata()), digits=6)


@query
def knn_filter_text(spark, sf):
    return search.knn(base(spark, sf), vector(spark, sf, 7), 10, where=filters.has_text(" SRC1 ", metadata=vectors.metadata()), digits=6)


@query
def knn_structured(spark, sf):
    where = filters.structured([f"v-{i:06d}" for i in range(0, 500, 3)], {"lang": "en"}, "src", metadata=vectors.metadata())
    return search.knn(base(spark, sf), vector(spark, sf, 7), 10, where=where, digits=6)


@query
def knn_namespace(spark, sf):
    return search.knn(base(spark, sf), vector(spark, sf, 7), 10, "cosine", where=filters.in_namespace("src5", "source"), digits=6)


def _selective(n: int) -> Query:
    return lambda spark, sf: search.knn(base(spark, sf), vector(spark, sf, 7), 10, where=F.col("vec_id") % n == 0, digits=6)


for share, modulus in ((5, 20), (20, 5), (50, 2), (100, 1)):
    QUERIES[f"knn_selectivity_{share:02d}"] = _selective(modulus)


@query
def knn_multi_vector(spark, sf):
    return search.knn_multi(base(spark, sf), [vector(spark, sf, n) for n in ASKED], 10, digits=6)


@query
def knn_rerank(spark, sf):
    return search.knn_reranked(base(spark, sf), vector(spark, sf, 7), 10, 50, F.col("distance") * (1 + F.col("label") % 3), digits=6)


@query
def vec_kernels(spark, sf):
    v, q = F.col("values"), K.literal([1 / (i + 1) for i in range(DIM)])
    r = lambda c: F.round(c, 6)
    return base(spark, sf).select("id", r(K.l2(v, q)).alias("l2"), r(K.squared_l2(v, q)).alias("l2sq"), r(K.cosine_distance(v, q)).alias("cosine"), r(K.inner_product_distance(v, q)).alias("ip"), r(K.norm(v)).alias("length"), F.isnan(K.l2(v, F.slice(q, 1, 3))).alias("mismatch"), K.cosine_distance(v, F.transform(q, lambda x: x * 0)).alias("zero"))


@query
def vec_l2_float(spark, sf):
    q = K.literal([1 / (i + 1) for i in range(DIM)])
    return base(spark, sf).select("id", F.round(K.squared_l2_float(F.col("values"), q), 6).alias("l2sq"))


def _long(spark, sf, f: Callable[[Column, Column], Column]) -> DataFrame:
    other = K.literal([i / 10 for i in range(DIM)])
    return base(spark, sf).select("id", F.posexplode(f(F.col("values"), other)).alias("dim", "v")).select("id", "dim", F.round("v", 6).alias("value"))


@query
def vec_add(spark, sf):
    return _long(spark, sf, K.add)


@query
def vec_sub(spark, sf):
    return _long(spark, sf, K.subtract)


@query
def vec_normalize(spark, sf):
    return _long(spark, sf, lambda v, o: K.normalize(K.add(v, o)))


@query
def validate_requests(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    values = F.when(F.col("p_size") % 5 != 0, F.array_repeat(F.lit(1.0), (F.col("p_size") % 5 * 1500).cast("int"))).otherwise(F.array().cast("array<double>"))
    return p.select("p_partkey", vectors.error_code(values, F.col("p_size") * 5 - 20).alias("fault"))


@query
def scan_ordered(spark, sf):
    return routing.segments(base(spark, sf).select("id", "label"), 1).select("id", "label", F.col("segment").cast("long").alias("position"))


@query
def scan_from_offset(spark, sf):
    return scan_ordered(spark, sf).where("position >= 100").select("id")


@query
def scan_selected(spark, sf):
    return filters.with_ids(base(spark, sf), [f"v-{i:06d}" for i in range(0, 300, 11)]).select("id", "label", F.round(F.element_at("values", 1).cast("double"), 6).alias("first"))


@query
def scan_ids(spark, sf):
    return base(spark, sf).select("id")


@query
def get_vector(spark, sf):
    return base(spark, sf).where("id = 'v-000042'").select("id", F.posexplode("values").alias("dim", "v")).select("id", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


@query
def list_page(spark, sf):
    return changes.page(base(spark, sf), "v-000100", 50).select("id", F.round(F.element_at("values", 1).cast("double"), 6).alias("first"))


@query
def list_page_ids(spark, sf):
    return changes.page(base(spark, sf), None, 100, ids_only=True)


@query
def cursor_codec(spark, sf):
    c = K.encode_cursor(F.col("id"))
    return base(spark, sf).select("id", c.alias("cursor"), K.decode_cursor(c).alias("decoded"))


@query
def count_vectors(spark, sf):
    return base(spark, sf).agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("label").alias("labels"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("offset"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("id"), F.array(F.col("value").cast("float")).alias("values"), F.lit(None).cast("map<string,string>").alias("metadata"))


@query
def state_replay(spark, sf):
    return changes.state(log(spark, sf)).select("id", F.round(F.element_at("values", 1).cast("double"), 4).alias("value"), "offset")


@query
def latest_change(spark, sf):
    return changes.latest(log(spark, sf)).select("id", "op", "offset")


@query
def delta_since(spark, sf):
    return changes.since(log(spark, sf), 500).select("offset", "id", "op")


@query
def insert_conflicts(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    batch = s.select(F.col("s_nationkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 9 != 0, F.array(F.col("s_acctbal").cast("float"))).alias("values"))
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("id"))
    return changes.insert_faults(batch, n)


@query
def delete_anti(spark, sf):
    gone = base(spark, sf).where("label = 4").select("id")
    return changes.without(base(spark, sf).select("id", "label"), gone)


@query
def delete_missing(spark, sf):
    asked_ids = spark.range(0, 5000, 250).select(F.format_string("v-%06d", "id").alias("id"))
    return changes.missing(asked_ids, base(spark, sf))


@query
def id_mapping(spark, sf):
    return changes.id_mapping(base(spark, sf))


@query
def id_reserve(spark, sf):
    known = changes.id_mapping(base(spark, sf).where("label < 5"))
    return changes.reserve(known, base(spark, sf).select("id").unionByName(base(spark, sf).where("label = 7").select("id")))


@query
def id_mapping_conflicts(spark, sf):
    known = changes.id_mapping(base(spark, sf))
    other = base(spark, sf).select("id", F.when(F.col("vec_id") % 10 == 0, F.col("vec_id") + 2).otherwise(F.col("vec_id") + 1).alias("internal"))
    return changes.mapping_conflicts(known, other)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select("id", "lang", "source")


@query
def text_ngram_postings(spark, sf):
    return text_index.text_postings(_texts(spark, sf), ["lang", "source"]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def text_search(spark, sf):
    return text_index.search_text(text_index.text_postings(_texts(spark, sf), ["id", "lang", "source"]), "SRC1 en")


@query
def meta_postings(spark, sf):
    rows = base(spark, sf).withColumn("metadata", vectors.metadata())
    return text_index.metadata_postings(rows, F.col("metadata")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query
def sq_train(spark, sf):
    return quantize.train_sq(base(spark, sf)).select("dim", F.round(F.col("lo").cast("double"), 6).alias("lo"), F.round(F.col("hi").cast("double"), 6).alias("hi"))


@query
def sq_encode(spark, sf):
    v = base(spark, sf)
    return quantize.encode_sq(v, quantize.train_sq(v))


@query
def sq_approx_l2(spark, sf):
    v = base(spark, sf)
    model = quantize.train_sq(v)
    return quantize.approximate_l2(quantize.encode_sq(v, model), model, vector(spark, sf, 7)).select("id", F.round("distance", 4).alias("distance"))


@query
def pq_codes(spark, sf):
    v = base(spark, sf)
    return quantize.product_codes(quantize.encode_sq(v, quantize.train_sq(v)), DIM, 8).groupBy("id", "subspace").agg(F.sum("code").alias("total"))


@query
def opq_perm(spark, sf):
    return quantize.permutation(base(spark, sf), digits=6)


@query
def opq_codes(spark, sf):
    v = base(spark, sf)
    return quantize.permuted_codes(v, quantize.permutation(v, digits=6), quantize.train_sq(v), DIM, 8).groupBy("id", "subspace").agg(F.sum("code").alias("total"))


LISTS, PROBES = 16, 3


def _ivf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = ivf.pick(base(spark, sf), LISTS)
    return ivf.assign(base(spark, sf), c, digits=6), c


@query
def ivf_bootstrap(spark, sf):
    return ivf.pick(base(spark, sf), LISTS).select("cid", F.posexplode("c").alias("dim", "v")).select("cid", "dim", F.round("v", 6).alias("value"))


@query
def ivf_assign(spark, sf):
    return _ivf(spark, sf)[0].select("id", "cid", "d2")


@query
def ivf_lloyd_step(spark, sf):
    return ivf.lloyd_step(_ivf(spark, sf)[0], digits=6)


@query
def ivf_search(spark, sf):
    lists, c = _ivf(spark, sf)
    return ivf.search(lists, c, asked(spark, sf), 5, PROBES, digits=6)


@query
def ivf_adaptive(spark, sf):
    lists, c = _ivf(spark, sf)
    return ivf.search_lists(lists, ivf.adaptive_probes(lists, c, asked(spark, sf), 5, 1, least=100, digits=6), 5, digits=6)


@query
def ivf_tombstones(spark, sf):
    lists, c = _ivf(spark, sf)
    live = ivf.without(lists, base(spark, sf).where("label = 4").select("id"))
    return ivf.search(live, c, asked(spark, sf), 5, PROBES, digits=6)


@query
def ivf_drift(spark, sf):
    return ivf.drift(_ivf(spark, sf)[0], 0.5, digits=6)


@query
def ann_ivf_eval(spark, sf):
    exact = search.knn_batch(base(spark, sf), asked(spark, sf), k=5, squared=True, digits=6)
    return search.ann_quality(ivf_search(spark, sf), exact)


@query
def route_signature(spark, sf):
    return base(spark, sf).select("id", K.sign_signature(F.col("values")).alias("sig"))


@query
def route_hamming(spark, sf):
    sig = sum(1 << i for i, x in enumerate(vector(spark, sf, 7)[:24]) if x >= 0)
    return base(spark, sf).select("id", K.hamming(K.sign_signature(F.col("values")), F.lit(sig).cast("long")).cast("int").alias("distance"))


@query
def route_segments(spark, sf):
    segmented = routing.segments(base(spark, sf), 20)
    return routing.route(routing.routes(segmented), vector(spark, sf, 7), least=3, keep=5, reach=6)


@query
def shard_modulo(spark, sf):
    return base(spark, sf).select("id", routing.modulo_shard(F.col("id"), 7).alias("shard"))


@query
def shard_rendezvous(spark, sf):
    return base(spark, sf).select("id", routing.rendezvous_shard(F.col("id"), SHARDS).alias("shard"))


@query
def shard_movement(spark, sf):
    keys = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("routing-key-"), F.col("c_custkey").cast("string")).alias("id"))
    return routing.movement(routing.rendezvous_shard(F.col("id"), SHARDS[:3]), routing.rendezvous_shard(F.col("id"), SHARDS), 3, keys)


@query
def shard_merge(spark, sf):
    v, q = base(spark, sf).withColumn("shard", routing.modulo_shard(F.col("id"), 3)), vector(spark, sf, 7)
    parts = [search.knn(v.where(F.col("shard") == s), q, 10, digits=6) for s in range(3)]
    return search.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[0]), 10)


@query
def shard_owned(spark, sf):
    copies = base(spark, sf).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("shard"))
    return routing.owned(copies, routing.modulo_shard(F.col("id"), 3))


def _migrated(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).where("label <> 4").withColumn("values", F.when(F.col("label") == 5, F.transform("values", lambda x: (x + 1).cast("float"))).otherwise(F.col("values")))


@query
def reshard_delta(spark, sf):
    return routing.migration_delta(base(spark, sf), _migrated(spark, sf))


@query
def dup_conflicts(spark, sf):
    return routing.conflicts(base(spark, sf).select("id", "values").unionByName(_migrated(spark, sf).select("id", "values")))


@query
def segment_catalog(spark, sf):
    s = routing.segments(base(spark, sf), 100)
    return s.groupBy("segment").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("nodes"), F.max(F.size("values")).alias("dimension"))


@query
def rebuild_policy(spark, sf):
    s = routing.segments(base(spark, sf), 100).groupBy("segment").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("label") < 3).alias("tombstones"))
    return s.select("segment", "nodes", "tombstones", maintenance.should_rebuild(F.col("tombstones"), F.col("nodes"), 20, 0.3).alias("rebuild"))


@query
def tier_plan(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("ts").alias("last_access"))
    return maintenance.tier_moves(e.withColumn("tier", F.lit("hot")), F.lit(NOW).cast("timestamp_ntz"))


def _manifest(spark: SparkSession, sf: str, add: int) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").where(F.lit(add == 1) | (F.col("s_suppkey") % 7 != 0))
    grown = F.when((F.lit(add) == 1) & (F.col("s_suppkey") % 5 == 0), 1).otherwise(0)
    return s.select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 10 + grown).alias("bytes"), F.sha2(F.concat(F.col("s_name"), grown.cast("string")).cast("binary"), 256).alias("sha256"))


@query
def backup_diff(spark, sf):
    return maintenance.backup_diff(_manifest(spark, sf, 0), _manifest(spark, sf, 1))


@query
def backup_restore(spark, sf):
    return maintenance.restored([_manifest(spark, sf, 0), backup_diff(spark, sf)])


@query
def vector_map(spark, sf):
    return maintenance.vector_map(base(spark, sf), DIM, digits=6)


@query
def vector_map_edges(spark, sf):
    """Of one page of the map, which is a page by nature."""
    return maintenance.map_edges(maintenance.vector_map(base(spark, sf).orderBy("id").limit(PAGE), DIM, digits=6), digits=6)


@query
def stats_counters(spark, sf):
    s = base(spark, sf).groupBy(routing.modulo_shard(F.col("id"), 4).alias("shard")).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("label") == 4).alias("tombstones"))
    return maintenance.counters(s.withColumn("ready", F.col("vectors") > 10))


@query
def latency_percentiles(spark, sf):
    return maintenance.percentiles(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query
def loadgen_vectors(spark, sf):
    return vectors.generated(spark, 200, 8).select("id", F.posexplode("values").alias("dim", "v")).select("id", "dim", F.round("v", 6).alias("value"))


@query
def kv_prefix(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    kv = e.select(F.col("event_id").alias("offset"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.round("value", 4).alias("value"))
    return changes.kv_state(kv, "user:1")


@query
def knn_planned(spark, sf):
    v = base(spark, sf)
    rows = v.withColumn("metadata", vectors.metadata())
    found = text_index.candidates(text_index.metadata_postings(rows, F.col("metadata")), {"lang": "en", "label": "3"}, text_index.text_postings(_texts(spark, sf), ["source"]), "src")
    return search.knn(v.join(found, "id", "left_semi"), vector(spark, sf, 7), 10, squared=True, digits=6)


@query
def ivf_upsert(spark, sf):
    lists, c = _ivf(spark, sf)
    moved = base(spark, sf).where("label = 5").withColumn("values", F.transform("values", lambda x: (x + 1).cast("float")))
    return ivf.upsert(lists, c, moved, digits=6).select("id", "cid", "d2")


@query
def reshard_apply(spark, sf):
    source, target = base(spark, sf), _migrated(spark, sf)
    done = routing.migrated(source, target, routing.migration_delta(source, target))
    return done.select("id", F.round(F.element_at("values", 1).cast("double"), 6).alias("first"))


@query
def collection_checksum(spark, sf):
    return routing.collection_checksum(base(spark, sf), 4)


@query
def backup_verify(spark, sf):
    return maintenance.backup_verify(_manifest(spark, sf, 0), _manifest(spark, sf, 1).where(F.col("bytes") % 3 != 0))


@query
def replay_metadata(spark, sf):
    """A log with changes of metadata: view events set them."""
    kinds = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "metadata").otherwise("upsert")
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("offset"), kinds.alias("op"), F.col("user_id").cast("string").alias("id"), "value")
    values = F.when(F.col("op") == "upsert", F.array(F.col("value").cast("float")))
    log_ = e.select("offset", "op", "id", values.alias("values"), F.when(F.col("op") == "metadata", F.create_map(F.lit("seen"), F.col("offset").cast("string"))).alias("metadata"))
    return changes.state(log_).select("id", F.round(F.element_at("values", 1).cast("double"), 4).alias("value"), F.element_at("metadata", "seen").alias("seen"))


def _searched(spark: SparkSession, sf: str, size: int) -> tuple[DataFrame, list[tuple[str, list[float]]]]:
    """Packed segments, written to the cluster's folder, and what is asked."""
    from ..operators import graph

    index = written(graph.packed(graph.build(base(spark, sf), 16, 96, segment_size=size)))
    return index, [(r["qid"], list(r["q"])) for r in asked(spark, sf).toLocalIterator()]


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query
def graph_search(spark, sf):
    """Segments of 100, each walked with a beam as wide, so that the result is the exact one."""
    from ..operators import graph

    index, qs = _searched(spark, sf, 100)
    return _hits(graph.search(index, qs, 10, 100, digits=6))


@query
def graph_quantized_search(spark, sf):
    """Codes are walked; all that their bounds leave open is measured on the stored vectors."""
    from ..operators import graph

    index, qs = _searched(spark, sf, 100)
    near = graph.candidates(graph.quantized(index), qs, 10, 100, digits=6)
    return _hits(graph.rescore(near, base(spark, sf), qs, 10, digits=6))


@query
def graph_live_search(spark, sf):
    """The index before, label 5 moved and label 4 deleted since."""
    from ..operators import graph

    index, qs = _searched(spark, sf, 100)
    moved = base(spark, sf).where("label = 5").withColumn("values", F.transform("values", lambda x: (x + 0.125).cast("float")))
    return _hits(graph.search_live(index, moved, base(spark, sf).where("label = 4"), qs, 10, 100, digits=6))


@query
def graph_compaction(spark, sf):
    from ..operators import graph

    index, _ = _searched(spark, sf, 100)
    return graph.catalog(graph.compacted(index, base(spark, sf).where("label < 5").select("id"), 120)).select("segment", "first_id", "last_id", "nodes")


@query
def graph_compacted_search(spark, sf):
    """Deleted ids are gone from merged segments and hidden in the others."""
    from ..operators import graph

    index, qs = _searched(spark, sf, 100)
    gone = base(spark, sf).where("label < 5").select("id")
    return _hits(graph.search(graph.compacted(index, gone, 120), qs, 10, 120, deleted=gone, digits=6))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return knn_batch_l2(spark, sf)


def _graph_quality(spark: SparkSession, sf: str, m: int, ef: int, beam: int, flat: bool, least: float, metric: str = "l2") -> DataFrame:
    """compared, ok: whether the recall at 10 over every EVERYth vector, against an exact scan of all, reaches ``least``."""
    from ..operators import graph

    v = scaled(spark, sf).withColumn("values", F.col("values").cast("array<float>"))
    index = graph.packed(graph.build(v, m, ef, metric, 500, flat))
    qs = [(r["qid"], list(r["q"])) for r in asked(spark, sf, scaled).toLocalIterator()]
    exact = search.knn_batch(v, spark.createDataFrame(qs, "qid string, q array<double>"), metric, k=10, squared=True)
    return search.ann_quality(graph.search(index, qs, 10, beam, metric), exact).select("compared", (F.col("recall") >= least).alias("ok"))


@query
def graph_recall_ok(spark, sf):
    return _graph_quality(spark, sf, 24, 96, 128, True, 0.95)


@query
def hnsw_recall_ok(spark, sf):
    return _graph_quality(spark, sf, 16, 96, 128, False, 0.95)


@query
def hnsw_cosine_recall_ok(spark, sf):
    return _graph_quality(spark, sf, 16, 96, 128, False, 0.95, "cosine")


@query
def ivf_recall_ok(spark, sf):
    v, qs = base(spark, sf), asked(spark, sf)
    c = ivf.kmeans(v, LISTS)
    found = ivf.search(ivf.assign(v, c), c, qs, 10, 12)
    return search.ann_quality(found, search.knn_batch(v, qs, k=10, squared=True)).select("compared", (F.col("recall") >= 0.9).alias("ok"))


@query
def hnsw_diagnostics(spark, sf):
    from ..operators import graph

    nodes = graph.build(base(spark, sf), 8, 32, segment_size=500)
    found = graph.diagnostics(nodes, 8).join(graph.reachable(nodes).select("segment", "reached"), "segment")
    return found.select("segment", "nodes", "self_links", "double_links", "too_many", (F.col("reached") >= 0.99 * F.col("nodes")).alias("ok"))
