"""The same queries in DuckDB's SQL. Written against the tables, not against our code."""

from __future__ import annotations

from ..functions.kernels import projection_weight
from .queries import ASKED, DIM, EVERY, LISTS, NOW, PAGE, PROBES, SHARDS

V = "v AS (SELECT e.vec_id, printf('v-%06d', e.vec_id) AS id, e.embedding::DOUBLE[] AS x, e.embedding AS f, e.label, d.lang, d.source FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"
S = V + ", s AS (SELECT vec_id, id, list_transform(x, lambda y: y * (1 + label)) AS x FROM v)"


def l2sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN 1.0 ELSE 1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END"


def knn(expr: str, k: int = 10, where: str = "true", of: str = "v", n: int = 7) -> str:
    q = f"(SELECT x FROM {of} WHERE vec_id = {n})"
    return f"WITH {S} SELECT id, round({expr.format(a='x', b=q)}, 6) + 0.0 AS distance FROM {of} WHERE {where} ORDER BY distance, id LIMIT {k}"


ROOT, SQUARED = f"sqrt({l2sq('{a}', '{b}')})", l2sq("{a}", "{b}")
META = "coalesce(contains(lower({0}), '{1}'), false)"


def batch(expr: str, of: str = "v", k: str = "10") -> str:
    return f"""WITH {S}, q AS (SELECT 'q' || vec_id AS qid, x AS q, (vec_id % 7 + 2) AS k FROM {of} WHERE vec_id % {EVERY} = 0),
        d AS (SELECT qid, k, id, round({expr.format(a='x', b='q')}, 6) + 0.0 AS distance FROM {of}, q)
        SELECT qid, id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d) WHERE rank <= {k}"""


def searched(state: str) -> str:
    """Exact search of a state(vec_id, id, x) of the vectors for the vectors as they were."""
    return f"""WITH {V}, t AS ({state}), q AS (SELECT 'q' || vec_id AS qid, x AS q FROM v WHERE vec_id % {EVERY} = 0),
        d AS (SELECT qid, id, round({l2sq('x', 'q')}, 6) + 0.0 AS distance FROM t, q)
        SELECT qid, id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10"""


def text_where(q: str) -> str:
    return f"(contains(lower(id), '{q}') OR contains('label', '{q}') OR (lang IS NOT NULL AND (contains('lang', '{q}') OR contains(lower(lang), '{q}'))) OR (source IS NOT NULL AND (contains('source', '{q}') OR contains(lower(source), '{q}'))) OR contains(label::VARCHAR, '{q}'))"


def long(value: str) -> str:
    return f"WITH {V}, o AS (SELECT list_transform(range(0, {DIM}), lambda i: i / 10.0::DOUBLE) AS o), r AS (SELECT id, {value} AS y FROM v, o) SELECT id, (i - 1)::INT AS dim, round(y[i], 6) AS value FROM (SELECT id, y, unnest(range(1, {DIM + 1})) AS i FROM r)"


FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::UHUGEINT), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"
SPLIT = "18446744073709551616::UHUGEINT"


def rendezvous(keys: str, names: list[str]) -> str:
    """keys: a query with column id -> (id, shard)."""
    mul = lambda x, c: f"((({x}) % 4294967296::UHUGEINT) * {c}::UHUGEINT + (((({x}) // 4294967296::UHUGEINT) * {c}::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % {SPLIT}"
    shift = lambda x, n: f"xor({x}, ({x}) // {1 << n}::UHUGEINT)"
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""(WITH k AS (SELECT id, {FNV.format('id')} AS h FROM ({keys})), n AS (SELECT i, {FNV.format('name')} AS g FROM (VALUES {rows}) t(i, name)),
        a AS (SELECT id, i, (xor(h, g) + 11400714819323198485::UHUGEINT) % {SPLIT} AS x FROM k, n), b AS (SELECT id, i, {mul(shift('x', 30), 0xBF58476D1CE4E5B9)} AS x FROM a),
        c AS (SELECT id, i, {mul(shift('x', 27), 0x94D049BB133111EB)} AS x FROM b), d AS (SELECT id, i, {shift('x', 31)} AS x FROM c)
        SELECT id, i::INT AS shard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, i) AS r FROM d) WHERE r = 1)"""


LONG = "lf AS (SELECT id, unnest(f) AS val, unnest(range(0, 64)) AS dim FROM v), m AS (SELECT dim, min(val) AS lo, max(val) AS hi FROM lf GROUP BY dim)"
CODES = f"{LONG}, c AS (SELECT id, lf.dim::INT AS dim, CASE WHEN hi - lo <= 0 THEN 0 ELSE floor((greatest(0::FLOAT, least(1::FLOAT, (val - lo) / (hi - lo))) * 255::FLOAT)::FLOAT + 0.5::FLOAT)::INT END AS code, lo, hi FROM lf JOIN m ON lf.dim = m.dim)"
PERM = "mu AS (SELECT dim, avg(val::DOUBLE) AS mean FROM lf GROUP BY dim), va AS (SELECT lf.dim, round(sum((val::DOUBLE - mean) * (val::DOUBLE - mean)), 6) AS var FROM lf JOIN mu ON lf.dim = mu.dim GROUP BY lf.dim), p AS (SELECT (row_number() OVER (ORDER BY var DESC, dim) - 1)::INT AS pos, dim::INT AS dim FROM va)"
CENT = f"nn AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM v), ce AS (SELECT i AS cid, x AS c FROM nn JOIN (SELECT unnest(range(0, {LISTS})) AS i) ON place = i * (n - 1) // {LISTS - 1})"
CELL = f"{CENT}, dd AS (SELECT id, label, x, cid, round({l2sq('x', 'c')}, 6) AS d2 FROM v, ce), li AS (SELECT id, label, x, cid, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cid) AS r FROM dd) WHERE r = 1)"
PROBE = f"q AS (SELECT 'q' || vec_id AS qid, x AS q FROM v WHERE vec_id % {EVERY} = 0), pr AS (SELECT qid, q, cid, row_number() OVER (PARTITION BY qid ORDER BY round({l2sq('q', 'c')}, 6), cid) AS probe FROM q, ce)"


def ivf_top(lists: str, probes: str, k: int = 5) -> str:
    return f"SELECT qid, id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (SELECT qid, id, round({l2sq('q', 'x')}, 6) AS distance FROM {lists} l JOIN {probes} p ON l.cid = p.cid)) WHERE rank <= {k}"


SIG = "list_sum(list_transform(range(1, 25), lambda i: CASE WHEN x[i] >= 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT"
W = [[projection_weight(d, a) for d in range(DIM)] for a in (0, 1)]
MAP = f"""raw AS (SELECT vec_id, id, {dot('x', str(W[0]) + '::DOUBLE[]')} AS px, {dot('x', str(W[1]) + '::DOUBLE[]')} AS py FROM v WHERE {{where}}),
    pt AS (SELECT id, round(CASE WHEN max(px) OVER () = min(px) OVER () THEN 0.5 ELSE (px - min(px) OVER ()) / (max(px) OVER () - min(px) OVER ()) END, 6) AS x,
                      round(CASE WHEN max(py) OVER () = min(py) OVER () THEN 0.5 ELSE (py - min(py) OVER ()) / (max(py) OVER () - min(py) OVER ()) END, 6) AS y FROM raw)"""
TOKEN = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
GRAMS = "list_distinct(flatten(list_transform({0}, lambda t: list_concat([t], flatten(list_transform(range(2, least(length(t), 32) + 1), lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substring(t, i, n))))))))"
LOG = "lg AS (SELECT event_id AS o, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id::VARCHAR AS id, value::FLOAT AS value FROM events)"
SEG = "sg AS (SELECT *, ((row_number() OVER (ORDER BY id) - 1) // {0})::INT AS segment FROM v)"
MIG = "mg AS (SELECT id, CASE WHEN label = 5 THEN list_transform(f, lambda y: y + 1) ELSE f END AS f FROM v WHERE label <> 4)"


def manifest(add: int) -> str:
    grown = "CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END" if add else "0"
    return f"SELECT s_name AS name, (s_suppkey * 10 + {grown})::BIGINT AS bytes, sha256(s_name || ({grown})::VARCHAR) AS sha256 FROM supplier WHERE {'true' if add else 's_suppkey % 7 <> 0'}"


DIFF = f"(SELECT n.* FROM ({manifest(1)}) n ANTI JOIN ({manifest(0)}) b ON n.name = b.name AND n.sha256 = b.sha256)"

ORACLE: dict[str, str] = {
    "knn_exact_l2": knn(ROOT),
    "knn_exact_cosine": knn(cosine("{a}", "{b}"), of="s"),
    "knn_exact_ip": knn("-" + dot("{a}", "{b}"), of="s"),
    "knn_batch_l2": batch(ROOT),
    "knn_batch_cosine": batch(cosine("{a}", "{b}"), "s"),
    "knn_batch_ip": batch("-" + dot("{a}", "{b}"), "s"),
    "knn_batch_var_k": batch(ROOT, k="k"),
    "knn_filter_ids": knn(SQUARED, where="vec_id % 13 = 0 AND vec_id < 400"),
    "knn_candidates": knn(SQUARED, where="vec_id % 13 = 0 AND vec_id < 400"),
    "knn_filter_meta": knn(SQUARED, where="label = 3 AND lang = 'en'"),
    "knn_filter_text": knn(SQUARED, where=text_where("src1")),
    "knn_structured": knn(SQUARED, where=f"vec_id % 3 = 0 AND vec_id < 500 AND lang = 'en' AND {text_where('src')}"),
    "knn_namespace": knn(cosine("{a}", "{b}"), where="source = 'src5'"),
    **{f"knn_selectivity_{s:02d}": knn(SQUARED, where=f"vec_id % {m} = 0") for s, m in ((5, 20), (20, 5), (50, 2), (100, 1))},
    "knn_multi_vector": f"WITH {V}, q AS (SELECT x AS q FROM v WHERE vec_id IN (3, 17, 42)) SELECT id, round(min({l2sq('x', 'q')}), 6) AS distance FROM v, q GROUP BY id ORDER BY distance, id LIMIT 10",
    "knn_rerank": f"WITH {V}, n AS (SELECT id, label, round({l2sq('x', '(SELECT x FROM v WHERE vec_id = 7)')}, 6) AS d FROM v ORDER BY d, id LIMIT 50) SELECT id, round(d * (1 + label % 3), 6) AS distance FROM n ORDER BY distance, id LIMIT 10",
    "vec_kernels": f"WITH {V}, q AS (SELECT list_transform(range(0, 64), lambda i: 1.0::DOUBLE / (i + 1)) AS q) SELECT id, round(sqrt({l2sq('x', 'q')}), 6) AS l2, round({l2sq('x', 'q')}, 6) AS l2sq, round({cosine('x', 'q')}, 6) AS cosine, round(-{dot('x', 'q')}, 6) AS ip, round(sqrt({dot('x', 'x')}), 6) AS length, true AS mismatch, 1.0::DOUBLE AS zero FROM v, q",
    "vec_add": long("list_transform(list_zip(x, o), lambda z: z[1] + z[2])"),
    "vec_sub": long("list_transform(list_zip(x, o), lambda z: z[1] - z[2])"),
    "vec_normalize": long(f"list_transform(list_zip(x, o), lambda z: (z[1] + z[2]) / sqrt({dot('list_transform(list_zip(x, o), lambda w: w[1] + w[2])', 'list_transform(list_zip(x, o), lambda w: w[1] + w[2])')}))"),
    "validate_requests": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'empty_vector' WHEN p_size % 5 * 1500 > 4096 THEN 'dimension_too_large' WHEN p_size * 5 - 20 <= 0 THEN 'invalid_k' WHEN p_size * 5 - 20 > 100 THEN 'k_too_large' END AS fault FROM part",
    "scan_ordered": f"WITH {V} SELECT id, label, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS position FROM v",
    "scan_from_offset": f"WITH {V} SELECT id FROM v ORDER BY id OFFSET 100",
    "scan_selected": f"WITH {V} SELECT id, label, round(x[1], 6) AS first FROM v WHERE vec_id % 11 = 0 AND vec_id < 300",
    "scan_ids": f"WITH {V} SELECT id FROM v",
    "get_vector": f"WITH {V} SELECT id, (i - 1)::INT AS dim, round(x[i], 6) AS value FROM (SELECT id, x, unnest(range(1, 65)) AS i FROM v WHERE vec_id = 42)",
    "list_page": f"WITH {V} SELECT id, round(x[1], 6) AS first FROM v WHERE id > 'v-000100' ORDER BY id LIMIT 51",
    "list_page_ids": f"WITH {V} SELECT id FROM v ORDER BY id LIMIT 101",
    "cursor_codec": f"WITH {V} SELECT id, rtrim(replace(replace(base64(id::BLOB), '+', '-'), '/', '_'), '=') AS cursor, id AS decoded FROM v",
    "count_vectors": "SELECT count(*) AS vectors, count(DISTINCT label) AS labels FROM embeddings",
    "state_replay": f"WITH {LOG} SELECT id, round(value::DOUBLE, 4) AS value, o AS \"offset\" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS r FROM lg) WHERE r = 1 AND op = 'upsert'",
    "latest_change": f"WITH {LOG} SELECT id, op, o AS \"offset\" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS r FROM lg) WHERE r = 1",
    "delta_since": f"WITH {LOG} SELECT o AS \"offset\", id, op FROM lg WHERE o > 500",
    "insert_conflicts": "WITH b AS (SELECT s_nationkey::VARCHAR AS id, s_suppkey FROM supplier) SELECT id, 'empty_vector' AS fault FROM b WHERE s_suppkey % 9 = 0 UNION ALL SELECT id, 'repeated' FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'exists' FROM b WHERE id IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1)",
    "delete_anti": f"WITH {V} SELECT id, label FROM v WHERE label <> 4",
    "delete_missing": f"WITH {V} SELECT printf('v-%06d', i) AS id FROM range(0, 5000, 250) t(i) WHERE printf('v-%06d', i) NOT IN (SELECT id FROM v)",
    "id_mapping": f"WITH {V} SELECT id, row_number() OVER (ORDER BY id) AS internal FROM v",
    "id_mapping_conflicts": f"WITH {V}, k AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM v), i AS (SELECT id, CASE WHEN vec_id % 10 = 0 THEN vec_id + 2 ELSE vec_id + 1 END AS n FROM v) SELECT DISTINCT i.id, i.n AS internal FROM i JOIN k ON (i.id = k.id AND i.n <> k.n) OR (i.n = k.n AND i.id <> k.id)",
    "text_ngram_postings": f"WITH {V}, t AS (SELECT id, unnest(list_distinct(list_concat({GRAMS.format(TOKEN.format(chr(99) + 'oalesce(lang, ' + chr(39) * 2 + ')'))}, {GRAMS.format(TOKEN.format(chr(99) + 'oalesce(source, ' + chr(39) * 2 + ')'))}))) AS term FROM v) SELECT term, count(*) AS n FROM t GROUP BY term",
    "text_search": f"WITH {V} SELECT id FROM v WHERE contains(source, 'src1') AND (lang = 'en')",
    "meta_postings": f"WITH {V}, p AS (SELECT id, 'label' AS key, label::VARCHAR AS value FROM v UNION ALL SELECT id, 'lang', lang FROM v WHERE lang IS NOT NULL UNION ALL SELECT id, 'source', source FROM v WHERE source IS NOT NULL) SELECT key, value, count(*) AS n, min(id) AS first FROM p GROUP BY key, value",
    "sq_train": f"WITH {V}, {LONG} SELECT dim::INT AS dim, round(lo::DOUBLE, 6) AS lo, round(hi::DOUBLE, 6) AS hi FROM m",
    "sq_encode": f"WITH {V}, {CODES} SELECT id, dim, code FROM c",
    "sq_approx_l2": f"WITH {V}, {CODES}, q AS (SELECT x AS q FROM v WHERE vec_id = 7) SELECT id, round(sum(pow(q[dim + 1] - (lo + ((hi - lo) * code::FLOAT)::FLOAT / 255::FLOAT)::FLOAT::DOUBLE, 2)), 4) AS distance FROM c, q GROUP BY id",
    "pq_codes": f"WITH {V}, {CODES} SELECT id, (dim // 8)::INT AS subspace, sum(code)::BIGINT AS total FROM c GROUP BY 1, 2",
    "opq_perm": f"WITH {V}, {LONG}, {PERM} SELECT pos, dim FROM p",
    "opq_codes": f"WITH {V}, {CODES}, {PERM} SELECT id, (pos // 8)::INT AS subspace, sum(code)::BIGINT AS total FROM c JOIN p ON c.dim = p.dim GROUP BY 1, 2",
    "ivf_bootstrap": f"WITH {V}, {CENT} SELECT cid::INT AS cid, (i - 1)::INT AS dim, round(c[i], 6) AS value FROM (SELECT cid, c, unnest(range(1, 65)) AS i FROM ce)",
    "ivf_assign": f"WITH {V}, {CELL} SELECT id, cid::INT AS cid, d2 FROM li",
    "ivf_lloyd_step": f"WITH {V}, {CELL} SELECT cid::INT AS cid, (i - 1)::INT AS dim, round(avg(x[i]), 6) AS value FROM (SELECT cid, x, unnest(range(1, 65)) AS i FROM li) GROUP BY 1, 2",
    "ivf_search": f"WITH {V}, {CELL}, {PROBE} {ivf_top('li', f'(SELECT * FROM pr WHERE probe <= {PROBES})')}",
    "ivf_adaptive": f"""WITH {V}, {CELL}, {PROBE}, sz AS (SELECT cid, count(*) AS n FROM li GROUP BY cid),
        hv AS (SELECT pr.*, sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY probe) AS have FROM pr LEFT JOIN sz ON pr.cid = sz.cid),
        st AS (SELECT qid, coalesce(min(CASE WHEN probe IN (1, 2, 4, 8, 16) AND have >= 100 THEN probe END), 16) AS stop FROM hv GROUP BY qid)
        {ivf_top('li', '(SELECT pr.* FROM pr JOIN st ON pr.qid = st.qid WHERE probe <= stop)')}""",
    "ivf_tombstones": f"WITH {V}, {CELL}, {PROBE} {ivf_top('(SELECT * FROM li WHERE label <> 4)', f'(SELECT * FROM pr WHERE probe <= {PROBES})')}",
    "ivf_drift": f"WITH {V}, {CELL} SELECT round(avg(d2), 6) AS score, round(avg(d2), 6) > 0.5 AS needs_retrain FROM li",
    "ann_ivf_eval": f"""WITH {V}, {CELL}, {PROBE}, fo AS ({ivf_top('li', f'(SELECT * FROM pr WHERE probe <= {PROBES})')}), ex AS ({ivf_top('li', 'pr')})
        SELECT count(DISTINCT ex.qid) AS compared, count(*) FILTER (ex.rank = 1 AND fo.rank = 1) AS top1_matches, count(fo.rank) AS overlap, round(count(fo.rank) / count(*), 6) AS recall FROM ex LEFT JOIN fo ON ex.qid = fo.qid AND ex.id = fo.id""",
    "route_signature": f"WITH {V} SELECT id, {SIG} AS sig FROM v",
    "route_hamming": f"WITH {V}, g AS (SELECT vec_id, id, {SIG} AS sig FROM v) SELECT id, bit_count(xor(sig, (SELECT sig FROM g WHERE vec_id = 7)))::INT AS distance FROM g",
    "route_segments": f"""WITH {V}, {SEG.format(20)}, g AS (SELECT vec_id, segment, {SIG} AS sig FROM sg), n AS (SELECT segment, min(bit_count(xor(sig, (SELECT sig FROM g WHERE vec_id = 7))))::INT AS distance FROM g GROUP BY segment)
        SELECT segment, distance FROM n WHERE (SELECT count(*) FROM n WHERE distance <= 6) < 3 OR distance <= 5""",
    "shard_modulo": f"WITH {V} SELECT id, ({FNV.format('id')} % 7)::INT AS shard FROM v",
    "shard_rendezvous": f"SELECT id, shard FROM {rendezvous(f'WITH {V} SELECT id FROM v', SHARDS)}",
    "shard_movement": (lambda k: f"SELECT count(*) AS keys, count(*) FILTER (a.shard <> b.shard) AS moved, count(*) FILTER (a.shard <> b.shard AND b.shard = 3) AS moved_to_new FROM {rendezvous(k, SHARDS[:3])} a JOIN {rendezvous(k, SHARDS)} b ON a.id = b.id")("SELECT 'routing-key-' || c_custkey AS id FROM customer"),
    "shard_merge": knn(ROOT),
    "shard_owned": f"WITH {V} SELECT id, ({FNV.format('id')} % 3)::INT AS shard FROM v",
    "reshard_delta": f"WITH {V}, {MIG} SELECT v.id, 'source' AS side FROM v LEFT JOIN mg ON v.id = mg.id AND v.f = mg.f WHERE mg.id IS NULL UNION ALL SELECT mg.id, 'target' FROM mg LEFT JOIN v ON v.id = mg.id AND v.f = mg.f WHERE v.id IS NULL",
    "dup_conflicts": f"WITH {V} SELECT id, 2::BIGINT AS n FROM v WHERE label = 5",
    "segment_catalog": f"WITH {V}, {SEG.format(100)} SELECT segment, min(id) AS first_id, max(id) AS last_id, count(*) AS nodes, 64::INT AS dimension FROM sg GROUP BY segment",
    "rebuild_policy": f"WITH {V}, {SEG.format(100)}, c AS (SELECT segment, count(*) AS nodes, count(*) FILTER (label < 3) AS tombstones FROM sg GROUP BY segment) SELECT *, tombstones >= 20 AND tombstones >= nodes * 0.3 AS rebuild FROM c",
    "tier_plan": f"WITH e AS (SELECT user_id::VARCHAR AS key, max(ts) AS t FROM events GROUP BY 1), w AS (SELECT key, CASE WHEN TIMESTAMP '{NOW}' - t <= INTERVAL 24 HOURS THEN 'hot' WHEN TIMESTAMP '{NOW}' - t <= INTERVAL 168 HOURS THEN 'warm' ELSE 'cold' END AS to_tier FROM e) SELECT key, 'hot' AS from_tier, to_tier FROM w WHERE to_tier <> 'hot'",
    "backup_diff": f"SELECT * FROM {DIFF}",
    "backup_restore": manifest(1),
    "vector_map": f"WITH {V}, {MAP.format(where='true')} SELECT id, x, y FROM pt",
    "vector_map_edges": f"""WITH {V}, {MAP.format(where=f'id IN (SELECT id FROM v ORDER BY id LIMIT {PAGE})')}, e AS (SELECT a.id AS source, b.id AS target, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) AS d2 FROM pt a, pt b WHERE a.id <> b.id)
        SELECT source, target, round(1 / (1 + sqrt(d2)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d2, target) AS r FROM e) WHERE r = 1 AND source < target""",
    "stats_counters": f"WITH {V}, s AS (SELECT {FNV.format('id')} % 4 AS shard, count(*) AS n, count(*) FILTER (label = 4) AS t FROM v GROUP BY 1) SELECT count(*) AS shards, sum(n)::BIGINT AS vectors, sum(t)::BIGINT AS tombstones, max(n) AS largest, bool_and(n > 10) AS ready FROM s",
    "latency_percentiles": "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p::INT AS p, value FROM r JOIN (VALUES (50), (95), (99)) t(p) ON place = greatest(1, (n * p + 99) // 100)",
    "loadgen_vectors": "SELECT printf('load-%06d', s) AS id, i::INT AS dim, round(42200.0 + (s % 10) * 10 + sin(s + i) * 0.25 + ((s + i) % 7) / 100.0, 6) AS value FROM range(0, 200) a(s), range(0, 8) b(i)".replace("42200.0", str(float(sum(map(ord, "load")) % 1000) * 100)),
    "kv_prefix": "SELECT key, value FROM (SELECT 'user:' || user_id AS key, event_type, round(value, 4) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error' AND starts_with(key, 'user:1')",
    "knn_planned": knn(SQUARED, where=f"label = 3 AND lang = 'en' AND {META.format('source', 'src')}"),
    "ivf_upsert": f"""WITH {V}, {CENT}, w AS (SELECT id, CASE WHEN label = 5 THEN list_transform(f, lambda y: (y + 1)::FLOAT)::DOUBLE[] ELSE x END AS x FROM v),
        d AS (SELECT id, cid, {l2sq('x', 'c')} AS d2 FROM w, ce), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 6), cid) AS n FROM d)
        SELECT id, cid::INT AS cid, round(d2, 6) AS d2 FROM r WHERE n = 1""",
    "reshard_apply": f"WITH {V} SELECT id, round(x[1], 6) AS first FROM v",
    "collection_checksum": f"""WITH {V}, h AS (SELECT sha256(id || '|' || array_to_string(list_transform(x, lambda y: round(y * 10000)::BIGINT), ',')) AS s FROM v)
        SELECT count(*) AS records, (sum(('0x' || s[1:12])::BIGINT) % 1000000007)::BIGINT AS checksum FROM h""",
    "backup_verify": """WITH a AS (SELECT s_name AS name, s_suppkey * 10 AS bytes, sha256(s_name || '0') AS sha FROM supplier WHERE s_suppkey % 7 <> 0),
        b AS (SELECT s_name AS name, s_suppkey * 10 + g AS bytes, sha256(s_name || g) AS sha FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS g FROM supplier) WHERE (s_suppkey * 10 + g) % 3 <> 0),
        c AS (SELECT name, CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'extra' WHEN a.sha <> b.sha OR a.bytes <> b.bytes THEN 'corrupt' END AS status FROM a FULL JOIN b USING (name))
        SELECT name, status FROM c WHERE status IS NOT NULL""",
    "replay_metadata": """WITH e AS (SELECT user_id::VARCHAR AS id, event_id AS o, event_type AS t, value FROM events),
        l AS (SELECT id, coalesce(max(o) FILTER (t = 'error'), -1) AS gone, max(o) FILTER (t NOT IN ('error', 'view')) AS up, max(o) FILTER (t = 'view') AS me FROM e GROUP BY id)
        SELECT l.id, round(e.value::FLOAT::DOUBLE, 4) AS value, CASE WHEN me > gone THEN me::VARCHAR END AS seen FROM l JOIN e ON e.o = l.up AND e.id = l.id WHERE up > gone""",
    "id_reserve": f"""WITH {V}, k AS (SELECT id, row_number() OVER (ORDER BY id) AS internal FROM v WHERE label < 5)
        SELECT id, internal FROM k UNION ALL SELECT id, row_number() OVER (ORDER BY id) + (SELECT count(*) FROM k) FROM v WHERE label >= 5""",
    "vec_l2_float": f"WITH {V}, q AS (SELECT list_transform(range(0, {DIM}), lambda i: (1.0::DOUBLE / (i + 1))::FLOAT) AS q) SELECT id, round(list_sum(list_transform(list_zip(f, q), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)), 6) AS l2sq FROM v, q",
    "graph_search": searched("SELECT * FROM v"),
    "graph_quantized_search": searched("SELECT * FROM v"),
    "graph_live_search": searched("SELECT vec_id, id, CASE WHEN label = 5 THEN list_transform(f, lambda y: (y + 0.125)::FLOAT)::DOUBLE[] ELSE x END AS x FROM v WHERE label <> 4"),
    "graph_compacted_search": searched("SELECT * FROM v WHERE label >= 5"),
    "graph_compaction": f"""WITH {V}, {SEG.format(100)}, c AS (SELECT segment, count(*) FILTER (label >= 5) AS live FROM sg GROUP BY 1),
        r AS (SELECT segment, sum(live) OVER (ORDER BY segment) AS so_far FROM c), m AS (SELECT segment FROM r WHERE so_far <= 120 OR segment = 0),
        g AS (SELECT CASE WHEN segment IN (FROM m) THEN 0 ELSE segment END AS segment, id FROM sg WHERE (SELECT count(*) FROM m) < 2 OR label >= 5 OR segment NOT IN (FROM m))
        SELECT segment::INT AS segment, min(id) AS first_id, max(id) AS last_id, count(*) AS nodes FROM g GROUP BY 1""",
    **{k: f"SELECT count(*) AS compared, true AS ok FROM embeddings WHERE vec_id % {EVERY} = 0" for k in ("graph_recall_ok", "hnsw_recall_ok", "hnsw_cosine_recall_ok", "ivf_recall_ok")},
    "hnsw_diagnostics": f"""WITH {V}, p AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 500 AS segment FROM v)
        SELECT segment::INT AS segment, count(*) AS nodes, 0::BIGINT AS self_links, 0::BIGINT AS double_links, 0::BIGINT AS too_many, true AS ok FROM p GROUP BY 1""",
}
