"""SQL (DuckDB) for the queries of this subpackage that SQL can express: the contract's result by plain counting."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters that stand around a match while its places are read; a text's own ones count as a dot there.
LEFT, RIGHT = "chr(57344)", "chr(57345)"

#: kind: (characters that count as others in the scan, characters they count as, pattern, test of match m and text t at s). Word boundaries
#: replace look-around once other characters take the place of an underscore.
PII = {
    "email": ("", "", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("", "", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) <= 255))"),
    "card": ("", "", r"[0-9]([\x20-]?[0-9])+", "len(g) BETWEEN 16 AND 19 AND luhn(g)"),
    "phone": ("", "", r"\+[0-9][\x20().0-9-]+[0-9]", "len(g) BETWEEN 8 AND 15"),
    "iban": ("_", ".", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", "mod97(replace(m, ' ', '')) = 1"),
    "ssn": ("_-", "._", r"\b[0-9]{3}_[0-9]{2}_[0-9]{4}\b", r"regexp_matches(lower(substr(t, greatest(1, s - 39), least(40, s)) || ' ' || substr(t, s + 12, 40)), '\b(?:ssn|social|security|insurance)')"),
    "secret": ("_", "-", r"(?i)\b(?:token|secret|password|passwd|api-?key|access-?key|private-?key)[\"'']?[ \t]{0,4}[=:][ \t]{0,4}[\"'']?[a-z0-9+/=.-]{16,}[\"'']?", "true"),
}


def _pii_kind(rank: int, kind: str) -> str:
    others, as_, pattern, test = PII[kind]
    scanned = f"translate(t, {LEFT} || {RIGHT} || '{others}', '..{as_}')"
    flag = pattern.startswith("(?i)")
    marked = f"regexp_replace({scanned}, '({pattern.removeprefix('(?i)')})', {LEFT} || '\\1' || {RIGHT}, 'g{'i' if flag else ''}')"
    test = test.replace("luhn(g)", "list_sum(list_transform(list_reverse(string_split(g, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (2 * c::INT) % 10 + (c::INT > 4)::INT END)) % 10 = 0")
    test = test.replace(
        "mod97(replace(m, ' ', ''))",
        "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97)",
    )
    return f"""
        SELECT r, {rank} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
            SELECT r, t, m, regexp_replace(m, '[^0-9]', '', 'g') AS g, (sum(size) OVER (PARTITION BY r ORDER BY i) - size)::BIGINT AS s FROM (
                SELECT r, t, i, split_part(piece, {RIGHT}, 1) AS m, length(piece) - (i > 1)::INT AS size
                FROM (SELECT r, t, unnest(string_split({marked}, {LEFT})) AS piece, generate_subscripts(string_split({marked}, {LEFT}), 1) AS i FROM d))
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY i) > 1) x
        WHERE {test}"""


def _pii() -> str:
    base = "('email', 'ip', 'card', 'phone')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PII)
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
             f AS ({" UNION ALL ".join(_pii_kind(i, k) for i, k in enumerate(PII))})
        SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({said} FILTER (kind IN {base}), '')) AS base_sha256, coalesce({said}, '') AS spans
        FROM d LEFT JOIN f USING (r) GROUP BY r"""


def _twice(name: str, size: str) -> str:
    """Places (r, i) of the windows of ``size`` words that a text holds twice, and the number of words they cover."""
    return f"""
             {name}_w AS (SELECT r, unnest(range(1, n - {size} + 2)) AS i, unnest(list_transform(range(1, n - {size} + 2), lambda i: md5(array_to_string(w[i:i + {size} - 1], ' ')))) AS h
                          FROM d WHERE n >= {size}),
             {name}_at AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM (SELECT r, i FROM {name}_w QUALIFY count(*) OVER (PARTITION BY r, h) > 1)),
             {name} AS (SELECT r, sum(least(coalesce(next - i, {size}), {size}))::BIGINT AS covered FROM {name}_at JOIN (SELECT r, long FROM d) USING (r) GROUP BY r)"""


ORACLE = {
    "op1_substring_dedup": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
             b AS (SELECT r, b, substr(x, 2 * b + 1, 2 * 600) AS x, least(200, n - 399 - b) AS own FROM (SELECT r, x, n, unnest(range(0, n - 399, 200)) AS b FROM d WHERE n >= 400)),
             w AS (SELECT r, b + i AS i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, b, x, unnest(range(0, own)) AS i FROM b)),
             a AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, -1) AS new FROM (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1)),
             s AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM a) GROUP BY r, run),
             k AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS past FROM s),
             e AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS hi, string_agg(substr(x, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) AS x
                   FROM k JOIN d USING (r) GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(e.x, '') || substr(d.x, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN e USING (r)""",
    "op2_pii": _pii(),
    "op4_near_dedup": f"""
        WITH RECURSIVE
             d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
                                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS h
                                FROM d WHERE len(w) > 0),
             n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
             l AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.r <> y.r GROUP BY ALL)
                                JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
             c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
             m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op9_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) x(i)),
             e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS said, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|n|>') AS who FROM t),
             g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                          coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                          sum(length('<|turn|>' || who || chr(10) || said || '<|end|>' || chr(10)))::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    # A repeat over both limits exists if a window of the least such length is found twice; what maximal repeats of ten words and more cover is what windows of ten words found twice cover.
    "op10_quality": rf"""
        WITH d AS MATERIALIZED (SELECT *, len(w) AS n, greatest(61, floor(0.1::DOUBLE * len(w))::BIGINT + 1) AS long FROM (
                 SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents)),
             v AS (SELECT r, (sum(c) - count(*))::BIGINT AS n_dup_lines FROM (
                 SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORDS}') GROUP BY ALL) GROUP BY r),
             {_twice("three", "3").strip()},{_twice("ten", "10")},{_twice("far", "long")}
        SELECT doc_id, n AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(three.covered, 0) AS n_repeat_words,
               n < 50 OR 100 * coalesce(three.covered, 0) > 50 * n AS base_failed,
               NOT (n < 50 OR 100 * coalesce(three.covered, 0) > 50 * n) AND coalesce(ten.covered, 0) <= 0.3::DOUBLE * n AND far.r IS NULL AS kept
        FROM d LEFT JOIN v USING (r) LEFT JOIN three USING (r) LEFT JOIN ten USING (r) LEFT JOIN far USING (r)""",
}
