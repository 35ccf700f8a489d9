"""The queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_digests
from .common import table
from .exact_dedup import exact_dedup
from .langid import calibrating, held_out, identify, train
from .mixing import mix
from .near_dedup import near_dedup
from .oracle import ORACLE as COUNTED
from .packing import pack, pieces
from .pii import BASE, EXTRA, find_pii
from .quality import quality
from .substring_dedup import remove_repeats
from .url_filter import url_verdicts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in (*BASE, *EXTRA)]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("rid")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    models = train(docs.where("not held_out"), kept_out=calibrating())
    return identify(docs.drop("lang"), models).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    items = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(rows.unionByName(more)).drop("n_rewrites")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_langid": op5_langid,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
}

ORACLE: dict[str, str] = {
    **COUNTED,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
                   FROM d GROUP BY source),
             r AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS fixed, sum(weight) OVER a AS free
                   FROM s WINDOW b AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                 a AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
             l AS (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - fixed) / free AS level FROM r
                   WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - fixed) / free * weight <= 2.0::DOUBLE * source_size
                   ORDER BY source_size / weight, source LIMIT 1),
             t AS (SELECT source, source_size, least(weight * coalesce((SELECT level FROM l), 1e300), 2.0::DOUBLE * source_size) AS target FROM s),
             g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
             c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, floor(g.target + 0.5)::BIGINT - g.whole * g.source_size AS rest,
                          coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
                   FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target, (whole * size + greatest(0, least(size, rest - low)))::BIGINT AS taken FROM c""",
}
