"""The pipeline against the brute-force versions of its stages."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_langid_packing import check_packed
from tests.llm.test_near_dedup import brute
from tests.llm.test_small_ops import WORD

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    for _, stage in P.STAGES[:-1]:
        out = P.cut(stage(spark, docs, SF))
        assert out.columns == P.COLUMNS
        before, after = docs.toPandas(), out.toPandas()
        if stage is P.language:
            assert len(before) - len(after) < 0.03 * len(before)
        elif stage is P.exact:
            last: dict = {}
            for d, t in zip(before["doc_id"], before["text"], strict=True):
                last[t] = max(d, last.get(t, d))
            assert sorted(last.values()) == sorted(after["doc_id"])
        elif stage is P.near:
            want = [d for d, _, _, kept in brute(list(zip(before["doc_id"], before["text"], strict=True))) if kept]
            assert sorted(want) == sorted(after["doc_id"])
        else:
            n = Counter()
            for d, t, c in zip(after["doc_id"], after["text"], after["n_chars"], strict=True):
                assert t == rows[d]["text"] and c == rows[d]["n_chars"]
                n[rows[d]["source"]] += len(WORD.findall(t))
            sizes, longest = Counter(), Counter()
            for d, t in zip(before["doc_id"], before["text"], strict=True):
                sizes[rows[d]["source"]] += len(WORD.findall(t))
                longest[rows[d]["source"]] = max(longest[rows[d]["source"]], len(WORD.findall(t)))
            assert abs(sum(n.values()) - 1.5 * sum(sizes.values())) <= sum(longest.values()) / 2 + len(sizes)
            assert all(n[s] <= 2 * sizes[s] for s in sizes)
        docs = out
    final = P.STAGES[-1][1](spark, docs, SF).collect()
    check_packed(final, 4096)
    t, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in final:
        got[r["doc_id"]] += r["length"]
    want = Counter()
    for d, text in docs.select("doc_id", "text").collect():
        want[d] += len(t.encode(text, add_special_tokens=False).ids) + 1
    assert got == want
    key = lambda rs: hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rs)).encode()).hexdigest()
    assert key(final) == key(P.run(spark, SF).collect())


def test_stages_take_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the cat", "en", "a", 7), (3, "the cat", "en", "a", 7), (None, "the dog", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, d, SF).count() >= 0
