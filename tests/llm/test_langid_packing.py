"""Held-out accuracy of language ID; exact token round trips and certified packing."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vexil.llm import queries as Q
from vexil.llm.langid import ORDER, calibrating, grams, held_out, identify, train
from vexil.llm.packing import best_fit, lower_bound, pack, pieces

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_langid_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = Q.op5_langid(spark, SF).join(truth, "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int))", "avg(cast(rejected as int))", "min(score)", "max(score)").first()
    assert out[0] > 0.97 and out[1] < 0.03 and 0 <= out[2] <= out[3] <= 1


def test_langid_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("abc abd abe", "x"), ("aaa bbb", "y")], "text string, lang string")
    m = train(df).shared(0).value
    doc, key, has = grams(["ab", "", "12", "Éa"])
    assert has.tolist() == [True, False, False, True] and doc.tolist() == [0, 0, 3, 3]
    seen = sorted({int(k) & 0xFFFF for k in grams(["abc abd abe aaa bbb"])[1]})
    context = (ord("a") << 48 | ord("b") << 32 | ord(" ") << 16, 32 << 48 | ord("a") << 32 | ord("b") << 16)
    for c in context:
        p = np.exp(-m.losses(np.array([c | s for s in seen], np.uint64), "x")).sum()
        assert 0.8 < p <= 1.0 + 1e-9, (ORDER, p)


def test_langid_keeps_every_gram(spark):
    rng = np.random.default_rng(1)
    text = lambda n, lo, hi: "".join(map(chr, rng.integers(lo, hi, n)))
    big = [text(50_000, 0x4E00, 0x9000) for _ in range(4)]
    df = spark.createDataFrame([(t, "big") for t in big] + [("the cat sat on the mat " * 20, "en")], "text string, lang string")
    m = train(df)
    assert len(m.shared(0).value.entries["big", ORDER][0]) == len(np.unique(grams(big)[1]))
    other = spark.createDataFrame([(text(200, 0xAC00, 0xD000),)], "text string")
    assert identify(other, m).first()["rejected"]


def test_langid_letters_of_other_planes():
    texts = ["a\U00020061a", "aaa", "\U00020061\U00010330"]
    doc, key, has = grams(texts)
    assert has.all() and np.bincount(doc).tolist() == [4, 3, 4]
    units = [np.frombuffer(t.encode("utf-16-le"), np.uint16).tolist() for t in texts]
    assert (key & np.uint64(0xFFFF)).tolist() == sum(units, [])


def kneser_ney(texts):
    """P(c | three before) by dictionaries."""
    clean = lambda t: re.sub(r"[^\W\d_]+|[\W\d_]+", lambda m: m[0] if m[0][0].isalpha() else " ", t.lower()).lstrip(" ")
    grams_of = lambda t: [("   " + clean(t))[i : i + 4] for i in range(len(clean(t)))]
    levels = {4: Counter(g for t in texts for g in grams_of(t))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off = {k: min(0.95, max(0.1, sum(n == 1 for n in c.values()) / max(1, sum(n == 1 for n in c.values()) + 2 * sum(n == 2 for n in c.values())))) for k, c in levels.items()}

    def p(g, uniform):
        out = uniform
        for k in range(1, 5):
            own, total = g[-k:], sum(n for x, n in levels[k].items() if x[:-1] == g[-k:-1])
            if total:
                kinds = sum(x[:-1] == own[:-1] for x in levels[k])
                out = max(levels[k][own] - off[k], 0) / total + min(1, off[k] * kinds / total) * out
        return out

    return grams_of, p, len(levels[1])


def test_langid_matches_brute_force(spark):
    t = [x for x in pq.read_table(f"{SF}/documents.parquet").to_pylist() if x["text"] and len(x["text"]) < 300][:40]
    langs = sorted({x["lang"] for x in t if x["lang"]})
    models = {x: kneser_ney([r["text"] for r in t if r["lang"] == x]) for x in langs}
    uniform = 1 / (1 + max(n for _, _, n in models.values()))
    df = spark.createDataFrame([(i, x["text"], x["lang"]) for i, x in enumerate(t)], "doc_id long, text string, lang string")
    # a kept-out row counts nowhere
    more = df.unionByName(spark.createDataFrame([(1000, "zzz qqq zzz", langs[0])], df.schema))
    parted = train(df, model_rows=300)
    assert parted.parts > 3
    for trained in (train(more, kept_out=F.col("doc_id") == 1000), parted):
        for r in identify(df, trained).collect():
            want = {}
            for x, (grams_of, p, _) in models.items():
                g = grams_of(r["text"])
                want[x] = -sum(np.log(p(y, uniform)) for y in g) / max(1, len(g))
            best = min(want, key=lambda x: (round(want[x], 9), x))
            if any(c.isalpha() for c in r["text"]):
                assert r["lang_pred"] == best and abs(r["cross_entropy"] - want[best]) < 1e-9, r["doc_id"]


def test_langid_rejects_junk_and_keeps_clean(spark):
    rng = np.random.default_rng(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = train(docs.where(~held_out()), kept_out=calibrating())
    assert all(0.05 <= s < 1.5 for _, _, s in m.usual.values()), m.usual
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 300)) for _ in range(50)] + ["".join(map(chr, rng.integers(0x4E00, 0x9000, 300))) for _ in range(50)]
    assert identify(spark.createDataFrame([(t,) for t in junk], "text string"), m).where("rejected").count() == 100
    assert identify(docs.where(held_out()), m).selectExpr("avg(cast(rejected as int))").first()[0] <= 0.02


def test_langid_slack_is_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'")
    m = train(docs.where(~held_out()), kept_out=calibrating())
    assert 0.05 <= m.usual["en"][2] < 0.7
    share = identify(docs.where(held_out() & F.col("text").rlike("[A-Za-z]")), m).selectExpr("avg(cast(rejected as int))").first()[0]
    assert share <= 0.01


def test_langid_edges(spark):
    rows = [(1, "the thing", "en"), (2, None, "en"), (3, "", None), (4, "12 !?", "de"), (5, "der die das", "de"), (6, "das der", None), (None, "x" * 100_000, None), (6, "das der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumnRenamed("score", "lang")
    got = identify(df, train(df)).collect()
    assert len(got) == 8 and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (5, 6)} == {"de"}
    none = train(df.where("lang is null"))
    assert none is None and {r["lang_pred"] for r in identify(df, none).collect()} == {"und"}
    assert identify(df.limit(0), train(df)).count() == 0
    ids = [r["doc_id"] for r in spark.range(100).withColumnRenamed("id", "doc_id").where(held_out()).collect()]
    assert ids == [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]


TEXTS = [None, "", "a", "It's we'll I'd x'y 'S don't 'the", "Été ÅNGSTRÖM Å é ́x ΣΑΣ οδος", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y", "12345 6٣٤ \U0001f600\U0001f600 ###!!", "日本語 ﬁ", "x " * 9000,
         "A,b;'s !'S l'eau,'t x<|endoftext|>Y <|ENDOFTEXT|> <|Ab.C", "E\u0301A\u0300.B\u0327 I\u0307x 3'd4 d'3 a\u2019s K\u212a\u00a0B,\u2026.c", "<|", "<|endoftext|>"]


def test_tokens_round_trip(spark):
    texts = TEXTS + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pieces(df, PATH, with_ids=True).collect():
        assert r["length"] == len(r["ids"]) <= 4096 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    t = Tokenizer.from_file(PATH)
    for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        ids = [x for _, s, p in sorted(got[i]) for x in p]
        assert ids == [*e.ids, 1], i
        assert [s for _, s, _ in sorted(got[i])] == list(range(0, len(ids), 4096))


def test_colliding_units_have_their_own_ids(spark):
    from tests.llm.test_substring_dedup import colliding

    texts = [*colliding(), " ".join(colliding())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: list(r["ids"]) for r in pieces(df, PATH, with_ids=True).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


def test_units_of_one_hash_are_told_apart(monkeypatch):
    import vexil.llm.packing as M
    import vexil.llm.textnum as N

    monkeypatch.setattr(N, "identity_hash", lambda first, second, size: first % np.uint64(3))
    texts, t, own = [x or "" for x in TEXTS], Tokenizer.from_file(PATH), M.Tokens(PATH)
    for part in (texts[:6], texts[6:], texts):
        ids, at = own(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in part]


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    t, got = Tokenizer.from_file(path), {}
    for r in pieces(df, path, with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["ids"]))
    for i, x in enumerate(TEXTS):
        assert [y for _, p in sorted(got[i]) for y in p] == [*t.encode(x or "", add_special_tokens=False).ids, 1]


def check_packed(rows, room):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= room
    return len(bins)


def test_packing_is_certified(spark):
    df = Q.op6_packing(spark, SF)
    rows = df.collect()
    n = check_packed(rows, 4096)
    bound = lower_bound(np.array([r["length"] for r in rows]), 4096)
    assert bound <= n <= bound + 1


def test_packing_exchanges_between_partitions(spark):
    items = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.hash("id"), F.lit(90)) + 5).cast("long").alias("length"))
    rows = pack(items, length=100, per_task=300, spare=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(4000))
    n = check_packed(rows, 100)
    whole = len(best_fit(np.array([r["length"] for r in rows]), 100)[2])  # all in one task
    assert n <= whole * 1.03
    assert pack(items.limit(0), length=100).count() == 0
    same = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit(60).cast("long").alias("length"), F.lit("x").alias("offset"))
    assert check_packed(pack(same, length=100).collect(), 100) == 50


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        room = int(rng.integers(5, 60))
        sizes = rng.integers(1, room + 1, int(rng.integers(1, 40)))
        _, _, left = best_fit(sizes, room)
        assert -(-sizes.sum() // room) <= lower_bound(sizes, room) <= len(left)
    assert lower_bound(np.array([51] * 7), 100) == 7 and lower_bound(np.array([34] * 9), 100) == 5
