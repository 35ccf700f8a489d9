"""Repeated byte strings against a plain dictionary of all windows."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from vexil.llm.substring_dedup import maximal_repeats, remove_repeats, repeated_spans

SF = "/root/testdata/sf0.01"


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen: dict = {}
    for x in raw:
        for i in range(len(x) - length + 1):
            h = hash(x[i : i + length])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for (d, _), x in zip(rows, raw, strict=True):
        gone = bytearray(len(x))
        end = 0
        for i in range(len(x) - length + 1):
            if seen[hash(x[i : i + length])] > 1:
                lo = max(end, i)
                gone[lo : i + length] = b"\1" * (i + length - lo)
                end = i + length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def same(spark, rows, length, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, rid string").repartition(5)
    got = [tuple(r)[:5] for r in remove_repeats(df, length=length, **more).collect()]
    want = brute(rows, length)
    assert sorted(got, key=key) == sorted(want, key=key)
    return sum(r[2] for r in want)


def test_documents(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    assert same(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)), 400) > 10_000


def texts(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 5)))
    base = [" ".join(word() for _ in range(r.randrange(10, 120))) for _ in range(6)]
    passage = " ".join(word() for _ in range(60))
    rows = [(None, None), (-1, ""), (-2, "short"), (-3, "xy" * 500), (-4, "z" * 900), (-5, "z" * 41), (7, base[0]), (7, base[0]), (None, base[0])]
    for i in range(n):
        t = r.choice(base)
        a, b = sorted(r.randrange(len(t)) for _ in range(2))
        t = r.choice([t[a:b], t[:a] + word() + t[b:], t + t[a:b], f"{word()} {word()} {word()}{passage}{word()} {word()}", " ".join(word() for _ in range(40)), passage[a % 60 : -1 - b % 60]])
        rows.append((i, t))
    return rows


@pytest.mark.parametrize(("seed", "length", "gram", "held"), [(1, 40, 10, 4096), (2, 40, 10, 3), (3, 41, 20, 2), (4, 60, 7, 9), (5, 25, 25, 4096)])
def test_random_texts(spark, seed, length, gram, held):
    assert same(spark, texts(seed), length, gram=gram, held=held) > 0


@pytest.mark.parametrize(("seed", "length", "gram", "heavy"), [(6, 40, 10, 1), (7, 41, 20, 5), (8, 25, 25, 0), (9, 60, 7, 12)])
def test_heavy_anchors(spark, seed, length, gram, heavy):
    assert same(spark, texts(seed), length, gram=gram, heavy=heavy, named=1) > 0


def test_hot_passage(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(65))
    rows = [(i, " ".join(word() for _ in range(20 + i % 7)) + passage[i % 3 :] + " ".join(word() for _ in range(30))) for i in range(400)]
    assert same(spark, rows, 400, heavy=50) > 400 * 400


def colliding(n=1024):
    """Two words that collide under every polynomial hash modulo 2**64."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_colliding_words(spark):
    a, b = colliding()
    assert same(spark, [(1, a), (2, b), (3, f"{a} x"), (4, f"y {b}"), (5, b[3:900])], 700) > 0


def test_maximal_repeats_list_all_occurrences():
    whole = [b"xxabcd", b"yxabce", b"zxabcf", b"zzabcd", b"qqabqq"]
    right, left = [w[2:] for w in whole], [w[:2][::-1] for w in whole]
    got = {(frozenset(i.tolist()), int(e), int(d)) for i, e, d in maximal_repeats(right, left, 2)}
    # abcd twice, xabc three times, abc four times, ab five times; bc or abc with one more to the left are parts of these
    assert got == {(frozenset([0, 3]), 0, 4), (frozenset([0, 1, 2]), 1, 3), (frozenset([0, 1, 2, 3]), 0, 3), (frozenset(range(5)), 0, 2)}
    r = random.Random(5)
    for _ in range(200):
        text = lambda n: bytes(r.choice(b"ab") for _ in range(r.randrange(n)))
        right, left = [b"a" + text(9) for _ in range(12)], [text(7) for _ in range(12)]
        byte = lambda found: {(int(i), x) for who, e, d in found for i, own in zip(who, np.broadcast_to(e, len(who))) for x in range(-int(own), int(d))}
        assert byte(maximal_repeats(right, left, 4)) == byte(repeated_spans(right, left, 4))


def test_text_and_empty(spark):
    df = spark.createDataFrame([(1, "é" * 300), (2, "a" + "é" * 300)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df, with_text=True).collect()}
    assert got[1]["text"] == "" and got[2]["text"] == "a" and got[2]["spans"][0].asDict() == {"start": 1, "end": 601}
    assert remove_repeats(df.limit(0)).count() == 0
