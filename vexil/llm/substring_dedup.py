"""Removal of byte strings of a given length that occur anywhere else.

Of the GRAM-byte strings inside each window of ``length`` bytes, the one of least rank (leftmost of equals) is the
window's anchor, so equal windows have equal anchors at the same place in them, and only about one byte in 150 is an
anchor. An anchor's context is all that a window holding it can reach. Contexts that are equal as a whole, by 128-bit
BLAKE2b digests, are settled first, within each partition and then by digest.

Where one anchor has different contexts, their bytes travel. A suffix array of the contexts from the anchor on is scanned
with a stack for its longest-common-prefix intervals; inside each, the same scan over the order of what stands to the left
gives the groups with a common left extension. A group whose members also agree to the right of the interval is not
maximal and belongs to a deeper one; the others are the maximal repeats, with all their occurrences. Covered bytes are
the union over them.

An anchor with very many contexts (a passage in ever new surroundings) is never gathered in a task: its windows, by ranges of
their starts, are settled by digests of what all windows of a range share and of all they span, then one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, small_batches, text_or_empty
from .textnum import mix, prefix_sums, released, slid_hash

LENGTH, GRAM = 400, 100
#: Bytes of text held as arrays at once, and anchors that a task combines at once.
CHUNK, COMBINED = 1 << 20, 500_000
#: Contexts of one anchor that one suffix array holds; more are parted by what their windows share.
HELD = 2048
#: Contexts of an anchor that make a partition name it, and contexts (of 700 bytes at most) that a task may hold of one anchor.
NAMED, HEAVY = 8, 100_000
#: Rows of heavy anchors (a long each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Contexts, about, that are handled together.
BATCH = 8_000

KINDS = "kind int, kh long, c1 long, c2 long, rid long, pos int, l int, r int, n int"
SETTLED, ANCHOR, ASKED, MANY = 0, 1, 2, 3


def merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each document; touching ones become one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    wide = int(hi.max()) + 2
    top = np.maximum.accumulate(hi + rank * wide) - rank * wide
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1])
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.maximum.reduceat(top, first)


def anchors(raw: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """doc, pos, l, r, kh, c1, c2 of the anchors of texts of at least ``length`` bytes."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    wide = length - gram + 1
    sums = prefix_sums(data)
    h = slid_hash(sums, gram)
    n = len(h)
    if n < wide:
        return {}
    bits = np.uint64(32)  # the same for all texts, so that ties fall alike
    keyed = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // wide) * wide, np.uint64(2**64 - 1))
    padded[:n] = keyed
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - wide + 1)
    least = np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n])
    doc_of = np.repeat(np.arange(len(raw)), np.diff(at))
    inside = doc_of[start] == doc_of[start + length - 1]
    is_anchor = np.zeros(n, bool)
    is_anchor[(least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    a = np.flatnonzero(is_anchor)
    doc = doc_of[a]
    left = np.minimum(length - gram, a - at[doc])
    right = np.minimum(length, at[doc + 1] - a)
    whole = data.tobytes()
    said = b"".join([hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip((a - left).tolist(), (a + right).tolist(), strict=True)])
    c = np.frombuffer(said, "<u8").reshape(-1, 2)
    return {"doc": doc, "pos": a - at[doc], "l": left, "r": right, "kh": h[a], "c1": c[:, 0] ^ mix(left.astype(np.uint64)), "c2": c[:, 1]}


def _frame(kind: int, rid: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, kh=0, c1=0, c2=0, n=0) -> pd.DataFrame:
    one = lambda x: x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x
    return pd.DataFrame({"kind": np.int32(kind), "kh": one(kh), "c1": one(c1), "c2": one(c2), "rid": rid, "pos": pos.astype(np.int32), "l": left.astype(np.int32), "r": right.astype(np.int32), "n": n if isinstance(n, int) else n.astype(np.int32)}).astype({"kh": np.int64, "c1": np.int64, "c2": np.int64, "n": np.int32})


def _spans(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """Settled spans [lo, hi) as rows: pos is lo, r the length."""
    rid, lo, hi = merge(rid, lo, hi)
    return _frame(SETTLED, rid, lo, np.zeros(len(lo), np.int64), hi - lo)


def find_anchors(docs: DataFrame, length: int, gram: int, named: int = NAMED) -> DataFrame:
    """docs(rid, _text) -> SETTLED spans of contexts that a partition holds twice, one ANCHOR row for each context, and MANY (kh, n) of anchors with ``named`` contexts and more."""

    def combine(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = pd.concat(held, ignore_index=True)
        c1, c2 = a["c1"].to_numpy(), a["c2"].to_numpy()
        order = np.lexsort((c2, c1))
        new = np.ones(len(a), bool)
        new[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(a)))
        again = order[np.repeat(n > 1, n)]
        if len(again):
            x = a.iloc[again]
            yield _spans(x["rid"].to_numpy(), (x["pos"] - x["l"]).to_numpy(), (x["pos"] + x["r"]).to_numpy())
        x = a.iloc[order[first]]
        yield _frame(ANCHOR, *(x[k].to_numpy() for k in ("rid", "pos", "l", "r", "kh", "c1", "c2")), n=np.minimum(n, 2))
        kh, many = np.unique(x["kh"].to_numpy(), return_counts=True)
        kh, many = kh[many >= named], many[many >= named]
        if len(kh):
            none = np.zeros(len(kh), np.int64)
            yield _frame(MANY, none, none, none, none, kh, n=many)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            rid, raw = b["rid"].to_numpy(), [t.encode("utf-8", "surrogatepass") for t in b["_text"]]
            group = np.cumsum([len(x) for x in raw]) // CHUNK
            for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(group)) + 1):
                part = [i for i in part if len(raw[i]) >= length]
                got = anchors([raw[i] for i in part], length, gram) if part else {}
                if got:
                    held.append(pd.DataFrame({k: v for k, v in got.items() if k != "doc"} | {"rid": rid[part][got["doc"]]}))
                    size += len(held[-1])
                if size > COMBINED:
                    yield from combine(held)
                    held, size = [], 0
        if held:
            yield from combine(held)

    return docs.mapInPandas(released(run), KINDS)


def heavy_anchors(found: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """kh of anchors with more than ``heavy`` contexts, as far as partitions named them. There is at most one for each ``heavy`` rows."""
    return cut(found.where(f"kind = {MANY}").groupBy("kh").agg(F.sum("n").alias("_n")).where(F.col("_n") > heavy).select("kh"))


def settle(found: DataFrame, heavy: DataFrame) -> DataFrame:
    """ANCHOR rows by kh -> SETTLED spans of contexts held twice, and an ASKED row for each context of an anchor that has several (n: 2 if the context itself is settled).

    Rows of a heavy anchor are dealt by their context as well. Each partition has sent a context once, so that no key is hot.
    """

    def out(a: pd.DataFrame) -> Iterator[pd.DataFrame]:
        kh, c1, c2, n = (a[k].to_numpy() for k in ("kh", "c1", "c2", "n"))
        new_k = np.ones(len(a), bool)
        new_k[1:] = kh[1:] != kh[:-1]
        new_c = new_k.copy()
        new_c[1:] |= (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        heads, keys = np.flatnonzero(new_c), np.flatnonzero(new_k)
        total = np.add.reduceat(n, heads)
        twice = np.repeat(total > 1, np.diff(np.append(heads, len(a)))) & (n == 1)
        if twice.any():
            x = a[twice]
            yield _spans(x["rid"].to_numpy(), (x["pos"] - x["l"]).to_numpy(), (x["pos"] + x["r"]).to_numpy())
        contexts = np.add.reduceat(new_c.astype(np.int64), keys)
        several = np.repeat((contexts > 1) | a["heavy"].to_numpy()[keys], np.diff(np.append(keys, len(a))))[heads]
        if several.any():
            x, own = a.iloc[heads[several]], np.minimum(total[several], 2)
            yield _frame(ASKED, *(x[k].to_numpy() for k in ("rid", "pos", "l", "r", "kh")), n=own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if b["kh"].iloc[-1] == b["kh"].iloc[0] and rest and rest[-1]["kh"].iloc[-1] == b["kh"].iloc[0]:
                rest.append(b)
                continue
            last = int(np.searchsorted(b["kh"].to_numpy(), b["kh"].iloc[-1]))
            yield from out(pd.concat([*rest, b.iloc[:last]], ignore_index=True)) if rest or last else ()
            rest = [b.iloc[last:]]
        if rest:
            yield from out(pd.concat(rest, ignore_index=True))

    rows = _marked(found.where(f"kind = {ANCHOR}"), heavy)
    rows = rows.repartition("kh", F.when(F.col("heavy"), F.col("c1"))).sortWithinPartitions("kh", "c1", "c2")
    return rows.mapInPandas(released(run), KINDS)


def _marked(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` with ``heavy``: whether their anchor is."""
    n = heavy.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.withColumn("heavy", F.lit(False))
    marks = heavy.withColumn("_heavy", F.lit(True))
    return rows.join(F.broadcast(marks) if n <= BROADCAST_ROWS else marks, "kh", "left").withColumn("heavy", F.col("_heavy").isNotNull()).drop("_heavy")


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """kh, rid, pos, l, n, ctx of each ASKED row; texts without any stay where they are read."""
    wanted = asked.groupBy("rid").agg(F.collect_list(F.struct("kh", "pos", "l", "r", "n")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, text, asked in zip(b["rid"], b["_text"], b["asked"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["kh"], rid, x["pos"], x["l"], x["n"], raw[x["pos"] - x["l"] : x["pos"] + x["r"]]) for x in asked]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["kh", "rid", "pos", "l", "n", "ctx"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["kh", "rid", "pos", "l", "n", "ctx"])

    return docs.join(wanted, "rid").select("rid", "_text", "asked").mapInPandas(released(run), "kh long, rid long, pos int, l int, n int, ctx binary")


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a[i] and b[i]."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 8192):
        x, y = a[lo : lo + 8192], b[lo : lo + 8192]
        differ = m[x] != m[y]
        at = np.where(differ.any(1), differ.argmax(1), m.shape[1])
        out[lo : lo + 8192] = np.minimum(at, np.minimum(size[x], size[y]))
    return out


def _intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the suffix array with these common prefixes; lcp[0] is not used."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, first = int(lcp[i]) if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


class _Least:
    """Least of any stretch of an array."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 ** len(self.rows) <= len(x):
            y, k = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(y[:-k], y[k:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of x[lo] to x[hi], both included."""
        k = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for j in np.unique(k):
            i = k == j
            out[i] = np.minimum(self.rows[j][lo[i]], self.rows[j][hi[i] - 2**j + 1])
        return out


def _sorted(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before it)."""
    size = np.array(list(map(len, parts)))
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__))
    lcp = np.zeros(len(parts), np.int64)
    lcp[1:] = _common(_matrix(parts, max(1, int(size.max()))), size, order[:-1], order[1:])
    return order, lcp


def _agreeing(right: list[bytes], left: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, _Least]]:
    """(common right, members in order of their left parts, common left of each with the one before, places, common right by places) of each interval.

    ``right`` are the contexts from the anchor on, ``left`` those before it, reversed. An interval of the suffix array is a
    set that agrees to the right as far as it can.
    """
    m = len(right)
    l_size = np.array(list(map(len, left)))
    order, lcp = _sorted(right)
    by_left, left_lcp = _sorted(left)
    rank, place = np.empty(m, np.int64), np.empty(m, np.int64)
    rank[by_left], place[order] = np.arange(m), np.arange(m)
    near_left, near_right = _Least(left_lcp), _Least(lcp)
    for depth, first, last in _intervals(lcp):
        if last == first:
            continue
        own = order[first : last + 1]
        own = own[l_size[own] + depth >= length]
        if len(own) < 2:
            continue
        own = own[np.argsort(rank[own])]
        common = np.append(0, near_left(rank[own[:-1]] + 1, rank[own[1:]]))
        if (common[1:] + depth >= length).any():
            yield depth, own, common, place[own], near_right


def maximal_repeats(right: list[bytes], left: list[bytes], length: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(all occurrences, common left extension, common right) of the maximal repeats of ``length`` bytes and more.

    An interval of the left order within one of the suffix array is a subset whose members differ in the byte to the left of
    what they share. Those that agree further to the right are left to a deeper interval.
    """
    for depth, own, common, place, near_right in _agreeing(right, left, length):
        for ext, a, b in _intervals(common):
            if b > a and ext + depth >= length:
                at = place[a : b + 1]
                if near_right(at.min(keepdims=True) + 1, at.max(keepdims=True))[0] == depth:
                    yield own[a : b + 1], ext, depth


def repeated_spans(right: list[bytes], left: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """[(members, bytes to the left that each shares, bytes to the right)]: the spans of maximal_repeats() without listing every group.

    A member's longest extension is shared with a neighbour in the left order. Where both agree further to the right, a
    deeper interval holds them with no less to the left, so nothing is lost here.
    """
    out = []
    for depth, own, common, place, near_right in _agreeing(right, left, length):
        k = np.flatnonzero(common[1:] + depth >= length)
        x, y = place[k], place[k + 1]
        k = k[near_right(np.minimum(x, y) + 1, np.maximum(x, y)) == depth]
        ext = np.zeros(len(own), np.int64)
        np.maximum.at(ext, k, common[k + 1])
        np.maximum.at(ext, k + 1, common[k + 1])
        some = ext + depth >= length
        some[np.setdiff1d(np.arange(len(own)), np.append(k, k + 1))] = False
        if some.any():
            out.append((own[some], ext[some], depth))
    return out


def cover(ctx: list[bytes], left: np.ndarray, length: int, gram: int, span: tuple[int, int] | None = None, held: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, lo, hi), from the anchor, of spans that each context shares with another of the same anchor.

    More than ``held`` contexts are parted: all windows that begin ``a`` to ``b`` bytes before the anchor hold the bytes from a
    before it to length - b after it, so contexts without another that agrees there have no repeat among those windows. The
    parts halve until a suffix array can hold them or one window is left, which then is the repeat.
    """
    m = len(ctx)
    if m <= held and span is None:
        return _flat(repeated_spans([c[x:] for c, x in zip(ctx, left.tolist(), strict=True)], [c[:x][::-1] for c, x in zip(ctx, left.tolist(), strict=True)], length))
    lo, hi = span or (0, length - gram)
    size = np.array(list(map(len, ctx)))
    fits = np.flatnonzero((left >= lo) & (size - left >= length - hi))
    parts: dict[bytes, list[int]] = {}
    for i in fits.tolist():
        parts.setdefault(ctx[i][left[i] - lo : left[i] + length - hi], []).append(i)
    out = []
    for own in parts.values():
        if len(own) < 2:
            continue
        own = np.array(own)
        if lo == hi:
            out.append((own, np.full(len(own), -lo), np.full(len(own), length - lo)))
        elif len(own) <= held:
            i, a, b = cover([ctx[k] for k in own], left[own], length, gram, None, held)
            out.append((own[i], a, b))
        else:
            mid = (lo + hi) // 2
            for half in ((lo, mid), (mid + 1, hi)):
                i, a, b = cover([ctx[k] for k in own], left[own], length, gram, half, held)
                out.append((own[i], a, b))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _flat(found: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    empty = np.zeros(0, np.int64)
    return (
        np.concatenate([empty, *(i for i, _, _ in found)]),
        np.concatenate([empty, *(-e for _, e, _ in found)]),
        np.concatenate([empty, *(np.full(len(i), d, np.int64) for i, _, d in found)]),
    )


def heavy_repeats(ctx: DataFrame, length: int, gram: int) -> DataFrame:
    """SETTLED spans of the contexts of heavy anchors, by digests alone; rows of one digest never meet in a task.

    Windows start 0 to length - gram bytes before the anchor. Those that start lo to hi before it all hold the bytes from
    lo before it to length - hi after it (their core); a context whose core is its own has no repeat among them. All they
    span is hi before to length - lo after; a context that shares this with another has a repeat in each. Ranges for which
    neither holds are halved until they are one window, whose core is all of it.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, pos, left, c, lo, hi in zip(b["rid"], b["pos"], b["l"], b["ctx"], b["lo"], b["hi"], strict=True):
                right = len(c) - left
                if left >= lo and right >= length - hi:
                    core, whole = (hashlib.blake2b(c[left - x : left + y], digest_size=16).digest() for x, y in ((lo, length - hi), (hi, length - lo)))
                    out.append((rid, pos, lo, hi, core, whole if left >= hi and right >= length - lo else None))
            yield pd.DataFrame(out, columns=["rid", "pos", "lo", "hi", "core", "whole"])

    place = ["rid", "pos", "lo", "hi"]
    often = lambda rows, d: rows.where(F.col(d).isNotNull()).groupBy(d, "lo").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(d, "lo")
    asked = ctx.select("rid", "pos", F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    spans: list[DataFrame] = []
    while True:
        rows = cut(ctx.select("rid", "pos", "l", "ctx").join(asked, ["rid", "pos"]).mapInPandas(released(digests), "rid long, pos int, lo int, hi int, core binary, whole binary"))
        shared = cut(rows.join(cut(often(rows, "core")), ["core", "lo"], "left_semi"))
        settled = cut(shared.join(cut(often(shared, "whole")), ["whole", "lo"], "left_semi"))
        spans.append(settled.select(place))
        open_ = shared.where("lo < hi").join(settled.select(place), place, "left_anti")
        # A window of an open range may be shared with a context whose range is settled: one of each such kind stands for all.
        kinds = settled.where("lo < hi").groupBy("whole", "lo").agg(F.min(F.struct("rid", "pos", "hi", "core")).alias("r")).select("lo", "r.*")
        partners = kinds.join(open_.select("core", "lo").distinct(), ["core", "lo"], "left_semi")
        halves = F.inline(F.array(F.struct("lo", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("hi")), F.struct((F.floor((F.col("lo") + F.col("hi")) / 2) + 1).cast("int").alias("lo"), "hi")))
        asked = cut(open_.select(place).unionByName(partners.select(place)).select("rid", "pos", halves))
        if not asked.limit(1).count():
            break
    found, zero = reduce(DataFrame.unionByName, spans), F.lit(0).cast("long")
    return found.select(F.lit(SETTLED).alias("kind"), zero.alias("kh"), zero.alias("c1"), zero.alias("c2"), "rid", (F.col("pos") - F.col("hi")).alias("pos"), F.lit(0).alias("l"), (F.col("hi") - F.col("lo") + length).alias("r"), F.lit(1).alias("n"))


def repeats(ctx: DataFrame, length: int, gram: int, held: int = HELD) -> DataFrame:
    """SETTLED spans of contexts that share only a part with others of their anchor."""

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        """g: two rows of each anchor."""
        left, whole = g["l"].to_numpy(np.int64), g["ctx"].tolist()
        right, back = [c[x:] for c, x in zip(whole, left.tolist(), strict=True)], [c[:x][::-1] for c, x in zip(whole, left.tolist(), strict=True)]
        a, b = np.arange(0, len(g), 2), np.arange(1, len(g), 2)
        r = np.repeat(_common(_matrix(right, length), np.array(list(map(len, right))), a, b), 2)
        x = np.repeat(_common(_matrix(back, length - gram), left, a, b), 2)
        ok = (r + x >= length) & (g["n"].to_numpy() < 2)
        pos = g["pos"].to_numpy(np.int64)[ok]
        return _spans(g["rid"].to_numpy()[ok], pos - x[ok], pos + r[ok])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        size = 0
        for b in _with_end(batches):
            if b is not None and len(b):
                rest.append(b)
                size += len(b)
                if size < BATCH:
                    continue
            if not rest:
                continue
            a = pd.concat(rest, ignore_index=True)
            kh = a["kh"].to_numpy()
            last = len(a) if b is None else int(np.searchsorted(kh, kh[-1]))
            rest, size = [a.iloc[last:]], len(a) - last
            a, kh = a.iloc[:last], kh[:last]
            edges = np.append(np.flatnonzero(np.append(True, kh[1:] != kh[:-1])), last) if last else np.zeros(1, np.int64)
            n = np.diff(edges)
            two = np.repeat(n == 2, n)
            if two.any():
                yield pairs(a[two])
            for i in np.flatnonzero(n > 2).tolist():
                g = a.iloc[edges[i] : edges[i + 1]]
                who, lo, hi = cover(g["ctx"].tolist(), g["l"].to_numpy(np.int64), length, gram, None, held)
                keep = g["n"].to_numpy()[who] < 2
                pos = g["pos"].to_numpy(np.int64)[who[keep]]
                if len(pos):
                    yield _spans(g["rid"].to_numpy()[who[keep]], pos + lo[keep], pos + hi[keep])

    return ctx.repartition("kh").sortWithinPartitions("kh").mapInPandas(released(run), KINDS)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, held: int = HELD, heavy: int = HEAVY, named: int = NAMED, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges: array<struct<start, end>>), and the rest of the text with ``with_text``.

    Each byte covered by a ``length``-byte string that also starts anywhere else, in this or another row, is removed.
    Null text is empty; shorter texts lose nothing. Rows that repeat are copies of each other. Other columns are not
    carried. Where a cut parts a character, the rest of the text drops its halves.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("_text")).withColumn("rid", F.xxhash64("doc_id", "_text"))
    long = docs.select("rid", "_text").where(F.octet_length("_text") >= length)
    found = cut(find_anchors(long, length, gram, named))
    many = heavy_anchors(found, heavy)
    settled = cut(settle(found, many))
    free(spark)
    asked = _marked(settled.where(f"kind = {ASKED}"), many)
    shared = cut(repeats(contexts(long, asked.where("not heavy")), length, gram, held))
    if many.limit(1).count():
        hot = cut(contexts(long, asked.where("heavy")))
        shared = shared.unionByName(cut(heavy_repeats(hot, length, gram)))
    free(spark)
    known = lambda d: d.where(f"kind = {SETTLED}").select("rid", F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("r")).alias("end")).alias("s"))
    spans = known(found).unionByName(known(settled)).unionByName(known(shared)).groupBy("rid").agg(F.collect_list("s").alias("_spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, s in zip(b["_text"], b["_spans"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                lo, hi = (np.array([x[k] for x in s], np.int64) for k in ("start", "end")) if s is not None and len(s) else (np.zeros(0, np.int64),) * 2
                _, lo, hi = merge(np.zeros(len(lo), np.int64), lo, hi)
                cuts = [0, *(x for p in zip(lo.tolist(), hi.tolist(), strict=True) for x in p), len(raw)]
                kept = b"".join(raw[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))
                row = (len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
                rows.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"][: 5 + with_text])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,`end`:long>>" + (", text string" if with_text else "")
    return docs.join(spans, "rid", "left").select("doc_id", "_text", "_spans").mapInPandas(released(run), kinds)
