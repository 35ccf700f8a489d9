"""Best-fit packing with certified bin counts.

Texts become token ids; only those longer than a sequence are cut. Each partition packs its pieces by best-fit
decreasing and holds its bin count against lower bounds from dual feasible functions. A partition that meets its bound is
certified optimal. The others release the pieces of their emptiest bins, which meet in fewer partitions and are packed
again, until no gap is left or one partition holds them all.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .textnum import LOWER, SPACE, Words, joined, released, words_at

LENGTH = 4096
END = 1
#: Pieces that one task packs, about.
PER_TASK = 1 << 16
#: Bytes of text tokenised at once, and words whose ids a worker remembers.
CHUNK, REMEMBERED = 1 << 20, 1_000_000


#: Byte classes: 1 ASCII letters, 2 digits, 3 other ASCII, 0 what may belong with any neighbour.
KIND = np.zeros(256, np.int8)
KIND[:128] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2


def units(texts: list[str]) -> Words:
    """The texts in units that the tokenizer encodes alike alone and in place: words, parted further where ASCII classes meet, A-Z in lower case.

    An apostrophe stays with the letters after it. A word with ``<|`` is left as it is, since it may hold a special token.
    """
    data, at = joined(texts)
    kind, gap = KIND[data], SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a unit starts or ends in front of this byte
    edge[0] = edge[-1] = True
    edge[1:-1] = (gap[1:] != gap[:-1]) | ((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ((data[:-1] != 39) | (kind[1:] != 1)))
    low = LOWER[data]
    odd = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(odd):
        space = np.flatnonzero(gap)
        i = np.searchsorted(space, odd)
        for lo, hi in {(int(space[k - 1]) + 1 if k else 0, int(space[k])) for k in i.tolist()}:
            edge[lo + 1 : hi] = False
            low[lo:hi] = data[lo:hi]
    cuts = np.flatnonzero(edge)
    whole = ~gap[cuts[:-1]] if len(data) else np.zeros(0, bool)
    start, end = cuts[:-1][whole], cuts[1:][whole]
    return words_at(low, at, start, end)


#: What units() relies on: white space parts words and is dropped, case is folded, and a pattern parts words further.
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_units(path: str) -> bool:
    """Whether a tokenizer's file asks for what units() relies on. Texts of others are encoded whole."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = lambda x, many: [x] if x and x["type"] != "Sequence" else (x or {}).get(many, [])
    before = steps(said.get("normalizer"), "normalizers")
    parts = steps(said.get("pre_tokenizer"), "pretokenizers")
    return (
        [x["type"] for x in before] == ["NFC", "Replace", "Lowercase"]
        and (before[1]["pattern"], before[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": PARTED}, "Removed", True)
        and not (parts[1]["add_prefix_space"] or parts[1]["use_regex"])
        and all("<|" in x["content"] and not x["lstrip"] and not x["rstrip"] for x in said["added_tokens"])
        and not said["model"].get("dropout")
    )


class Tokens:
    """Ids of texts unit by unit; each distinct unit is encoded once, and a worker remembers what it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parted = Tokenizer.from_file(path), by_units(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes in order, and of each the identity and the place and number of its ids
        self.same = tuple(np.zeros(0, np.uint64) for _ in range(3))
        self.place, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.empty(1 << 23, np.uint32), 0  # grows in large steps

    def find(self, hashes: np.ndarray, own: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(where each unit is known, whether it is). Units of one hash are told apart by their identities."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        i = np.searchsorted(self.known, hashes)
        while True:
            j = np.minimum(i, len(self.known) - 1)
            hit = (i == j) & (self.known[j] == hashes)
            right = hit & np.logical_and.reduce([x[j] == y for x, y in zip(self.same, own, strict=True)])
            if (hit == right).all():
                return j, right
            i = i + (hit & ~right)

    def learn(self, hashes: np.ndarray, own: tuple[np.ndarray, ...], said: list[str]) -> None:
        new = [e.ids for e in self.tokenizer.encode_batch_fast(said, add_special_tokens=False)]
        count = np.fromiter(map(len, new), np.int64, len(new))
        place, total = self.used + np.cumsum(count) - count, int(count.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(total, 1 << 23), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(new), np.uint32, total)
        self.used += total
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        put = lambda have, more: np.insert(have, at, more[order])
        self.known, self.place, self.count = put(self.known, hashes), put(self.place, place), put(self.count, count)
        self.same = tuple(put(x, y) for x, y in zip(self.same, own, strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END after it; where each starts, and the end)."""
        if not self.parted:
            own = [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        w = units(texts)
        code, head = w.codes()
        order = np.argsort(w.hash[head])  # looked up in order, which keeps to the caches
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        head, code = head[order], place[code]
        kinds, own = w.hash[head], (*(x[head] for x in w.identity), (w.end - w.start)[head].astype(np.uint64))
        if len(self.known) > REMEMBERED:
            self.clear()
        i, known = self.find(kinds, own)
        new = np.flatnonzero(~known)
        if len(new):
            raw, at = w.data.tobytes(), head[new]
            said = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            self.learn(kinds[new], tuple(x[new] for x in own), said)
            i, _ = self.find(kinds, own)
        n = self.count[i].astype(np.int64)[code]
        ends = np.cumsum(n)
        source = np.repeat(self.place[i].astype(np.int64)[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        before = np.concatenate([[0], ends])[w.first]  # ids before each text, without ENDs
        at = before + np.arange(len(before))
        out = np.full(at[-1], END, np.uint32)
        out[np.arange(len(source)) + np.repeat(w.doc, n)] = self.ids[source]
        return out, at


_tokens: dict[str, Tokens] = {}


def pieces(df: DataFrame, tokenizer: str, text: str = "text", length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` and piece, start, length, ids_crc32 (and ids) of each text's pieces. A null text is empty, and so END alone."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokens.setdefault(tokenizer, None) or Tokens(tokenizer)
        _tokens[tokenizer] = encode
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["_text"]]
            group = np.cumsum([len(t) for t in texts]) // CHUNK
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                ids, at = encode([texts[i] for i in part])
                rows = [(i, k, s, min(length, n - s)) for i, n in enumerate(np.diff(at).tolist()) for k, s in enumerate(range(0, n, length))]
                doc, piece, start, size = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                own = [ids[a : a + n].astype("<u4") for a, n in zip((at[doc] + start).tolist(), size.tolist(), strict=True)]
                out = b[list(keep)].iloc[part[doc]].copy()
                out["piece"], out["start"], out["length"], out["ids_crc32"] = piece.astype(np.int32), start, size, [zlib.crc32(x.tobytes()) for x in own]
                if with_ids:
                    out["ids"] = own
                yield out

    kinds = f"{fields}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(released(run), kinds)


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each item, its offset there, room left in each bin), best fit by decreasing length."""
    bins, offsets, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                some ^= 1 << r
        else:
            r, b = room, len(left)
            left.append(room)
        bins[i], offsets[i] = b, room - r
        left[b] = r - n
        with_room[r - n].append(b)
        some |= 1 << (r - n)
    return bins, offsets, left


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """Greatest of the bounds from two families of dual feasible functions.

    One rounds items above room - t up to a whole bin and drops those below t, for every t up to half a bin; the other
    is u(k), which rounds (k + 1) x / room down to k-ths of a bin unless it is whole.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=room + 1)
    size = np.arange(room + 1)
    count, total = np.cumsum(n), np.cumsum(n * size)
    t = np.arange(0, room // 2 + 1)
    big = count[-1] - count[room - t]
    middle = total[room - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int((big + -(-middle // room)).max())
    for k in range(1, 65):
        whole = (k + 1) * size % room == 0
        scaled = np.where(whole, size * k, (k + 1) * size // room * room)  # in units of 1 / (k * room)
        best = max(best, int(-(-(n * scaled).sum() // (k * room))))
    return best


def _packer(rest: list[str], size: str, length: int, spare: int, turn: int, final: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        sizes = g[size].to_numpy(np.int64)
        bins, offsets, left = best_fit(sizes, length)
        bound = lower_bound(sizes, length)
        free = np.zeros(len(left), bool)
        if len(left) > bound and not final:
            free[np.argsort(-np.array(left), kind="stable")[: 2 * (len(left) - bound) + spare]] = True
        out = g[rest].copy()
        out["sequence_id"], out["offset"], out["bins"], out["bound"], out["_free"] = (turn << 52) + (int(key[0]) << 32) + bins, offsets, len(left), bound, free[bins]
        return out

    return run


def pack(items: DataFrame, length: int = LENGTH, per_task: int = PER_TASK, spare: int = 64, size: str = "length") -> DataFrame:
    """``items`` with sequence_id, offset, bins and bound (of the partition that packed it last).

    Items longer than ``length`` are an error of the caller; an empty table gives an empty one. Rows that repeat are
    packed each. Every column of ``items`` passes through but those named like results.
    """
    names = ["sequence_id", "offset", "bins", "bound"]
    rest = [c for c in items.columns if c not in names]
    fields = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in rest)
    work = cut(items.select(rest))
    count = work.count()
    tasks, done = max(1, -(-count // per_task)), []
    for turn in range(64):
        own = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(tasks)).alias("_task")
        kinds = f"{fields}, sequence_id long, offset long, bins long, bound long, _free boolean"
        packed = cut(work.select("*", own).groupBy("_task").applyInPandas(_packer(rest, size, length, spare, turn, tasks == 1), kinds))
        done.append(packed.where("not _free").drop("_free"))
        work = packed.where("_free").select(rest)
        count = 0 if tasks == 1 else work.count()
        if not count:
            break
        tasks = max(1, min(tasks // 2, -(-count // per_task)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
