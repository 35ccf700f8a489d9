"""Whole batches of texts as numpy arrays: words, their identities, hashes of shingles and of byte windows.

A word's identity is its length and 128 bits: the word itself up to 16 bytes, the BLAKE2b digest of a longer one. Its hash
mixes them to 64 bits. Where equal words decide a result, identities are compared and not hashes (``Words.codes``).
Windows of a fixed length have a polynomial hash modulo 2**64, which only ranks them: strings that collide there may share a
rank, but nothing takes them for equal.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def released(run: Callable) -> Callable:
    """``run`` for mapInPandas; when it is through, its memory goes back to the system, since the worker lives on for later stages."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return tidy


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def slid_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Rank of data[i:i + k] for each i."""
    n = len(sums) - 1
    if n < k:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[: n - k + 1]) * powers(_INV, n + 1)[: n - k + 1])


#: Bytes of a word that are its identity as they stand.
PLAIN = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def identities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) 64 bits of the identity of each data[start:end]; with the length they are equal only for equal strings."""
    size = end - start
    lanes = np.ndarray((len(data) + 8,), "<u8", np.concatenate([data, np.zeros(15, np.uint8)]), strides=(1,))
    first = lanes[start] & _MASK[np.minimum(size, 8)]
    second = np.where(size > 8, lanes[np.maximum(end - 8, 0)], np.uint64(0))
    long = np.flatnonzero(size > PLAIN)
    if len(long):
        raw = data.tobytes()
        said = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        both = np.frombuffer(said, "<u8").reshape(-1, 2)
        first[long], second[long] = both[:, 0], both[:, 1]
    return first, second


def identity_hash(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(mix(first + size.astype(np.uint64) * np.uint64(_ODD)) + second * np.uint64(_BASE))


def first_of(code: np.ndarray, n: int) -> np.ndarray:
    """Index of the first member of each of ``n`` codes."""
    out = np.zeros(n, np.int64)
    out[code[::-1]] = np.arange(len(code))[::-1]
    return out


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, a blank after each
    doc_at: np.ndarray  # where each text starts, and the end
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # of each word
    first: np.ndarray  # index of each text's first word, and the number of words
    identity: tuple[np.ndarray, np.ndarray]
    hash: np.ndarray

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word's kind, a word of each kind): equal numbers for equal words and for no others."""
        code, kinds = pd.factorize(self.hash)
        head = first_of(code, len(kinds))
        own = (*self.identity, self.end - self.start)
        if all((x == x[head][code]).all() for x in own):
            return code, head
        rows = np.stack([own[0], own[1], own[2].astype(np.uint64)], 1)  # two words share a hash
        _, head, code = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        return code.ravel().astype(np.int64), head


def words_at(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> Words:
    doc = np.searchsorted(at, start, side="right") - 1
    own = identities(data, start, end)
    return Words(data, at, start, end, doc, np.searchsorted(start, at), own, identity_hash(*own, end - start))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), at


def words(texts: list[str | None], lower: bool = False) -> Words:
    data, at = joined(texts)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return words_at(data, at, start, end)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of n words; of a text with fewer words, but some, the run of them all."""
    m = len(w.hash)
    short_hash = []
    counts = np.diff(w.first)
    if m >= n:
        h = np.zeros(m - n + 1, np.uint64)
        for j in range(n):
            h = (h + w.hash[j : m - n + 1 + j]) * np.uint64(_BASE) + np.uint64(_ODD)
            h ^= h >> np.uint64(29)
        whole = w.doc[: m - n + 1] == w.doc[n - 1 :]
        doc, h = w.doc[: m - n + 1][whole], mix(h[whole])
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    for d in short:
        x = int(counts[d]) * _ODD % (1 << 64)
        for v in w.hash[w.first[d] : w.first[d + 1]]:
            x = ((x ^ int(v)) * _BASE + _ODD) % (1 << 64)
        short_hash.append(x)
    if len(short):
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(np.array(short_hash, np.uint64))])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def exact_shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) as of shingles(), but equal numbers within this batch are equal runs of words."""
    code, _ = w.codes()
    m, counts = len(code), np.diff(w.first)
    doc, num, kinds = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if m >= n:
        whole = w.doc[: m - n + 1] == w.doc[n - 1 :]
        at, wide = np.flatnonzero(whole), int(code.max()) + 1
        num = code[at].astype(np.int64)
        for j in range(1, n):
            num, known = pd.factorize(num * wide + code[at + j])
            kinds = len(known)
        doc = w.doc[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        seen: dict[tuple, int] = {}
        more = [kinds + seen.setdefault(tuple(code[w.first[d] : w.first[d + 1]].tolist()), len(seen)) for d in short]
        doc, num = np.concatenate([doc, short]), np.concatenate([num, np.array(more, np.int64)])
        order = np.argsort(doc, kind="stable")
        doc, num = doc[order], num[order]
    return doc, num


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, hash); doc must not fall."""
    if not len(doc):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
