"""Quality rules on repetition inside a text.

A suffix array over the words of each text is built for a whole batch at once by prefix doubling. Where neighbours share
``min_words`` words or more, a stack scan forms the longest-common-prefix intervals; those whose members differ in the word
to the left are the maximal repeated substrings. Their spans are united; a text fails if the spans cover too much of it or
one repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import Words, identities, released, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]")] = True
SYMBOLS[list(b"[]")] = False
#: Bytes of text that are held as arrays at once.
CHUNK = 2 << 20
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def suffix_array(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of all texts, each ending with its text; lcp[i] is that of order[i - 1] and order[i].

    Suffixes sort by (length-h prefix, prefix after it), h doubling. Only those that still tie are sorted anew.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.ones(n, bool)
    last[:-1] = doc[1:] != doc[:-1]
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(n))]  # last word of the suffix's text
    order = np.lexsort((ids, doc))
    new = np.ones(n, bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n, np.int64)  # index in order of the first suffix that ties with this
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank.copy()], 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        pos = order[tied]
        after = np.where(pos + h <= end[pos], rank[np.minimum(pos + h, n - 1)], -1)
        again = np.lexsort((after, rank[pos]))
        pos, after, head = pos[again], after[again], rank[pos[again]]
        order[tied] = pos
        diff = np.ones(len(pos), bool)
        diff[1:] = (after[1:] != after[:-1]) | (head[1:] != head[:-1])
        new[tied[diff]] = True
        rank[pos] = np.maximum.accumulate(np.where(diff, tied, 0))
        levels.append(rank.copy())
        h *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        i = live
        x, y = a[i], b[i]
        ok = (x < n) & (y < n)
        xs, ys = np.minimum(x, n - 1), np.minimum(y, n - 1)
        step = 1 << k
        ok &= (levels[k][xs] == levels[k][ys]) & (doc[xs] == doc[order[i]]) & (doc[ys] == doc[order[i]]) & (xs + step - 1 <= end[xs]) & (ys + step - 1 <= end[ys])
        i = i[ok]
        lcp[i + 1] += step
        a[i] += step
        b[i] += step
    return order, lcp


def intervals(lcp: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """([(common prefix, first, last, parent)], the least interval of each suffix) of a run of a suffix array.

    lcp[i] is that of suffixes i - 1 and i, and lcp[0] is not used; all others are above 0. Parents come after their
    children; the last has parent -1. Each suffix's least interval is the first that holds it to be closed.
    """
    n = len(lcp)
    out: list[list[int]] = []
    own = [-1] * n
    stack: list[tuple[int, int, list[int], list[int]]] = []  # depth, first, closed children, suffixes without an interval so far
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        first, children, loose = i - 1, [], [i - 1]
        while stack and stack[-1][0] > now:
            depth, first, below, suffixes = stack.pop()
            k = len(out)
            out.append([depth, first, i - 1, -1])
            for c in below + children:
                out[c][3] = k
            for x in suffixes + loose:
                own[x] = k
            children, loose = [k], []
        if stack and stack[-1][0] == now:
            stack[-1][2].extend(children)
            stack[-1][3].extend(loose)
        elif now:
            stack.append((now, first, children, loose))
    return [tuple(x) for x in out], own


def maximal_reach(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """Of each place, the longest maximal repeat of ``least`` words or more that starts there, or 0. ``before``: the code of the word to the left, others at a text's start."""
    reach = np.zeros(len(order), np.int64)
    deep = np.append(np.append(False, lcp[1:] >= least), False)
    edge = np.flatnonzero(np.diff(deep.astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # suffixes a to b share `least` words with a neighbour
        found, own = intervals(lcp[a : b + 1].tolist())
        left = before[order[a : b + 1]]
        change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
        value = [0] * len(found)
        for k in range(len(found) - 1, -1, -1):  # parents first
            depth, first, last, parent = found[k]
            diverse = change[last] > change[first]
            value[k] = depth if diverse else value[parent] if parent >= 0 else 0
        reach[order[a : b + 1]] = [value[k] for k in own]
    return reach


def spread(marks: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in [mark, mark + length) for some mark."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, marks, 1)
    np.add.at(edge, marks + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(w: Words, texts: list[str], min_words: int) -> dict[str, np.ndarray]:
    n_docs, n = len(texts), len(w.hash)
    ids, _ = w.codes()
    order, lcp = suffix_array(ids, w.doc)
    twice = np.zeros(n, bool)  # whether the three words from here on are found elsewhere in the text
    if n:
        twice[order] = np.maximum(lcp, np.append(lcp[1:], 0)) >= 3
    three = spread(np.flatnonzero(twice), np.full(twice.sum(), 3), n)
    before = np.append(-1, ids[:-1]) if n else ids
    starts = w.first[:-1][np.diff(w.first) > 0]
    before[starts] = -1 - np.arange(len(starts))
    reach = maximal_reach(order, lcp, before, min_words)
    long = np.flatnonzero(reach)
    covered = spread(long, reach[long], n)
    per = lambda x: np.bincount(w.doc, weights=x, minlength=n_docs).astype(np.int64)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, w.doc[long], reach[long])
    heads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[w.data])])
    # lines: identity of the whole line, counted where it holds a word
    cuts = np.unique(np.concatenate([w.doc_at - 1, np.flatnonzero(w.data == 10)]))
    lo, hi = cuts[:-1] + 1, cuts[1:]
    line_doc = np.searchsorted(w.doc_at, lo, side="right") - 1
    has = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
    lo, hi, line_doc = lo[has], hi[has], line_doc[has]
    first, second = identities(w.data, lo, hi)
    same = pd.DataFrame({"d": line_doc, "n": hi - lo, "a": first, "b": second}).duplicated().to_numpy()
    return {
        "n_words": np.diff(w.first), "word_chars": per(heads[w.end] - heads[w.start]), "n_symbols": symbols[w.doc_at[1:]] - symbols[w.doc_at[:-1]],
        "n_dup_lines": np.bincount(line_doc[same], minlength=n_docs), "n_repeat_words": per(three), "covered_words": per(covered), "longest_repeat": longest,
    }


def quality(df: DataFrame, text: str = "text", min_words: int = 10, max_covered: float = 0.3, max_longest: int = 60, long_share: float = 0.1, least_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """Columns of ``df`` but ``text``, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept.

    A null text has no words and fails. ``base_failed``: fewer than ``least_words`` words, or more than ``max_repeated``
    percent of them in three-word windows that occur twice. Then the verdict is that of the maximal repeats of
    ``min_words`` words and more: they may cover ``max_covered`` of the words, and none may be longer than
    ``max_longest`` words and ``long_share`` of the text. Columns named like results are replaced.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    rest = [c for c in df.columns if c != text and c not in names]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["_text"]]
            sizes = np.cumsum([len(t) for t in texts])
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // CHUNK)) + 1):
                if not len(part):
                    continue
                own = [texts[i] for i in part]
                m = measure(words(own), own, min_words)
                n = m["n_words"]
                failed = (n < least_words) | (100 * m["n_repeat_words"] > max_repeated * n)
                bad = (m["covered_words"] > max_covered * n) | ((m["longest_repeat"] > max_longest) & (m["longest_repeat"] > long_share * n))
                out = b[rest].iloc[part].copy()
                for k, v in m.items():
                    out[k] = v
                out["base_failed"], out["kept"] = failed, ~failed & ~bad
                yield out

    return df.select(*rest, F.col(text).alias("_text")).mapInPandas(released(run), f"{fields}, {RESULT}" if fields else RESULT)
