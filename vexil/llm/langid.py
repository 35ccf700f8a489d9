"""Language identification with interpolated Kneser-Ney models of characters, one for each language.

Training counts every character 4-gram of every labelled text; each partition first adds up its own. Lower orders are
continuation counts of the next higher one. The models are sorted arrays of the n-grams themselves, 16 bits a character,
so no two n-grams share a count; they grow with the distinct n-grams of the labelled texts. A character beyond U+FFFF counts
as its two UTF-16 units, which are no letters by themselves.

All that the probability of a character needs is found under the character before it. So models of more than ``MODEL_ROWS``
rows are parted by that character: each part is collected and broadcast by itself, scores the characters that are its
own, and the sums of all parts meet by text. Smaller models are one part.

A text gets the language of least cross-entropy a character. How far that may lie above the language's own is calibrated on
labelled texts that were kept out of the counts: the ``QUANTILE`` of what they exceed it by, beyond what length explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .textnum import released

ORDER = 4
#: Labels are few by nature; more than this is taken for a wrong column.
MAX_LANGUAGES = 256
#: Characters that are held as arrays at once.
CHUNK = 1 << 18
#: Rows of model (24 bytes each) that are collected and broadcast at once.
MODEL_ROWS = 4_000_000
#: Share of kept-out texts of a language that pass its limit, standard errors that length explains, and the least and usual slack in nats.
QUANTILE, SIGMAS, LEAST_SLACK, SLACK = 0.998, 3.0, 0.05, 0.7
#: Kept-out texts of a language below which its slack is not set under the usual one.
ENOUGH = 500
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key) of each character, with the three before it, 16 bits each, and whether each text has a letter.

    Letters are lower-cased; each run of other characters is one blank, and three stand before a text.
    """
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(r) // 4 for r in raw])
    is_letter = letters()[codes]
    has = np.bincount(doc[is_letter], minlength=len(texts)) > 0
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & ~first[1:]
    c, doc = np.where(is_letter, codes, 32)[keep].astype(np.uint64), doc[keep]
    wide = c > 0xFFFF
    if wide.any():
        again = np.repeat(np.arange(len(c)), 1 + wide)
        c, doc, wide = c[again], doc[again], wide[again]
        second = np.zeros(len(c), bool)
        second[1:] = again[1:] == again[:-1]
        rest = c - np.uint64(0x10000)
        units = np.where(second, np.uint64(0xDC00) | rest & np.uint64(0x3FF), np.uint64(0xD800) | rest >> np.uint64(10))
        c = np.where(wide, units, c)
    key = c.copy()
    for back in (1, 2, 3):
        before = np.full(len(c), 32, np.uint64)
        if len(c) > back:
            same = doc[back:] == doc[:-back]
            before[back:][same] = c[:-back][same]
        key |= before << np.uint64(16 * back)
    return doc, key, has


def chunks(texts: list[str]) -> Iterator[np.ndarray]:
    if texts:
        size = np.cumsum([len(t) for t in texts]) // CHUNK
        yield from np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1)


def _low(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << 16 * order) - 1)


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, key, n of every 4-gram."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(name: str, keys: np.ndarray, n: np.ndarray) -> None:
            have = parts.setdefault(name, [])
            have.append((keys, n))
            if len(have) > 16:
                parts[name] = [merged(have)]

        def merged(have: list) -> tuple[np.ndarray, np.ndarray]:
            code, keys = pd.factorize(np.concatenate([k for k, _ in have]))
            return keys, np.bincount(code, weights=np.concatenate([n for _, n in have])).astype(np.int64)

        for b in batches:
            texts, names = b["_text"].tolist(), b["_lang"].to_numpy()
            for part in chunks(texts):
                doc, key, _ = grams([texts[i] for i in part])
                own, kinds = pd.factorize(names[part])
                of = own[doc]
                for j, name in enumerate(kinds):
                    code, keys = pd.factorize(key[of == j])
                    add(name, keys, np.bincount(code, minlength=len(keys)))
        for name, have in parts.items():
            keys, n = merged(have)
            yield pd.DataFrame({"lang": name, "key": keys.view(np.int64), "n": n})

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    return rows.mapInPandas(released(count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Models:
    """Sorted arrays: for each language and order, entries (n-gram, discounted count) and contexts (what stands before, 1 / total, share left to the lower order)."""

    def __init__(self, entries: pd.DataFrame, contexts: pd.DataFrame, discounts: dict[tuple[str, int], float]):
        self.langs = sorted(map(str, entries["lang"].unique()))
        self.entries, self.contexts = {}, {}
        for (lang, order), g in entries.groupby(["lang", "k"], observed=True):
            g, d = _by_key(g), discounts[lang, order]
            self.entries[lang, order] = (_unsigned(g), np.maximum(g["n"].to_numpy(float) - d, 0.0))
        for (lang, order), g in contexts.groupby(["lang", "k"], observed=True):
            g, d = _by_key(g), discounts[lang, order]
            total = g["total"].to_numpy(float)
            self.contexts[lang, order] = (_unsigned(g), 1 / total, np.minimum(1.0, d * g["kinds"].to_numpy(float) / total))
        self.uniform = 1.0 / (1 + max([0, *(len(v[0]) for (_, k), v in self.entries.items() if k == 1)]))

    def losses(self, key: np.ndarray, lang: str) -> np.ndarray:
        """-ln P(last character | the three before), interpolated down to the uniform model."""
        p = np.full(len(key), self.uniform)
        for order in range(1, ORDER + 1):
            own = _low(key, order)
            if (lang, order) not in self.entries:  # this part has none
                continue
            at, inverse, left = self.contexts[lang, order]
            i, seen = _find(at, own >> np.uint64(16))
            at, value = self.entries[lang, order]
            j, known = _find(at, own)
            p = np.where(seen, np.where(known, value[j], 0.0) * inverse[i] + left[i] * p, p)
        return -np.log(p)


def _unsigned(g: pd.DataFrame) -> np.ndarray:
    return g["key"].to_numpy(np.int64).view(np.uint64)


def _by_key(g: pd.DataFrame) -> pd.DataFrame:
    return g.iloc[np.argsort(_unsigned(g))]


def _find(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return i, sorted_keys[i] == key


def _part_of(before: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(before), F.lit(parts))


class Trained:
    """Tables of entries (k, lang, key, n, before) and contexts (k, lang, key, total, kinds, before), and what is small."""

    def __init__(self, entries: DataFrame, contexts: DataFrame, discounts: dict[tuple[str, int], float], rows: int):
        self.entries, self.contexts, self.discounts = entries, contexts, discounts
        self.langs = sorted({x for x, _ in discounts})
        self.parts = max(1, -(-entries.count() // max(1, rows // 2)))
        self.usual: dict[str, tuple[float, float, float]] = {}  # mean and variance of a character's loss, slack
        self.spark, self._only = entries.sparkSession, None

    def shared(self, part: int):
        """A broadcast of one part; the least order, which all parts need, has as many rows as characters. Models of one part are sent once."""
        if self._only is None:
            sent = self._send(part)
            if self.parts > 1:
                return sent
            self._only = sent
        return self._only

    def _send(self, part: int):
        own = lambda t: t.where(F.col("before").isNull() | (_part_of(F.col("before"), self.parts) == part)).drop("before").toArrow().to_pandas(strings_to_categorical=True)
        return self.spark.sparkContext.broadcast(Models(own(self.entries), own(self.contexts), self.discounts))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", kept_out: Column | None = None, model_rows: int = MODEL_ROWS) -> Trained | None:
    """Models of all languages, or None without a labelled text. Rows where ``kept_out`` holds only calibrate the rejection.

    A language with fewer than ``ENOUGH`` kept-out texts has the slack ``SLACK`` at least.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    kept = F.lit(False) if kept_out is None else F.coalesce(kept_out, F.lit(False))
    level = cut(gram_counts(labelled.where(~kept), text, lang))
    four, entries, contexts, discounts = level, [], [], {}
    mask = {k: (1 << 16 * k) - 1 for k in (1, 2, 3)}
    last = lambda key, k: F.when(F.lit(k > 1), key.bitwiseAND(F.lit(0xFFFF)))
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            level = cut(level.groupBy("lang", F.col("key").bitwiseAND(F.lit(mask[k])).alias("key")).agg(F.count(F.lit(1)).alias("n")))
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect():
            discounts[r["lang"], k] = min(0.95, max(0.1, r["a"] / max(1, r["a"] + 2 * r["b"])))
        context = F.shiftrightunsigned("key", 16)
        entries.append(level.select(F.lit(k).alias("k"), "lang", "key", "n", last(context, k).alias("before")))
        totals = level.groupBy("lang", context.alias("key")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts.append(totals.select(F.lit(k).alias("k"), "lang", "key", "total", "kinds", last(F.col("key"), k).alias("before")))
    if len({x for x, _ in discounts}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not discounts:
        return None
    union = lambda parts: cut(reduce(DataFrame.unionByName, parts))
    models = Trained(union(entries), union(contexts), discounts, model_rows)
    total: dict[str, np.ndarray] = {x: np.zeros(3) for x in models.langs}
    for part in range(models.parts):
        own = four.where(_part_of(F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFF)), models.parts) == part)
        for r in own.mapInPandas(_own_loss(models.shared(part)), "lang string, n double, s double, q double").groupBy("lang").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect():
            total[r[0]] += (r[1], r[2], r[3])
    for x, (n, s, q) in total.items():
        models.usual[x] = (s / n, max(0.0, q / n - (s / n) ** 2), SLACK)
    if kept_out is not None:
        rows = labelled.where(kept & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("_lang"))
        found = identify(rows, models).where("lang_pred = _lang").groupBy("_lang").agg(F.percentile_approx("excess", QUANTILE, 10_000), F.count(F.lit(1)))
        for x, slack, n in found.collect():
            models.usual[x] = (*models.usual[x][:2], max(LEAST_SLACK if n >= ENOUGH else SLACK, slack))
    return models


def _own_loss(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, g in b.groupby("lang"):
                loss, n = shared.value.losses(_unsigned(g), name), g["n"].to_numpy(float)
                yield pd.DataFrame({"lang": [name], "n": [n.sum()], "s": [(n * loss).sum()], "q": [(n * loss * loss).sum()]})

    return run


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32(id as text) mod ``folds`` is 0; a null id counts as empty text."""
    return _fold(doc_id, folds) == 0


def calibrating(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32(id as text) mod ``folds`` is 1: the fold that is kept out of the counts to calibrate the rejection."""
    return _fold(doc_id, folds) == 1


def _fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def _summed(texts: list[str], m: Models, parts: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss of each language and text, characters of each text, whether it has a letter); losses of other parts' characters are 0."""
    n = len(texts)
    doc, key, has = grams(texts)
    length = np.bincount(doc, minlength=n)
    code, kinds = pd.factorize(key)
    own = np.ones(len(kinds), bool)
    if parts > 1:
        own = part_numbers((kinds >> np.uint64(16)) & np.uint64(0xFFFF), parts) == part
    loss = np.zeros((len(m.langs), len(kinds)))
    for i, x in enumerate(m.langs):
        loss[i, own] = m.losses(kinds[own], x)
    return np.stack([np.bincount(doc, weights=x[code], minlength=n) for x in loss]), length, has


def part_numbers(before: np.ndarray, parts: int) -> np.ndarray:
    """As _part_of(): XXH64 of a long with Spark's seed."""
    kinds, code = np.unique(before, return_inverse=True)
    said = [xxhash.xxh64_intdigest(int(x).to_bytes(8, "little"), seed=42) for x in kinds]
    return (np.array(said, np.uint64).view(np.int64) % parts)[code]


def _verdict(total: np.ndarray, length: np.ndarray, has: np.ndarray, langs: list[str], usual: dict) -> dict[str, np.ndarray]:
    n = len(length)
    length = np.maximum(1, length)
    mean = total / length
    best = mean.argmin(0)
    low = mean[best, np.arange(n)]
    share = 1 / np.exp(-(mean - low) * np.minimum(length, 50)).sum(0)
    own = np.array([usual[x] for x in langs])[best]
    excess = low - own[:, 0] - SIGMAS * np.sqrt(own[:, 1] / length)
    return {
        "lang_pred": np.where(has, np.array(langs, object)[best], "und"), "score": np.where(has, np.round(share, 6), 0.0),
        "cross_entropy": np.where(has, low, np.nan), "excess": np.where(has, excess, np.nan), "rejected": ~has | (excess > own[:, 2]),
    }


RESULT = "lang_pred string, score double, cross_entropy double, excess double, rejected boolean"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _texts(b: pd.DataFrame, text: str) -> list[str]:
    return [t if isinstance(t, str) else "" for t in b[text]]


def identify(df: DataFrame, models: Trained | None, text: str = "text") -> DataFrame:
    """Columns of ``df`` with lang_pred, score (0 to 1), cross_entropy, excess (nats a character) and rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text where there are no
    models. The score is the best language's share of the likelihoods, at a length of at most 50 characters. The excess is
    what the cross-entropy has over the language's mean and ``SIGMAS`` standard errors of the text's length; a text is
    rejected where that is above the language's slack. Ties go to the first language by code point. Columns named like
    results are replaced.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in NAMES or c == text]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]
    if models is None:
        nothing = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(float("nan")), "excess": F.lit(float("nan")), "rejected": F.lit(True)}
        return df.select(*rest).withColumns(nothing)
    if models.parts > 1:
        return _in_parts(df, models, text, rest)
    shared, langs, usual = models.shared(0), models.langs, models.usual

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = _texts(b, text if text in rest else "_text")
            for part in chunks(texts):
                out = b[rest].iloc[part].copy()
                for k, v in _verdict(*_summed([texts[i] for i in part], shared.value, 1, 0), langs, usual).items():
                    out[k] = v
                yield out

    more = [] if text in rest else [F.col(text).alias("_text")]
    return df.select(*rest, *more).mapInPandas(released(run), ", ".join([*fields, RESULT]))


def _in_parts(df: DataFrame, models: Trained, text: str, rest: list[str]) -> DataFrame:
    """identify() with a scan for each part of the models; only sums travel. Rows of equal texts share theirs."""
    langs, usual = models.langs, models.usual
    rows = df.withColumn("_tid", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    texts = cut(rows.groupBy("_tid").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("_text")))

    def sums(part: int) -> DataFrame:
        shared, parts = models.shared(part), models.parts

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = _texts(b, "_text")
                for i in chunks(own):
                    total, length, has = _summed([own[j] for j in i], shared.value, parts, part)
                    yield pd.DataFrame({"_tid": b["_tid"].to_numpy()[i], "total": list(total.T), "length": length, "has": has})

        return cut(texts.mapInPandas(released(run), "_tid string, total array<double>, length long, has boolean"))

    found = reduce(DataFrame.unionByName, [sums(p) for p in range(models.parts)])
    added = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(len(langs))]
    found = found.groupBy("_tid").agg(*added, F.max("length").alias("length"), F.max("has").alias("has"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = b[[f"t{i}" for i in range(len(langs))]].to_numpy(float).T
            out = _verdict(total, b["length"].to_numpy(), b["has"].to_numpy(bool), langs, usual)
            yield pd.DataFrame({"_tid": b["_tid"].to_numpy(), **out})

    judged = cut(found.mapInPandas(judge, f"_tid string, {RESULT}"))
    return rows.drop(*[c for c in NAMES if c != text]).join(judged, "_tid").select(*rest, *NAMES)
