"""MinHash near-deduplication by a multi-index Hamming join, confirmed on full shingle sets.

Sets that are equal form one class. A class's signature has SIZE values of 16 bits, cut into CHUNKS chunks. Two
signatures that differ in at most RADIUS values differ in at most ERRORS values of some chunk (pigeonhole), so they share
a key among those made of a chunk without each choice of ERRORS values: every such pair meets. Pairs that meet are
followed up to NEAR differences. At a similarity of 0.75 the difference is binomial with mean 16 and deviation 3.5: it
exceeds RADIUS in about 1 of 160,000 pairs and NEAR in 1 of 10**10, and a pair beyond RADIUS still meets in all but
1 of 10**9 cases.

Within a key, breadth-first search over signatures keeps a star for each tree instead of all pairs. A key that a large
share of the classes has is dealt to many tasks and joined whole. The stars join to candidate clusters, and within each
cluster the links are computed from full sets, in one task as far as it holds HELD shingles, and in many beyond: first
with a few pivots of the cluster, and then, between the components so far, by blocks of which a task holds two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty
from .textnum import distinct, exact_shingles, mix, released, shingles, words

SIZE, CHUNKS, ERRORS, RADIUS, NEAR = 64, 16, 1, 31, 40
WIDTH = 5
#: Bytes of text held as arrays at once.
CHUNK = 1 << 19
#: Members of a key that one search compares; larger keys are joined whole, which adds candidates and loses none.
SEARCHED = 2_000
#: Classes of a key in one batch of rows that make the batch name the key, and tasks that a named key is dealt to.
NAMED, SALTS = 8, 256
#: Shingles of a cluster that one task holds.
HELD = 100_000
#: Rows (three longs each) up to which cluster members are broadcast, and bytes up to which pivots are.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Rounds of pivots in a large cluster at most.
ROUNDS = 4

_rng = np.random.default_rng(75)
_A, _B = (_rng.integers(1, 1 << 32, SIZE, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_PER = SIZE // CHUNKS
assert SIZE % CHUNKS == 0 and RADIUS // CHUNKS <= ERRORS


def split_texts(texts: list[str]) -> Iterator[np.ndarray]:
    if texts:
        size = np.cumsum([len(t) for t in texts]) // CHUNK
        yield from np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1)


def sets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle), in order."""
    return distinct(*shingles(words(texts, lower=True), WIDTH))


def minhash(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SIZE values of 16 bits for each set; the sets are consecutive and start at ``start``."""
    high, low = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
    out = np.empty((len(start), SIZE), np.uint16)
    for j in range(SIZE):
        v = np.minimum.reduceat(high * _A[j] + low * _B[j], start)
        out[:, j] = (v * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, rid, _text) -> doc_id, rid, n_shingles, cls (hash of the set, 0 if empty), sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["_text"].tolist()
            for part in split_texts(texts):
                doc, h = sets_of([texts[i] for i in part])
                n = np.bincount(doc, minlength=len(part))
                some = np.flatnonzero(n)
                start = np.concatenate([[0], np.cumsum(n[some])])[:-1]
                cls, sig = np.zeros(len(part), np.uint64), np.full(len(part), b"", object)
                if len(some):
                    two = mix(np.add.reduceat(mix(h), start)) ^ mix(np.add.reduceat(mix(h ^ np.uint64(0x5555)), start) + n[some].astype(np.uint64))
                    cls[some] = np.maximum(two, np.uint64(1))
                    sig[some] = [s.tobytes() for s in minhash(h, start)]
                out = b[["doc_id", "rid"]].iloc[part].copy()
                out["n_shingles"], out["cls"], out["sig"] = n, cls.view(np.int64), sig
                yield out

    return docs.mapInPandas(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid long, n_shingles long, cls long, sig binary")


def _keys(sigs: pd.Series) -> np.ndarray:
    """CHUNKS * (values choose ERRORS) keys of each signature."""
    sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, CHUNKS, _PER).astype(np.uint64)
    out = []
    for k, gone in enumerate(combinations(range(_PER), ERRORS)):
        x = np.zeros(sig.shape[:2], np.uint64)
        for v in (v for v in range(_PER) if v not in gone):
            x = (x << np.uint64(16)) | sig[:, :, v]
        salt = np.uint64(k * CHUNKS) + np.arange(CHUNKS, dtype=np.uint64)
        out.append(mix(x + (salt << np.uint64(54))))
    return np.concatenate(out, 1).view(np.int64)


def signature_keys(classes: DataFrame) -> DataFrame:
    """classes(cls, sig) -> key, cls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                keys = _keys(b["sig"].iloc[lo : lo + 1024])
                yield pd.DataFrame({"key": keys.ravel(), "cls": np.repeat(b["cls"].to_numpy()[lo : lo + 1024], keys.shape[1])})

    return classes.mapInPandas(released(run), "key long, cls long")


def hot_keys(classes: DataFrame, searched: int, named: int = NAMED) -> DataFrame:
    """key, of those that batches name and more than ``searched`` classes have: one for each ``searched`` rows of keys at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                key, n = np.unique(_keys(b["sig"]), return_counts=True)
                yield pd.DataFrame({"key": key[n >= named], "n": n[n >= named]})

    counts = classes.mapInPandas(released(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return cut(counts.where(F.col("n") > searched).select("key"))


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of each key, where rows come in order of the key."""
    held: list[pd.DataFrame] = []
    for b in batches:
        at = np.flatnonzero(np.diff(b[key].to_numpy())) + 1
        for part in np.split(np.arange(len(b)), at):
            if not len(part):
                continue
            g = b.iloc[part[0] : part[-1] + 1]
            if held and held[0][key].iloc[0] != g[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(g)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def shared_keys(keys: DataFrame, hot: DataFrame, searched: int = SEARCHED) -> DataFrame:
    """bucket, cls, whole: keys with two classes or more; keys with the same classes are one bucket.

    Runs of up to ``searched`` rows of a key are held. A longer key is passed on as runs of which each starts with the key's
    first class, so that joining every run whole joins the key. The classes of a hot key are dealt to SALTS tasks, which
    pass theirs on in the same way, and the first of each as one more run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, first, more, top = None, [], None, False, None
        out_b, out_c, out_w = [], [], []

        def add(bucket: int, members: np.ndarray, whole: bool) -> None:
            out_b.append(np.full(len(members), bucket))
            out_c.append(members)
            out_w.append(np.full(len(members), whole))

        def close(last: bool) -> None:
            members = np.array(held, np.int64)
            whole = more or len(members) > searched or top is not None
            if len(members) > 1:
                add(_number(np.add.reduce(mix(members.view(np.uint64))) + np.uint64(whole)), members, whole)
            if last and top is not None:
                add(_number(np.uint64(top & (2**64 - 1))), np.array([first], np.int64), True)

        def frame() -> pd.DataFrame:
            f = pd.DataFrame({"bucket": np.concatenate(out_b), "cls": np.concatenate(out_c), "whole": np.concatenate(out_w)})
            out_b.clear(), out_c.clear(), out_w.clear()
            return f

        for b in batches:
            k, c, t = b["key"].to_numpy(), b["cls"].to_numpy(), b["top"]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            many = np.flatnonzero((np.diff(edges) > 1) | t.notna().to_numpy()[edges[:-1]]) if len(k) else ()
            ends = {0, len(edges) - 2} if len(k) else set()
            for i in sorted(ends | set(np.asarray(many).tolist())):
                own = c[edges[i] : edges[i + 1]]
                if k[edges[i]] != now:
                    close(True)
                    now, held, first, more = k[edges[i]], [], int(own[0]), False
                    top = None if pd.isna(t.iloc[edges[i]]) else int(t.iloc[edges[i]])
                for lo in range(0, len(own), searched):
                    held.extend(own[lo : lo + searched].tolist())
                    if len(held) > searched:
                        more = True
                        close(False)
                        held = [first]
            if out_b:
                yield frame()
        close(True)
        if out_b:
            yield frame()

    n = hot.limit(BROADCAST_ROWS + 1).count()
    marks = hot.withColumnRenamed("key", "top")
    if n:
        rows = keys.join(F.broadcast(marks) if n <= BROADCAST_ROWS else marks, keys["key"] == marks["top"], "left")
        salted = F.xxhash64("key", F.pmod(F.xxhash64("cls"), F.lit(SALTS)))
        rows = rows.select(F.when(F.col("top").isNull(), F.col("key")).otherwise(salted).alias("key"), "cls", F.col("top").cast("string").alias("top"))
    else:
        rows = keys.withColumn("top", F.lit(None).cast("string"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "cls")
    return ordered.mapInPandas(released(run), "bucket long, cls long, whole boolean").distinct()


def _number(x: np.uint64) -> int:
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def signature_forest(buckets: DataFrame) -> DataFrame:
    """(bucket, cls, whole, sig) -> edges a, b: stars that span what pairs within NEAR connect; of whole buckets, a star.

    A star starts at its least class, so that the many keys of one family give mostly the same edges.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for g in _groups(batches, "bucket"):
            cls = g["cls"].to_numpy(np.int64)
            if g["whole"].iloc[0]:
                a.append(np.full(len(cls) - 1, cls[0]))
                b.append(cls[1:])
            else:
                sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(-1, SIZE)
                rest = np.arange(len(cls))
                while len(rest) > 1:
                    tree, queue, rest = [rest[0]], [rest[0]], rest[1:]
                    while queue and len(rest):
                        p = queue.pop()
                        near = (sig[rest] != sig[p]).sum(1) <= NEAR
                        if near.any():
                            tree.extend(rest[near].tolist())
                            queue.extend(rest[near].tolist())
                            rest = rest[~near]
                    if len(tree) > 1:
                        own = np.sort(cls[tree])
                        a.append(np.full(len(own) - 1, own[0]))
                        b.append(own[1:])
            if sum(map(len, a)) > 10_000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return buckets.repartition("bucket").sortWithinPartitions("bucket", "cls").mapInPandas(released(run), "a long, b long").distinct()


def fewer(stars: DataFrame) -> DataFrame:
    """Edges a, b that connect the same as those of stars(a, b) from many keys: each b to its least a, and that to its others.

    A class is in as many stars as it has keys at most. Centres are few and mostly the same, so few edges are left.
    """
    own = stars.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("s"))
    pairs = F.concat(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b"))), F.transform(F.filter("s", lambda x: x != F.col("m")), lambda x: F.struct(F.col("m").alias("a"), x.alias("b"))))
    return own.select(F.inline(pairs)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, label of every vertex of edges(a, b): the least vertex of its component, by least labels of neighbours and pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(10_000):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        # Written, so that both sides of the next join are plain exchanges and a label that many vertices share can be split.
        better = cut(labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = better.select(F.col("v").alias("_v"), F.col("label").alias("_up"))
        jumped = better.join(up, F.col("label") == F.col("_v"), "left").select("v", "old", F.least("label", F.coalesce("_up", "label")).alias("label"))
        done = cut(jumped)
        labels = done.select("v", "label")
        if not done.where("label <> old").limit(1).count():
            break
    return labels


def linked(inter: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return 100 * inter >= 75 * (n + m - inter)


def least_of_component(cls: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of the sets (n[i] numbers of shingles each, in a row), the least ``cls`` of the sets reached by links.

    Breadth-first search; each set met is compared with those not yet reached, so a cluster around one text costs a few scans.
    """
    idx = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    start = np.cumsum(n) - n
    often = np.bincount(idx)
    order = np.argsort(-(np.add.reduceat(often[idx], start) / n), kind="stable")
    out, rest = np.zeros(len(cls), np.int64), order
    mark = np.zeros(len(often), bool)
    take = lambda rows: np.repeat(start[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(n[rows].sum())
    while len(rest):
        queue, comp, rest = [rest[0]], [rest[0]], rest[1:]
        own = idx[take(rest)] if len(rest) else idx[:0]
        while queue and len(rest):
            p = queue.pop()
            words_of = idx[start[p] : start[p] + n[p]]
            mark[words_of] = True
            hit = linked(np.add.reduceat(mark[own].astype(np.int64), np.cumsum(n[rest]) - n[rest]), n[rest], int(n[p]))
            mark[words_of] = False
            if hit.any():
                queue.extend(rest[hit].tolist())
                comp.extend(rest[hit].tolist())
                rest = rest[~hit]
                own = idx[take(rest)] if len(rest) else idx[:0]
        out[comp] = cls[comp].min()
    return out


def confirm_small(members: DataFrame) -> DataFrame:
    """(cluster, cls, _text) of clusters of HELD shingles at most -> cls, comp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, "cluster"):
            g = g.drop_duplicates("cls")
            doc, own = distinct(*exact_shingles(words(g["_text"].tolist(), lower=True), WIDTH))
            cls = g["cls"].to_numpy(np.int64)
            yield pd.DataFrame({"cls": cls, "comp": least_of_component(cls, own, np.bincount(doc, minlength=len(cls)))})

    return members.repartition("cluster").sortWithinPartitions("cluster", "cls").mapInPandas(released(run), "cls long, comp long")


def confirm_large(members: DataFrame, rounds: int = ROUNDS, held: int = HELD) -> DataFrame:
    """(cluster, cls, n_shingles, _text) of the clusters that no task should hold -> edges a, b.

    Each round takes from each cluster one set that no pivot has reached and joins all it reaches to it; so all links of a
    pivot are known. Then only pairs of other sets in different components are open. The sets outside the component that
    is largest so far are dealt to blocks of ``held`` / 2 shingles, and so are those in it; each block of the former meets each
    other block in a task of its own. Of a set's links to a component one leaves the task.
    """

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["_text"].tolist()
            for part in split_texts(texts):
                doc, h = sets_of([texts[i] for i in part])
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                out = b[["cluster", "cls"]].iloc[part].copy()
                out["h"] = [h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield out

    sets = cut(members.select("cluster", "cls", "_text").mapInPandas(to_sets, "cluster long, cls long, h binary").dropDuplicates(["cls"]))
    edges, left = [], sets.select("cluster", "cls")
    for _ in range(rounds):
        # The first by hash stands for the cluster; there are at most (all shingles / HELD) clusters of this size.
        heads = left.groupBy("cluster").agg(F.min_by("cls", F.xxhash64("cls")).alias("cls"))
        pivots = cut(heads.join(sets, ["cluster", "cls"]).select("cluster", F.col("cls").alias("a"), F.col("h").alias("ah")))
        size = pivots.agg(F.sum(F.length("ah") + 24)).first()[0]
        if not size:
            break
        met = sets.withColumnsRenamed({"cls": "b", "h": "bh"}).join(F.broadcast(pivots) if size <= BROADCAST_BYTES else pivots, "cluster")
        found = cut(met.mapInPandas(_linked, "a long, b long"))
        edges.append(found)
        left = cut(left.join(found.select(F.col("b").alias("cls")), "cls", "left_anti"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    known = union(edges).select("a").distinct()
    joined = components(union(edges).where("a <> b")).withColumnsRenamed({"v": "cls", "label": "comp"})
    sets = cut(sets.join(joined, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    sets = sets.join(known.withColumnRenamed("a", "cls"), "cls", "left_anti")
    parted = sets.groupBy("cluster").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("cluster")
    sets = cut(sets.join(parted, "cluster", "left_semi"))
    weights = sets.groupBy("cluster", "comp").agg(F.sum(F.length("h") / 8).alias("w"))
    per = F.lit(held / 2)
    total = weights.groupBy("cluster").agg(F.sum("w").alias("_all"), F.max(F.struct("w", "comp")).alias("_main"))
    blocks = total.select("cluster", F.col("_main.comp").alias("_main"), F.ceil((F.col("_all") - F.col("_main.w")) / per).alias("n_out"), F.ceil(F.col("_main.w") / per).alias("n_in"))
    dealt = sets.join(cut(blocks), "cluster").withColumn("inside", F.col("comp") == F.col("_main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(1)), F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))))
    below = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda out, inside, other: F.struct(out.alias("out"), inside.alias("inside"), other.alias("other"))
    # A block outside asks itself and those after it, and all inside; a set answers in the tasks that ask its block.
    asks = F.concat(F.transform(F.sequence(F.col("own"), F.col("n_out") - 1), lambda j: task(F.col("own"), F.lit(False), j)), F.transform(below(F.col("n_in")), lambda j: task(F.col("own"), F.lit(True), j)))
    answers = F.transform(F.when(F.col("inside"), below(F.col("n_out"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("own"))), lambda j: task(j, F.col("inside"), F.col("own")))
    sent = dealt.where("not inside").select("cluster", "cls", "comp", "h", F.lit(True).alias("asks"), F.explode(asks).alias("t"))
    sent = sent.unionByName(dealt.select("cluster", "cls", "comp", "h", F.lit(False).alias("asks"), F.explode(answers).alias("t")))
    sent = sent.select(F.xxhash64("cluster", "t.out", "t.inside", "t.other").alias("task"), "cls", "comp", "h", "asks")
    edges.append(cut(sent.repartition("task").sortWithinPartitions("task").mapInPandas(released(_between), "a long, b long")))
    return union(edges)


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the sets that ask and those that answer in a task, one link of each set that asks to each other component."""
    for g in _groups(batches, "task"):
        ask, answer = g[g["asks"]], g[~g["asks"]]
        if not len(ask) or not len(answer):
            continue
        n, first = (answer["h"].map(len) // 8).to_numpy(), answer["comp"].to_numpy()
        kinds, flat = np.unique(np.frombuffer(b"".join(answer["h"]), np.uint64), return_inverse=True)
        start, cls, mark = np.cumsum(n) - n, answer["cls"].to_numpy(), np.zeros(len(kinds), bool)
        a, b = [], []
        for own, comp, h in zip(ask["cls"], ask["comp"], ask["h"], strict=True):
            x = np.frombuffer(h, np.uint64)
            at = np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)
            at = at[kinds[at] == x]
            mark[at] = True
            hit = np.flatnonzero(linked(np.add.reduceat(mark[flat].astype(np.int64), start), n, len(x)) & (first != comp))
            mark[at] = False
            if len(hit):
                hit = hit[np.unique(first[hit], return_index=True)[1]]
                a += [own] * len(hit)
                b += cls[hit].tolist()
        if a:
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (a, ah, b, bh), the pairs whose sets are linked."""
    for batch in batches:
        sure = []
        for ah, bh in zip(batch["ah"], batch["bh"], strict=True):
            x, y = np.frombuffer(ah, np.uint64), np.frombuffer(bh, np.uint64)
            sure.append(bool(linked(np.int64(len(np.intersect1d(x, y, assume_unique=True))), np.int64(len(x)), len(y))))
        yield batch[["a", "b"]][np.array(sure, bool)]


def near_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", held: int = HELD, searched: int = SEARCHED, named: int = NAMED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and rid (hash of id and text), one row for each row of ``df``.

    A null text, or one without words, has no shingles and is linked with nothing: its component is its own id. A row
    with a null id takes part in its component, whose id is the least that is not null. Rows that repeat share all
    values. Other columns are not carried; join on the id for them.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("_text")).withColumn("rid", F.xxhash64("doc_id", "_text"))
    rows = cut(signatures(docs))
    some = rows.where("n_shingles > 0")
    classes = cut(some.groupBy("cls").agg(F.min("rid").alias("rid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    signed = classes.where("n_shingles > 1").select("cls", "sig")
    buckets = cut(shared_keys(signature_keys(signed), hot_keys(signed, searched, named), searched))
    edges = signature_forest(buckets.join(classes.select("cls", "sig"), "cls").select("bucket", "cls", "whole", "sig"))
    clusters = components(fewer(edges)).withColumnsRenamed({"v": "cls", "label": "cluster"})
    members = cut(clusters.join(classes.select("cls", "rid", "n_shingles"), "cls"))
    sizes = members.groupBy("cluster").agg(F.sum("n_shingles").alias("_size"))
    large = cut(sizes.where(F.col("_size") > held).select("cluster"))
    small = members.join(large, "cluster", "left_anti")
    n = members.count()
    hint = F.broadcast if n <= BROADCAST_ROWS else (lambda x: x)
    confirmed = confirm_small(docs.select("rid", "_text").join(hint(small.select("rid", "cluster", "cls")), "rid").select("cluster", "cls", "_text"))
    if large.limit(1).count():
        held_back = members.join(large, "cluster", "left_semi")
        found = components(confirm_large(docs.select("rid", "_text").join(hint(held_back), "rid"), held=held).where("a <> b"))
        confirmed = confirmed.unionByName(found.select(F.col("v").alias("cls"), F.col("label").alias("comp")))
    labels = cut(confirmed.where("comp <> cls"))
    named = cut(rows.select("doc_id", "rid", "n_shingles", "cls").join(labels, "cls", "left").select("doc_id", "rid", "n_shingles", F.coalesce("comp", "cls").alias("comp")))
    least = cut(named.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("comp", "least"))
    out = named.join(least, "comp", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid")


def near_deduped(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` of which near_dedup says kept; the text of the others is found by its hash."""
    gone = cut(near_dedup(df, text, doc_id).where("not kept").select("rid").distinct())
    hint = F.broadcast if gone.count() <= BROADCAST_ROWS else (lambda x: x)
    return df.withColumn("rid", F.xxhash64(F.col(doc_id), text_or_empty(text))).join(hint(gone), "rid", "left_anti").select(df.columns)
