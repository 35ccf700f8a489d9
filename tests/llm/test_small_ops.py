"""Brute-force versions of the operators whose results SQL doesn't express, and their edge cases."""

import hashlib
import re

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vexil.llm import queries as Q
from vexil.llm.chat import chat_digests, default_template, escape, format_chats, parse, turn_spans, unescape
from vexil.llm.exact_dedup import exact_dedup, possibly_repeated
from vexil.llm.mixing import mix
from vexil.llm.pii import find_pii, masked
from vexil.llm.quality import quality
from vexil.llm.url_filter import RULES, url_verdicts

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRICKY = [
    None, "", " \n\t", "a", "call +1 (835) 555-2742 now", "x@y.z a@b.co,c@d 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "é4111 1111 1111 1111 and 4111-1111-1111-1112",
    "a@b.com-foo@x.y.z_q@r.s", "+1+2345678901 +12 345 678 9012 345 678", "\U0001f600 4111111111111111  4111111111111111", "9" * 3000, "a" * 5000 + "@" + "b.c" * 500, "1 2 3 4 " * 400,
    "000.001.02.3 1.2.3.0000255 1.2.3.0000256", "one two three one two three\n\nline\nline\nline", "same same same " * 200, "GB82 WEST 1234 5698 7654 32 is my iban", "ssn 078-05-1120 or 078-05-1121",
]


def docs(spark, texts):
    rows = [(i, t, None if i % 3 else "en", f"s{i % 2}" if i % 4 else None, i, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def small_texts():
    return [*pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:300], *TRICKY]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def pii_brute(t):
    t = t or ""
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".") if x.isdigit()), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_matches_brute_force(spark):
    texts = small_texts()
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [s for s in rows[i] if s[0] not in ("iban", "ssn", "secret")] == pii_brute(t), (i, (t or "")[:80])
    extra = [s for v in rows.values() for s in v if s[0] in ("iban", "ssn")]
    assert {s[0] for s in extra} == {"iban", "ssn"} and len(extra) == 3
    secrets = {i: [texts[i][s[1] : s[2]] for s in v if s[0] == "secret"] for i, v in rows.items()}
    for i, t in enumerate(texts):
        assert secrets[i] == re.findall(r"(?i)(?<![a-z0-9])token = \"[0-9a-f]{40}\"", t or ""), i
    out = {r["doc_id"]: r["text"] for r in masked(find_pii(docs(spark, TRICKY))).collect()}
    assert out[4] == "call [phone] now" and out[0] == ""


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_pii_query_matches_brute_force(spark, tmp_path):
    texts = [*small_texts(), "a@b.c " * 1000, "x1.2.3.4 " * 700 + "é" * 50 + " +1 222 333 4444"]
    df = docs(spark, texts).withColumn("pii", F.lit("clash"))
    df.unionByName(df.where("doc_id = 4")).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op2_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = pii_brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(said(want).encode()).hexdigest()
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert ",".join(base) == said(want)
    df.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert Q.op2_pii(spark, str(tmp_path / "empty")).count() == 0


def test_exact_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a", "x"), (5, "a", "y"), (3, "b", "z"), (4, None, "n"), (9, "", "e"), (None, "b", "q"), (7, "c", "r"), (7, "c", "r")], "doc_id long, text string, kept string")
    for more in ({}, {"per_task": 2}, {"broadcast_rows": 0}):
        out = exact_dedup(df, **more).collect()
        assert sum(r["kept"] for r in out if r["doc_id"] == 7) == 1
        got = {(r["doc_id"], r["text_sha256"][:4]): (r["keep_id"], r["group_size"], r["kept"]) for r in out}
        h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
        assert got[1, h("a")] == (5, 2, False) and got[5, h("a")] == (5, 2, True) and got[4, h("")] == (9, 2, False)
        assert got[None, h("b")] == (3, 2, False) and got[7, h("c")][:2] == (7, 2)
        assert exact_dedup(df, with_text=True, **more).where("kept").select("text").count() == 4
    assert exact_dedup(df.limit(0)).count() == 0
    long = spark.range(4).selectExpr("id as doc_id", "repeat('é', 2000000 + cast(id % 2 as int)) as text")
    assert exact_dedup(long).where("kept and group_size = 2").count() == 2


def test_bloom_filters(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "cast(if(id < 10000, 0, id % 15000) as string) as text")
    for per_task in (1000, 1 << 20):
        out = exact_dedup(df, per_task=per_task).selectExpr("sum(group_size)", "count(*)", "count_if(kept)").first()
        want = df.groupBy("text").count().selectExpr("sum(count * count)", "sum(count)", "count(*)").first()
        assert tuple(out) == tuple(want)
    hashes = df.selectExpr("xxhash64(text) as h")
    twice = hashes.groupBy("h").count().where("count > 1").select("h")
    found = possibly_repeated(hashes, 30_000, 1000)
    assert twice.join(found, "h", "left_anti").count() == 0 and found.count() <= twice.count() + 0.02 * 30_000


def test_mixing_meets_targets(spark):
    df = docs(spark, small_texts()).withColumn("source", __import__("pyspark.sql.functions", fromlist=["f"]).expr("case when doc_id % 3 = 0 then 'hot' else source end"))
    a = mix(df).toPandas()
    assert len(a) == df.count() and (a["taken"] <= 2 * a["size"]).all()
    for _, g in a.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5 and g["size"].sum() == g["source_size"].iloc[0]
    b = mix(df.repartition(7)).toPandas()
    assert a.sort_values("doc_id").reset_index(drop=True).equals(b.sort_values("doc_id").reset_index(drop=True))
    assert mix(df.limit(0)).count() == 0


def quality_brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    from collections import Counter

    g = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = set()
    for i in range(len(w) - 2):
        if g[w[i], w[i + 1], w[i + 2]] > 1:
            rep |= {i, i + 1, i + 2}
    cov, longest = set(), 0
    n = len(w)
    for i in range(n if n < 700 else 0):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        if best >= 10:
            cov |= set(range(i, i + best))
            longest = max(longest, best)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), (len(cov), longest) if n < 700 else None


def test_quality_matches_brute_force(spark):
    texts = [t for t in small_texts() if len(t or "") < 3000]
    for r in quality(docs(spark, texts)).collect():
        b = quality_brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b[:5], r["doc_id"]
        if b[5]:
            assert (r["covered_words"], r["longest_repeat"]) == b[5], r["doc_id"]
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
    assert quality(docs(spark, ["a"]).limit(0)).count() == 0


def test_quality_query_matches_brute_force(spark, tmp_path):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(100)]
    fresh = lambda n: [word() for _ in range(n)]
    texts = [" ".join(fresh(200) + passage + fresh(200) + passage + fresh(60)), " ".join(fresh(1500) + passage + fresh(200) + passage), " ".join(fresh(60) + 3 * passage[:30]),
             " ".join(fresh(20) + passage[:40] + ["x", *passage[5:40]] + fresh(500)), " ".join(fresh(400)), "a b c d e f g h i j k l " * 9, *[" ".join(r.choice("abc") for _ in range(300)) for _ in range(20)]]
    texts += [t for t in small_texts() if len(t or "") < 3000]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    verdicts = set()
    for r in Q.op10_quality(spark, str(tmp_path)).collect():
        n, chars, symbols, dup, rep, more = quality_brute(texts[r["doc_id"]])
        failed = n < 50 or 100 * rep > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, rep, failed)
        if more:
            cov, longest = more
            bad = cov > 0.3 * n or longest > 60 and longest > 0.1 * n
            assert r["kept"] == (not failed and not bad), r["doc_id"]
            verdicts.add((r["doc_id"], r["kept"]))
    assert {(0, False), (4, True)} <= verdicts


def test_quality_on_long_and_colliding_texts(spark):
    from tests.llm.test_substring_dedup import colliding

    a, b = colliding()
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [f"{a}\n{b}", f"{a}\n{a}", long, f"{long} {long[:40_000]}", "same " * 40_000, f"{long}\n{long}", "x" * 3_000_000]
    got = {r["doc_id"]: r for r in quality(docs(spark, texts)).collect()}
    assert [got[i]["n_dup_lines"] for i in (0, 1, 5)] == [0, 1, 1]
    assert got[2]["covered_words"] == got[2]["longest_repeat"] == 0 and got[2]["kept"] and not got[3]["kept"]
    assert got[4]["covered_words"] == 40_000 and got[4]["longest_repeat"] == 39_999
    n = len(WORD.findall(long[:40_000])) - 1  # the last word may be cut
    assert n <= got[3]["longest_repeat"] <= n + 1 and got[3]["covered_words"] == 2 * got[3]["longest_repeat"]


def test_maximal_repeats_of_words():
    import itertools
    import random

    import numpy as np

    from vexil.llm.quality import maximal_reach, suffix_array

    r = random.Random(3)
    for _ in range(300):
        ids = np.array([r.randrange(3) for _ in range(r.randrange(2, 40))])
        n, least = len(ids), r.randrange(1, 4)
        order, lcp = suffix_array(ids, np.zeros(n, np.int64))
        got = maximal_reach(order, lcp, np.append(-1, ids[:-1]), least)
        w, want = ids.tolist(), [0] * n
        for m in range(least, n):
            places: dict = {}
            for i in range(n - m + 1):
                places.setdefault(tuple(w[i : i + m]), []).append(i)
            for p in places.values():
                left, right = {w[i - 1] if i else -1 for i in p}, {w[i + m] if i + m < n else -1 - i for i in p}
                if len(p) > 1 and len(left) > 1 and len(right) > 1:
                    for i in p:
                        want[i] = m
        assert got.tolist() == want, (w, least)


def url_brute(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_urls(spark):
    urls = [*pq.read_table(f"{SF}/pages.parquet")["url"].to_pylist(), None, "", "no scheme", "http://A.ExAmple.ORG/en/1?x", "http://example.org", "x://y://z/w", "http://org/a#b", "http://notexample.org/es/", "HTTP://É.com/fr/\nx"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_verdicts(df).collect():
        host, path, best = url_brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    assert url_verdicts(df.limit(0)).count() == 0


def test_url_verdicts_are_the_models(spark):
    from pyspark.ml.feature import VectorAssembler

    from vexil.llm.url_filter import features, host_of, path_of, train

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").withColumn("blocked", F.col("url").rlike("casino|bets|pills").cast("double"))
    pages = pages.unionByName(pages.where("page_id < 3")).unionByName(spark.createDataFrame([(-1, "http://x.net/" + "a1/" * 20_000, 0.0), (-2, None, None)], pages.schema))
    held = F.col("page_id") % 2 == 0
    out = url_verdicts(pages, labelled=pages.where(~held)).collect()
    model, suffixes = train(pages.where(~held), "url", "blocked")
    cols = features(F.col("url"), host_of(F.col("url")), path_of(F.col("url")), suffixes)
    assert {"com", "net", "org"} <= set(suffixes.shares[1])
    x = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(pages.select("page_id", "blocked", *[c.alias(k) for k, c in cols.items()]))
    said = {r["page_id"]: "block" if r["prediction"] else "allow" for r in model.transform(x).collect()}
    mine = [r for r in out if r["rule"] is None]
    assert len(out) == pages.count() and len(mine) > 50 and all(r["verdict"] == said[r["page_id"]] for r in mine)
    again = [r for r in mine if r["page_id"] % 2 == 0 and r["blocked"] is not None]
    assert sum((r["verdict"] == "block") == (r["blocked"] == 1) for r in again) >= 0.8 * len(again)


def test_url_trees_learn(spark):
    df = spark.range(600).selectExpr("id as page_id", "concat('https://', case when id % 2 = 0 then 'x9-7-3-' else 'site' end, id, '.net/', id % 7) as url", "cast(id % 2 = 0 as double) as blocked")
    out = url_verdicts(df, rules=(), labelled=df).selectExpr("avg(cast((verdict = 'block') = (blocked = 1) as int))").first()[0]
    assert out > 0.95


TURNS = [("user", "</s>[INST] ok [/INST]"), ("assistant", "<|turn|>\\ <|end|>\n \\< |"), ("a\nb<|n|>", ""), ("assistant", "<|end|>\n")]


def test_chat_round_trip():
    assert parse(default_template(TURNS)) == TURNS
    assert all(unescape(escape(t)) == t for _, t in TURNS)
    out, spans, rewrites = turn_spans(default_template, TURNS)
    assert not rewrites and out == default_template(TURNS) and spans[0][0] == 0 and spans[-1][1] == len(out)
    assert [unescape(out[s[2] : s[3]]) for s in spans] == [t for _, t in TURNS]
    _, _, rewrites = turn_spans(lambda turns, _: "".join(f"<{r}>{t if i == len(turns) - 1 else '..'}" for i, (r, t) in enumerate(turns)), TURNS[:2])
    assert rewrites == [1]


def test_chat_digests(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(TURNS)] + [(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(100)] + [(None, None, None, None), (3, 1, "assistant", "z"), (3, 0, "assistant", "é"), (3, 0, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_digests(df).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in TURNS).encode()).hexdigest()
    assert got[2]["n_turns"] == 100 and got[2]["formatted_chars"] == len(default_template([(r[2], r[3]) for r in rows if r[0] == 2]))
    assert got[3]["loss_sha256"] == hashlib.sha256("ééz".encode()).hexdigest() and got[3]["loss_chars"] == 3
    assert got[None]["n_turns"] == 1
    whole = format_chats(df).where("conv_id = 2").orderBy("block").collect()
    assert "".join(r["formatted"] for r in whole) == default_template([(r[2], r[3]) for r in rows if r[0] == 2])
    assert chat_digests(df.limit(0)).count() == 0
    named = df.withColumns({"conv_id": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "extra": F.lit("x")})
    assert {r["conv_id"]: r["turns_sha256"] for r in chat_digests(named).collect()} == {r["conv_id"] and f"c{r['conv_id']}": r["turns_sha256"] for r in got.values()}
    big = spark.createDataFrame([(2**60 + 1, 0, "user", "é<|" * 200_000), (None, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"] for r in chat_digests(big).collect()} == {2**60 + 1, None}


def test_chat_query_matches_the_tables(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    rows += [{"conv_id": -1, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in Q.op9_chat(spark, SF).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(default_template(turns)))
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) == want


def last_thought_kept(turns, _=0):
    """A system text stands before every turn; reasoning is stripped from all turns but the last."""
    system = turns[0][1] if turns else ""
    return "".join(f"[{system}|{r}]{t if i == len(turns) - 1 else re.sub('<think>.*</think>', '', t)};" for i, (r, t) in enumerate(turns))


def test_chat_history_rewritten_across_blocks(spark):
    turns = [("user", f"t{i}<think>x</think>" if i == 31 else f"t{i}") for i in range(70)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = format_chats(df, last_thought_kept).orderBy("block").collect()
    assert [len(r["turns"]) for r in got] == [32, 32, 6] and "".join(r["formatted"] for r in got) == last_thought_kept(turns)
    assert [32 * r["block"] + i for r in got for i in r["rewrites"]] == turn_spans(last_thought_kept, turns)[2] == [32]
    assert [r["formatted"][s["text_start"] : s["text_end"]] for r in got for s in r["turns"]][33:] == [t for _, t in turns[33:]]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_on_every_row(spark, sf, name):
    out = Q.QUERIES[name](spark, sf)
    assert isinstance(out.toPandas(), pd.DataFrame)
