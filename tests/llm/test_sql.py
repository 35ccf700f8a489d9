"""Registered queries against their SQL in DuckDB, on the smallest tables and on a table of edge cases."""

import os

import duckdb
import pytest

from vexil.llm.queries import ORACLE, QUERIES

PROSE = " ".join(f"word{i * 7919 % 9973}" for i in range(900))
FOUND = (
    "Write to a.b@mail.example.com or x@y, host 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111 or 4111 1111 1111 1112, call +44 (20) 7946-0958 or +1, "
    "IBAN GB82 WEST 1234 5698 7654 32 and _DE89370400440532013000, social security 123-45-6789, number 123-45-6780, api_key=abcdefgh12345678"
)
TEXTS = [
    None, "", " \n\t", "one two three four", "ONE two three four", "short\nshort\n\nshort", FOUND, f"é {FOUND} 語 {FOUND}", "1.2.3.4.5.6.7.8 " * 70,
    PROSE, PROSE, PROSE.upper(), f"é語 {PROSE}", f"{PROSE[:1500]} other {PROSE[1500:3000]}", f"{PROSE[:600]} | {PROSE[:600]} | {PROSE[:300]}",
    f"{PROSE} {PROSE[:500]}", "a" * 3000, "ab " * 700, "#*$%&|<> [x] " * 3, " ".join(f"w{i % 61}x{i}" for i in range(60)),
]
TURNS = [
    (1, 1, "assistant", "a\\b <| <|turn|> \\"), (1, 0, "user", None), (1, None, "system", "s\nt"), (2, 0, None, "é語"), (2, 0, None, "é語"),
    (3, 0, "assistant", ""), (3, 1, "assistant", "<|end|>\n"), (3, 1, "as\nsistant", "x"), (4, 5, "user", "<<||"),
]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    docs = [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def rows(df):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("where", ["tables", "edges"])
def test_query(spark, sf, edges, name, where):
    path, duck = sf if where == "tables" else edges, duckdb.connect()
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            at = f"{path}/{f}"
            duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    got, want = QUERIES[name](spark, path).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
