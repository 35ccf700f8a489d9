"""Places in an order, and what rests on them."""

import numpy as np
from pyspark.sql import functions as F

from vexil.operators import maintenance, search
from vexil.sources.ranges import numbered


def test_places_follow_the_order(spark):
    rows = spark.range(5000).repartition(7).select((F.col("id") * 7919 % 5003).alias("n"), F.lit("x").alias("_part_name"))
    own, total = numbered(rows, "n")
    got = own.orderBy("_at").toPandas()
    assert total == 5000 and got["_at"].tolist() == list(range(5000)) and got["n"].is_monotonic_increasing
    assert own.columns == ["n", "_part_name", "_at"]
    none, total = numbered(rows.where("n < 0"), "n")
    assert total == 0 and none.count() == 0


def test_percentiles_of_a_frequent_value(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(5.0)).otherwise(F.col("id") / 1000).alias("v"))
    values = np.sort([5.0 if i % 3 == 1 else i / 1000 for i in range(9000) if i % 3])
    want = {p: values[max(1, -(-len(values) * p // 100)) - 1] for p in (1, 50, 95, 99)}
    assert {r["p"]: r["value"] for r in maintenance.percentiles(rows, "v", (1, 50, 95, 99)).collect()} == want
    assert maintenance.percentiles(rows.where("v < 0"), "v").count() == 0


def test_batch_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(400, 5)), rng.normal(size=(9, 5))
    vectors = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, values array<double>")
    asked = spark.createDataFrame([(f"q{i}", x.tolist(), 1 + i % 4) for i, x in enumerate(q)], "qid string, q array<double>, k int")
    for held in (1, 700, search.HELD):
        monkeypatch.setattr(search, "HELD", held)
        got = {(r["qid"], r["rank"]): r["id"] for r in search.knn_batch(vectors, asked).collect()}
        want = {(f"q{i}", n + 1): f"v{j:03d}" for i, x in enumerate(q) for n, j in enumerate(np.argsort(((v - x) ** 2).sum(1))[: 1 + i % 4])}
        assert got == want
