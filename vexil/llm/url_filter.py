"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees are trained by pyspark.ml on at most ``MAX_TRAIN`` labelled addresses and then written out as a column
expression, so that scoring is one projection inside the scan's stage. Two of the features are statistics of the same
sample: how many addresses of a host's last label, and of its last two, are to block, drawn to the share of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the sample the trees are fitted on: the labelled addresses that come first by hash.
MAX_TRAIN = 20_000
#: Suffixes with a statistic of their own, and addresses by which the share of all counts in each.
MAX_SUFFIXES, PRIOR = 200, 2.0
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. A rule is written as host and path together."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character, over letters and digits."""
    n = F.length(text)
    terms = []
    for c in LOWER + "0123456789":
        k = n - F.length(F.translate(text, c, ""))
        terms.append(F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0))
    return reduce(lambda a, b: a + b, terms)


def suffix_of(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host."""
    return F.substring_index(host, ".", -labels)


class Suffixes:
    """Smoothed share to block of each suffix of one and two labels, and of all addresses: a small table, written out as a map."""

    def __init__(self, shares: dict[int, dict[str, float]], overall: float):
        self.shares, self.overall = shares, overall

    @classmethod
    def of(cls, sample: DataFrame, host: Column, label: Column) -> Suffixes:
        total, blocked = sample.agg(F.count(F.lit(1)), F.sum(label)).first()
        overall = (blocked or 0.0) / total if total else 0.0
        shares = {}
        for n in (1, 2):
            by = sample.groupBy(suffix_of(host, n).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("b"))
            rows = by.orderBy(F.desc("n"), "s").limit(MAX_SUFFIXES).collect()
            shares[n] = {r["s"]: (r["b"] + PRIOR * overall) / (r["n"] + PRIOR) for r in rows}
        return cls(shares, overall)

    def column(self, host: Column, labels: int) -> Column:
        table = self.shares[labels]
        if not table:
            return F.lit(self.overall)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), suffix_of(host, labels)), F.lit(self.overall))


def features(url: Column, host: Column, path: Column, suffixes: Suffixes) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    query = F.coalesce(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit(""))
    out = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.translate(path, "/", "")), "dots": F.length(host) - F.length(F.translate(host, ".", "")),
        "hyphens": F.length(host) - F.length(F.translate(host, "-", "")), "digit_ratio": digits / F.greatest(F.length(u), F.lit(1)),
        "entropy": entropy(F.lower(u)), "host_entropy": entropy(host), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.contains(u, F.lit("#")).cast("int"), "https": u.startswith("https://").cast("int"),
        "last_length": F.length(F.substring_index(path, "/", -1)), "first_length": F.length(F.substring_index(F.substring(path, 2, 1 << 20), "/", 1)),
        "suffix": suffixes.column(host, 1), "domain": suffixes.column(host, 2),
    }
    return {k: v.cast("double") for k, v in out.items()}


def tree_column(node, names: list[Column]) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    s = node.split()
    return F.when(names[s.featureIndex()] <= F.lit(float(s.threshold())), tree_column(node.leftChild(), names)).otherwise(tree_column(node.rightChild(), names))


def train(labelled: DataFrame, url: str, label: str, max_train: int = MAX_TRAIN, trees: int = 10, depth: int = 4) -> tuple[GBTClassificationModel | float, Suffixes]:
    """``label``: 1.0 to block. Where only one class or none is labelled, the constant score of that class (else to allow)."""
    u, h, p = F.col("_u"), F.col("_host"), F.col("_path")
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(F.col(url)).alias("_h"), F.col(url).alias("_u"), F.col(label).cast("double").alias("_label"))
    sample = rows.orderBy("_h", "_u", "_label").limit(max_train).withColumns({"_host": host_of(u), "_path": path_of(u)}).coalesce(1).persist()
    try:
        seen = sample.agg(F.min("_label"), F.max("_label")).first()
        suffixes = Suffixes.of(sample, h, F.col("_label"))
        if seen[0] is None or seen[0] == seen[1]:
            return seen[0] or 0.0, suffixes
        cols = features(u, h, p, suffixes)
        measured = sample.select("_label", *[c.alias(k) for k, c in cols.items()])
        ready = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(measured).select("_x", "_label").persist()
        model = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, checkpointInterval=-1, cacheNodeIds=False).fit(ready)
        ready.unpersist()
        return model, suffixes
    finally:
        sample.unpersist()


def url_verdicts(df: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None, label: str = "blocked", max_train: int = MAX_TRAIN) -> DataFrame:
    """Columns of ``df`` with host, path, rule, score (null where a rule decides) and verdict.

    ``labelled(url, label)`` trains the trees; without it, addresses that a rule decides are the labelled ones, and a
    tie or score of 0 allows. A null address, or one without ``://``, has empty host and path and is judged like any
    other. Columns named like results are replaced.
    """
    u = F.col(url)
    rule, said = rule_column(F.col("host"), F.col("path"), rules)
    base = df.drop(*[c for c in ("host", "path", "rule", "score", "verdict", "_said") if c != url]).withColumns({"host": host_of(u), "path": path_of(u)}).withColumns({"rule": rule, "_said": said})
    if labelled is None:
        labelled, label = base.where("_said is not null").select(u, (F.col("_said") == "block").cast("double").alias("blocked")), "blocked"
    model, suffixes = train(labelled, url, label, max_train)
    if isinstance(model, float):
        score = F.lit(2 * model - 1)
    else:
        own = features(u, F.col("host"), F.col("path"), suffixes)
        base = base.withColumns({f"_f_{k}": F.when(F.col("_said").isNull(), c) for k, c in own.items()})
        cols = [F.col(f"_f_{k}") for k in own]
        score = reduce(lambda a, b: a + b, [F.lit(float(w)) * tree_column(t._call_java("rootNode"), cols) for t, w in zip(model.trees, model.treeWeights, strict=True)])
    out = base.withColumn("score", F.when(F.col("_said").isNull(), score)).withColumn("verdict", F.coalesce(F.col("_said"), F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))))
    return out.drop("_said", *[c for c in out.columns if c.startswith("_f_")])
