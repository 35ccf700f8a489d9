"""Posting lists over metadata and character n-grams, for collections that are searched often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
LEAST, MOST = 2, 32


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)))


def ngrams(text: Column) -> Column:
    """Whole tokens and all their n-grams of LEAST to MOST characters, distinct."""
    own = lambda t: F.flatten(F.transform(F.sequence(F.lit(LEAST), F.least(F.length(t), F.lit(MOST))), lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))))
    some = F.transform(tokens(text), lambda t: F.when(F.length(t) >= LEAST, own(t)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(tokens(text), F.flatten(some)))


def text_postings(rows: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """term, id."""
    grams = F.array_distinct(F.flatten(F.array(*[ngrams(F.coalesce(F.col(c), F.lit(""))) for c in columns])))
    return rows.select(F.col(id_column).alias("id"), F.explode(grams).alias("term"))


def metadata_postings(rows: DataFrame, metadata: Column, id_column: str = "id") -> DataFrame:
    """key, value, id."""
    return rows.select(F.col(id_column).alias("id"), F.explode(metadata).alias("key", "value"))


def search_text(postings: DataFrame, query: str) -> DataFrame:
    """id: all terms of the query match; a query without letter or digit matches nothing here (the predicate decides then)."""
    spark = postings.sparkSession
    terms = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(ngrams(F.col("q")))).collect()]
    if not terms:
        return postings.select("id").limit(0)
    return postings.where(F.col("term").isin(terms)).groupBy("id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(terms)).select("id")


def candidates(metadata: DataFrame, pairs: dict[str, str], text: DataFrame | None = None, query: str | None = None) -> DataFrame:
    """id of rows with all ``pairs``, by metadata_postings(), and all terms of ``query``, by text_postings(): one aggregate over the lists asked for."""
    out = None
    if pairs:
        asked = metadata.where(F.struct("key", "value").isin([F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in pairs.items()]))
        out = asked.groupBy("id").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(pairs)).select("id")
    if query and text is not None:
        own = search_text(text, query)
        out = own if out is None else out.join(own, "id", "left_semi")
    if out is None:
        raise ValueError("nothing is asked for")
    return out
