"""Filters as boolean columns, so that Catalyst pushes and orders them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = "namespace"
#: Ids up to which a set is a literal; larger sets are a DataFrame and a semi join.
LITERAL_IDS = 1000


def has_metadata(pairs: dict[str, str], metadata: str | Column = "metadata") -> Column:
    """All pairs are there, compared exactly; a missing key never matches, not even an empty value."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return reduce(lambda a, b: a & b, [F.coalesce(m[k] == v, F.lit(False)) for k, v in pairs.items()], F.lit(True))


def has_text(query: str, id_column: str = "id", metadata: str | Column = "metadata") -> Column:
    """The lower-cased, trimmed query is part of the id, or of a key or value of the metadata."""
    q = query.strip().lower()
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    part = lambda c: F.contains(F.lower(c), F.lit(q))
    return part(F.col(id_column)) | F.exists(F.map_entries(m), lambda e: part(e["key"]) | part(e["value"]))


def in_namespace(namespace: str | None, column: str = NAMESPACE) -> Column:
    """No namespace means no restriction."""
    return F.lit(True) if not namespace else F.col(column) == namespace


def structured(ids: list[str] | None = None, pairs: dict[str, str] | None = None, text: str | None = None, id_column: str = "id", metadata: str | Column = "metadata") -> Column:
    out = F.lit(True)
    if ids:
        out = out & F.col(id_column).isin(ids)
    if pairs:
        out = out & has_metadata(pairs, metadata)
    if text and text.strip():
        out = out & has_text(text, id_column, metadata)
    return out


def with_ids(vectors: DataFrame, ids: DataFrame | list[str], id_column: str = "id") -> DataFrame:
    """Rows whose id is in a set; a short list is pushed to the scan, a DataFrame is a semi join whose size Spark measures."""
    if isinstance(ids, list) and len(ids) <= LITERAL_IDS:
        return vectors.where(F.col(id_column).isin(ids))
    if isinstance(ids, list):
        ids = vectors.sparkSession.createDataFrame([(i,) for i in ids], f"{id_column} string")
    return vectors.join(ids.select(id_column).distinct(), id_column, "left_semi")
