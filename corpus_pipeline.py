"""A training corpus from documents: language, exact copies, near copies, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and reads nothing but ``docs``, which is what its predecessor wrote. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm.common import cut, table
from vexil.llm.exact_dedup import exact_dedup
from vexil.llm.langid import calibrating, held_out, identify, train
from vexil.llm.mixing import mixed
from vexil.llm.near_dedup import near_deduped
from vexil.llm.packing import pack, pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the models reject go."""
    models = train(docs.where(~held_out()), kept_out=calibrating())
    return identify(docs, models).where("not rejected").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return exact_dedup(docs, with_text=True).where(F.col("kept")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the least id."""
    return near_deduped(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixed(docs).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    items = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(items).select("sequence_id", "offset", "doc_id", "piece", "start", "length", "ids_crc32")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", sequences)]
#: Models, seeded order and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
