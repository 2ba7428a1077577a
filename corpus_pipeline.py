"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

language    drops documents without a recognised language (no letters, null)
near_dup    keeps one document, that of the smallest id, of each near-duplicate class
decontaminate   drops documents that hold a benchmark item
pii         replaces personal data in the texts by its kind
pieces      encodes the texts to piece ids and checks that they decode to the text

All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.decontaminate import without_leaks
from folio.llm.language import without_unknown
from folio.llm.near_dup import without_near_duplicates
from folio.llm.pieces import encode_pieces
from folio.llm.pii import redact
from folio.llm.storage import saved

#: Texts in a known language have larger cosines, even those of a few words.
MIN_LANGUAGE_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_unknown(docs, MIN_LANGUAGE_SCORE)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(docs, path, check_col="round_trip", keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [("language", language), ("near_dup", near_dup), ("decontaminate", decontaminate), ("pii", pii), ("pieces", pieces)]

#: Signatures, hyperdimensional profiles and piece encoding cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
