"""The registered queries of this subpackage and their SQL.

Each query applies its operator, with production parameters, to the whole
table(s) of ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.ann import nearest
from folio.llm.decontaminate import leak_pairs
from folio.llm.exact_repeats import exact_repeats
from folio.llm.language import identify_languages
from folio.llm.near_dup import near_duplicates
from folio.llm.pieces import piece_digest
from folio.llm.pii import pii_report, report_sql
from folio.llm.sharding import shard_report
from folio.llm.token_counts import token_counts
from folio.llm.url_filter import FILTER_SQL, dated_pages, filter_captures, sample_list

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_repeats(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.expr("vec_id % 100 = 0"), k=10)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_captures(dated_pages(pages), sample_list(pages))


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language_id": op2_language_id,
        "op3_exact_repeats": op3_exact_repeats,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_personal_data": op5_personal_data,
        "op6_sharding": op6_sharding,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_url_filter": op8_url_filter,
        "op9_piece_encoding": op9_piece_encoding,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_personal_data": report_sql(),
        "op8_url_filter": FILTER_SQL,
    }
