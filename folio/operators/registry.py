"""All registered queries of the engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.operators import compare, dense, layout, masks, pages, raster, reports

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (layout, raster, masks, reports, pages, dense, compare)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.q_preprocess(spark, sf_dir)
