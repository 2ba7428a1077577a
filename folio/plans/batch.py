"""Running stages over pages: isolation of failures, resumption, and long strips in segments."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]
STRIP_ASPECT = 0.33


def isolated(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, step: str) -> DataFrame:
    """work per page; a page that raises becomes one row with its error and step instead of failing the job."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = work(rows)
            return out.assign(status="completed", step=None, error=None)
        except Exception as e:  # the page's own failure is its result
            row = {n: [None] for n in names} | {"page_id": [rows["page_id"].iloc[0]], "status": ["failed"], "step": [step], "error": [traceback.format_exception_only(e)[-1].strip()]}
            return pd.DataFrame(row)

    return df.groupBy("page_id").applyInPandas(run, f"{schema}, status string, step string, error string")


def run_stages(df: DataFrame, stages: list[tuple[str, Stage]], folder: str, resume_after: str | None = None, fail_fast: bool = False) -> DataFrame:
    """Each stage's result is a Parquet checkpoint; stages up to resume_after are read from theirs.

    The run ends behind a stage that left a run-fatal row, with fail_fast behind
    the first that left failed rows.
    """
    spark, skip = df.sparkSession, resume_after is not None
    for name, stage in stages:
        path = f"{folder}/{name}"
        if not skip:
            stage(df).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        if name == resume_after:
            skip = False
        ends = "status in ('failed', 'run_fatal')" if fail_fast else "status = 'run_fatal'"
        if "status" in df.columns and not df.filter(ends).isEmpty():
            break
    return df


def should_split(w, h):
    return w / h <= STRIP_ASPECT


def segments(pages: DataFrame, splits: DataFrame) -> DataFrame:
    """(page_id, seg_idx, top, bottom) of half-open row ranges between the rising split rows."""
    rows = splits.groupBy("page_id").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    cut = F.concat(F.array(F.lit(0)), F.coalesce("ys", F.array().cast("array<int>")), F.array(F.col("h")))
    parts = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("top"), F.get("cuts", i + 1).alias("bottom")))
    return pages.join(rows, "page_id", "left").withColumn("cuts", cut).select("page_id", F.posexplode(parts)).select("page_id", F.col("pos").alias("seg_idx"), "col.top", "col.bottom")


def stitched(parts: DataFrame, n_segments: DataFrame) -> DataFrame:
    """Pixels of segments back on their page; an artifact is left out if any of its segments is missing."""
    have = parts.select("page_id", "category", "seg_idx").distinct().groupBy("page_id", "category").count()
    whole = have.join(n_segments, "page_id").filter(F.col("count") == F.col("n")).select("page_id", "category")
    return parts.join(whole, ["page_id", "category"], "left_semi").withColumn("y", F.col("y") + F.col("top")).drop("top", "seg_idx")
