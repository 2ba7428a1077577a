"""Page-layout relations derived from the driver's tables.

The tables hold no pages or boxes.  These views give every operator real input
by integer arithmetic that Spark and DuckDB evaluate alike; each view has a SQL
twin in ``SQL`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANVAS_W, CANVAS_H = 1200, 1660
_ROW = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(e: str) -> Column:
    return F.expr(e).cast("int")


def blocks(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, idx, x1, y1, x2, y2, lang, conf_milli): a page per order, a box per line; only those of the given pages, whose lines alone are then dealt out and numbered."""
    lines = table(spark, sf_dir, "lineitem")
    if pages is not None:
        lines = lines.join(pages.select(F.col("page_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    order = Window.partitionBy("l_orderkey").orderBy(*_ROW)
    x1, y1 = "(l_partkey * 37 + l_suppkey * 11) % 400", "(l_partkey * 53 + l_linenumber * 97) % 500"
    w, h = "(5 + (l_partkey * 7 + l_linenumber * 29) % 200)", "(5 + (l_suppkey * 13 + l_partkey * 3) % 200)"
    return lines.select(
        F.col("l_orderkey").alias("page_id"), (F.row_number().over(order) - 1).cast("int").alias("idx"),
        _int(x1).alias("x1"), _int(y1).alias("y1"), _int(f"{x1} + {w}").alias("x2"), _int(f"{y1} + {h}").alias("y2"),
        F.when(F.col("l_returnflag") == "R", "japanese").when(F.col("l_returnflag") == "A", "english").alias("lang"),
        _int("400 + (l_partkey * 17 + l_suppkey * 5) % 600").alias("conf_milli"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, row_idx, q0..q6): detector rows as integers, ten from each vector; the last goes round to its first components."""
    cut = F.explode(F.sequence(F.lit(0), F.lit(9)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", cut.alias("row_idx"))
    value = lambda i: F.floor(F.abs(F.get(F.col("embedding"), (F.col("row_idx") * 7 + i) % F.size("embedding")).cast("double")) * 4096).cast("int").alias(f"q{i}")
    return rows.select(F.col("vec_id").alias("page_id"), F.col("row_idx").cast("int"), *(value(i) for i in range(7)))


def pixels(spark: SparkSession, sf_dir: str, width: int = 24, height: int = 16) -> DataFrame:
    """(page_id, x, y, v): a small grey raster for every part; numbers are dealt out first, as a file of them is small beside its pixels."""
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id")).repartition(2 * spark.sparkContext.defaultParallelism)
    v = "(x * 7 + y * 13 + page_id * 29 + x * y * 3) % 256"
    return keys.join(F.broadcast(grid)).select("page_id", "x", "y", _int(v).alias("v"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with fit statistics: (page_id, idx, rect..., std_milli, failed, thickness)."""
    b = blocks(spark, sf_dir)
    return b.withColumn("std_milli", _int("(x1 * 131 + y1 * 17 + idx * 7) % 30000")).withColumn("failed", F.expr("(x2 + y2) % 5 = 0")).withColumn("thickness", F.when(F.expr("(x1 + y2) % 7 <> 0"), _int("4 + 2 * ((x1 + y1) % 11)")))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, page_id, status, step): one outcome per event, runs of users."""
    status = F.when(F.expr("event_id % 11 = 0"), "skipped").when(F.expr("event_id % 17 = 0"), "failed").when(F.expr("event_id % 101 = 0"), "run_fatal").otherwise("completed")
    step = F.element_at(F.array(*map(F.lit, STEPS)), _int("event_id % 6 + 1"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("page_id"), status.alias("status"), step.alias("step"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, pos, ms): samples of each run in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(order).cast("int").alias("pos"), _int("(event_id * 7919) % 5000").alias("ms"))


def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, idx, text): each conversation turn stands for the text of a box."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("idx"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): the URL's path as a file with one of ten suffixes."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), _int("page_id % 10 + 1"))
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(path, suffix).alias("path"))


#: The steps in order, and suffixes for the file bridge (two of them unsupported).
STEPS = ("detect", "preprocess", "mask", "denoise", "inpaint", "export")
SUFFIXES = (".png", ".JPG", ".webp", ".tif", ".gif", ".bmp", ".jp2", ".ppm", "", ".txt")

_BX, _BY = "(l_partkey * 37 + l_suppkey * 11) % 400", "(l_partkey * 53 + l_linenumber * 97) % 500"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SQL = {
    "blocks": f"""blocks AS (SELECT l_orderkey AS page_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ROW)}) - 1 AS INTEGER) AS idx,
  CAST({_BX} AS INTEGER) AS x1, CAST({_BY} AS INTEGER) AS y1,
  CAST({_BX} + (5 + (l_partkey * 7 + l_linenumber * 29) % 200) AS INTEGER) AS x2, CAST({_BY} + (5 + (l_suppkey * 13 + l_partkey * 3) % 200) AS INTEGER) AS y2,
  CASE l_returnflag WHEN 'R' THEN 'japanese' WHEN 'A' THEN 'english' END AS lang,
  CAST(400 + (l_partkey * 17 + l_suppkey * 5) % 600 AS INTEGER) AS conf_milli FROM lineitem)""",
    "raw_rows": "raw_rows AS (SELECT vec_id AS page_id, CAST(row_idx AS INTEGER) AS row_idx, "
    + ", ".join(f"CAST(floor(abs(CAST(embedding[(row_idx * 7 + {i}) % len(embedding) + 1] AS DOUBLE)) * 4096) AS INTEGER) AS q{i}" for i in range(7))
    + " FROM embeddings, generate_series(0, 9) AS g(row_idx))",
    "pixels": """pixels AS (SELECT page_id, x, y, CAST((x * 7 + y * 13 + page_id * 29 + x * y * 3) % 256 AS INTEGER) AS v
  FROM (SELECT p_partkey AS page_id FROM part), (SELECT CAST(i % 24 AS INTEGER) AS x, CAST(i // 24 AS INTEGER) AS y FROM generate_series(0, 383) AS g(i)))""",
    "regions": """regions AS (SELECT *, CAST((x1 * 131 + y1 * 17 + idx * 7) % 30000 AS INTEGER) AS std_milli, (x2 + y2) % 5 = 0 AS failed,
  CASE WHEN (x1 + y2) % 7 <> 0 THEN CAST(4 + 2 * ((x1 + y1) % 11) AS INTEGER) END AS thickness FROM blocks)""",
    "outcomes": f"""outcomes AS (SELECT user_id AS run_id, event_id AS page_id,
  CASE WHEN event_id % 11 = 0 THEN 'skipped' WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 101 = 0 THEN 'run_fatal' ELSE 'completed' END AS status,
  {_LIST(STEPS)}[event_id % 6 + 1] AS step FROM events)""",
    "durations": """durations AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos,
  CAST((event_id * 7919) % 5000 AS INTEGER) AS ms FROM events)""",
    "ocr_text": "ocr_text AS (SELECT conv_id AS page_id, CAST(turn AS INTEGER) AS idx, text FROM conversations)",
    "files": f"""files AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') || {_LIST(SUFFIXES)}[page_id % 10 + 1] AS path FROM pages)""",
}


def with_views(sql: str, *names: str) -> str:
    """sql (a SELECT, or further CTEs and a SELECT after a comma) over the named views."""
    return f"WITH RECURSIVE {', '.join(SQL[n] for n in names)}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
