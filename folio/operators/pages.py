"""Page-level operators: strips, windows copied with edges, write-back, formats, reports and path rewriting, with their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.operators.raster import best_splits, row_scores
from folio.plans.batch import segments, stitched
from folio.sources.bridges import blocks, files, outcomes, pixels, table, with_views
from folio.sources.images import cleaned_mode, coerced_mode

#: Cacheable artifacts with the step that makes each and its file suffix.
ARTIFACTS = (("raw", "detect", "#raw.json"), ("base", "detect", "_base.png"), ("clean", "preprocess", "#clean.json"), ("mask", "mask", "_mask.png"), ("masked", "mask", "_clean.png"), ("denoised", "denoise", "_clean_denoised.png"), ("inpainted", "inpaint", "_clean_inpaint.png"))


def crop_replicated(df: DataFrame, x1: int, y1: int, x2: int, y2: int, w: int, h: int) -> DataFrame:
    """The window x1..x2, y1..y2 of each page, edges repeated outside the canvas."""
    grid = df.sparkSession.range((x2 - x1) * (y2 - y1)).select((F.col("id") % (x2 - x1)).cast("int").alias("nx"), F.floor(F.col("id") / (x2 - x1)).cast("int").alias("ny"))
    clamp = lambda c, at, top: F.greatest(F.least(F.col(c) + at, F.lit(top)), F.lit(0))
    grid = grid.select("nx", "ny", clamp("nx", x1, w - 1).alias("x"), clamp("ny", y1, h - 1).alias("y"))
    return df.join(F.broadcast(grid), ["x", "y"]).select("page_id", F.col("nx").alias("x"), F.col("ny").alias("y"), "v")


def write_back(page: DataFrame, filled: DataFrame, owner: DataFrame, mask: DataFrame) -> DataFrame:
    """Page pixels, replaced inside the mask by the value of the tile that owns them."""
    own = owner.join(filled, ["page_id", "x", "y", "tile"]).join(mask, ["page_id", "x", "y"], "left_semi").select("page_id", "x", "y", F.col("v").alias("new"))
    return page.join(own, ["page_id", "x", "y"], "left").select("page_id", "x", "y", F.coalesce("new", "v").alias("v"))


def residual_report(boxes: DataFrame) -> DataFrame:
    """One JSON line per page with the count and rectangles of confident boxes."""
    rect = F.struct("idx", "x1", "y1", "x2", "y2")
    found = boxes.filter("conf_milli > 600").groupBy("page_id").agg(F.array_sort(F.collect_list(rect)).alias("b"))
    return found.select("page_id", F.to_json(F.struct(F.size("b").alias("count"), F.transform("b", lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"])).alias("rects"))).alias("line"))


def rebased(path: Column, old: str, new: str) -> Column:
    """path with a leading folder replaced; other paths stay."""
    return F.when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def coverage_of(value: Column, *keys: str):
    """Aggregates that say whether an optional field is present, absent or partial in a group."""
    have, n = F.count(value), F.count(F.lit(1))
    return F.when(have == n, "present").when(have == 0, "absent").otherwise("partial")


def q_strips(spark, sf):
    """Pages cut at their best rows, each segment's pixels counted, and stitched back unless one of its segments is missing."""
    p = pixels(spark, sf)
    pages = p.select("page_id").distinct().withColumn("h", F.lit(16))
    seg = segments(pages, best_splits(row_scores(p), 16, 4, 2).select("page_id", F.col("y").cast("int").alias("y")))
    parts = p.join(seg, "page_id").filter("y >= top and y < bottom").withColumn("y", F.col("y") - F.col("top")).withColumn("category", F.lit("clean"))
    parts = parts.filter("not (page_id % 5 = 0 and seg_idx = 1)").select("page_id", "category", "seg_idx", "top", "x", "y", "v")
    whole = stitched(parts, seg.groupBy("page_id").agg(F.count("*").alias("n")))
    return whole.groupBy("page_id").agg(F.count("*").alias("pixels"), F.sum((F.col("y") * 31 + F.col("x")) * F.col("v")).alias("digest"))


SQL_STRIPS = with_views(""", d AS (SELECT page_id, y, v - lag(v) OVER (PARTITION BY page_id, x ORDER BY y) AS d FROM pixels), s AS (SELECT page_id, y, sum(d * d) AS score FROM d GROUP BY ALL),
r(i, a, b) AS (VALUES (1, 2, 7), (2, 6, 11), (3, 10, 15)), z AS (SELECT page_id, i, y, row_number() OVER (PARTITION BY page_id, i ORDER BY score, y) AS k FROM s, r WHERE y >= a AND y < b),
m AS (SELECT page_id, i, y, max(y) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM z WHERE k = 1),
c AS (SELECT page_id, count(*) FILTER (before IS NULL OR y > before) AS n FROM m GROUP BY page_id)
SELECT p.page_id, count(*) AS pixels, CAST(sum((y * 31 + x) * v) AS BIGINT) AS digest FROM pixels p JOIN c USING (page_id) WHERE NOT (page_id % 5 = 0 AND n >= 1) GROUP BY p.page_id""", "pixels")


def q_crop_replicated(spark, sf):
    return crop_replicated(pixels(spark, sf), -3, -2, 9, 20, 24, 16)


SQL_CROP = with_views(" SELECT page_id, CAST(nx AS INTEGER) AS x, CAST(ny AS INTEGER) AS y, v FROM pixels JOIN (SELECT nx, ny, greatest(least(nx - 3, 23), 0) AS sx, greatest(least(ny - 2, 15), 0) AS sy FROM generate_series(0, 11) a(nx), generate_series(0, 21) b(ny)) ON x = sx AND y = sy", "pixels")


def q_residual_report(spark, sf):
    return residual_report(blocks(spark, sf))


SQL_RESIDUAL = with_views(""" SELECT page_id, '{"count":' || count(*) || ',"rects":[' || string_agg('[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']', ',' ORDER BY idx) || ']}' AS line FROM blocks WHERE conf_milli > 600 GROUP BY page_id""", "blocks")


def q_output_formats(spark, sf):
    """Each file's colour mode after export to each of three formats, with its destination and rebased path."""
    f = files(spark, sf).withColumn("mode", F.element_at(F.array(*map(F.lit, ("L", "LA", "RGB", "RGBA"))), (F.col("page_id") % 4 + 1).cast("int")))
    f = f.withColumn("out", F.explode(F.array(*map(F.lit, (".jpg", ".tif", ".ppm")))))
    return f.select("page_id", "out", coerced_mode(F.col("mode"), F.col("out")).alias("written"), F.col("out").isin(".tif").alias("alpha"), F.col("out").isin(".jpg", ".tif").alias("dpi"), rebased(F.concat(F.lit("old/"), F.col("page_id").cast("string")), "old", "new/place").alias("path"), cleaned_mode(F.col("mode"), F.expr("page_id % 3 = 0")).alias("cleaned"))


SQL_FORMATS = with_views(""" SELECT page_id, out, CASE WHEN out = '.ppm' THEN 'RGB' WHEN out = '.jpg' AND mode = 'LA' THEN 'L' WHEN out = '.jpg' AND mode = 'RGBA' THEN 'RGB' WHEN out = '.tif' AND mode = 'LA' THEN 'RGBA' ELSE mode END AS written, out = '.tif' AS alpha, out IN ('.jpg', '.tif') AS dpi, 'new/place/' || page_id AS path, CASE WHEN mode IN ('L', 'LA') AND page_id % 3 = 0 THEN 'L' ELSE 'RGB' END AS cleaned
FROM (SELECT page_id, ['L', 'LA', 'RGB', 'RGBA'][page_id % 4 + 1] AS mode, unnest(['.jpg', '.tif', '.ppm']) AS out FROM files)""", "files")


def q_field_coverage(spark, sf):
    """Per page: is the language known of all, none or some boxes, which lack it, and the bounds of all its corners."""
    missing = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lang").isNull(), F.col("idx")))), lambda i: i.cast("string")), ",")
    return blocks(spark, sf).groupBy("page_id").agg(coverage_of(F.col("lang")).alias("coverage"), missing.alias("missing"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


SQL_FIELD = with_views(" SELECT page_id, CASE WHEN count(lang) = count(*) THEN 'present' WHEN count(lang) = 0 THEN 'absent' ELSE 'partial' END AS coverage, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (lang IS NULL), '') AS missing, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM blocks GROUP BY page_id", "blocks")


def q_artifact_dimension(spark, sf):
    """Artifacts wanted for each run's last step, with their cache suffix; what a step needs is all before it."""
    dim = spark.createDataFrame([(i, *a) for i, a in enumerate(ARTIFACTS)], "ord int, artifact string, step string, suffix string")
    last = outcomes(spark, sf).filter("status = 'completed'").groupBy("run_id").agg(F.max_by("step", "page_id").alias("step"))
    reach = dim.groupBy("step").agg(F.max("ord").alias("upto"))
    return last.join(F.broadcast(reach), "step").join(F.broadcast(dim.drop("step")), F.col("ord") <= F.col("upto")).select("run_id", "artifact", "suffix")


SQL_DIMENSION = with_views(f""", dim(ord, artifact, step, suffix) AS (VALUES {', '.join(f"({i}, '{a}', '{s}', '{x}')" for i, (a, s, x) in enumerate(ARTIFACTS))}),
last AS (SELECT run_id, arg_max(step, page_id) AS step FROM outcomes WHERE status = 'completed' GROUP BY run_id), reach AS (SELECT step, max(ord) AS upto FROM dim GROUP BY step)
SELECT run_id, d.artifact, d.suffix FROM last JOIN reach USING (step) JOIN dim d ON d.ord <= upto""", "outcomes")


def zipped(left: DataFrame, right: DataFrame, order: str = "idx") -> DataFrame:
    """Rows of a page side by side by their position in order, whatever their numbers are; the shorter side is null at the end."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(order))
    return left.withColumn("place", place).drop(order).join(right.withColumn("place", place).drop(order), ["page_id", "place"], "full")


def q_zip_positions(spark, sf):
    """Text boxes joined with their extended boxes by position, and pages where the two differ in number."""
    b = blocks(spark, sf).select("page_id", "idx", g.of().alias("r"))
    e = b.filter("not (page_id % 9 = 0 and idx = 1)").select("page_id", "idx", g.pad(F.col("r"), 5, 1200, 1660).alias("e"))
    j = zipped(b, e)
    return j.groupBy("page_id").agg(F.count("r").alias("boxes"), F.count("e").alias("extended"), F.sum(F.when(F.col("e").isNotNull(), g.area(F.col("e")) - g.area(F.col("r")))).alias("growth")).withColumn("paired", F.col("boxes") == F.col("extended"))


SQL_ZIP = with_views(""", b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS place FROM blocks),
e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS place, (least(x2 + 5, 1200) - greatest(x1 - 5, 0)) * (least(y2 + 5, 1660) - greatest(y1 - 5, 0)) AS area FROM blocks WHERE NOT (page_id % 9 = 0 AND idx = 1))
SELECT b.page_id, count(*) AS boxes, count(e.area) AS extended, CAST(sum(e.area - (x2 - x1) * (y2 - y1)) AS BIGINT) AS growth, count(*) = count(e.area) AS paired FROM b LEFT JOIN e ON e.page_id = b.page_id AND e.place = b.place GROUP BY b.page_id""", "blocks")


def directory_sizes(stored: DataFrame) -> DataFrame:
    """(folder, bytes, files): what is stored below every folder of the paths, on all levels."""
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return stored.filter(F.size(parts) > 1).select(above.alias("folder"), "bytes").groupBy("folder").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def q_directory_sizes(spark, sf):
    path = F.concat(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), F.lit("/"), F.col("page_id").cast("string"))
    return directory_sizes(table(spark, sf, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("bytes")))


SQL_DIRS = """SELECT array_to_string(list_slice(parts, 1, n), '/') AS folder, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files
FROM (SELECT parts, bytes, unnest(generate_series(1, len(parts) - 1)) AS n FROM (SELECT string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1) || '/' || page_id, '/') AS parts, strlen(html) AS bytes FROM pages)) GROUP BY 1"""

QUERIES = {
    "strips": q_strips, "crop_replicated": q_crop_replicated, "residual_report": q_residual_report, "output_formats": q_output_formats, "field_coverage": q_field_coverage,
    "artifact_dimension": q_artifact_dimension, "zip_positions": q_zip_positions, "directory_sizes": q_directory_sizes,
}
ORACLES = {
    "strips": SQL_STRIPS, "crop_replicated": SQL_CROP, "residual_report": SQL_RESIDUAL, "output_formats": SQL_FORMATS, "field_coverage": SQL_FIELD,
    "artifact_dimension": SQL_DIMENSION, "zip_positions": SQL_ZIP, "directory_sizes": SQL_DIRS,
}
