"""Mask fitting, inpainting plans, connected components and profile rules, with their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.operators.raster import _SMALL, edge_pixels, rasterize, small_boxes
from folio.plans.profile import DEFAULTS, RULES
from folio.sources.bridges import CANVAS_H, CANVAS_W, blocks, pixels, regions, with_views

#: Defaults of the profile, as stated fixed values.
IMPROVEMENT, MAX_STD, NOISE_STD, INPAINT_STD, INPAINT_THICKNESS = 0.1, 15.0, 0.25, 15.0, 7
MIN_RADIUS, MAX_RADIUS, RADIUS_PER_STD, ISOLATION, TILE = 7, 20, 0.2, 5, 512


# -- candidate selection ---------------------------------------------------------


def select_candidate(stds: Column, improvement: float = IMPROVEMENT, fast: bool = False) -> Column:
    """(chosen, lowest) places of an ordered array of deviations.

    The first is accepted, then each that improves on the accepted one by the
    given share (inclusive); lowest is the first strict minimum.  Fast mode
    stops behind a deviation of 0.
    """
    none = F.struct(F.lit(-1).alias("chosen"), F.lit(None).cast("double").alias("std"), F.lit(-1).alias("lowest"), F.lit(None).cast("double").alias("low"), F.lit(0).alias("i"), F.lit(False).alias("stop"))

    def step(s: Column, x: Column) -> Column:
        take = s["std"].isNull() | (x <= s["std"] * (1 - improvement))
        lower = s["low"].isNull() | (x < s["low"])
        new = F.struct(F.when(take, s["i"]).otherwise(s["chosen"]).alias("chosen"), F.when(take, x).otherwise(s["std"]).alias("std"), F.when(lower, s["i"]).otherwise(s["lowest"]).alias("lowest"), F.when(lower, x).otherwise(s["low"]).alias("low"), (s["i"] + 1).alias("i"), (F.lit(fast) & (x == 0)).alias("stop"))
        return F.when(s["stop"], s).otherwise(new)

    return F.aggregate(stds, none, step)


def resolve_fallback(choice: Column, stds: Column, max_std: float = MAX_STD, enabled: bool = True) -> Column:
    """The greedy choice if it fits or the fallback is off, else the lowest if that fits, else the greedy one."""
    at = lambda i: F.get(stds, i)
    fits = lambda i: at(i) <= max_std
    return F.when(fits(choice["chosen"]) | ~F.lit(enabled), choice["chosen"]).when(fits(choice["lowest"]), choice["lowest"]).otherwise(choice["chosen"])


# -- inpainting plans ---------------------------------------------------------------


def eligible_regions(df: DataFrame) -> DataFrame:
    """Failed regions first (from the raw image), then poorly fitted thin ones (from the combined mask), each by index."""
    failed = df.filter("failed").select("page_id", "idx", F.lit("raw").alias("source"), F.lit(0).alias("class"))
    poor = df.filter((~F.col("failed")) & (F.col("std_milli") >= INPAINT_STD * 1000) & (F.col("thickness") <= INPAINT_THICKNESS)).select("page_id", "idx", F.lit("combined").alias("source"), F.lit(1).alias("class"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("class", "idx"))
    return failed.unionByName(poor).withColumn("place", place).drop("class")


def growth(std: Column) -> Column:
    extra = F.when(F.isnan(std), F.lit(0)).otherwise(F.greatest(g.saturated(std * RADIUS_PER_STD), F.lit(0)))
    return F.lit(MIN_RADIUS) + F.least(extra, F.lit(MAX_RADIUS - MIN_RADIUS))


def merge_rects(df: DataFrame) -> DataFrame:
    """Per page, non-empty boxes merged until no two bounding boxes intersect, with their place by rows, then columns.

    The fixpoint runs inside the fold of a page: each box absorbs what it meets,
    again while it grows.
    """
    box = g.of()
    pages = df.filter("x2 > x1 and y2 > y1").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", box.alias("r")))).alias("all"))
    empty = F.transform(F.slice("all", 1, 0), lambda s: s["r"])

    def absorb(acc: Column, r: Column) -> Column:
        hit = lambda a: g.intersects(a, r)
        return F.concat(F.filter(acc, lambda a: ~hit(a)), F.array(F.aggregate(F.filter(acc, hit), r, g.merge)))

    once = lambda boxes: F.aggregate(boxes, empty, absorb)
    first = F.aggregate("all", empty, lambda acc, s: absorb(acc, s["r"]))
    state = lambda boxes, done: F.struct(boxes.alias("boxes"), done.alias("done"))

    def again(s: Column, _: Column) -> Column:
        after = F.transform(F.array(once(s["boxes"])), lambda b: state(b, F.size(b) == F.size(s["boxes"])))  # settled when nothing merged
        return F.when(s["done"], s).otherwise(F.get(after, 0))

    settled = F.aggregate(F.sequence(F.lit(1), F.size("all")), state(first, F.lit(False)), again, lambda s: s["boxes"])
    ordered = F.array_sort(F.transform(settled, lambda b: F.struct(b["y1"].alias("y1"), b["x1"].alias("x1"), b["y2"].alias("y2"), b["x2"].alias("x2"))))
    return pages.select("page_id", F.posexplode(ordered)).select("page_id", F.col("pos").alias("place"), "col.x1", "col.y1", "col.x2", "col.y2")


def axis_anchors(low: Column, high: Column, canvas: int, tile: int = TILE) -> Column:
    """Starts of tiles along one axis: one centred and clamped, or a lattice whose last start is clamped."""
    top = max(canvas - tile, 0)
    clamp = lambda v: F.greatest(F.least(v, F.lit(top)), F.lit(0))
    centred = clamp(F.shiftright(low + high, 1) - tile // 2)
    lattice = F.transform(F.sequence(low, high - 1, F.lit(tile)), clamp)
    return F.when(high - low <= tile, F.array(centred)).otherwise(F.array_distinct(lattice))


def tile_windows(df: DataFrame, w: int, h: int, tile: int = TILE) -> DataFrame:
    """(page_id, idx, tile, tx, ty): the windows over each box, rows before columns."""
    t = df.withColumn("ys", axis_anchors(F.col("y1"), F.col("y2"), h, tile)).withColumn("xs", axis_anchors(F.col("x1"), F.col("x2"), w, tile))
    grid = F.flatten(F.transform("ys", lambda y: F.transform("xs", lambda x: F.struct(x.alias("tx"), y.alias("ty")))))
    return t.select("page_id", "idx", "x1", "y1", "x2", "y2", F.posexplode(grid)).select("page_id", "idx", "x1", "y1", "x2", "y2", F.col("pos").alias("tile"), "col.tx", "col.ty")


def owner_map(write: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """(page_id, x, y, tile): each pixel to write belongs to the lowest window over it."""
    on = (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + tile) & (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + tile)
    return write.join(tiles.select("page_id", "tile", "tx", "ty"), "page_id").filter(on).groupBy("page_id", "x", "y").agg(F.min("tile").alias("tile"))


# -- queries --------------------------------------------------------------------------


def q_candidate_selection(spark, sf):
    """Per page, its regions' deviations as candidates: the greedy choice, the fallback and the fast one."""
    df = regions(spark, sf).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "std_milli"))), lambda s: s["std_milli"] / 1000.0).alias("stds"))
    c = select_candidate(F.col("stds"))
    df = df.withColumn("c", c).withColumn("fast", select_candidate(F.col("stds"), fast=True)["chosen"])
    return df.select("page_id", F.col("c.chosen").alias("chosen"), F.col("c.lowest").alias("lowest"), resolve_fallback(F.col("c"), F.col("stds")).alias("resolved"), "fast")


SQL_SELECT = with_views(""", s AS (SELECT page_id, list(std_milli / 1000.0::DOUBLE ORDER BY idx) AS d FROM regions GROUP BY page_id),
f AS (SELECT page_id, d, 0 AS i, 0 AS chosen, d[1] AS std, 0 AS lowest, d[1] AS low FROM s
 UNION ALL SELECT page_id, d, i + 1, CASE WHEN d[i + 2] <= std * 0.9::DOUBLE THEN i + 1 ELSE chosen END, CASE WHEN d[i + 2] <= std * 0.9::DOUBLE THEN d[i + 2] ELSE std END, CASE WHEN d[i + 2] < low THEN i + 1 ELSE lowest END, CASE WHEN d[i + 2] < low THEN d[i + 2] ELSE low END FROM f WHERE i + 1 < len(d)),
fast AS (SELECT page_id, arg_max(chosen, i) AS fast FROM (SELECT *, list_position(d, 0.0::DOUBLE) AS z FROM f) WHERE z IS NULL OR z = 0 OR i < z GROUP BY page_id)
SELECT f.page_id, chosen, lowest, CASE WHEN std <= 15 THEN chosen WHEN low <= 15 THEN lowest ELSE chosen END AS resolved, fast FROM f JOIN fast USING (page_id) WHERE i + 1 = len(d)""", "blocks", "regions")


def q_border_statistics(spark, sf):
    """Deviation and truncated median of the page's grey values along the border of each box, and whether the fit is accepted."""
    inside = rasterize(small_boxes(spark, sf), 24, 16)
    edge = edge_pixels(inside.select(F.expr("page_id * 100 + idx").alias("page_id"), "x", "y"), 24, 16).select(F.expr("cast(page_id div 100 as bigint)").alias("page_id"), F.expr("cast(page_id % 100 as int)").alias("idx"), "x", "y")
    s = edge.join(pixels(spark, sf), ["page_id", "x", "y"]).groupBy("page_id", "idx").agg(F.round(F.coalesce(F.stddev_pop("v"), F.lit(0.0)), 6).alias("std"), F.median("v").cast("int").alias("median"), F.count("*").alias("n"))
    return s.withColumn("accepted", F.col("std") <= MAX_STD)


SQL_BORDER = with_views(_SMALL + """, r AS (SELECT b.page_id, idx, p.x, p.y, v FROM boxes b JOIN pixels p ON p.page_id = b.page_id AND p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2),
e AS (SELECT a.*, (SELECT count(*) FROM r b WHERE b.page_id = a.page_id AND b.idx = a.idx AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1) AS n FROM r a)
SELECT page_id, idx, round(coalesce(stddev_pop(v), 0), 6) AS std, CAST(trunc(median(v)) AS INTEGER) AS median, count(*) AS n, round(coalesce(stddev_pop(v), 0), 6) <= 15 AS accepted FROM e WHERE n < 9 OR x IN (0, 23) OR y IN (0, 15) GROUP BY page_id, idx""", "blocks", "pixels")


def q_inpaint_eligible(spark, sf):
    df = regions(spark, sf)
    e = eligible_regions(df).join(df, ["page_id", "idx"])
    radius = growth(F.col("std_milli") / 1000.0)
    padded = g.pad(g.of(), radius + ISOLATION, CANVAS_W, CANVAS_H)
    return e.select("page_id", "idx", "source", "place", radius.alias("radius"), padded["x1"].alias("x1"), padded["y2"].alias("y2"))


SQL_ELIGIBLE = with_views(""", e AS (SELECT *, CASE WHEN failed THEN 'raw' ELSE 'combined' END AS source, CAST(least(7 + trunc(std_milli / 1000.0 * 0.2), 20) AS INTEGER) AS radius FROM regions WHERE failed OR (std_milli >= 15000 AND thickness <= 7))
SELECT page_id, idx, source, CAST(row_number() OVER (PARTITION BY page_id ORDER BY failed DESC, idx) AS INTEGER) AS place, radius, greatest(x1 - radius - 5, 0) AS x1, least(y2 + radius + 5, 1660) AS y2 FROM e""", "blocks", "regions")


def q_denoise_regions(spark, sf):
    """Accepted noisy regions scaled and cropped with their halo."""
    df = regions(spark, sf).filter((~F.col("failed")) & (F.col("std_milli") > NOISE_STD * 1000))
    crop = g.region_crop(g.pad(g.of(), 8, CANVAS_W, CANVAS_H), 0.5, 600, 830)
    return df.select("page_id", "idx", crop["x"].alias("x"), crop["y"].alias("y"), crop["w"].alias("w"), crop["h"].alias("h"))


SQL_DENOISE = with_views(" SELECT page_id, idx, x, y, x2 - x AS w, y2 - y AS h FROM (SELECT page_id, idx, CAST(trunc(greatest(x1 - 8, 0) * 0.5) AS INTEGER) AS x, CAST(trunc(greatest(y1 - 8, 0) * 0.5) AS INTEGER) AS y, CAST(trunc((x2 + 8) * 0.5) AS INTEGER) AS x2, CAST(trunc((y2 + 8) * 0.5) AS INTEGER) AS y2 FROM regions WHERE NOT failed AND std_milli > 250)", "blocks", "regions")


def q_merge_rects(spark, sf):
    return merge_rects(blocks(spark, sf))


SQL_MERGE_RECTS = with_views(""", f AS (SELECT page_id, 0 AS step, list({'a': x1, 'b': y1, 'c': x2, 'd': y2}) AS boxes FROM blocks WHERE x2 > x1 AND y2 > y1 GROUP BY page_id
 UNION ALL SELECT page_id, step + 1, list_distinct(list_transform(boxes, lambda p: {
  'a': list_min(list_transform(list_filter(boxes, lambda q: p.a < q.c AND q.a < p.c AND p.b < q.d AND q.b < p.d), lambda q: q.a)), 'b': list_min(list_transform(list_filter(boxes, lambda q: p.a < q.c AND q.a < p.c AND p.b < q.d AND q.b < p.d), lambda q: q.b)),
  'c': list_max(list_transform(list_filter(boxes, lambda q: p.a < q.c AND q.a < p.c AND p.b < q.d AND q.b < p.d), lambda q: q.c)), 'd': list_max(list_transform(list_filter(boxes, lambda q: p.a < q.c AND q.a < p.c AND p.b < q.d AND q.b < p.d), lambda q: q.d))})) FROM f WHERE step < 24)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY u.b, u.a, u.d, u.c) - 1 AS INTEGER) AS place, u.a AS x1, u.b AS y1, u.c AS x2, u.d AS y2 FROM (SELECT page_id, unnest(boxes) AS u FROM f WHERE step = 24)""", "blocks")


def q_tile_windows(spark, sf):
    return tile_windows(blocks(spark, sf), 600, 700, 96).select("page_id", "idx", "tile", "tx", "ty", ((F.col("x1") < F.col("tx") + 96) & (F.col("tx") < F.col("x2")) & (F.col("y1") < F.col("ty") + 96) & (F.col("ty") < F.col("y2"))).alias("touches"))


SQL_TILES = with_views(""", a AS (SELECT *, CASE WHEN x2 - x1 <= 96 THEN [greatest(least((x1 + x2) // 2 - 48, 504), 0)] ELSE list_sort(list_distinct(list_transform(generate_series(x1, x2 - 1, 96), lambda v: greatest(least(v, 504), 0)))) END AS xs,
 CASE WHEN y2 - y1 <= 96 THEN [greatest(least((y1 + y2) // 2 - 48, 604), 0)] ELSE list_sort(list_distinct(list_transform(generate_series(y1, y2 - 1, 96), lambda v: greatest(least(v, 604), 0)))) END AS ys FROM blocks),
t AS (SELECT page_id, idx, x1, y1, x2, y2, i, j, len(xs) AS n, xs[i] AS tx, ys[j] AS ty FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM a) x, LATERAL (SELECT unnest(generate_series(1, len(x.ys))) AS j))
SELECT page_id, idx, CAST((j - 1) * n + i - 1 AS INTEGER) AS tile, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, x1 < tx + 96 AND tx < x2 AND y1 < ty + 96 AND ty < y2 AS touches FROM t""", "blocks")


def q_owner_map(spark, sf):
    """Pixels of the boxes owned by each window of the page's first box."""
    b = small_boxes(spark, sf)
    tiles = tile_windows(b.filter("idx = 0"), 24, 16, 4)
    return owner_map(rasterize(b, 24, 16).select("page_id", "x", "y").distinct(), tiles, 4).groupBy("page_id", "tile").agg(F.count("*").alias("n"), F.min("x").alias("x"))


SQL_OWNER = with_views(_SMALL + """, w AS (SELECT DISTINCT p.page_id, p.x, p.y FROM boxes b JOIN pixels p ON p.page_id = b.page_id AND p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2),
a AS (SELECT *, CASE WHEN x2 - x1 <= 4 THEN [greatest(least((x1 + x2) // 2 - 2, 20), 0)] ELSE list_sort(list_distinct(list_transform(generate_series(x1, x2 - 1, 4), lambda v: greatest(least(v, 20), 0)))) END AS xs,
 CASE WHEN y2 - y1 <= 4 THEN [greatest(least((y1 + y2) // 2 - 2, 12), 0)] ELSE list_sort(list_distinct(list_transform(generate_series(y1, y2 - 1, 4), lambda v: greatest(least(v, 12), 0)))) END AS ys FROM boxes WHERE idx = 0),
t AS (SELECT page_id, (j - 1) * len(xs) + i - 1 AS tile, xs[i] AS tx, ys[j] AS ty FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM a) x, LATERAL (SELECT unnest(generate_series(1, len(x.ys))) AS j)),
o AS (SELECT w.page_id, w.x, w.y, min(tile) AS tile FROM w JOIN t ON w.page_id = t.page_id AND x >= tx AND x < tx + 4 AND y >= ty AND y < ty + 4 GROUP BY ALL)
SELECT page_id, CAST(tile AS INTEGER) AS tile, count(*) AS n, min(x) AS x FROM o GROUP BY page_id, tile""", "blocks", "pixels")


def q_profile_violations(spark, sf):
    """Rules that variants of the default profile break, all in the order of the rules, and the first."""
    variants = [(i, key, value) for i, (key, value) in enumerate([("overlap", 120.0), ("max_std", 0.0), ("improvement", 1.0), ("window", 4.0), ("max_radius", 3.0), ("aspect", float("nan")), ("overlap", 20.0)])]
    wide = [(i, *(value if key == k else DEFAULTS[k] for k in DEFAULTS)) for i, key, value in variants]
    df = spark.createDataFrame(wide, ["variant", *DEFAULTS])
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in RULES.items())))
    changed = F.array_compact(F.array(*(F.when(F.isnan(F.lit(float(d))) | (F.col(k) != float(d)), F.lit(k)) for k, d in DEFAULTS.items())))
    return df.withColumn("broken", broken).select(F.col("variant").cast("int").alias("variant"), F.array_join("broken", ",").alias("violations"), F.get("broken", 0).alias("first"), F.array_join(changed, ",").alias("changed"))


# Defaults, variants and rules stated again; a rule with something that is not a number is broken.
SQL_PROFILE = """WITH v(variant, key, value) AS (VALUES (0, 'overlap', 120.0::DOUBLE), (1, 'max_std', 0.0), (2, 'improvement', 1.0), (3, 'window', 4.0), (4, 'max_radius', 3.0), (5, 'aspect', 'nan'::DOUBLE), (6, 'overlap', 20.0)),
p AS (SELECT variant, key, value, CASE WHEN key = 'overlap' THEN value ELSE 20.0 END AS overlap, CASE WHEN key = 'aspect' THEN value ELSE 0.33 END AS aspect, CASE WHEN key = 'max_std' THEN value ELSE 15.0 END AS max_std,
 CASE WHEN key = 'improvement' THEN value ELSE 0.1 END AS improvement, CASE WHEN key = 'window' THEN value ELSE 7.0 END AS win, CASE WHEN key = 'max_radius' THEN value ELSE 20.0 END AS max_radius FROM v),
r AS (SELECT variant, concat_ws(',', CASE WHEN NOT overlap BETWEEN 0 AND 100 THEN 'overlap' END, CASE WHEN isnan(aspect) OR NOT aspect > 0 THEN 'aspect' END, CASE WHEN isnan(max_std) OR NOT max_std > 0 THEN 'max_std' END,
 CASE WHEN NOT (improvement >= 0 AND improvement < 1) THEN 'improvement' END, CASE WHEN NOT (win >= 3 AND win % 2 = 1) THEN 'window' END, CASE WHEN NOT max_radius >= 7 THEN 'radius' END) AS violations,
 CASE WHEN key = 'overlap' AND value = 20.0 THEN '' ELSE key END AS changed FROM p)
SELECT variant, violations, CASE WHEN violations <> '' THEN string_split(violations, ',')[1] END AS first, changed FROM r"""

QUERIES = {
    "candidate_selection": q_candidate_selection, "border_statistics": q_border_statistics, "inpaint_eligible": q_inpaint_eligible, "denoise_regions": q_denoise_regions, "merge_rects": q_merge_rects,
    "tile_windows": q_tile_windows, "owner_map": q_owner_map, "profile_violations": q_profile_violations,
}
ORACLES = {
    "candidate_selection": SQL_SELECT, "border_statistics": SQL_BORDER, "inpaint_eligible": SQL_ELIGIBLE, "denoise_regions": SQL_DENOISE, "merge_rects": SQL_MERGE_RECTS,
    "tile_windows": SQL_TILES, "owner_map": SQL_OWNER, "profile_violations": SQL_PROFILE,
}
