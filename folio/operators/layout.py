"""Rectangle operators, box filters and the greedy box folds, with their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.sources.bridges import CANVAS_H, CANVAS_W, blocks, raw_rows, with_views

#: Defaults of the profile, as stated fixed values.
MIN_AREA, UNKNOWN_MIN_AREA, OCR_MAX_SIZE, OVERLAP_PERCENT = 400, 40_000, 30_000, 20.0
TIGHT, TIGHT_RIGHT, EXTEND, EXTEND_RIGHT, REFERENCE = 2, 3, 5, 5, 20
READING_X, READING_Y = 0.4, 1.0
OBJECTNESS, CONFIDENCE, IOU_LIMIT, SURVIVORS = 0.4, 0.4, 0.35, 300
CLASSES = ("english", "japanese")


def boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("r", g.of())


# -- filters ---------------------------------------------------------------


def assign_language(lang: Column, pinned: str | None) -> Column:
    """A pinned language overrides what was detected."""
    return F.lit(pinned) if pinned else lang


def keep_box(r: Column, lang: Column, ocr_run: bool = False, strict: bool = False) -> Column:
    """Not too small; boxes of unknown language need more area, or go in a strict OCR run."""
    small = (g.area(r) < MIN_AREA) | (lang.isNull() & (g.area(r) < UNKNOWN_MIN_AREA))
    return ~(small | (lang.isNull() & F.lit(ocr_run and strict)))


def page_language(df: DataFrame) -> DataFrame:
    """(page_id, page_lang): most frequent known language, ties to the first seen; null without one."""
    seen = df.filter("lang is not null").groupBy("page_id", "lang").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    best = seen.groupBy("page_id").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("first"))).alias("page_lang"))
    return df.select("page_id").distinct().join(best, "page_id", "left")


def apply_page_language(df: DataFrame, setting: str = "detect_page") -> DataFrame:
    """Every box's language becomes its page's, null where no box's is known; other settings leave the boxes alone."""
    if setting != "detect_page":
        return df
    return df.join(page_language(df), "page_id").withColumn("lang", F.col("page_lang")).drop("page_lang")


def is_right_to_left(order: str, page_lang: Column) -> Column:
    return {"manga": F.lit(True), "comic": F.lit(False)}.get(order, F.coalesce(page_lang == "japanese", F.lit(False)))


def reading_order(df: DataFrame, right_to_left: Column) -> DataFrame:
    """df with place: stable ascending weight of the upper left corner, x mirrored for right-to-left pages."""
    sign = F.when(right_to_left, -READING_X).otherwise(READING_X)
    key = sign * F.col("x1") + READING_Y * F.col("y1")
    return df.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(key, "idx")))


def ocr_candidate(r: Column, lang: Column, engines: list[str]) -> Column:
    """Small enough, an engine for its language, and something of it on the canvas."""
    return (g.area(r) < OCR_MAX_SIZE) & F.coalesce(lang.isin(engines), F.lit(False)) & g.to_crop(r, CANVAS_W, CANVAS_H).isNotNull()


def filter_candidates(df: DataFrame) -> DataFrame:
    """Detector rows (cx, cy, w, h, obj, c0, c1 as float) to corner boxes with score and class; of equal classes the last."""
    f = lambda v: F.lit(v).cast("float")
    best = F.greatest("c0", "c1")
    out = df.withColumn("score", (F.col("obj") * best).cast("float")).withColumn("cls", F.when(F.col("c1") >= F.col("c0"), 1).otherwise(0))
    out = out.filter((F.col("obj") > f(OBJECTNESS)) & (F.col("score") > f(CONFIDENCE)))
    half = lambda c, s, sign: (F.col(c) + sign * F.col(s) / F.lit(2.0).cast("float")).cast("float")
    return out.withColumns({"bx1": half("cx", "w", -1), "by1": half("cy", "h", -1), "bx2": half("cx", "w", 1), "by2": half("cy", "h", 1)})


def class_language(cls: Column) -> Column:
    return F.when(cls == 0, CLASSES[0]).when(cls == 1, CLASSES[1])


def as_detector_rows(df: DataFrame) -> DataFrame:
    """The integer bridge as detector floats: centres within 200, sides 20 to 84, scores within 1."""
    d = lambda i, mod, add, div: ((F.col(f"q{i}") % mod + add) / F.lit(div)).cast("float")
    return df.select("page_id", "row_idx", d(0, 200, 30, 1.0), d(1, 200, 30, 1.0), d(2, 64, 20, 1.0), d(3, 64, 20, 1.0), d(4, 1024, 0, 1024.0), d(5, 1024, 0, 1024.0), d(6, 1024, 0, 1024.0)).toDF("page_id", "row_idx", "cx", "cy", "w", "h", "obj", "c0", "c1")


# -- greedy folds: one ordered array per page, folded inside the JVM -----------


def non_maximum_suppression(df: DataFrame, limit: float = IOU_LIMIT, survivors: int = SURVIVORS) -> DataFrame:
    """Per page, boxes by falling score (stable); one stays when it overlaps no kept box by more than the limit."""
    box = F.struct((-F.col("score")).alias("order"), F.col("row_idx"), F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"), F.col("cls"))
    pages = df.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("all"))

    def share(a: Column, b: Column) -> Column:
        w = F.greatest(F.least(a["bx2"], b["bx2"]) - F.greatest(a["bx1"], b["bx1"]), F.lit(0.0).cast("float"))
        h = F.greatest(F.least(a["by2"], b["by2"]) - F.greatest(a["by1"], b["by1"]), F.lit(0.0).cast("float"))
        own = lambda x: (x["bx2"] - x["bx1"]) * (x["by2"] - x["by1"])
        union = own(a) + own(b) - w * h
        return F.when(union <= 0, F.lit(0.0)).otherwise(w * h / F.when(union <= 0, F.lit(1.0).cast("float")).otherwise(union))

    empty = F.slice("all", 1, 0)
    keep = F.aggregate("all", empty, lambda acc, b: F.when((F.size(acc) >= survivors) | F.exists(acc, lambda k: share(k, b) > limit), acc).otherwise(F.concat(acc, F.array(b))))
    return pages.select("page_id", F.explode(keep).alias("b")).select("page_id", "b.*").withColumn("score", -F.col("order")).drop("order")


def rescale(df: DataFrame, ratio: float, w: int, h: int) -> DataFrame:
    """Boxes back to image size: truncated, clamped, score to three places."""
    cut = lambda c, top: F.greatest(F.least(g.saturated(F.col(c).cast("double") * ratio), F.lit(top)), F.lit(0))
    return df.select("page_id", "row_idx", cut("bx1", w).alias("x1"), cut("by1", h).alias("y1"), cut("bx2", w).alias("x2"), cut("by2", h).alias("y2"), "cls", g.round3(F.col("score")).alias("score"))


def merge_by_anchor(df: DataFrame, test) -> DataFrame:
    """Per page in order of idx: a box joins the first anchor whose original box it meets, else becomes one.

    The test sees anchors as they came, not as they grew, so merging is not
    transitive.  An anchor keeps its idx, and the first known language.
    """
    box = F.struct("idx", F.col("lang"), g.of().alias("r"))
    pages = df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", box.alias("b")))).alias("all"))
    anchor = lambda idx, lang, first, grown: F.struct(idx.alias("idx"), lang.alias("lang"), first.alias("first"), grown.alias("grown"))
    start = F.transform(F.slice("all", 1, 0), lambda x: anchor(x["idx"], x["b"]["lang"], x["b"]["r"], x["b"]["r"]))

    def add(acc: Column, x: Column) -> Column:
        b = x["b"]
        hit = F.array_position(F.transform(acc, lambda a: test(a["first"], b["r"])), True)
        grown = F.transform(acc, lambda a, i: F.when(i + 1 == hit, anchor(a["idx"], F.coalesce(a["lang"], b["lang"]), a["first"], g.merge(a["grown"], b["r"]))).otherwise(a))
        return F.when(hit > 0, grown).otherwise(F.concat(acc, F.array(anchor(b["idx"], b["lang"], b["r"], b["r"]))))

    return pages.select("page_id", F.explode(F.aggregate("all", start, add)).alias("a")).select("page_id", "a.idx", "a.lang", "a.grown.*")


def resolve_overlaps(df: DataFrame, percent: float = OVERLAP_PERCENT) -> DataFrame:
    return merge_by_anchor(df, lambda a, b: g.overlaps(a, b, percent))


def resolve_total_overlaps(df: DataFrame) -> DataFrame:
    return merge_by_anchor(df, g.overlaps_center)


def preprocess(df: DataFrame, order: str = "auto", language: str = "detect_box") -> DataFrame:
    """Filter, give the page's language (if set so), merge by centres, pad, order and reference boxes of every page."""
    kept = boxed(df).filter(keep_box(F.col("r"), F.col("lang"))).drop("r")
    langs = page_language(kept)
    kept = apply_page_language(kept, language)
    merged = resolve_total_overlaps(kept)
    tight = merged.withColumn("r", g.right_pad(g.pad(g.of(), TIGHT, CANVAS_W, CANVAS_H), TIGHT_RIGHT, CANVAS_W))
    tight = tight.select("page_id", "idx", "lang", "r.*").join(langs, "page_id")
    placed = reading_order(tight, is_right_to_left(order, F.col("page_lang")))
    extended = g.right_pad(g.pad(g.of(), EXTEND, CANVAS_W, CANVAS_H), EXTEND_RIGHT, CANVAS_W)
    out = placed.withColumn("e", extended)
    return out.withColumn("ref", g.pad(F.col("e"), REFERENCE, CANVAS_W, CANVAS_H))


# -- queries -----------------------------------------------------------------


def q_geometry_scalars(spark, sf):
    r = F.col("r")
    crop, center = g.to_crop(g.translate(r, -80, -90), 300, 350), g.center(g.translate(r, -601, -700))
    text = g.expand_text_window(r, 3.0, 500, 620)
    return boxed(blocks(spark, sf)).select(
        "page_id", "idx", g.width(r).alias("w"), g.height(r).alias("h"), g.area(r).alias("area"), center["x"].alias("cx"), center["y"].alias("cy"),
        g.contains(r, F.lit(200), F.lit(250)).alias("has_point"), g.is_empty(g.translate(r, 0, 0)).alias("empty"),
        crop["x"].alias("crop_x"), crop["w"].alias("crop_w"), crop["h"].alias("crop_h"),
        *(g.pad(r, 20, 500, 600)[n].alias(f"pad_{n}") for n in ("x1", "y1", "x2", "y2")), g.right_pad(r, 5, 420)["x2"].alias("right_x2"),
        *(g.scale(r, 0.375)[n].alias(f"scale_{n}") for n in ("x1", "y1", "x2", "y2")),
        *(g.scale_rect_to(r, (1200, 1660), (700, 900))[n].alias(f"up_{n}") for n in ("x1", "y2")),
        *(text[n].alias(f"text_{n}") for n in ("x1", "y1", "x2", "y2")), g.scale_to_original(r, F.lit(0.5))["x2"].alias("orig_x2"),
        F.array_max(g.xyxy(r)).alias("top"), g.from_xyxy(g.xyxy(r))["y1"].alias("back_y1"),
    )


SQL_SCALARS = with_views("""
SELECT page_id, idx, x2 - x1 AS w, y2 - y1 AS h, CAST(x2 - x1 AS BIGINT) * (y2 - y1) AS area,
 CAST(floor((x1 + x2 - 1202) / 2.0) AS INTEGER) AS cx, CAST(floor((y1 + y2 - 1400) / 2.0) AS INTEGER) AS cy,
 (200 BETWEEN x1 AND x2) AND (250 BETWEEN y1 AND y2) AS has_point, (x2 <= x1 OR y2 <= y1) AS empty,
 CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cx1 END AS crop_x, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cx2 - cx1 END AS crop_w, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cy2 - cy1 END AS crop_h,
 greatest(x1 - 20, 0) AS pad_x1, greatest(y1 - 20, 0) AS pad_y1, least(x2 + 20, 500) AS pad_x2, least(y2 + 20, 600) AS pad_y2, least(x2 + 5, 420) AS right_x2,
 CAST(trunc(x1 * 0.375) AS INTEGER) AS scale_x1, CAST(trunc(y1 * 0.375) AS INTEGER) AS scale_y1, CAST(trunc(x2 * 0.375) AS INTEGER) AS scale_x2, CAST(trunc(y2 * 0.375) AS INTEGER) AS scale_y2,
 CAST((x1 * 700 + 1199) // 1200 AS INTEGER) AS up_x1, CAST((y2 * 900 + 1659) // 1660 AS INTEGER) AS up_y2,
 greatest(x1 - p, 0) AS text_x1, greatest(y1 - p, 0) AS text_y1, least(x2 + p, 499) AS text_x2, least(y2 + p, 619) AS text_y2,
 x2 * 2 AS orig_x2, greatest(x1, y1, x2, y2) AS top, y1 AS back_y1
FROM (SELECT *, least(greatest(x1 - 80, 0), 300) AS cx1, least(greatest(x2 - 80, 0), 300) AS cx2, least(greatest(y1 - 90, 0), 350) AS cy1, least(greatest(y2 - 90, 0), 350) AS cy2,
  CAST(round_even((greatest(x2 - x1, y2 - y1) * 0.25 + least(x2 - x1, y2 - y1) * 0.75) / 3.0, 0) AS INTEGER) AS p FROM blocks)""", "blocks")


def _pairs(spark, sf):
    b = boxed(blocks(spark, sf)).select("page_id", "idx", "r")
    other = b.select("page_id", F.col("idx").alias("idx2"), F.col("r").alias("s"))
    return b.join(other, "page_id").filter("idx < idx2")


def q_geometry_pairs(spark, sf):
    a, b = F.col("r"), F.col("s")
    return _pairs(spark, sf).select(
        "page_id", "idx", "idx2", *(g.merge(a, b)[n].alias(f"m_{n}") for n in ("x1", "y1", "x2", "y2")), g.overlaps(a, b, 20.0).alias("overlaps"), g.overlaps_center(a, b).alias("overlaps_center"),
        g.contains_rect(a, b).alias("contains"), g.intersects(a, b).alias("intersects"), g.intersection_area(a, b).alias("shared"), F.round(g.iou(a, b).cast("double"), 4).alias("iou"), g.subtract(a, b)["x1"].alias("d_x1"),
    )


_PAIRS = """, pairs AS (SELECT a.page_id, a.idx, b.idx AS idx2, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
  CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS BIGINT) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  CAST(a.x2 - a.x1 AS BIGINT) * (a.y2 - a.y1) AS aa, CAST(b.x2 - b.x1 AS BIGINT) * (b.y2 - b.y1) AS ba
  FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.idx < b.idx)"""
_CENTER = "(((ax1 + ax2) // 2 BETWEEN bx1 AND bx2 AND (ay1 + ay2) // 2 BETWEEN by1 AND by2) OR ((bx1 + bx2) // 2 BETWEEN ax1 AND ax2 AND (by1 + by2) // 2 BETWEEN ay1 AND ay2))"
SQL_PAIRS = with_views(_PAIRS + f"""
SELECT page_id, idx, idx2, least(ax1, bx1) AS m_x1, least(ay1, by1) AS m_y1, greatest(ax2, bx2) AS m_x2, greatest(ay2, by2) AS m_y2,
 CAST(inter AS DOUBLE) / greatest(least(aa, ba), 1) > 0.2 AS overlaps, {_CENTER} AS overlaps_center,
 ax1 <= bx1 AND ay1 <= by1 AND ax2 >= bx2 AND ay2 >= by2 AS contains, ax1 < bx2 AND bx1 < ax2 AND ay1 < by2 AND by1 < ay2 AS intersects,
 CASE WHEN least(ay2, by2) < greatest(ay1, by1) OR least(ax2, bx2) < greatest(ax1, bx1) THEN -1 ELSE inter END AS shared,
 round(CAST(CAST(inter AS FLOAT) / CAST(aa + ba - inter AS FLOAT) AS DOUBLE), 4) AS iou, ax1 - bx1 AS d_x1 FROM pairs""", "blocks")


def q_resize_policy(spark, sf):
    w, h = F.col("x2") * 7, F.col("y2") * 9
    s, t = g.new_size_and_scale(w, h, 1000, 1500), g.new_size_and_scale(w, h, 1500, 1500)
    box = g.letterbox(w, h)
    return blocks(spark, sf).select("page_id", "idx", s["w"].alias("new_w"), s["h"].alias("new_h"), F.round(s["scale"], 6).alias("scale"), t["h"].alias("fixed_h"), box["new_w"].alias("box_w"), box["pad_bottom"].alias("box_pad"))


SQL_RESIZE = with_views("""
SELECT page_id, idx, CAST(CASE WHEN h <= 1500 THEN w WHEN ceil(h / 1500.0) <= h / 1000.0 THEN floor(w / ceil(h / 1500.0) + 0.5) ELSE floor(w * (1500.0 / h) + 0.5) END AS INTEGER) AS new_w,
 CAST(CASE WHEN h <= 1500 THEN h WHEN ceil(h / 1500.0) <= h / 1000.0 THEN floor(h / ceil(h / 1500.0) + 0.5) ELSE 1500 END AS INTEGER) AS new_h,
 round(CASE WHEN h <= 1500 THEN 1.0 WHEN ceil(h / 1500.0) <= h / 1000.0 THEN 1.0 / ceil(h / 1500.0) ELSE CAST(1500 AS DOUBLE) / h END, 6) AS scale,
 CAST(least(h, 1500) AS INTEGER) AS fixed_h,
 CAST(floor(w * least(CAST(1024 AS DOUBLE) / w, CAST(1024 AS DOUBLE) / h) + 0.5) AS INTEGER) AS box_w, CAST(1024 - floor(h * least(CAST(1024 AS DOUBLE) / w, CAST(1024 AS DOUBLE) / h) + 0.5) AS INTEGER) AS box_pad
FROM (SELECT page_id, idx, x2 * 7 AS w, y2 * 9 AS h FROM blocks)""", "blocks")


def q_box_filter(spark, sf):
    df = boxed(blocks(spark, sf))
    r, lang = F.col("r"), F.col("lang")
    return df.filter(keep_box(r, lang)).select("page_id", "idx", "lang", g.area(r).alias("area"), keep_box(r, lang, True, True).alias("strict_keep"), ocr_candidate(r, lang, ["japanese"]).alias("ocr"), assign_language(lang, "english").alias("pinned"))


SQL_FILTER = with_views("""
SELECT page_id, idx, lang, area, lang IS NOT NULL AS strict_keep, area < 30000 AND coalesce(lang = 'japanese', false) AND least(x2, 1200) > x1 AND least(y2, 1660) > y1 AS ocr, 'english' AS pinned
FROM (SELECT *, CAST(x2 - x1 AS BIGINT) * (y2 - y1) AS area FROM blocks) WHERE NOT (area < 400 OR (lang IS NULL AND area < 40000))""", "blocks")


def q_page_language(spark, sf):
    return page_language(blocks(spark, sf)).select("page_id", "page_lang", is_right_to_left("auto", F.col("page_lang")).alias("right_to_left"))


_LANGS = """, langs AS (SELECT page_id, lang, count(*) AS n, min(idx) AS first FROM {0} WHERE lang IS NOT NULL GROUP BY page_id, lang),
best AS (SELECT page_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS r FROM langs) WHERE r = 1)"""
SQL_LANGUAGE = with_views(_LANGS.format("blocks") + " SELECT p.page_id, b.lang AS page_lang, coalesce(b.lang = 'japanese', false) AS right_to_left FROM (SELECT DISTINCT page_id FROM blocks) p LEFT JOIN best b ON p.page_id = b.page_id", "blocks")


def q_page_language_applied(spark, sf):
    return apply_page_language(blocks(spark, sf)).select("page_id", "idx", "lang")


SQL_APPLIED = with_views(_LANGS.format("blocks") + " SELECT k.page_id, k.idx, b.lang FROM blocks k LEFT JOIN best b ON k.page_id = b.page_id", "blocks")


def q_reading_order(spark, sf):
    df = blocks(spark, sf).join(page_language(blocks(spark, sf)), "page_id")
    return reading_order(df, is_right_to_left("auto", F.col("page_lang"))).select("page_id", "idx", "place")


SQL_ORDER = with_views(_LANGS.format("blocks") + """ SELECT k.page_id, idx, CAST(row_number() OVER (PARTITION BY k.page_id ORDER BY (CASE WHEN b.lang = 'japanese' THEN -0.4 ELSE 0.4 END)::DOUBLE * x1 + 1.0::DOUBLE * y1, idx) AS INTEGER) AS place
 FROM blocks k LEFT JOIN best b ON k.page_id = b.page_id""", "blocks")


def q_detector_candidates(spark, sf):
    c = filter_candidates(as_detector_rows(raw_rows(spark, sf)))
    return c.select("page_id", "row_idx", F.round(F.col("bx1").cast("double"), 3).alias("bx1"), F.round(F.col("by2").cast("double"), 3).alias("by2"), F.round(F.col("score").cast("double"), 5).alias("score"), "cls", class_language(F.col("cls")).alias("lang"))


_CAND = """, cand AS (SELECT page_id, row_idx, cx, cy, w, h, CASE WHEN c1 >= c0 THEN 1 ELSE 0 END AS cls, CAST(obj * greatest(c0, c1) AS FLOAT) AS score, cx - w / 2 AS bx1, cy - h / 2 AS by1, cx + w / 2 AS bx2, cy + h / 2 AS by2
 FROM (SELECT page_id, row_idx, CAST(q0 % 200 + 30 AS DOUBLE) AS cx, CAST(q1 % 200 + 30 AS DOUBLE) AS cy, CAST(q2 % 64 + 20 AS DOUBLE) AS w, CAST(q3 % 64 + 20 AS DOUBLE) AS h,
  CAST(q4 % 1024 / 1024.0 AS FLOAT) AS obj, CAST(q5 % 1024 / 1024.0 AS FLOAT) AS c0, CAST(q6 % 1024 / 1024.0 AS FLOAT) AS c1 FROM raw_rows)
 WHERE obj > 0.4::FLOAT AND CAST(obj * greatest(c0, c1) AS FLOAT) > 0.4::FLOAT)"""
SQL_CAND = with_views(_CAND + " SELECT page_id, row_idx, round(bx1, 3) AS bx1, round(by2, 3) AS by2, round(CAST(score AS DOUBLE), 5) AS score, CAST(cls AS INTEGER) AS cls, CASE cls WHEN 0 THEN 'english' WHEN 1 THEN 'japanese' END AS lang FROM cand", "raw_rows")


def q_nms(spark, sf):
    kept = non_maximum_suppression(filter_candidates(as_detector_rows(raw_rows(spark, sf))))
    return rescale(kept, 1.5, 300, 320).select("page_id", "row_idx", "x1", "y1", "x2", "y2", "cls", F.round(F.col("score").cast("double"), 3).alias("score"))


SQL_NMS = with_views(_CAND + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, row_idx) AS n FROM cand),
fold AS (SELECT page_id, 1 AS n, [{'i': row_idx, 'a': bx1, 'b': by1, 'c': bx2, 'd': by2}] AS kept FROM ranked WHERE n = 1
 UNION ALL SELECT f.page_id, r.n, CASE WHEN len(list_filter(f.kept, lambda k: greatest(least(k.c, r.bx2) - greatest(k.a, r.bx1), 0) * greatest(least(k.d, r.by2) - greatest(k.b, r.by1), 0)
   > 0.35 * ((k.c - k.a) * (k.d - k.b) + (r.bx2 - r.bx1) * (r.by2 - r.by1) - greatest(least(k.c, r.bx2) - greatest(k.a, r.bx1), 0) * greatest(least(k.d, r.by2) - greatest(k.b, r.by1), 0)))) > 0
   THEN f.kept ELSE list_append(f.kept, {'i': r.row_idx, 'a': r.bx1, 'b': r.by1, 'c': r.bx2, 'd': r.by2}) END FROM fold f JOIN ranked r ON r.page_id = f.page_id AND r.n = f.n + 1),
done AS (SELECT page_id, unnest(kept).i AS row_idx FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS z FROM fold) WHERE z = 1)
SELECT c.page_id, c.row_idx, CAST(greatest(least(trunc(bx1 * 1.5), 300), 0) AS INTEGER) AS x1, CAST(greatest(least(trunc(by1 * 1.5), 320), 0) AS INTEGER) AS y1,
 CAST(greatest(least(trunc(bx2 * 1.5), 300), 0) AS INTEGER) AS x2, CAST(greatest(least(trunc(by2 * 1.5), 320), 0) AS INTEGER) AS y2, CAST(cls AS INTEGER) AS cls, round(CAST(score AS DOUBLE), 3) AS score
FROM cand c JOIN done d ON c.page_id = d.page_id AND c.row_idx = d.row_idx""", "raw_rows")


def _fold_sql(test: str) -> str:
    return with_views(f""", fold AS (SELECT page_id, 0 AS n, [{{'idx': idx, 'lang': lang, 'ax1': x1, 'ay1': y1, 'ax2': x2, 'ay2': y2, 'gx1': x1, 'gy1': y1, 'gx2': x2, 'gy2': y2}}] AS acc FROM blocks WHERE idx = 0
 UNION ALL SELECT page_id, n, CASE WHEN hit IS NULL THEN list_append(acc, {{'idx': idx, 'lang': lang, 'ax1': bx1, 'ay1': by1, 'ax2': bx2, 'ay2': by2, 'gx1': bx1, 'gy1': by1, 'gx2': bx2, 'gy2': by2}})
  ELSE list_transform(acc, lambda a: CASE WHEN a.idx = hit THEN {{'idx': a.idx, 'lang': coalesce(a.lang, lang), 'ax1': a.ax1, 'ay1': a.ay1, 'ax2': a.ax2, 'ay2': a.ay2,
   'gx1': least(a.gx1, bx1), 'gy1': least(a.gy1, by1), 'gx2': greatest(a.gx2, bx2), 'gy2': greatest(a.gy2, by2)}} ELSE a END) END AS acc
  FROM (SELECT f.page_id, b.idx AS n, b.idx, b.lang, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, f.acc, list_filter(f.acc, lambda a: {test})[1].idx AS hit
   FROM fold f JOIN blocks b ON b.page_id = f.page_id AND b.idx = f.n + 1)),
last AS (SELECT page_id, acc FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS z FROM fold) WHERE z = 1)
SELECT page_id, u.idx, u.lang, u.gx1 AS x1, u.gy1 AS y1, u.gx2 AS x2, u.gy2 AS y2 FROM (SELECT page_id, unnest(acc) AS u FROM last)""", "blocks")


SQL_OVERLAPS = _fold_sql("CAST(greatest(0, least(a.ax2, b.x2) - greatest(a.ax1, b.x1)) AS DOUBLE) * greatest(0, least(a.ay2, b.y2) - greatest(a.ay1, b.y1)) / greatest(1, least((a.ax2 - a.ax1) * (a.ay2 - a.ay1), (b.x2 - b.x1) * (b.y2 - b.y1))) > 0.2")
SQL_TOTAL = _fold_sql("(((a.ax1 + a.ax2) // 2 BETWEEN b.x1 AND b.x2 AND (a.ay1 + a.ay2) // 2 BETWEEN b.y1 AND b.y2) OR ((b.x1 + b.x2) // 2 BETWEEN a.ax1 AND a.ax2 AND (b.y1 + b.y2) // 2 BETWEEN a.ay1 AND a.ay2))")


def q_preprocess(spark, sf):
    return preprocess(blocks(spark, sf)).select("page_id", "idx", "place", "lang", "page_lang", "x1", "y1", "x2", "y2", *(F.col(f"e.{n}").alias(f"e_{n}") for n in ("x1", "y1", "x2", "y2")), F.col("ref.x1").alias("ref_x1"), F.col("ref.y2").alias("ref_y2"))


def _preprocess_sql() -> str:
    keep = "kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) AS k FROM blocks WHERE NOT ((x2 - x1) * (y2 - y1) < 400 OR (lang IS NULL AND (x2 - x1) * (y2 - y1) < 40000)))"
    fold = SQL_TOTAL.split("SELECT page_id, u.idx")[0].split(", fold AS", 1)[1]
    fold = fold.replace("FROM blocks WHERE idx = 0", "FROM kept WHERE k = 0").replace("JOIN blocks b ON b.page_id = f.page_id AND b.idx = f.n + 1", "JOIN kept b ON b.page_id = f.page_id AND b.k = f.n + 1").replace("b.idx AS n", "b.k AS n")
    return with_views(f""", {keep}{_LANGS.format("kept")}, fold AS{fold},
boxes AS (SELECT page_id, u.idx, u.lang, u.gx1, u.gy1, u.gx2, u.gy2 FROM (SELECT page_id, unnest(acc) AS u FROM last)),
tight AS (SELECT t.page_id, idx, t.lang, b.lang AS page_lang, greatest(gx1 - 2, 0) AS x1, greatest(gy1 - 2, 0) AS y1, least(least(gx2 + 2, 1200) + 3, 1200) AS x2, least(gy2 + 2, 1660) AS y2 FROM boxes t LEFT JOIN best b ON t.page_id = b.page_id)
SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (CASE WHEN page_lang = 'japanese' THEN -0.4 ELSE 0.4 END)::DOUBLE * x1 + 1.0::DOUBLE * y1, idx) AS INTEGER) AS place, lang, page_lang, x1, y1, x2, y2,
 greatest(x1 - 5, 0) AS e_x1, greatest(y1 - 5, 0) AS e_y1, least(least(x2 + 5, 1200) + 5, 1200) AS e_x2, least(y2 + 5, 1660) AS e_y2, greatest(greatest(x1 - 5, 0) - 20, 0) AS ref_x1, least(least(y2 + 5, 1660) + 20, 1660) AS ref_y2 FROM tight""", "blocks")


QUERIES = {
    "geometry_scalars": q_geometry_scalars, "geometry_pairs": q_geometry_pairs, "resize_policy": q_resize_policy, "box_filter": q_box_filter,
    "page_language": q_page_language, "page_language_applied": q_page_language_applied, "reading_order": q_reading_order, "detector_candidates": q_detector_candidates, "nms": q_nms,
    "resolve_overlaps": lambda s, d: resolve_overlaps(blocks(s, d)), "resolve_total_overlaps": lambda s, d: resolve_total_overlaps(blocks(s, d)), "preprocess": q_preprocess,
}
ORACLES = {
    "geometry_scalars": SQL_SCALARS, "geometry_pairs": SQL_PAIRS, "resize_policy": SQL_RESIZE, "box_filter": SQL_FILTER, "page_language": SQL_LANGUAGE, "page_language_applied": SQL_APPLIED, "reading_order": SQL_ORDER,
    "detector_candidates": SQL_CAND, "nms": SQL_NMS, "resolve_overlaps": SQL_OVERLAPS, "resolve_total_overlaps": SQL_TOTAL, "preprocess": _preprocess_sql(),
}
