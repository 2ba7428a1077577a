"""Hand-derived vectors for box operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.operators.layout import merge_by_anchor, page_language, reading_order, resolve_overlaps, resolve_total_overlaps
from folio.operators.masks import growth, merge_rects, resolve_fallback, select_candidate

BOXES = "page_id long, idx int, x1 int, y1 int, x2 int, y2 int, lang string"


def boxes(spark, *rects, langs=None):
    rows = [(1, i, *r, (langs or [None] * len(rects))[i]) for i, r in enumerate(rects)]
    return spark.createDataFrame(rows, BOXES)


def rects(df):
    return sorted((r.x1, r.y1, r.x2, r.y2) for r in df.collect())


@pytest.mark.parametrize(("second", "want"), [((0, 80, 100, 180), [(0, 0, 100, 100), (0, 80, 100, 180)]), ((31, 71, 131, 171), [(0, 0, 131, 171)])])
def test_overlap_is_strict(spark, second, want):
    assert rects(resolve_overlaps(boxes(spark, (0, 0, 100, 100), second), 20.0)) == want


@pytest.mark.parametrize(("rows", "percent", "want"), [
    ([(0, 0, 100, 100), (90, 0, 190, 100), (180, 0, 280, 100)], 5.0, [(0, 0, 190, 100), (180, 0, 280, 100)]),
    ([(0, 0, 100, 100), (50, 0, 150, 100), (120, 0, 220, 100)], 20.0, [(0, 0, 150, 100), (120, 0, 220, 100)]),
    ([(10, 10, 10, 10), (0, 0, 100, 100)], 20.0, [(0, 0, 100, 100), (10, 10, 10, 10)]),
])
def test_merging_sees_boxes_as_they_came(spark, rows, percent, want):
    assert rects(resolve_overlaps(boxes(spark, *rows), percent)) == want


def test_total_overlap_keeps_the_first_language(spark):
    got = resolve_total_overlaps(boxes(spark, (0, 0, 100, 100), (10, 10, 90, 90), (20, 20, 80, 80), langs=[None, "english", "japanese"])).collect()
    assert [(r.idx, r.lang, r.x2) for r in got] == [(0, "english", 100)]


def test_merge_by_anchor_takes_the_first_anchor(spark):
    df = boxes(spark, (0, 0, 10, 10), (100, 0, 110, 10), (0, 0, 110, 10))
    assert rects(merge_by_anchor(df, g.intersects)) == [(0, 0, 110, 10), (100, 0, 110, 10)]


def test_transitive_merge_in_any_order(spark):
    base = [(0, 0, 10, 10), (9, 0, 20, 10), (19, 5, 30, 30), (40, 40, 50, 50)]
    for order in itertools.permutations(base):
        assert rects(merge_rects(boxes(spark, *order).drop("lang"))) == [(0, 0, 30, 30), (40, 40, 50, 50)]
    assert rects(merge_rects(boxes(spark, (0, 0, 10, 10), (10, 0, 20, 10)))) == [(0, 0, 10, 10), (10, 0, 20, 10)]


@pytest.mark.parametrize(("stds", "want"), [([10.0, 9.5, 8.0, 8.0], (2, 2)), ([0.0, 0.0], (1, 0)), ([0.0, 0.001, 5.0], (0, 0)), ([], (-1, -1))])
def test_candidate_selection(spark, stds, want):
    df = spark.createDataFrame([(stds,)], "s array<double>")
    c = df.select(select_candidate(F.col("s")).alias("c")).first().c
    assert (c.chosen, c.lowest) == want


def test_fallback_and_growth(spark):
    df = spark.createDataFrame([([20.0, 19.0, 14.0],)], "s array<double>")
    c = select_candidate(F.col("s"), improvement=0.5)
    assert df.select(resolve_fallback(c, F.col("s")), resolve_fallback(c, F.col("s"), enabled=False)).first()[:] == (2, 0)
    stds = spark.createDataFrame([(0.0,), (34.9,), (1e12,), (float("nan"),)], "s double")
    assert [r[0] for r in stds.select(growth(F.col("s"))).collect()] == [7, 13, 20, 7]


def test_page_language_ties_and_none(spark):
    df = boxes(spark, *[(0, 0, 1, 1)] * 4, langs=["english", "japanese", "japanese", "english"])
    assert page_language(df).first().page_lang == "english"
    assert page_language(boxes(spark, (0, 0, 1, 1))).first().page_lang is None


def test_reading_order_mirrors_for_right_to_left(spark):
    df = boxes(spark, (0, 0, 5, 5), (100, 0, 105, 5), (0, 0, 9, 9))
    order = lambda rtl: [r.idx for r in reading_order(df, F.lit(rtl)).orderBy("place").collect()]
    assert order(False) == [0, 2, 1] and order(True) == [1, 0, 2]


def test_scaling_truncates_and_saturates(spark):
    df = spark.createDataFrame([(-3, 7)], "a int, b int").withColumn("r", g.rect(F.col("a"), 0, F.col("b"), 10))
    r = df.select(g.scale(F.col("r"), 0.5).alias("h"), g.scale(F.col("r"), 1e12).alias("s"), g.center(F.col("r")).alias("c"), g.to_crop(F.col("r"), 5, 0).alias("e")).first()
    assert (r.h.x1, r.h.x2) == (-1, 3) and (r.s.x1, r.s.x2) == (-(2**31), 2**31 - 1) and r.c.x == 2 and r.e is None
    assert df.select(g.scale_to_original(F.col("r"), F.lit(0.0))["x2"]).first()[0] == 7
