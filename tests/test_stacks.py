"""Stacks of pages against the one-page functions and slow definitions; plans that shuffle no pixel."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import fitting, raster, registry, stacks
from folio.operators import kernels as k

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plan(spark, name):
    return registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def no_pixel_shuffled(text):
    assert "MapInArrow" in text and "Exchange" not in text[: text.index("MapInArrow")]
    return True


@needs_data
def test_best_channel_shuffles_page_numbers_only(spark):
    assert no_pixel_shuffled(text := plan(spark, "best_channel")) and text.count("Exchange") == 1 and "Join" not in text


def test_otsu_of_a_stack():
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 256, (5, 6, 7)).astype(np.uint8)
    stack[1], stack[2] = 9, np.where(stack[2] > 99, 200, 40)
    for page, got in zip(stack, stacks.otsu_thresholds(stack).tolist(), strict=True):
        v = page.ravel().astype(float)
        spread = {t: round(float((v <= t).mean() * (v > t).mean() * (v[v <= t].mean() - v[v > t].mean()) ** 2), 9) if (v > t).any() else 0.0 for t in sorted(set(v.tolist()))}
        assert got == min(t for t in spread if spread[t] == max(spread.values()))


@needs_data
def test_candidate_greys_shuffles_page_numbers_only(spark):
    assert no_pixel_shuffled(text := plan(spark, "candidate_greys")) and text.count("Exchange") == 1 and "Join" not in text


@needs_data
def test_mask_sets_shuffles_page_numbers_only(spark):
    assert no_pixel_shuffled(text := plan(spark, "mask_sets")) and text.count("Exchange") == 1 and "Join" not in text


def test_stacks_of_different_sizes(spark):
    rows = [(1, 2, 3, bytes([0, 9, 0, 0, 0, 9])), (2, 1, 1, bytes([0])), (3, 4, 1, bytes([9, 9, 0, 9])), (4, 2, 3, bytes(6)), (5, 0, 0, b"")]
    pages = spark.createDataFrame(rows, "page_id long, w int, h int, data binary")
    got = stacks.over_stacks(pages, "page_id long, x int, y int", lambda stack: stacks.places(stack > 5), at_once=6)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (1, 1, 2), (3, 0, 0), (3, 1, 0), (3, 3, 0)]
    assert sorted(map(tuple, stacks.over_stacks(pages, "page_id long, n long", lambda stack: {"n": (stack > 5).sum(axis=(1, 2))}).collect())) == [(1, 2), (2, 0), (3, 3), (4, 0), (5, 0)]


@needs_data
def test_refine_simple_shuffles_no_pixel(spark):
    assert no_pixel_shuffled(plan(spark, "refine_simple"))


def test_refine_simple_of_small_pages(spark):
    page = bytes([0, 0, 200, 0, 0, 0])
    pages = spark.createDataFrame([(1, 6, 1, page, [(0, 2, 0, 3, 1), (1, 5, 0, 9, 1)]), (2, 6, 1, page, [(0, 4, 0, 5, 1)]), (3, 6, 1, page, None)], "page_id long, w int, h int, data binary, boxes array<struct<idx:int,x1:int,y1:int,x2:int,y2:int>>")
    assert sorted(map(tuple, raster.refine_simple(pages, 1).collect())) == [(1, x, 0) for x in (1, 2, 3, 4, 5)]


@needs_data
def test_composite_layers_is_dealt_out_and_compiled(spark):
    text = plan(spark, "composite_layers")
    assert "RoundRobinPartitioning" in text and "lambda" not in text.lower()


def test_layers_of_pixels(spark):
    df = spark.createDataFrame([(10, 128, 200, 0), (10, 255, 200, 128), (10, 0, 7, 255), (10, 0, 7, 0)], "v1 int, a1 int, v2 int, a2 int")
    got = raster.composite(df, [(F.col("v1"), F.col("a1")), (F.col("v2"), F.col("a2"))]).select("c_v", "c_alpha").collect()
    assert list(map(tuple, got)) == [(10, 128), (105, 255), (7, 255), (0, 0)]


@needs_data
def test_grey_morphology_shuffles_page_numbers_only(spark):
    assert no_pixel_shuffled(text := plan(spark, "grey_morphology")) and text.count("Exchange") == 1 and "Join" not in text


def test_extremes_of_a_stack():
    stack = np.random.default_rng(2).integers(0, 256, (3, 4, 5)).astype(np.uint8)
    for offsets in (raster.diamond(3), raster.square(3), raster.square(5), raster.PLUS):
        for how, pick in (("max", max), ("min", min)):
            want = [[[pick(int(p[y + dy, x + dx]) for dx, dy in offsets if 0 <= x + dx < 5 and 0 <= y + dy < 4) for x in range(5)] for y in range(4)] for p in stack]
            assert stacks.extreme(stack, offsets, how).tolist() == want


def fitted(colour, seed=3, pages=120):
    """Every box's fit, one at a time and all at once."""
    rng = np.random.default_rng(seed)
    stack = (rng.integers(0, 256, (pages, 13, 17)) // rng.integers(1, 60, (pages, 1, 1))).astype(np.uint8)
    stack[rng.random(stack.shape) < 0.1] = 250
    image = np.stack([stack, stack * np.uint8(3), stack * np.uint8(7)], axis=-1) if colour else stack[..., None]
    cut = rng.random(stack.shape) < rng.choice([0.02, 0.3, 0.9], (pages, 1, 1))
    at = np.repeat(np.arange(pages), 5)
    x1, y1 = rng.integers(0, 20, len(at)), rng.integers(0, 14, len(at))
    rects = np.stack([x1, y1, x1 + rng.integers(0, 9, len(at)), y1 + rng.integers(1, 8, len(at))], axis=1)
    inside = stacks.under_boxes(stack.shape, at, *rects.T)
    many = fitting.fit_regions(image, cut, inside, at, rects, 3, 0.7, 30.0)
    single = []
    for page, rect in zip(at, rects.tolist(), strict=True):
        around = (max(rect[0] - 3, 0), max(rect[1] - 3, 0), min(rect[2] + 3, 17), min(rect[3] + 3, 13))
        single.append(k.fit_region(image[page] if colour else stack[page], cut[page], inside[page], tuple(rect), around, 0.7, 30.0))
    return stack, single, many


def same_fits(colour):
    stack, single, many = fitted(colour)
    assert many.region.tolist() == [i for i, f in enumerate(single) if f is not None]
    for i, f in enumerate(f for f in single if f is not None):
        assert many.std[i] == pytest.approx(f.std, abs=1e-9) and (many.candidate[i], many.rescued[i], many.fits[i]) == (f.candidate, f.rescued, f.mask is not None)
        assert tuple(many.colour[:, i]) == f.colour and many.thickness[i] == (-1 if f.thickness is None else f.thickness) and (f.mask is None or many.covered[i] == f.mask.sum())
    return stack, single, many


def test_many_regions_are_fitted_as_one():
    _, single, many = same_fits(False)
    assert 20 < many.fits.sum() < len(many.fits) and many.rescued.any() and None in single


def test_many_colour_regions_are_fitted_as_one():
    from folio.operators import dense

    stack, single, many = same_fits(True)
    canvas = dense._combined(stack, many)
    for page in range(len(stack)):
        assert (canvas[page] == k.combined_mask([f for f in single[page * 5 : page * 5 + 5] if f is not None], 17, 13)).all()


def test_many_windows_are_refined_as_one():
    from folio.operators import refining

    rng = np.random.default_rng(5)
    stack = (rng.integers(0, 256, (30, 22, 26)) // rng.integers(1, 40, (30, 1, 1))).astype(np.uint8)
    image = np.stack([stack, stack * np.uint8(3), stack * np.uint8(7)], axis=-1)
    prediction = (rng.integers(0, 256, stack.shape) * (np.kron(rng.random((30, 11, 13)), np.ones((1, 2, 2))) < 0.6)).astype(np.uint8)
    prediction[:4], prediction[4:6] = 0, 255
    prediction[6:20] |= np.where(np.kron(rng.random((14, 4, 5)), np.ones((1, 6, 6)))[:, :22, :26] < 0.5, 255, 0).astype(np.uint8)
    at = np.repeat(np.arange(30), 4)
    x1, y1 = rng.integers(0, 20, len(at)), rng.integers(0, 16, len(at))
    rects = np.stack([x1, y1, x1 + rng.integers(2, 27, len(at)), y1 + rng.integers(2, 23, len(at))], axis=1)
    got = refining.refine(image, prediction, at, rects)
    assert 0 < (got > 0).sum() < got.size
    for page in range(30):
        assert (got[page] == k.refine(image[page], prediction[page], [tuple(r) for r in rects[at == page].tolist()])).all()
    with pytest.raises(ValueError, match="empty window"):
        refining.refine(image, prediction, at[:1], np.array([[25, 21, 26, 22]]))


def test_geometric_medians_keep_the_order_of_sums():
    rng = np.random.default_rng(7)
    count = rng.integers(1, 60, 300)
    colours = rng.integers(0, 256, (int(count.sum()), 3)) // np.repeat(rng.integers(1, 90, 300), count)[:, None]
    want = [k.geometric_median(c.astype(float)).tolist() for c in np.split(colours, np.cumsum(count)[:-1])]
    assert fitting.geometric_medians(colours, count).tolist() == want


@needs_data
def test_noise_layer_takes_every_box(spark):
    boxed = raster.boxes_of(raster.small_boxes(spark, DATA)).collect()
    got = {r["page_id"]: (r["covered"], r["alpha_sum"]) for r in registry.queries()["noise_layer"](spark, DATA).collect()}
    y, x = np.indices((16, 24))
    some = [r for r in boxed if r["page_id"] in got and len(r["boxes"]) > 2][:12]
    for r in some:
        image = stacks.FORMULAS["grey"](x, y, r["page_id"]).astype(np.uint8)
        mask = np.zeros((16, 24, 4), np.uint8)
        mask[image < 30] = 255
        want = k.noise_layer(np.repeat(image[:, :, None], 3, axis=2), mask, [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in r["boxes"]])[:, :, 3]
        assert got[r["page_id"]] == ((want > 0).sum(), want.sum())
    assert some
