"""Numeric kernels, files, checkpoints, plans and the stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators import kernels as k
from folio.operators.dense import over_pages, set_rows, synthetic
from folio.operators.raster import kernel, kernel_rows, ssim
from folio.plans import profile
from folio.plans.batch import isolated, run_stages
from folio.sources.images import image_files, png_dpi, png_header, read_checkpoint, write_checkpoint
from folio.streaming.outcomes import outcome_stream, windowed_summary


def test_filters_leave_constants_and_ranges():
    flat = np.full((9, 12), 77, np.uint8)
    for work in (lambda i: k.blur(i, 1.5), k.non_local_means, lambda i: k.resize_bilinear(i, 5, 4), lambda i: k.resize_triangle(i, 5, 4)):
        assert (work(flat) == 77).all()
    step = np.where(np.arange(12)[None, :] < 6, 0, 255).repeat(9, axis=0).astype(np.uint8)
    soft = k.blur(step, 1.0)
    assert (np.diff(soft.astype(int), axis=1) >= 0).all() and soft[0, 0] == 0 and soft[0, -1] == 255
    assert abs(float(k.gaussian_taps(2.0).sum()) - 1) < 1e-12
    assert (k.resize_triangle(step, 12, 9) == step).all()


def test_geometric_median_and_colours():
    pts = np.array([[0, 0, 0], [0, 0, 0], [0, 0, 0], [90, 90, 90]], float)
    std, centre = k.colour_statistics(pts)
    assert centre.tolist() == [0, 0, 0] and std > 0
    square = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [10, 10, 0]], float)
    assert k.geometric_median(square).tolist() == [5, 5, 0]
    assert k.colour_statistics(pts[:1])[0] == 0.0
    assert k.top_colours(np.array([5, 9, 9, 1]), np.array([0.0, 50.0, 55.0, 200.0])) == [50.0, 0.0, 200.0]


def test_elements_are_radii():
    assert [len(kernel(t)) for t in (0, 1, 2, 4, 5, 7)] == [1, 5, 21, 57, 89, 169]
    assert kernel_rows(2) == [(-2, 1), (-1, 2), (0, 2), (1, 2), (2, 1)] and kernel_rows(4) == [(-4, 0), (-3, 3), (-2, 3), (-1, 4), (0, 4), (1, 4), (2, 3), (3, 3), (4, 0)]
    mask = np.random.default_rng(1).random((9, 13)) < 0.05
    for t in (0, 1, 3, 7, 20):
        want = np.zeros_like(mask)
        for y, x in zip(*np.nonzero(mask), strict=True):
            for dx, dy in kernel(t):
                if 0 <= y + dy < 9 and 0 <= x + dx < 13:
                    want[y + dy, x + dx] = True
        assert (k.grow(mask, kernel_rows(t)) == want).all()


def test_blur_equals_the_definition():
    image = np.random.default_rng(2).integers(0, 256, (6, 8)).astype(np.uint8)
    taps = np.exp(-(np.arange(-6, 7) ** 2) / 8.0)
    taps /= taps.sum()
    at = lambda i, n: min(max(i, 0), n - 1)
    rows = np.array([[sum(w * image[y, at(x + j - 6, 8)] for j, w in enumerate(taps)) for x in range(8)] for y in range(6)], np.float32)
    want = np.array([[np.floor(sum(w * float(rows[at(y + j - 6, 6), x]) for j, w in enumerate(taps)) + 0.5) for x in range(8)] for y in range(6)])
    assert (k.blur(image, 2) == want).all()


def test_resampling_of_small_rasters():
    two = np.array([[0, 100], [200, 60]], np.uint8)
    assert k.resize_bilinear(two, 4, 1).tolist() == [[100, 95, 85, 80]]
    assert k.resize_triangle(np.array([[0, 30, 60, 90]], np.uint8), 2, 1).tolist() == [[21, 69]]
    assert k.resized_nearest(np.arange(6).reshape(2, 3), 6, 1).tolist() == [[0, 0, 1, 1, 2, 2]]


def test_non_local_means_equals_the_definition():
    image = np.random.default_rng(0).integers(100, 140, (6, 8)).astype(np.uint8)
    mirror = lambda i, n: (lambda m: m if m < n else 2 * (n - 1) - m)(i % (2 * (n - 1)))
    at = lambda y, x: float(image[mirror(y, 6), mirror(x, 8)])
    want = np.zeros((6, 8))
    for y in range(6):
        for x in range(8):
            total = mass = 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    gap = sum((at(y + a, x + b) - at(y + dy + a, x + dx + b)) ** 2 for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
                    weight = np.exp(-gap / 100)
                    total, mass = total + weight * at(y + dy, x + dx), mass + weight
            want[y, x] = np.floor(total / mass + 0.5)
    assert (k.non_local_means(image, 10.0, 3, 5) == want).all()
    assert (k.non_local_means(np.repeat(image[:, :, None], 3, axis=2), 10.0, 3, 5) == want[:, :, None]).all()
    assert (k.non_local_means(np.full((1, 1), 9, np.uint8)) == 9).all()


def test_components_are_eight_connected_in_row_order():
    c = k.components(np.array([[0, 0, 1], [1, 0, 1], [0, 1, 0], [1, 0, 0]], bool))
    assert c.areas.tolist() == [7, 5] and c.boxes[1].tolist() == [0, 0, 3, 4]
    assert k.components(np.array([[1, 0, 0, 1]], bool)).labels.tolist() == [[1, 0, 0, 2]]
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = rng.random((7, 11)) < 0.4
        c, seen = k.components(mask), {}
        for y, x in zip(*np.nonzero(mask), strict=True):
            seen.setdefault(c.labels[y, x], []).append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if 0 <= y + dy < 7 and 0 <= x + dx < 11 and mask[y + dy, x + dx]:
                        assert c.labels[y, x] == c.labels[y + dy, x + dx]
        assert [min(p) for _, p in sorted(seen.items())] == sorted(min(p) for p in seen.values())
        for label, p in seen.items():  # each label is one spot
            todo, left = [p[0]], set(p[1:])
            while todo:
                y, x = todo.pop()
                near = {q for q in left if abs(q[0] - y) <= 1 and abs(q[1] - x) <= 1}
                left -= near
                todo += near
            assert not left and c.areas[label] == len(p)


def test_labels_are_ordered_by_any_of_their_pixels():
    mask = np.zeros((4, 14), bool)
    mask[0, 10] = mask[1, 9] = mask[0, 4] = True  # rows: (0, 4) first
    mask[1, 0] = True  # the lower pixel lies in the first cell
    c = k.components(mask)
    assert c.labels[0, 4] == 1 and c.labels[1, 0] == 3 and c.by_cell() == [3, 1, 2]


def test_hole_limit_counts_the_background():
    frame = np.zeros((11, 11), bool)
    frame[1:10, 1:10] = True
    frame[2:9, 2:9] = False
    assert sorted(k.components(~frame).areas.tolist()) == [32, 40, 49] and k.components(~frame).hole_limit() == 40
    assert k.components(np.ones((2, 3), bool)).hole_limit() == 0


def test_undetected_passes_over_the_first_large_entry():
    prediction = np.zeros((20, 40), np.uint8)
    prediction[2:12, 2:12] = 200
    prediction[2:12, 20:30] = 200
    assert k.undetected(prediction, []) == [(2, 2, 12, 12), (20, 2, 30, 12)]
    assert k.undetected(prediction, [(2, 2, 12, 8)]) == [(20, 2, 30, 12)]
    assert k.undetected(np.where(prediction > 0, 0, 200).astype(np.uint8), []) == [(0, 0, 40, 20)]
    full = np.full((8, 20), 200, np.uint8)
    full[:, 10] = 0
    assert k.undetected(full, []) == [(11, 0, 20, 8)]  # a background of 8 pixels is too small to be the first entry


def test_refinement_recovers_a_letter():
    image = np.full((40, 40, 3), 240, np.uint8)
    image[12:22, 16:22] = 10
    prediction = np.zeros((40, 40), np.uint8)
    prediction[11:23, 15:23] = 255
    out = k.refine(image, prediction, [(4, 4, 36, 36)])
    assert (out[12:22, 16:22] == 255).all() and (out > 0).sum() == 60
    assert (k.refine_undetected(image, prediction, np.zeros((40, 40), np.uint8), []) > 0).sum() == 60
    assert (k.refine_undetected(image, prediction, out, [], least=500) == out).all()
    with pytest.raises(ValueError, match="empty window"):
        k.refine(image, prediction, [(39, 39, 40, 40)])


def test_regions_are_fitted():
    page = np.full((40, 40), 250, np.uint8)
    cut, box = np.zeros((40, 40), bool), np.zeros((40, 40), bool)
    cut[18:22, 18:22] = box[10:30, 10:30] = True
    page[18:22, 18:22] = 0
    fit = k.fit_region(page, cut, box, (10, 10, 30, 30), (5, 5, 35, 35))
    assert fit.candidate == 11 and fit.std == 0 and fit.colour == (255, 255, 255) and fit.thickness is None and fit.at == (5, 5)  # each equal deviation takes over
    quick = k.fit_region(page, cut, box, (10, 10, 30, 30), (5, 5, 35, 35), fast=True)
    assert quick.candidate == 0 and quick.thickness is None
    assert k.fit_region(page, cut & False, box, (10, 10, 30, 30), (5, 5, 35, 35)) is None and k.fit_region(page, cut, box, (50, 50, 60, 60), (5, 5, 35, 35)) is None
    noisy = np.random.default_rng(3).integers(0, 256, (40, 40)).astype(np.uint8)
    assert k.fit_region(noisy, cut, box, (10, 10, 30, 30), (5, 5, 35, 35)).mask is None
    layer = k.combined_mask([fit], 40, 40)
    assert (layer[:, :, 3] > 0).sum() == fit.mask.sum() == 400 and (k.cleaned(np.repeat(page[:, :, None], 3, axis=2), layer)[10:30, 10:30] == 255).all()
    text = k.text_layer(np.repeat(page[:, :, None], 3, axis=2), layer)
    assert text[20, 20].tolist() == [0, 0, 0, 255] and text[0, 0].tolist() == [0, 0, 0, 0]
    assert k.mask_overlay(np.repeat(page[:, :, None], 3, axis=2), layer, (0, 0, 250, 51))[20, 20].tolist() == [0, 0, 50]


def test_growth_repeats_the_edge():
    mask = np.zeros((9, 9), bool)
    mask[0, 4] = True
    first = k.growth_masks(mask)[0]
    assert first[4, 4] and first[0].tolist() == [True] * 9  # the edge's copies above widen the element's upper rows
    assert len(k.growth_masks(mask)) == 11


def test_layers_are_laid_over():
    canvas = np.zeros((2, 2, 4), np.uint8)
    k.over(canvas, np.array([[[10, 20, 30, 128]]], np.uint8), (1, 1))
    k.over(canvas, np.array([[[200, 0, 0, 255], [1, 1, 1, 0]]], np.uint8), (0, 0))
    k.over(canvas, np.full((1, 1, 4), 9, np.uint8), (5, 5))
    assert canvas[1, 1].tolist() == [10, 20, 30, 128] and canvas[0, 0].tolist() == [200, 0, 0, 255] and canvas[0, 1].tolist() == [0, 0, 0, 0]
    k.over(canvas, np.array([[[110, 120, 130, 128]]], np.uint8), (1, 1))
    assert canvas[1, 1].tolist() == [77, 87, 97, 192]


def test_inpainting_writes_only_isolated_surroundings():
    page = np.full((60, 60, 3), 200, np.uint8)
    raw, combined = np.zeros((60, 60), np.uint8), np.zeros((60, 60, 4), np.uint8)
    raw[28:32, 28:32] = 255
    same = k.inpaint_page(page, raw, combined, [], lambda t, _: 255 - t, tile=32)
    assert (same[0][:, :, 3] == 0).all() and (same[1] == page).all()
    region = k.Region((26, 26, 34, 34), 0.0, True, None)
    layer, whole = k.inpaint_page(page, raw, combined, [region], lambda t, _: 255 - t, tile=32)
    touched = layer[:, :, 3] > 0
    assert touched[30, 30] and not touched[:10].any() and (whole[~touched] == 200).all() and 55 <= whole[30, 30, 0] < 60
    assert (layer[touched][:, :3] == 55).all()
    fine = k.Region((26, 26, 34, 34), 1.0, False, 4)
    assert (k.inpaint_page(page, raw, combined, [fine], lambda t, _: 255 - t, tile=32)[0][:, :, 3] == 0).all()
    assert k.merged_rects([(0, 0, 5, 5), (4, 4, 9, 9), (8, 0, 10, 5), (20, 0, 20, 9)]) == [(0, 0, 10, 9)]
    assert k.radius_of(40.0) == 15 and k.radius_of(float("nan")) == 7 and k.radius_of(1e6) == 20


def test_brush_masks_and_page_masks():
    alpha = np.zeros((5, 9), np.uint8)
    alpha[1:3, 1:4] = 1
    alpha[4, 8] = 255
    assert k.painted_regions(alpha) == [(1, 1, 4, 3), (8, 4, 9, 5)] and k.painted_regions(alpha * 0) == []
    samples = np.array([[0.5, 2.0, -1.0], [0.1, 0.999, 9.0]])
    assert k.page_mask(samples, 1, 0, 2, 2).tolist() == [[127, 255], [25, 254]]
    with pytest.raises(ValueError, match="padding"):
        k.page_mask(samples, 3, 0, 2, 2)


def test_pages_of_different_sizes_and_synthetic_rasters(spark):
    rows = [(1, 2, 3, bytes([0, 9, 0, 0, 0, 9])), (2, 1, 1, bytes([0])), (3, 4, 1, bytes([9, 9, 0, 9]))]
    pages = spark.createDataFrame(rows, "page_id long, w int, h int, data binary")
    got = over_pages(pages, "page_id long, x int, y int", lambda image: set_rows(image > 5))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (1, 1, 2), (3, 0, 0), (3, 1, 0), (3, 3, 0)]
    assert over_pages(pages.limit(0), "page_id long, x int, y int", lambda image: set_rows(image > 5)).count() == 0
    values = lambda kind, **o: [r.v for r in synthetic(spark, kind, 3, 2, **o).orderBy("y", "x").collect()]
    assert values("solid", values=(0, 7)) == [7] * 6 and values("checkerboard") == [0, 255, 0, 255, 0, 255] and values("rows") == [0, 0, 0, 1, 1, 1]
    assert values("noise", seed=4) == values("noise", seed=4) != values("noise", seed=5)


@pytest.mark.parametrize(("scripted", "want"), [
    ([[0, 0, 0, 0, 9, 0], [0, 0, 0, 9, 0, 0]], [2, 4, 3]), ([[0, 0, 0, 9, 0, 0]], [2, 3]),
])
def test_beam_search_follows_the_best_path(scripted, want):
    steps = np.array(scripted, float)
    assert k.beam_search(lambda ps: np.stack([steps[min(len(p) - 1, len(steps) - 1)] for p in ps]), beams=2, max_length=5) == want


def test_trigrams_are_banned():
    assert k.banned([7, 8, 9, 1, 7, 8]) == {9} and k.banned([1, 2]) == set()
    steps = np.array([[0, 0, 0, -9, 9, 0.0]])
    out = k.beam_search(lambda ps: np.repeat(steps, len(ps), axis=0), beams=1, max_length=6)
    assert len({tuple(out[i : i + 3]) for i in range(len(out) - 2)}) == len(out) - 2


def test_tensors_round_trip():
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (k.from_nchw(k.to_nchw(image, 0.0, 1.0)) == image).all() and k.to_nchw(image).shape == (1, 3, 2, 4)


def test_structural_similarity(spark):
    board = [(1, x, y, 255 * ((x + y) % 2)) for x in range(16) for y in range(16)]
    df = spark.createDataFrame(board, "page_id long, x int, y int, a int")
    assert ssim(df.withColumn("b", F.col("a")), "page_id").first().ssim == pytest.approx(1.0)
    assert ssim(df.withColumn("b", 255 - F.col("a")), "page_id").first().ssim < 0


def test_text_functions(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c).first()[0]
    assert one(t.post_process(F.col("c0")), " a…・・b.c　!") == "ａ．．．．．ｂ．ｃ！"
    assert one(t.post_process(F.col("c0")), "・") == "・"
    assert not one(t.full_match(F.col("c0"), "abc"), "abc\n") and one(t.full_match(F.col("c0"), ".*"), "a\nb")
    assert one(t.quote_csv(F.col("c0")), 'a"b') == '"a""b"' and one(t.quote_csv(F.col("c0")), "plain") == "plain"
    assert one(t.suffix(F.col("c0")), "a.b/C.TAR.GZ") == ".gz" and one(t.stem(F.col("c0")), "x/.hidden") == ".hidden"
    got = one(t.parse_cache_name(F.col("c0")), "0123abcd_my_page_mask.png")
    assert (got.stem, got.tail) == ("my_page", "_mask.png")


def test_images_and_headers(spark, tmp_path):
    image = (np.arange(60).reshape(5, 12) % 256).astype(np.uint8)
    (tmp_path / "a.PNG").write_bytes(k.encode_png(image, dpi=300))
    (tmp_path / "b.ppm").write_bytes(k.encode_ppm(image))
    (tmp_path / "c.txt").write_bytes(b"no")
    files = image_files(spark, [str(tmp_path)]).select("path", png_header(F.col("content")).alias("h"), png_dpi(F.col("content")).alias("dpi")).orderBy("path").collect()
    assert len(files) == 2 and (files[0].h.w, files[0].h.h, files[0].h.mode, files[0].dpi) == (12, 5, "L", 300) and files[1].h is None
    px = spark.read.format("image").load(str(tmp_path / "a.PNG")).select("image.*").first()
    assert (px.width, px.height, px.nChannels) == (12, 5, 1) and bytes(px.data) == image.tobytes()


def test_dpi_is_read_from_its_chunk_only(spark, tmp_path):
    image = np.zeros((4, 4), np.uint8)
    (tmp_path / "with.png").write_bytes(k.encode_png(image, dpi=72))
    plain = k.encode_png(image)
    text = b"\0\0\0\x19tEXtpHYs\0\0\x2e\x23\0\0\x2e\x23\x01 and more....\0\0\0\0"
    (tmp_path / "fake.png").write_bytes(plain[:33] + text[:8] + text[8:].ljust(25)[:25] + b"\0" * 4 + plain[33:])
    (tmp_path / "none.png").write_bytes(plain)
    got = {r.path.rsplit("/", 1)[1]: r.dpi for r in image_files(spark, [str(tmp_path)]).select("path", png_dpi(F.col("content")).alias("dpi")).collect()}
    assert got == {"with.png": 72, "fake.png": None, "none.png": None}


def test_mock_blocks_and_vocabulary(spark, tmp_path):
    from folio.sources.images import mock_blocks, vocabulary

    got = mock_blocks(spark.range(2).toDF("page_id"), [(1, 2, 3, 4), (5, 6, 7, 8)]).orderBy("page_id", "idx").collect()
    assert [tuple(r)[:6] for r in got] == [(0, 0, 1, 2, 3, 4), (0, 1, 5, 6, 7, 8), (1, 0, 1, 2, 3, 4), (1, 1, 5, 6, 7, 8)]
    (tmp_path / "vocab.txt").write_text("[PAD]\n\n字\n")
    assert [tuple(r) for r in vocabulary(spark, str(tmp_path / "vocab.txt")).orderBy("token_id").collect()] == [(0, "[PAD]"), (1, ""), (2, "字")]


def test_command_rules(spark):
    df = spark.createDataFrame([("it's",), ("a/b-c.png",), ("",), ("replay:",), ("replay:x y",), ("onnx",)], "v string")
    got = [(r.q, r.d.kind, r.d.folder) for r in df.select(t.shell_quoted(F.col("v")).alias("q"), t.detector_choice(F.col("v")).alias("d")).collect()]
    assert got == [("'it'\\''s'", None, None), ("a/b-c.png", None, None), ("''", None, None), ("replay:", None, None), ("'replay:x y'", "replay", "x y"), ("onnx", "onnx", None)]
    assert profile.resolve_device("auto", False) == "cpu" and profile.resolve_device("auto", True) == "cuda"
    with pytest.raises(ValueError, match="not available"):
        profile.resolve_device("cuda", False)
    assert profile.growth_padding() == 8 and profile.nlm_params(profile.Profile()) == {"strength": 10.0, "patch": 7, "search": 21}


def test_jpeg_headers(spark, tmp_path):
    jfif = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x02\x00\x76\x00\x76\0\0"
    frame = b"\xff\xc0\x00\x11\x08\x00\x20\x00\x30\x03" + b"\0" * 9
    (tmp_path / "a.jpg").write_bytes(jfif + frame)
    (tmp_path / "b.jpg").write_bytes(b"not one")
    from folio.sources.images import jpeg_headers

    assert [tuple(r)[1:] for r in jpeg_headers(image_files(spark, [str(tmp_path)])).collect()] == [(48, 32, 3, 300)]


def test_checkpoints(spark, tmp_path):
    page = [(1, "a.png", ("base.png",), ("mask.png",), 1.0, [10, 20], [((1, 2, 3, 4), None, 0.5, 0.25)])]
    from folio.sources.images import RAW_PAGE

    df = spark.createDataFrame(page, RAW_PAGE)
    write_checkpoint(df, str(tmp_path / "ok"))
    assert read_checkpoint(spark, str(tmp_path / "ok")).first() == df.first()
    with pytest.raises(ValueError, match="no path"):
        write_checkpoint(df.withColumn("base_image", F.lit(None).cast("struct<path:string>")), str(tmp_path / "bad"))
    df.withColumn("schema_version", F.lit(2)).write.json(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="version"):
        read_checkpoint(spark, str(tmp_path / "old"))


def test_a_failing_page_is_a_row(spark, tmp_path):
    df = spark.createDataFrame([(1, 4), (2, 0), (3, 2)], "page_id long, v int")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": rows["page_id"], "out": [8 // int(v) for v in rows["v"]]})

    got = {r.page_id: (r.status, r.out) for r in isolated(df, work, "page_id long, out long", "mask").collect()}
    assert got == {1: ("completed", 2), 2: ("failed", None), 3: ("completed", 4)}
    calls = []
    stages = [("one", lambda d: calls.append("one") or d.withColumn("a", F.lit(1))), ("two", lambda d: calls.append("two") or d.withColumn("b", F.col("a") + 1))]
    assert run_stages(df, stages, str(tmp_path)).first().b == 2
    assert run_stages(df, stages, str(tmp_path), resume_after="one").first().b == 2 and calls == ["one", "two", "two"]


def test_profile():
    p = profile.parse("[general]\noverlap = 30\nnew_key = 'x'\n")
    assert p.values["overlap"] == 30.0 and p.values["max_std"] == 15.0 and p.unknown == {"new_key": "x"}
    assert profile.resolve_threads(0, 8, 3) == 3 and profile.resolve_threads(2, 8, 30) == 2 and profile.start_step({"mask"}, ("detect", "preprocess", "mask")) == 3
    assert profile.requested_outputs() == {"cleaned", "mask"} and profile.requested_outputs(save_only_mask=True, extract_text=True) == {"mask"} and profile.requested_outputs(extract_text=True) == {"cleaned", "mask", "text"}
    assert profile.implied_skips({"preprocess"}, ("detect", "preprocess", "mask")) == {"detect", "preprocess"}
    assert profile.keeps_in_memory(1, False, True) and not profile.keeps_in_memory(2, False, True)


def test_stream_of_outcomes(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, i, "completed" if i % 2 else "failed", "mask", f"2024-01-01 00:0{i}:00") for i in range(6)], "run_id long, page_id long, status string, step string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(folder)
    q = windowed_summary(outcome_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r[2:]) for r in spark.sql("select * from summary").collect()] == [(3, 0, 3)]
