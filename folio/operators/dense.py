"""Pages as binary rasters: one row a page, batches of pages through numpy, with their queries.

A raster relation is (page_id, w, h, data): row-major bytes of one channel.
Nothing is shuffled to run a function over pages; a page's boxes travel in its
row.  Results are rows (boxes, measures) or pixels, built column by column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import kernels as k
from folio.operators import refining
from folio.operators.denoising import noise_layers
from folio.operators.fitting import Fits, fit_regions
from folio.operators.raster import _SMALL, boxes_of, small_boxes
from folio.operators.stacks import box_columns, or_null, over_stacks, page_rasters, under_boxes
from folio.sources.bridges import raw_rows, table, with_views

PIXELS = "page_id long, x int, y int, v int"
#: Pixels of the pages whose regions are fitted at once: more, so that crops of one size are many.
FIT_PIXELS = 1 << 22


def synthetic(spark, kind: str, w: int, h: int, seed: int = 0, values: tuple[int, int] = (0, 255)) -> DataFrame:
    """(x, y, v) of a test raster: solid, checkerboard, rows (rising by row) or noise (seeded, the same every time)."""
    grid = spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    low, high = values
    v = {
        "solid": F.lit(high), "checkerboard": F.when((F.col("x") + F.col("y")) % 2 == 0, low).otherwise(high), "rows": F.col("y") % 256,
        "noise": F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(256)),
    }[kind]
    return grid.select("x", "y", v.cast("int").alias("v"))


def over_pages(pages: DataFrame, schema: str, work: Callable[..., dict], *extra: str) -> DataFrame:
    """Rows of work(page raster, *extra values): a dict from column to values of equal length; page_id is added."""
    out = T.StructType.fromDDL(schema)
    names = [n for n in out.names if n != "page_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            ids, ws, hs = (batch.column(c).to_pylist() for c in ("page_id", "w", "h"))
            data = batch.column("data")
            others = [batch.column(c).to_pylist() for c in extra]
            parts: dict[str, list] = {n: [] for n in out.names}
            for i, page in enumerate(ids):
                image = np.frombuffer(data[i].as_buffer(), np.uint8).reshape(hs[i], ws[i])
                made = work(image, *(o[i] for o in others))
                size = len(made[names[0]])
                parts["page_id"].append(np.full(size, page, np.int64))
                for n in names:
                    parts[n].append(made[n])
            columns = []
            for n in out.names:
                flat = [p for p in parts[n] if len(p)]
                dense = flat and all(isinstance(p, np.ndarray) for p in flat)
                columns.append(pa.array(np.concatenate(flat) if dense else [v for p in flat for v in p], arrow.field(n).type))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return pages.select("page_id", "w", "h", "data", *extra).mapInArrow(run, out)


def pixel_rows(image: np.ndarray) -> dict:
    y, x = np.indices(image.shape)
    return {"x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "v": image.ravel().astype(np.int32)}


def set_rows(mask: np.ndarray) -> dict:
    y, x = np.nonzero(mask)
    return {"x": x.astype(np.int32), "y": y.astype(np.int32)}


def on_pages(pages: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(page_id, x, y, v) of the raster that work makes of each page's."""
    return over_pages(pages, PIXELS, lambda image: pixel_rows(work(image)))


def box_rows(rects: list[k.Rect]) -> dict:
    a = np.array(rects, np.int32).reshape(-1, 4)
    return {"idx": np.arange(len(a), dtype=np.int32), **{n: a[:, i] for i, n in enumerate(("x1", "y1", "x2", "y2"))}}


def colours(image: np.ndarray) -> np.ndarray:
    """A grey page as a colour page whose channels differ."""
    v = image.astype(int)
    return np.stack([v, v * 3 % 256, v * 7 % 256], axis=2).astype(np.uint8)


def colour_stack(stack: np.ndarray) -> np.ndarray:
    """``colours`` of every page of a stack; bytes wrap, which is the remainder."""
    return np.stack([stack, stack * np.uint8(3), stack * np.uint8(7)], axis=-1)


def rect_list(boxes) -> list[k.Rect]:
    return [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes or ()]


# -- morphology ----------------------------------------------------------------------


def q_dilate(spark, sf):
    return over_pages(page_rasters(spark, sf), "page_id long, x int, y int", lambda image: set_rows(k.grow(image > 200, k.kernel_rows(7))))


# Half widths of the elements' rows by their distance from the centre, written down from the ellipse of that radius.
ROWS7 = "e7(dy, half) AS (VALUES (0, 7), (1, 7), (-1, 7), (2, 7), (-2, 7), (3, 6), (-3, 6), (4, 6), (-4, 6), (5, 5), (-5, 5), (6, 4), (-6, 4), (7, 0), (-7, 0))"
ROWS5 = "e5(dy, half) AS (VALUES (0, 5), (1, 5), (-1, 5), (2, 5), (-2, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (-5, 0))"
ROWS4 = "e4(dy, half) AS (VALUES (0, 4), (1, 4), (-1, 4), (2, 3), (-2, 3), (3, 3), (-3, 3), (4, 0), (-4, 0))"
ROWS2 = "e2(dy, half) AS (VALUES (0, 2), (1, 2), (-1, 2), (2, 1), (-2, 1))"
SQL_DILATE = with_views(f""", {ROWS7} SELECT DISTINCT page_id, CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y
FROM pixels, e7, generate_series(-7, 7) AS g(dx) WHERE v > 200 AND abs(dx) <= half AND x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 15""", "pixels")


def q_growth_candidates(spark, sf):
    """Area and bounds of every growth candidate of the dark pixels, with its thickness."""

    def work(image: np.ndarray) -> dict:
        rows = []
        if (image < 6).any():
            for i, mask in enumerate(k.growth_masks(image < 6)):
                y, x = np.nonzero(mask)
                rows.append((i, len(x), int(x.min()), int(y.max()), 4 + 2 * i))
        return dict(zip(("candidate", "area", "x1", "y2", "thickness"), map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

    return over_pages(page_rasters(spark, sf), "page_id long, candidate int, area long, x1 int, y2 int, thickness int", work)


def _growth_sql() -> str:
    """In a frame of 8 around the page, where the edge repeats."""
    step = lambda name, source, e: f"{name} AS (SELECT DISTINCT page_id, x + dx AS x, y + dy AS y FROM {source}, {e}, generate_series(-4, 4) AS g(dx) WHERE abs(dx) <= half AND x + dx BETWEEN -8 AND 31 AND y + dy BETWEEN -8 AND 23)"
    chain = [step("c0", "framed", "e4"), *(step(f"c{i}", f"c{i - 1}", "e2") for i in range(1, 11))]
    every = " UNION ALL ".join(f"SELECT {i} AS c, * FROM c{i}" for i in range(11))
    return with_views(f""", {ROWS4}, {ROWS2},
framed AS (SELECT page_id, fx AS x, fy AS y FROM generate_series(-8, 31) AS a(fx), generate_series(-8, 23) AS b(fy) JOIN pixels ON x = greatest(least(fx, 23), 0) AND y = greatest(least(fy, 15), 0) WHERE v < 6),
{", ".join(chain)}
SELECT page_id, CAST(c AS INTEGER) AS candidate, count(*) AS area, CAST(min(x) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y2, CAST(4 + 2 * c AS INTEGER) AS thickness
FROM ({every}) WHERE x BETWEEN 0 AND 23 AND y BETWEEN 0 AND 15 GROUP BY page_id, c""", "pixels")


# -- components ------------------------------------------------------------------------


def q_components(spark, sf):
    """Components of the dark pixels with their boxes and areas, and the area below which holes are filled."""

    def work(image: np.ndarray) -> dict:
        c = k.components(image < 60)
        boxes = {n: c.boxes[1:, i].astype(np.int32) for i, n in enumerate(("x1", "y1", "x2", "y2"))}
        return {"label": np.arange(1, len(c.areas)), **boxes, "area": c.areas[1:], "hole_limit": np.full(len(c.areas) - 1, c.hole_limit())}

    return over_pages(page_rasters(spark, sf), "page_id long, label long, x1 int, y1 int, x2 int, y2 int, area long, hole_limit long", work)


_LABELLED = """, d AS (SELECT page_id, x, y, y * 24 + x AS id FROM pixels WHERE v < 60),
r AS (SELECT page_id, id AS root, x, y, id FROM d UNION SELECT r.page_id, r.root, d.x, d.y, d.id FROM r JOIN d ON d.page_id = r.page_id AND abs(d.x - r.x) <= 1 AND abs(d.y - r.y) <= 1),
m AS (SELECT page_id, id, min(root) AS root, any_value(x) AS x, any_value(y) AS y FROM r GROUP BY page_id, id),
c AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY root) AS label, x, y FROM m),
b AS (SELECT page_id, label, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS area, min((y // 2) * 100 + x // 2) AS cell FROM c GROUP BY page_id, label)"""
SQL_COMPONENTS = with_views(_LABELLED + """,
z AS (SELECT page_id, list_sort(list_append(list(area), 384 - sum(area)), 'DESC')[2] AS hole_limit FROM b GROUP BY page_id)
SELECT b.* EXCLUDE (cell), CAST(hole_limit AS BIGINT) AS hole_limit FROM b JOIN z USING (page_id)""", "pixels")


def q_label_order(spark, sf):
    """Labels of the dark components in order of the first two-by-two cell they touch."""

    def work(image: np.ndarray) -> dict:
        order = np.array(k.components(image < 60).by_cell(), np.int64)
        return {"label": order, "place": np.arange(1, len(order) + 1, dtype=np.int32)}

    return over_pages(page_rasters(spark, sf), "page_id long, label long, place int", work)


SQL_LABELS = with_views(_LABELLED + " SELECT page_id, label, CAST(row_number() OVER (PARTITION BY page_id ORDER BY cell) AS INTEGER) AS place FROM b", "pixels")


def q_brush_regions(spark, sf):
    """The painted spots of a brush mask as failed regions of deviation 0."""

    def work(image: np.ndarray) -> dict:
        rows = box_rows(k.painted_regions(np.where(image < 60, image + 1, 0)))
        n = len(rows["idx"])
        return {**rows, "std": np.zeros(n), "failed": np.ones(n, bool)}

    return over_pages(page_rasters(spark, sf), "page_id long, idx int, x1 int, y1 int, x2 int, y2 int, std double, failed boolean", work).withColumn("thickness", F.lit(None).cast("int"))


SQL_BRUSH = with_views(_LABELLED + " SELECT page_id, CAST(label - 1 AS INTEGER) AS idx, x1, y1, x2, y2, 0.0::DOUBLE AS std, true AS failed, CAST(NULL AS INTEGER) AS thickness FROM b", "pixels")


def prediction(image: np.ndarray) -> np.ndarray:
    """A detector's mask from the coarse page: the dark third of its values, inverted."""
    return np.where(image < 90, 250 - image, 0).astype(np.uint8)


def _coarse(spark, sf):
    return page_rasters(spark, sf, 48, 32, "coarse", boxes_of(small_boxes(spark, sf)), "left")


def q_undetected(spark, sf):
    """Components of a prediction that no box of the page holds to half."""
    work = lambda image, boxes: box_rows(k.undetected(prediction(image), rect_list(boxes)))
    return over_pages(_coarse(spark, sf), "page_id long, idx int, x1 int, y1 int, x2 int, y2 int", work, "boxes")


# The coarse page is flat within cells of eight, so components are those of its 6 x 4 cells; the background counts as the first entry where it is larger than 50.
SQL_UNDETECTED = with_views(_SMALL + """,
cells AS (SELECT p_partkey AS page_id, cx, cy, cy * 6 + cx AS id FROM part, generate_series(0, 5) AS a(cx), generate_series(0, 3) AS b(cy) WHERE (cx * 37 + cy * 91 + cx * cy * 53 + p_partkey * 29) % 256 < 90),
r AS (SELECT page_id, id AS root, cx, cy, id FROM cells UNION SELECT r.page_id, r.root, d.cx, d.cy, d.id FROM r JOIN cells d ON d.page_id = r.page_id AND abs(d.cx - r.cx) <= 1 AND abs(d.cy - r.cy) <= 1),
m AS (SELECT page_id, id, min(root) AS root, any_value(cx) AS cx, any_value(cy) AS cy FROM r GROUP BY page_id, id),
c AS (SELECT page_id, root, min(cx) * 8 AS x1, min(cy) * 8 AS y1, max(cx) * 8 + 8 AS x2, max(cy) * 8 + 8 AS y2, count(*) * 64 AS area, min(id) AS cell FROM m GROUP BY page_id, root),
e AS (SELECT page_id, 1536 - sum(area) AS rest FROM c GROUP BY page_id),
n AS (SELECT c.*, rest, row_number() OVER (PARTITION BY c.page_id ORDER BY cell) AS k FROM c JOIN e USING (page_id) WHERE area > 50),
s AS (SELECT n.page_id, n.x1, n.y1, n.x2, n.y2, cell, max(CASE WHEN s.page_id IS NULL OR least(n.y2, s.y2) < greatest(n.y1, s.y1) OR least(n.x2, s.x2) < greatest(n.x1, s.x1) THEN -1 ELSE (least(n.y2, s.y2) - greatest(n.y1, s.y1)) * (least(n.x2, s.x2) - greatest(n.x1, s.x1)) END) AS shared
 FROM n LEFT JOIN boxes s ON s.page_id = n.page_id WHERE rest > 50 OR k > 1 GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY cell) - 1 AS INTEGER) AS idx, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2
FROM s WHERE shared / (x2 - x1)::DOUBLE / (y2 - y1) < 0.5""", "blocks")


def q_refine_undetected(spark, sf):
    """Size of the refined mask of each page, alone and with what was refined around left-over components."""

    def work(image: np.ndarray, boxes) -> dict:
        page, guess = colours(image), prediction(image)
        first = k.refine(page, guess, rect_list(boxes)[:1])
        both = k.refine_undetected(page, guess, first, rect_list(boxes))
        return {"refined": [int((first > 0).sum())], "with_undetected": [int((both > 0).sum())], "kept": [bool((both >= first).all())]}

    return over_pages(_coarse(spark, sf), "page_id long, refined long, with_undetected long, kept boolean", work, "boxes")


def q_refine(spark, sf):
    """The refined mask of each page's boxes."""

    def work(stack: np.ndarray, boxes) -> dict:
        n, h, w = stack.shape
        b = box_columns(boxes)
        out = refining.refine(colour_stack(stack), stack * np.uint8(5), b["at"], np.stack([b[c] for c in ("x1", "y1", "x2", "y2")], axis=1))
        y, x = (np.tile(i.ravel().astype(np.int32), n) for i in np.indices((h, w)))
        return {"at": np.repeat(np.arange(n), h * w), "x": x, "y": y, "v": out.ravel()}

    return over_stacks(page_rasters(spark, sf, boxes=boxes_of(small_boxes(spark, sf)), how="left"), PIXELS, work, "boxes", at_once=1 << 20)


# -- masks and boxes -----------------------------------------------------------------------


def q_mask_coverage(spark, sf):
    """Share of the mask under each box (kept from a tenth on), and whether confident boxes hold any residue, by sums over the page's integral."""
    small = small_boxes(spark, sf)
    boxes = small.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x1", "y1", "x2", "y2", "conf_milli"))).alias("boxes"))

    def work(image: np.ndarray, boxes) -> dict:
        h, w = image.shape
        b = np.array([(r["idx"], r["x1"], r["y1"], r["x2"], r["y2"], r["conf_milli"]) for r in boxes])
        x1, x2, y1, y2 = b[:, 1].clip(0, w), b[:, 3].clip(0, w), b[:, 2].clip(0, h), b[:, 4].clip(0, h)

        def inside(values: np.ndarray) -> np.ndarray:
            s = np.pad(values.astype(np.int64), ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
            return s[y2, x2] - s[y1, x2] - s[y2, x1] + s[y1, x1]

        share = np.round(inside(image) / np.maximum((x2 - x1) * (y2 - y1) * 255.0, 1), 6)
        residue = inside(np.where(image > 240, image - 240, 0) > 0) > 0
        return {"idx": b[:, 0].astype(np.int32), "coverage": share, "kept": share >= 0.1, "residual": (b[:, 5] > 600) & residue}

    return over_pages(page_rasters(spark, sf, boxes=boxes), "page_id long, idx int, coverage double, kept boolean, residual boolean", work, "boxes")


SQL_COVERAGE = with_views(_SMALL + """, masked AS (SELECT page_id, x, y, v, CASE WHEN v > 240 THEN v - 240 ELSE 0 END AS alpha FROM pixels)
SELECT b.page_id, b.idx, round(coalesce(sum(v) / (count(v) * 255.0::DOUBLE), 0), 6) AS coverage, round(coalesce(sum(v) / (count(v) * 255.0::DOUBLE), 0), 6) >= 0.1 AS kept, any_value(conf_milli) > 600 AND coalesce(max(alpha), 0) > 0 AS residual
FROM boxes b LEFT JOIN masked p ON p.page_id = b.page_id AND p.x >= b.x1 AND p.x < b.x2 AND p.y >= b.y1 AND p.y < b.y2 GROUP BY b.page_id, b.idx""", "blocks", "pixels")


def _fits(stack: np.ndarray, boxes, colour: bool) -> tuple[dict[str, np.ndarray], Fits]:
    """The boxes of a stack's pages, and those that are fitted."""
    b = box_columns(boxes)
    rects = np.stack([b[n] for n in ("x1", "y1", "x2", "y2")], axis=1)
    image = colour_stack(stack) if colour else stack[..., None]
    return b, fit_regions(image, stack < 60, under_boxes(stack.shape, b["at"], *rects.T), b["at"], rects, 3, max_std=75.0, colour_failed=not colour)


def _combined(stack: np.ndarray, fits: Fits) -> np.ndarray:
    """``kernels.combined_mask`` of every page: the fitted masks painted in their colours, in order."""
    canvas = np.zeros((*stack.shape, 4), np.uint8)
    flat, by = canvas.reshape(-1, 4), np.searchsorted(fits.region, fits.painted_by)
    flat[fits.painted, :3] = fits.colour.T[by]
    flat[fits.painted, 3] = 255
    return canvas


def _boxed_pages(spark, sf):
    return page_rasters(spark, sf, boxes=boxes_of(small_boxes(spark, sf)))


def q_fit_region(spark, sf):
    """The fitted mask of every box: which candidate, its thickness, deviation and colour, and how many pixels it covers (none where it fails)."""

    def work(stack: np.ndarray, boxes) -> dict:
        b, f = _fits(stack, boxes, False)
        return {
            "at": b["at"][f.region], "idx": b["idx"][f.region], "candidate": f.candidate, "thickness": or_null(f.thickness.astype(np.int32), f.thickness < 0), "std": np.round(f.std, 6),
            "grey": f.colour[0], "covered": or_null(f.covered, ~f.fits), "rescued": f.rescued,
        }

    return over_stacks(_boxed_pages(spark, sf), "page_id long, idx int, candidate int, thickness int, std double, grey int, covered long, rescued boolean", work, "boxes", at_once=FIT_PIXELS)


def q_masked_layers(spark, sf):
    """Sums over the layers built from a page's fits: combined mask, cleaned page, text layer and overlay."""

    def work(stack: np.ndarray, boxes) -> dict:
        masks = _combined(stack, _fits(stack, boxes, True)[1])
        out: dict[str, list] = {n: [] for n in ("masked", "mask_sum", "cleaned_sum", "text_sum", "overlay_sum")}
        for i in range(0, len(stack), 512):  # pages one below the other are laid over as one
            n = len(mask := masks[i : i + 512])
            mask, page = mask.reshape(-1, *mask.shape[2:]), colour_stack(stack[i : i + 512]).reshape(-1, stack.shape[2], 3)
            layers = {"masked": mask[:, :, 3] > 0, "mask_sum": mask, "cleaned_sum": k.cleaned(page, mask), "text_sum": k.text_layer(page, mask), "overlay_sum": k.mask_overlay(page, mask, (108, 30, 240, 127))}
            for name, v in layers.items():
                out[name].append(v.reshape(n, -1).sum(axis=1, dtype=np.int64))
        return {n: np.concatenate(v) for n, v in out.items()}

    return over_stacks(_boxed_pages(spark, sf), "page_id long, masked long, mask_sum long, cleaned_sum long, text_sum long, overlay_sum long", work, "boxes", at_once=FIT_PIXELS)


def q_inpaint_page(spark, sf):
    """A whole inpainting pass over each page with a stand-in model (the tile's inverse): growth, fade, isolation, tiles, owners and layers."""

    def work(stack: np.ndarray, boxes) -> dict:
        b, fits = _fits(stack, boxes, True)
        masks = _combined(stack, fits)
        rects = list(zip(*(b[n].tolist() for n in ("x1", "y1", "x2", "y2")), strict=True))
        ends = np.searchsorted(b["at"], np.arange(len(stack) + 1)).tolist()
        out = []
        for i, image in enumerate(stack):
            page = np.repeat(np.repeat(colours(image), 2, axis=0), 2, axis=1)
            regions = [k.Region(r, (r[0] * 131 + r[1] * 17) % 30, (r[2] + r[3]) % 5 == 0, 4 + 2 * (r[0] % 3)) for r in rects[ends[i] : ends[i + 1]]]
            layer, whole = k.inpaint_page(page, np.where(image < 60, 255, 0).astype(np.uint8), masks[i], regions, lambda tile, _: 255 - tile, tile=16)
            out.append((int((layer[:, :, 3] > 0).sum()), int(layer[:, :, 3].sum()), int(whole.sum())))
        return dict(zip(("touched", "alpha_sum", "page_sum"), map(list, zip(*out, strict=True)), strict=True))

    return over_stacks(_boxed_pages(spark, sf), "page_id long, touched long, alpha_sum long, page_sum long", work, "boxes", at_once=FIT_PIXELS)


def q_noise_layer(spark, sf):
    """Denoised crops around each page's boxes: how many pixels the layer covers, and its alpha."""

    def work(stack: np.ndarray, boxes) -> dict:
        b = box_columns(boxes)
        out = noise_layers(colour_stack(stack), stack < 30, b["at"], np.stack([b[c] for c in ("x1", "y1", "x2", "y2")], axis=1))
        alpha = out[..., 3].reshape(len(stack), -1)
        return {"covered": (alpha > 0).sum(axis=1), "alpha_sum": alpha.sum(axis=1, dtype=np.int64)}

    return over_stacks(page_rasters(spark, sf, boxes=boxes_of(small_boxes(spark, sf)), alike=True), "page_id long, covered long, alpha_sum long", work, "boxes", at_once=1 << 20)


def q_page_mask(spark, sf):
    """A detector's eight-by-eight mask samples as a page mask: bytes, without padding, at page size."""
    samples = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(bytearray(64)).alias("data"), F.transform("embedding", lambda x: x.cast("float")).alias("samples"))
    work = lambda _, samples: pixel_rows(k.page_mask(np.array(samples, np.float32).reshape(8, 8), 2, 3, 6, 5))
    return over_pages(samples, PIXELS, work, "samples")


# Target and crop are of one size (6 x 5), so resampling changes nothing.
SQL_PAGE_MASK = """SELECT vec_id AS page_id, CAST(i % 6 AS INTEGER) AS x, CAST(i // 6 AS INTEGER) AS y,
 CAST(trunc(least(greatest(CAST(embedding[(i // 6) * 8 + i % 6 + 1] AS FLOAT) * 255::FLOAT, 0::FLOAT), 255::FLOAT)) AS INTEGER) AS v FROM embeddings, generate_series(0, 29) AS g(i)"""


# -- filters: the definitions, pixel by pixel ---------------------------------------------------


def _blur_sql(source: str) -> str:
    """Blur of radius 1 of a relation (page_id, x, y, v): seven taps, edges repeated, rows in single precision."""
    return f"""taps AS (SELECT j, exp(-j * j / 2.0::DOUBLE) AS w FROM generate_series(-3, 3) AS g(j)), n AS (SELECT j, w / (SELECT sum(w) FROM taps) AS w FROM taps),
across AS (SELECT p.page_id, p.x, p.y, CAST(sum(n.w * s.v) AS FLOAT) AS v FROM {source} p, n JOIN {source} s ON s.page_id = p.page_id AND s.y = p.y AND s.x = greatest(least(p.x + j, 23), 0) GROUP BY p.page_id, p.x, p.y)
SELECT p.page_id, p.x, p.y, CAST(floor(sum(n.w * CAST(s.v AS DOUBLE)) + 0.5) AS INTEGER) AS v FROM across p, n JOIN across s ON s.page_id = p.page_id AND s.x = p.x AND s.y = greatest(least(p.y + j, 15), 0) GROUP BY p.page_id, p.x, p.y"""


SQL_BLUR = with_views(f", {_blur_sql('pixels')}", "pixels")
SQL_FADE = with_views(f""", {ROWS5}, grown AS (SELECT DISTINCT page_id, x + dx AS x, y + dy AS y FROM pixels, e5, generate_series(-5, 5) AS g(dx) WHERE v > 200 AND abs(dx) <= half),
mask AS (SELECT p.page_id, p.x, p.y, CASE WHEN g.x IS NULL THEN 0 ELSE 255 END AS v FROM pixels p LEFT JOIN grown g ON g.page_id = p.page_id AND g.x = p.x AND g.y = p.y), {_blur_sql('mask')}""", "pixels")
SQL_BILINEAR = with_views(""", a AS (SELECT nx, greatest(least((nx + 0.5::DOUBLE) * 24 / 10 - 0.5, 23), 0) AS sx FROM generate_series(0, 9) AS g(nx)), b AS (SELECT ny, greatest(least((ny + 0.5::DOUBLE) * 16 / 7 - 0.5, 15), 0) AS sy FROM generate_series(0, 6) AS g(ny)),
c AS (SELECT nx, ny, CAST(floor(sx) AS INTEGER) AS x0, CAST(least(floor(sx) + 1, 23) AS INTEGER) AS x1, sx - floor(sx) AS fx, CAST(floor(sy) AS INTEGER) AS y0, CAST(least(floor(sy) + 1, 15) AS INTEGER) AS y1, sy - floor(sy) AS fy FROM a, b)
SELECT p.page_id, CAST(nx AS INTEGER) AS x, CAST(ny AS INTEGER) AS y, CAST(floor((p.v * (1 - fx) + q.v * fx) * (1 - fy) + (r.v * (1 - fx) + s.v * fx) * fy + 0.5) AS INTEGER) AS v
FROM c JOIN pixels p ON p.x = x0 AND p.y = y0 JOIN pixels q ON q.page_id = p.page_id AND q.x = x1 AND q.y = y0 JOIN pixels r ON r.page_id = p.page_id AND r.x = x0 AND r.y = y1 JOIN pixels s ON s.page_id = p.page_id AND s.x = x1 AND s.y = y1""", "pixels")


# -- decoding and colours --------------------------------------------------------------------


def q_beam_search(spark, sf):
    """Sequences decoded from the scripted steps of each page, sixty-four tokens wide by rotation of its vector."""
    steps = raw_rows(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", *(f"q{i}" for i in range(7))))).alias("steps"))
    pages = steps.select("page_id", F.lit(1).alias("w"), F.lit(1).alias("h"), F.lit(bytearray(1)).alias("data"), "steps")

    def work(_, steps) -> dict:
        s = np.array([[r[f"q{i}"] for i in range(7)] for r in steps]) / 256.0
        return {"ids": [k.beam_search(lambda prefixes: np.stack([s[min(len(p) - 1, len(s) - 1)] for p in prefixes]))]}

    return over_pages(pages, "page_id long, ids array<int>", work, "steps")


def q_colours(spark, sf):
    def work(image: np.ndarray) -> dict:
        std, centre = k.colour_statistics(colours(image).reshape(-1, 3).astype(float))
        return {"std": [round(std, 4)], "centre": [[int(c) for c in centre]]}

    return over_pages(page_rasters(spark, sf), "page_id long, std double, centre array<int>", work)


QUERIES = {
    "dilate": q_dilate, "growth_candidates": q_growth_candidates, "components": q_components, "label_order": q_label_order, "brush_regions": q_brush_regions, "undetected_blocks": q_undetected,
    "refine_undetected": q_refine_undetected, "refine_mask": q_refine, "mask_coverage": q_mask_coverage, "fit_region": q_fit_region, "masked_layers": q_masked_layers, "inpaint_page": q_inpaint_page, "noise_layer": q_noise_layer,
    "page_mask": q_page_mask, "beam_search": q_beam_search, "colour_statistics": q_colours,
    "gaussian_blur": lambda s, d: on_pages(page_rasters(s, d), lambda i: k.blur(i, 1.0)),
    "non_local_means": lambda s, d: on_pages(page_rasters(s, d), k.non_local_means),
    "resize_bilinear": lambda s, d: on_pages(page_rasters(s, d), lambda i: k.resize_bilinear(i, 10, 7)),
    "resize_triangle": lambda s, d: on_pages(page_rasters(s, d), lambda i: k.resize_triangle(i, 10, 7)),
    "fade_mask": lambda s, d: on_pages(page_rasters(s, d), lambda i: k.fade_mask(i > 200)),
}
ORACLES = {
    "dilate": SQL_DILATE, "growth_candidates": _growth_sql(), "components": SQL_COMPONENTS, "label_order": SQL_LABELS, "brush_regions": SQL_BRUSH, "undetected_blocks": SQL_UNDETECTED, "mask_coverage": SQL_COVERAGE, "page_mask": SQL_PAGE_MASK,
    "gaussian_blur": SQL_BLUR, "fade_mask": SQL_FADE, "resize_bilinear": SQL_BILINEAR,
}
