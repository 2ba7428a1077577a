"""Comparison with a recorded detector, colour metrics, output binding and command-line rules, with their queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.functions import text as t
from folio.operators.stacks import otsu_thresholds, over_stacks, page_rasters
from folio.sources.bridges import blocks, files, pixels, table, with_views

#: Mechanisms by which a box may stay unmatched, and the side each may be cited on.
MECHANISMS = ("class_duplicate", "coverage_filtered", "documented_split_merge", "dbnet_scattered", "open")
COLUMNS_OF_A_BOX = 7


# -- recorded lines ------------------------------------------------------------------


def lines_box(lines: Column, before: Column) -> Column:
    """Bounds of all points of nested polygons, those before expansion where there are any; null without a point."""
    points = F.flatten(F.when(F.size(before) > 0, before).otherwise(lines))
    side = lambda i, agg: agg(F.transform(points, lambda p: p[i]))
    return F.when(F.size(points) > 0, F.struct(side(0, F.array_min).alias("x1"), side(1, F.array_min).alias("y1"), side(0, F.array_max).alias("x2"), side(1, F.array_max).alias("y2")))


def identity_branch(lines: Column) -> Column:
    return F.when(lines.isNull(), "line_less").otherwise("line_informed")


def reconstructed(ours: Column, lines: Column) -> Column:
    """The box that a recorded one should be: ours, and its lines' bounds where it has lines."""
    return F.when(lines.isNull(), ours).otherwise(g.merge(ours, lines))


def _recorded(spark, sf) -> DataFrame:
    """Every box with recorded lines: none for each third, before-expansion ones for each second, two triangles shifted by its number."""
    b = blocks(spark, sf)
    point = lambda x, y: F.array(F.expr(x).cast("int"), F.expr(y).cast("int"))
    lines = F.array(F.array(point("x1 - idx", "y1"), point("x2", "y1 + 3"), point("x1", "y2")), F.array(point("x2 + idx", "y2"), point("x1 + 1", "y1 + 1"), point("x2", "y2 - 1")))
    before = F.array(F.array(point("x1 + 2", "y1 + 2"), point("x2 + 2", "y2 + 2")))
    none = F.array().cast("array<array<array<int>>>")
    return b.withColumn("lines", F.when(F.expr("idx % 3 = 0"), none).otherwise(lines)).withColumn("before", F.when(F.expr("idx % 2 = 0 and idx % 3 <> 0"), before).otherwise(none))


def q_line_reconstruction(spark, sf):
    """Each recorded box rebuilt from ours, by which branch, and whether that is what was recorded."""
    df = _recorded(spark, sf).withColumn("l", lines_box(F.col("lines"), F.col("before"))).withColumn("r", g.of())
    e = df.withColumn("e", reconstructed(F.col("r"), F.col("l")))
    return e.select("page_id", "idx", identity_branch(F.col("l")).alias("branch"), *(F.col(f"e.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")), (F.col("e") == F.col("r")).alias("identical"))


SQL_LINES = with_views(""" SELECT page_id, idx, CASE WHEN idx % 3 = 0 THEN 'line_less' ELSE 'line_informed' END AS branch,
 CASE WHEN idx % 3 = 0 OR idx % 2 = 0 THEN x1 ELSE x1 - idx END AS x1, y1,
 CASE WHEN idx % 3 = 0 THEN x2 WHEN idx % 2 = 0 THEN x2 + 2 ELSE x2 + idx END AS x2, CASE WHEN idx % 3 <> 0 AND idx % 2 = 0 THEN y2 + 2 ELSE y2 END AS y2,
 idx % 3 = 0 AS identical FROM blocks""", "blocks")


# -- accounting of unmatched boxes -------------------------------------------------------


def accounting(entries: DataFrame) -> DataFrame:
    """(page_id, counted, n): unmatched boxes by side and mechanism; what a side does not count is left out."""
    ours = F.when(F.col("mechanism").isin("coverage_filtered", "documented_split_merge", "open"), F.concat(F.col("mechanism"), F.lit("_ours")))
    upstream = F.when(F.col("mechanism").isin("documented_split_merge", "open"), F.concat(F.col("mechanism"), F.lit("_upstream"))).when(F.col("mechanism").isin("class_duplicate", "dbnet_scattered"), F.col("mechanism"))
    counted = F.when(F.col("side") == "ours", ours).otherwise(upstream)
    return entries.withColumn("counted", counted).filter("counted is not null").groupBy("page_id", "counted").agg(F.count("*").alias("n"))


def mechanism_problems(entries: DataFrame, paired: DataFrame, recorded: DataFrame) -> DataFrame:
    """(page_id, side, idx, kind, reason) of unmatched boxes whose mechanism is open or does not hold.

    entries: page_id, side, idx, mechanism, cited, x1..y2 (of our box); paired:
    (page_id, cited) of matched recorded boxes; recorded: (page_id, cited, lines,
    box) of the recorded boxes before filtering.
    """
    j = entries.join(paired.withColumn("is_paired", F.lit(True)), ["page_id", "cited"], "left")
    j = j.join(recorded.select("page_id", "cited", "lines", "box"), ["page_id", "cited"], "left")
    m, ours = F.col("mechanism"), F.col("side") == "ours"
    reason = (
        F.when((m == "dbnet_scattered") & ours, "upstream-side-only")
        .when((m == "class_duplicate") & ours, "upstream-side-only")
        .when((m == "class_duplicate") & F.col("is_paired").isNull(), "not a paired block")
        .when((m == "coverage_filtered") & ~ours, "ours-side-only")
        .when((m == "coverage_filtered") & F.col("box").isNull(), "out of range")
        .when((m == "coverage_filtered") & (reconstructed(g.of(), F.col("lines")) != F.col("box")), "does not match")
    )
    found = j.withColumn("reason", reason).withColumn("kind", F.when(m == "open", "open").when(F.col("reason").isNotNull(), "unverifiable"))
    return found.filter("kind is not null").select("page_id", "side", "idx", "kind", "reason")


def gating(divergences: DataFrame) -> DataFrame:
    """The divergences that fail a comparison; open mechanisms are diagnostics only."""
    return divergences.filter("kind <> 'open'")


def diagnostics(divergences: DataFrame) -> DataFrame:
    return divergences.filter("kind = 'open'")


def _entries(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = _recorded(spark, sf).withColumn("l", lines_box(F.col("lines"), F.col("before")))
    mechanism = F.element_at(F.array(*map(F.lit, MECHANISMS)), F.expr("cast((page_id + idx * 3) % 5 + 1 as int)"))
    e = b.filter("(page_id + idx) % 4 = 0").select("page_id", F.expr("if(idx % 2 = 0, 'ours', 'upstream')").alias("side"), "idx", mechanism.alias("mechanism"), (F.col("idx") + 1).alias("cited"), "x1", "y1", "x2", "y2")
    paired = b.filter("(page_id + idx) % 4 <> 0").select("page_id", F.col("idx").alias("cited"))
    before = b.select("page_id", (F.col("idx") + F.expr("cast(page_id % 2 as int)")).alias("cited"), F.col("l").alias("lines"), g.of().alias("box"))
    return e, paired, before


def q_accounting(spark, sf):
    return accounting(_entries(spark, sf)[0])


_ENTRIES = """, e AS (SELECT page_id, idx, idx % 2 = 0 AS ours, (page_id + idx * 3) % 5 AS m, idx + 1 AS cited, x1, y1, x2, y2 FROM blocks WHERE (page_id + idx) % 4 = 0)"""
SQL_ACCOUNTING = with_views(_ENTRIES + """ SELECT page_id, counted, count(*) AS n FROM (SELECT page_id, CASE
 WHEN ours AND m = 1 THEN 'coverage_filtered_ours' WHEN ours AND m = 2 THEN 'documented_split_merge_ours' WHEN ours AND m = 4 THEN 'open_ours' WHEN ours THEN NULL
 WHEN m = 0 THEN 'class_duplicate' WHEN m = 2 THEN 'documented_split_merge_upstream' WHEN m = 3 THEN 'dbnet_scattered' WHEN m = 4 THEN 'open_upstream' END AS counted FROM e) WHERE counted IS NOT NULL GROUP BY page_id, counted""", "blocks")


def q_mechanism_problems(spark, sf):
    found = mechanism_problems(*_entries(spark, sf))
    return gating(found).withColumn("gates", F.lit(True)).unionByName(diagnostics(found).withColumn("gates", F.lit(False)))


SQL_MECHANISMS = with_views(_ENTRIES + """, rec AS (SELECT page_id, CAST(idx + page_id % 2 AS INTEGER) AS cited, idx AS k, x1, y1, x2, y2 FROM blocks),
j AS (SELECT e.*, r.k, r.x1 AS bx1, r.y1 AS by1, r.x2 AS bx2, r.y2 AS by2, EXISTS (SELECT 1 FROM blocks p WHERE p.page_id = e.page_id AND p.idx = e.cited AND (p.page_id + p.idx) % 4 <> 0) AS paired FROM e LEFT JOIN rec r ON r.page_id = e.page_id AND r.cited = e.cited),
l AS (SELECT *, CASE WHEN k % 3 = 0 THEN x1 ELSE least(x1, CASE WHEN k % 2 = 0 THEN bx1 + 2 ELSE bx1 - k END) END AS ex1, CASE WHEN k % 3 = 0 THEN y1 ELSE least(y1, CASE WHEN k % 2 = 0 THEN by1 + 2 ELSE by1 END) END AS ey1,
 CASE WHEN k % 3 = 0 THEN x2 ELSE greatest(x2, CASE WHEN k % 2 = 0 THEN bx2 + 2 ELSE bx2 + k END) END AS ex2, CASE WHEN k % 3 = 0 THEN y2 ELSE greatest(y2, CASE WHEN k % 2 = 0 THEN by2 + 2 ELSE by2 END) END AS ey2 FROM j),
f AS (SELECT page_id, CASE WHEN ours THEN 'ours' ELSE 'upstream' END AS side, idx, m, CASE WHEN ours AND m IN (0, 3) THEN 'upstream-side-only' WHEN m = 0 AND NOT paired THEN 'not a paired block' WHEN m = 1 AND NOT ours THEN 'ours-side-only'
 WHEN m = 1 AND k IS NULL THEN 'out of range' WHEN m = 1 AND (ex1, ey1, ex2, ey2) <> (bx1, by1, bx2, by2) THEN 'does not match' END AS reason FROM l)
SELECT page_id, side, idx, CASE WHEN m = 4 THEN 'open' ELSE 'unverifiable' END AS kind, reason, m <> 4 AS gates FROM f WHERE m = 4 OR reason IS NOT NULL""", "blocks")


# -- colour metrics -------------------------------------------------------------------------


def channel_metrics(pairs: DataFrame, channels: tuple[str, ...], *keys: str) -> DataFrame:
    """Mean and largest difference over all samples and the share of wholly equal pixels, of columns a_c and b_c."""
    gaps = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in channels]
    total = sum(gaps[1:], gaps[0])
    most = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return pairs.groupBy(*keys).agg(F.round(F.avg(total) / len(channels), 6).alias("mean_gap"), F.max(most).alias("max_gap"), F.round(F.avg((total == 0).cast("double")), 6).alias("equal_share"))


def q_colour_metrics(spark, sf):
    """The metrics of page pairs as colour and as colour with alpha."""
    e = lambda s, n: F.expr(s).cast("int").alias(n)
    p = pixels(spark, sf).select("page_id", e("v", "a_r"), e("v * 3 % 256", "a_g"), e("v * 7 % 256", "a_b"), e("255 - x", "a_alpha"), e("v", "b_r"), e("(v * 3 + y % 3) % 256", "b_g"), e("v * 7 % 256", "b_b"), e("255 - x + (x + y) % 2", "b_alpha"))
    rgb = channel_metrics(p, ("r", "g", "b"), "page_id")
    rgba = channel_metrics(p, ("r", "g", "b", "alpha"), "page_id").withColumnsRenamed({"mean_gap": "mean_gap_alpha", "max_gap": "max_gap_alpha", "equal_share": "equal_share_alpha"})
    return rgb.join(rgba, "page_id")


SQL_COLOUR = with_views(""", p AS (SELECT page_id, abs(v * 3 % 256 - (v * 3 + y % 3) % 256) AS g, (x + y) % 2 AS a FROM pixels)
SELECT page_id, round(avg(g) / 3, 6) AS mean_gap, CAST(max(g) AS INTEGER) AS max_gap, round(avg(CASE WHEN g = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS equal_share,
 round(avg(g + a) / 4, 6) AS mean_gap_alpha, CAST(max(greatest(g, a)) AS INTEGER) AS max_gap_alpha, round(avg(CASE WHEN g + a = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS equal_share_alpha FROM p GROUP BY page_id""", "pixels")


def q_best_channel(spark, sf):
    """The channel whose Otsu mask, or its negative, is nearest to the prediction; blue before green before red among equals."""
    names = np.array(["b", "g", "r"])

    def work(stack: np.ndarray) -> dict:
        want = stack * np.uint8(5) > 127  # bytes wrap, which is the remainder
        size = want[0].size
        off = [((c > otsu_thresholds(c)[:, None, None]) != want).sum(axis=(1, 2)) for c in (stack * np.uint8(7), stack * np.uint8(3), stack)]
        xor = np.stack([np.minimum(d, size - d) * 255 for d in off], axis=1)
        best = xor.argmin(axis=1)
        pos = np.stack(off, axis=1)[np.arange(len(best)), best]
        return {"channel": names[best].tolist(), "xor": xor.min(axis=1), "inverted": size - pos < pos}

    return over_stacks(page_rasters(spark, sf), "page_id long, channel string, xor long, inverted boolean", work)


SQL_CHANNEL = with_views(""", e AS (SELECT page_id, CASE WHEN v * 5 % 256 > 127 THEN 255 ELSE 0 END AS want, 0 AS ord, 'b' AS channel, v * 7 % 256 AS c FROM pixels
 UNION ALL SELECT page_id, CASE WHEN v * 5 % 256 > 127 THEN 255 ELSE 0 END, 1, 'g', v * 3 % 256 FROM pixels UNION ALL SELECT page_id, CASE WHEN v * 5 % 256 > 127 THEN 255 ELSE 0 END, 2, 'r', v FROM pixels),
h AS (SELECT page_id, channel, c, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY ALL),
w AS (SELECT page_id, channel, c, sum(n) OVER o AS q, sum(n * c) OVER o AS m, sum(n) OVER p AS t, sum(n * c) OVER p AS mt FROM h WINDOW o AS (PARTITION BY page_id, channel ORDER BY c), p AS (PARTITION BY page_id, channel)),
s AS (SELECT page_id, channel, c, CASE WHEN t = q THEN 0 ELSE round(q * (t - q) * power(m / q - (mt - m) / (t - q), 2) / (t * t), 9) END AS sigma FROM w),
b AS (SELECT page_id, channel, c AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY page_id, channel ORDER BY sigma DESC, c) AS r FROM s) WHERE r = 1),
x AS (SELECT e.page_id, ord, channel, CAST(sum(xor(CASE WHEN c > threshold THEN 255 ELSE 0 END, want)) AS BIGINT) AS pos, CAST(sum(xor(CASE WHEN c > threshold THEN 0 ELSE 255 END, want)) AS BIGINT) AS neg FROM e JOIN b USING (page_id, channel) GROUP BY ALL)
SELECT page_id, channel, least(pos, neg) AS xor, neg < pos AS inverted FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY least(pos, neg), ord) AS k FROM x) WHERE k = 1""", "pixels")


# -- model outputs and command-line rules ----------------------------------------------------


def bound_outputs(shapes: Column) -> Column:
    """Which of three model outputs (their shapes, -1 for a dynamic side) holds boxes, mask and lines, or why none can be told.

    The first holds the boxes.  Of the others one channel means the mask and
    two the lines; where a channel count is dynamic the order decides.
    """
    channel = lambda i: F.get(F.get(shapes, i), 1)
    known = (F.coalesce(channel(1), F.lit(-1)) > 0) & (F.coalesce(channel(2), F.lit(-1)) > 0)
    bound = lambda error, mask, lines: F.struct(F.lit(error).alias("error"), F.lit(mask).cast("int").alias("mask"), F.lit(lines).cast("int").alias("lines"))
    columns = F.coalesce(F.element_at(F.get(shapes, 0), -1), F.lit(-1))
    return (
        F.when(F.size(shapes) != 3, bound("not three outputs", None, None))
        .when(columns != COLUMNS_OF_A_BOX, bound("columns", None, None))
        .when(~known | ((channel(1) == 1) & (channel(2) == 2)), bound(None, 1, 2))
        .when((channel(1) == 2) & (channel(2) == 1), bound(None, 2, 1))
        .otherwise(bound("channels", None, None))
    )


def q_output_binding(spark, sf):
    ints = lambda *e: F.array(*(F.expr(str(x)).cast("int") for x in e))
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("model"))
    three = F.array(ints(1, 64512, "if(model % 7 = 0, 6, 7)"), ints(1, "case model % 4 when 0 then 1 when 1 then 2 when 2 then 3 else -1 end", 1024, 1024), ints(1, "case model % 3 when 0 then 2 when 1 then 1 else -1 end", 1024, 1024))
    shapes = F.when(F.expr("model % 11 = 0"), F.slice(three, 1, 2)).otherwise(three)
    return df.withColumn("o", bound_outputs(shapes)).select("model", "o.error", "o.mask", "o.lines")


SQL_BINDING = """SELECT model, error, CASE WHEN error IS NULL THEN CASE WHEN a = 2 AND b = 1 THEN 2 ELSE 1 END END AS mask, CASE WHEN error IS NULL THEN CASE WHEN a = 2 AND b = 1 THEN 1 ELSE 2 END END AS lines
FROM (SELECT model, a, b, CASE WHEN model % 11 = 0 THEN 'not three outputs' WHEN model % 7 = 0 THEN 'columns' WHEN a > 0 AND b > 0 AND NOT (a = 1 AND b = 2) AND NOT (a = 2 AND b = 1) THEN 'channels' END AS error
 FROM (SELECT p_partkey AS model, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE -1 END AS a, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END AS b FROM part))"""


def q_command_rules(spark, sf):
    """Each path quoted for a shell, read as a detector choice, and the outcome that a run of it begins with."""
    f = files(spark, sf).withColumn("text", F.concat(F.when(F.expr("page_id % 3 = 0"), F.lit("replay:")).otherwise(F.lit("it's ")), F.col("path")))
    d = t.detector_choice(F.when(F.expr("page_id % 5 = 0"), F.lit("onnx")).when(F.expr("page_id % 5 = 1"), F.lit("mock")).otherwise(F.col("text")))
    outcome = F.when(~t.is_supported_input(F.col("path")), "skipped").otherwise("started")
    return f.select("page_id", t.shell_quoted(F.col("text")).alias("quoted"), d["kind"].alias("detector"), d["folder"].alias("folder"), outcome.alias("outcome"))


SQL_COMMANDS = with_views(r""" SELECT page_id, CASE WHEN regexp_full_match(text, '[A-Za-z0-9_@%+=:,./-]+') THEN text ELSE '''' || replace(text, '''', '''\''''') || '''' END AS quoted,
 CASE WHEN page_id % 5 = 0 THEN 'onnx' WHEN page_id % 5 = 1 THEN 'mock' WHEN page_id % 3 = 0 THEN 'replay' END AS detector, CASE WHEN page_id % 5 > 1 AND page_id % 3 = 0 THEN path END AS folder,
 CASE WHEN page_id % 10 IN (4, 8, 9) THEN 'skipped' ELSE 'started' END AS outcome FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'replay:' ELSE 'it''s ' END || path AS text FROM files)""", "files")


def markdown_rows(table_: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a Markdown table, null as a dash; order is the reader's."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    return table_.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def markdown_header(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n| {' | '.join(['---'] * len(columns))} |"


def q_markdown_report(spark, sf):
    b = blocks(spark, sf).groupBy("page_id").agg(F.count("*").alias("boxes"), F.count("lang").alias("known"), F.min("lang").alias("lang"))
    return markdown_rows(b, ["page_id", "boxes", "known", "lang"])


SQL_MARKDOWN = with_views(" SELECT '| ' || page_id || ' | ' || count(*) || ' | ' || count(lang) || ' | ' || coalesce(min(lang), '—') || ' |' AS line FROM blocks GROUP BY page_id", "blocks")

QUERIES = {
    "line_reconstruction": q_line_reconstruction, "accounting": q_accounting, "mechanism_problems": q_mechanism_problems, "colour_metrics": q_colour_metrics, "best_channel": q_best_channel,
    "output_binding": q_output_binding, "command_rules": q_command_rules, "markdown_report": q_markdown_report,
}
ORACLES = {
    "line_reconstruction": SQL_LINES, "accounting": SQL_ACCOUNTING, "mechanism_problems": SQL_MECHANISMS, "colour_metrics": SQL_COLOUR, "best_channel": SQL_CHANNEL,
    "output_binding": SQL_BINDING, "command_rules": SQL_COMMANDS, "markdown_report": SQL_MARKDOWN,
}
