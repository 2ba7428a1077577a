"""Text, file, cache, report, summary and comparison operators, with their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.functions import text as t
from folio.operators.dense import SQL_COVERAGE, q_mask_coverage
from folio.operators.layout import ORACLES as LAYOUT
from folio.operators.layout import boxed, preprocess
from folio.sources.bridges import STEPS, blocks, durations, files, ocr_text, outcomes, raw_rows, regions, table, with_views


# -- recognised text ---------------------------------------------------------


def ocr_removed(boxes: DataFrame, recognised: DataFrame, pattern: str, max_size: int) -> DataFrame:
    """Boxes whose recognised text is entirely of the pattern; boxes too large or without a text stay out."""
    small = boxed(boxes).filter(g.area(F.col("r")) < max_size)
    return small.join(recognised, ["page_id", "idx"]).filter(t.full_match(F.col("text"), pattern)).drop("r")


def csv_rows(removed: DataFrame, name: Column) -> DataFrame:
    """One quoted line per removed box, and the header line only where there are rows."""
    fields = [t.quote_csv(c) for c in (name, F.col("x1").cast("string"), F.col("y1").cast("string"), F.col("x2").cast("string"), F.col("y2").cast("string"), F.col("text"))]
    lines = removed.select("page_id", F.col("idx"), F.concat_ws(",", *fields).alias("line"))
    header = removed.limit(1).select(F.lit(-1).cast("bigint").alias("page_id"), F.lit(-1).alias("idx"), F.lit("filename,startx,starty,endx,endy,text").alias("line"))
    return header.unionByName(lines)


def reported(analytics: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """Recognition results that a report shows: of completed pages, with at least one removed box."""
    done = outcomes_.filter("status = 'completed'").select("page_id").distinct()
    return analytics.filter("n_removed > 0").join(done, "page_id", "left_semi")


def no_text(performing_ocr: bool, n_boxes: Column, n_text: Column) -> Column:
    """Whether a page has no text: by the recogniser's boxes where it ran, else by the text boxes."""
    by_boxes = F.coalesce(n_text, F.lit(0)) == 0
    return F.coalesce(n_boxes == 0, by_boxes) if performing_ocr else by_boxes


def txt_blocks(removed: DataFrame, name: Column) -> DataFrame:
    """A page's name line and its texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return removed.groupBy("page_id").agg(ordered.alias("o"), F.first(name).alias("name")).select("page_id", F.concat(F.col("name"), F.lit(": \n"), F.array_join(F.col("o.text"), "\n")).alias("block"))


def q_text_post_process(spark, sf):
    return ocr_text(spark, sf).select("page_id", "idx", t.post_process(F.concat(F.col("text"), F.lit(" …・・.a.・"))).alias("text"))


SQL_POST = with_views(r""", c AS (SELECT page_id, idx, replace(regexp_replace(text || ' …・・.a.・', '[\s\x{00A0}\x{3000}]', '', 'g'), '…', '...') AS s FROM ocr_text),
l AS (SELECT page_id, idx, string_split(s, '') AS a FROM c)
SELECT page_id, idx, array_to_string(list_transform(a, lambda c, i: CASE
  WHEN c IN ('・', '.') AND (coalesce(a[i - 1], '') IN ('・', '.') OR coalesce(a[i + 1], '') IN ('・', '.')) THEN chr(46 + 65248)
  WHEN c BETWEEN '!' AND '~' AND length(c) = 1 AND ascii(c) < 127 THEN chr(ascii(c) + 65248) ELSE c END), '') AS text FROM l""", "ocr_text")


def _removed(spark, sf):
    texts = ocr_text(spark, sf).filter("idx >= 0")
    return ocr_removed(blocks(spark, sf), texts, ".*e.*", 20_000)


_REMOVED = ", removed AS (SELECT b.*, o.text FROM blocks b JOIN ocr_text o ON b.page_id = o.page_id AND b.idx = o.idx WHERE (b.x2 - b.x1) * (b.y2 - b.y1) < 20000 AND regexp_full_match(o.text, '.*e.*', 's'))"


def q_ocr_csv(spark, sf):
    return csv_rows(_removed(spark, sf), F.format_string("p%d, scan.png", "page_id"))


SQL_CSV = with_views(_REMOVED + """ SELECT -1::BIGINT AS page_id, -1::INTEGER AS idx, 'filename,startx,starty,endx,endy,text' AS line FROM (SELECT 1 FROM removed LIMIT 1)
UNION ALL SELECT page_id, idx, '"p' || page_id || ', scan.png",' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ',' || CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END FROM removed""".replace("\\\\", "\\"), "blocks", "ocr_text")


def q_ocr_txt(spark, sf):
    return txt_blocks(_removed(spark, sf), F.format_string("p%d.png", "page_id"))


SQL_TXT = with_views(_REMOVED + " SELECT page_id, 'p' || page_id || '.png: ' || chr(10) || string_agg(text, chr(10) ORDER BY idx) AS block FROM removed GROUP BY page_id", "blocks", "ocr_text")


def q_ocr_analytics(spark, sf):
    """Boxes before removal, removed boxes and their areas in order, of every page with boxes."""
    all_ = boxed(blocks(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n_boxes"))
    gone = boxed(_removed(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n_removed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", g.area(F.col("r")).alias("a")))), lambda s: s["a"].cast("string")), ",").alias("areas"))
    return all_.join(gone, "page_id", "left").select("page_id", "n_boxes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("areas", F.lit("")).alias("areas"))


SQL_OCR_ANALYTICS = with_views(_REMOVED + """ SELECT b.page_id, b.n AS n_boxes, coalesce(r.n, 0) AS n_removed, coalesce(r.areas, '') AS areas FROM (SELECT page_id, count(*) AS n FROM blocks GROUP BY page_id) b
LEFT JOIN (SELECT page_id, count(*) AS n, string_agg((x2 - x1) * (y2 - y1), ',' ORDER BY idx) AS areas FROM removed GROUP BY page_id) r ON b.page_id = r.page_id""", "blocks", "ocr_text")


def q_ocr_report(spark, sf):
    """Pages in the recognition report, and whether each has text by either rule."""
    a = reported(q_ocr_analytics(spark, sf), outcomes(spark, sf))
    return a.select("page_id", "n_boxes", "n_removed", "areas", no_text(True, F.col("n_boxes") - F.col("n_removed"), F.col("n_boxes")).alias("no_text_ocr"), no_text(False, F.lit(None), F.col("n_boxes")).alias("no_text"))


SQL_OCR_REPORT = with_views(_REMOVED + """ SELECT b.page_id, b.n AS n_boxes, r.n AS n_removed, r.areas, b.n = r.n AS no_text_ocr, false AS no_text FROM (SELECT page_id, count(*) AS n FROM blocks GROUP BY page_id) b
JOIN (SELECT page_id, count(*) AS n, string_agg((x2 - x1) * (y2 - y1), ',' ORDER BY idx) AS areas FROM removed GROUP BY page_id) r ON b.page_id = r.page_id WHERE b.page_id IN (SELECT page_id FROM outcomes WHERE status = 'completed')""", "blocks", "ocr_text", "outcomes")


def q_token_decode(spark, sf):
    ids = F.transform(F.array(*(F.col(f"q{i}") % 9 for i in range(7))), lambda x: x.cast("int"))
    vocab = F.array(*(F.lit(w) for w in ("<pad>", "<s>", "</s>", "<unk>", "<mask>", "a", "b", "c", "d")))
    return raw_rows(spark, sf).select("page_id", "row_idx", t.decode_tokens(ids, vocab).alias("decoded"), F.array_join(t.banned_next(ids), ",").alias("banned"))


SQL_DECODE = with_views(""" SELECT page_id, row_idx, array_to_string(list_transform(list_filter(ids, lambda i: i > 4), lambda i: ['<pad>', '<s>', '</s>', '<unk>', '<mask>', 'a', 'b', 'c', 'd'][i + 1]), '') AS decoded,
 array_to_string(list_transform(list_filter(generate_series(1, 5), lambda i: ids[i] = ids[6] AND ids[i + 1] = ids[7]), lambda i: ids[i + 2]), ',') AS banned
 FROM (SELECT page_id, row_idx, [q0 % 9, q1 % 9, q2 % 9, q3 % 9, q4 % 9, q5 % 9, q6 % 9] AS ids FROM raw_rows)""", "raw_rows")


# -- files and caches ----------------------------------------------------------


def q_discover_inputs(spark, sf):
    """Supported files once each, in order of first sight."""
    seen = files(spark, sf).filter(t.is_supported_input(F.col("path")))
    first = seen.groupBy("path").agg(F.min("page_id").alias("first"))
    p = F.col("path")
    return first.select("path", "first", t.suffix(p).alias("suffix"), t.stem(p).alias("stem"), t.is_output_suffix(t.suffix(p)).alias("writable"), t.artifact_path(p, "_clean", t.normalise_suffix(F.lit("PNG"))).alias("clean_path"))


SQL_DISCOVER = with_views(r""" SELECT path, min(page_id) AS first, suffix, regexp_replace(name, '\.[^./]*$', '') AS stem, suffix <> '.jp2' AS writable, regexp_replace(path, '[^/]*$', '') || regexp_replace(name, '\.[^./]*$', '') || '_clean.png' AS clean_path
FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '[^/](\.[^./]*)$', 1)) AS suffix FROM files)
WHERE suffix IN ('.png', '.jpg', '.jpeg', '.webp', '.tif', '.tiff', '.bmp', '.dib', '.jp2', '.ppm') GROUP BY path, suffix, name""", "files")


def q_cache_discovery(spark, sf):
    """Cache names built for three writers, parsed again; per page and artifact the lowest writer id is used."""
    tails = F.array(*map(F.lit, (*t.CACHE_SUFFIXES, "_seg007.png", ".junk")))
    base = files(spark, sf).select("page_id", F.concat(t.stem(F.col("path")), F.lit("_"), F.col("page_id").cast("string")).alias("stem"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    uuid = F.substring(F.md5(F.concat_ws("-", "page_id", "k").cast("binary")), 1, 8)
    names = base.select("page_id", t.cache_name(uuid, F.col("stem"), F.get(tails, F.pmod(F.col("page_id") + F.col("k"), F.lit(9)).cast("int"))).alias("name"))
    parsed = names.select("page_id", t.parse_cache_name(F.col("name")).alias("c")).filter("c is not null")
    return parsed.groupBy(F.col("c.stem").alias("stem"), F.col("c.tail").alias("tail")).agg(F.min("c.uuid").alias("uuid"))


SQL_CACHE = with_views(""", made AS (SELECT substr(md5(page_id || '-' || k), 1, 8) AS uuid, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[^/]\\.[^./]*$', '') AS x, regexp_extract(path, '([^/]*)$', 1) AS name, page_id,
 ['#raw.json', '#clean.json', '#mask_data.json', '_base.png', '_mask.png', '_clean.png', '_text.png', '_seg007.png', '.junk'][(page_id + k) % 9 + 1] AS tail FROM files, generate_series(0, 2) AS g(k))
SELECT stem, tail, min(uuid) AS uuid FROM (SELECT regexp_replace(name, '(.)\\.[^./]*$', '\\1') || '_' || page_id AS stem, tail, uuid FROM made WHERE tail <> '.junk') GROUP BY stem, tail""", "files")


def q_artifact_resolution(spark, sf):
    """Which of the stage results is exported, what each category needs, and overlays that lost their base."""
    has = lambda i: F.expr(f"(page_id div {i}) % 2 = 1")
    df = files(spark, sf).select("page_id", has(1).alias("masked"), has(2).alias("denoised"), has(4).alias("inpainted"), has(8).alias("overlay"))
    clean = F.when(F.col("inpainted"), "inpainted").when(F.col("denoised"), "denoised").when(F.col("masked"), "masked")
    mask = F.when(F.col("overlay") & ~F.col("masked"), F.lit(None).cast("string")).when(F.col("overlay"), "overlay").when(F.col("masked"), "mask")
    wanted = {"cleaned": clean, "mask": mask}
    return df.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), v.alias("source")) for k, v in wanted.items()))).alias("e"), (F.col("overlay") & ~F.col("masked")).alias("dropped_overlay")).select("page_id", "e.category", "e.source", "dropped_overlay").filter("source is not null")


SQL_ARTIFACT = with_views(""", f AS (SELECT page_id, page_id % 2 = 1 AS masked, (page_id // 2) % 2 = 1 AS denoised, (page_id // 4) % 2 = 1 AS inpainted, (page_id // 8) % 2 = 1 AS overlay FROM files)
SELECT * FROM (SELECT page_id, 'cleaned' AS category, CASE WHEN inpainted THEN 'inpainted' WHEN denoised THEN 'denoised' WHEN masked THEN 'masked' END AS source, overlay AND NOT masked AS dropped_overlay FROM f
UNION ALL SELECT page_id, 'mask', CASE WHEN overlay AND NOT masked THEN NULL WHEN overlay THEN 'overlay' WHEN masked THEN 'mask' END, overlay AND NOT masked FROM f) WHERE source IS NOT NULL""", "files")


def q_verify_artifacts(spark, sf):
    """Stored files against a manifest: absent, then size, then digest."""
    stored = table(spark, sf, "pages").select("page_id", F.length("html").alias("size"), F.sha2(F.encode("html", "utf-8"), 256).alias("sha"))
    want = stored.select("page_id", F.when(F.expr("page_id % 5 = 0"), F.col("size") + 1).otherwise(F.col("size")).alias("want_size"), F.when(F.expr("page_id % 7 = 0"), F.lit("0" * 64)).when(F.expr("page_id % 4 = 0"), F.substring("sha", 1, 63)).otherwise(F.col("sha")).alias("want_sha"))
    have = stored.filter("page_id % 3 <> 0")
    status = F.when(F.col("size").isNull(), "absent").when(F.col("size") != F.col("want_size"), "size_mismatch").when(F.col("sha") != F.col("want_sha"), "hash_mismatch").otherwise("ok")
    return want.join(have, "page_id", "left").select("page_id", status.alias("status"), t.is_digest(F.col("want_sha")).alias("canonical"), t.is_commit(F.substring("want_sha", 24, 64)).alias("commit_like"))


SQL_VERIFY = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'absent' WHEN page_id % 5 = 0 THEN 'size_mismatch' WHEN page_id % 7 = 0 OR page_id % 4 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status,
 regexp_full_match(want, '[0-9a-f]{64}') AS canonical, regexp_full_match(substr(want, 24), '[0-9a-f]{40}') AS commit_like
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN repeat('0', 64) WHEN page_id % 4 = 0 THEN substr(sha256(html), 1, 63) ELSE sha256(html) END AS want FROM pages)"""


# -- outcomes and summaries ------------------------------------------------------


def q_batch_summary(spark, sf):
    """Counts of each run, its exit code and its summary line."""
    n = lambda s: F.count_if(F.col("status") == s)
    df = outcomes(spark, sf).groupBy("run_id").agg(n("completed").alias("completed"), n("skipped").alias("skipped"), n("failed").alias("failed"), n("run_fatal").alias("fatal"))
    code = F.when(F.col("fatal") > 0, 1).when(F.col("failed") > 0, 2).otherwise(0)
    return df.select("*", code.alias("exit_code"), F.format_string("%d completed, %d skipped, %d failed", "completed", "skipped", "failed").alias("line"))


SQL_BATCH = with_views(""" SELECT *, CAST(CASE WHEN fatal > 0 THEN 1 WHEN failed > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code, completed || ' completed, ' || skipped || ' skipped, ' || failed || ' failed' AS line
FROM (SELECT run_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'run_fatal') AS fatal FROM outcomes GROUP BY run_id)""", "outcomes")


def q_failed_steps(spark, sf):
    """Failures by step in the order of the steps, with the pages in order and where a rerun starts."""
    order = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step")).cast("int")
    bad = outcomes(spark, sf).filter("status in ('failed', 'run_fatal')")
    return bad.groupBy("step").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")).select(order.alias("place"), "*", F.coalesce(F.get(F.array(*map(F.lit, STEPS)), order - 2), F.lit("none")).alias("resume_after"))


SQL_FAILED = with_views(f""" SELECT CAST(list_position({list(STEPS)}, step) AS INTEGER) AS place, step, count(*) AS n, min(page_id) AS first_page, max(page_id) AS last_page, coalesce({list(STEPS)}[list_position({list(STEPS)}, step) - 1], 'none') AS resume_after
FROM outcomes WHERE status IN ('failed', 'run_fatal') GROUP BY step""", "outcomes")


def q_bench_summary(spark, sf):
    """Without two warm-ups and with at least three samples left: median, smallest, largest."""
    df = durations(spark, sf).filter("pos > 2").groupBy("run_id").agg(F.count("*").alias("n"), F.median("ms").alias("median_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    return df.filter("n >= 3")


SQL_BENCH = with_views(" SELECT run_id, count(*) AS n, median(CAST(ms AS DOUBLE)) AS median_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM durations WHERE pos > 2 GROUP BY run_id HAVING count(*) >= 3", "durations")


def q_detect_analytics(spark, sf):
    """Detected boxes of each page, and those that hold enough of the mask to be kept."""
    return q_mask_coverage(spark, sf).groupBy("page_id").agg(F.count("*").alias("detected"), F.count_if("kept").alias("kept"))


SQL_DETECT = f"SELECT page_id, count(*) AS detected, count(*) FILTER (kept) AS kept FROM ({SQL_COVERAGE}) GROUP BY page_id"


def q_merge_analytics(spark, sf):
    """Segments of eight pages each rolled up into one strip: sums, and boxes concatenated in order."""
    df = q_detect_analytics(spark, sf).withColumn("strip", F.floor(F.col("page_id") / 8)).groupBy("strip")
    return df.agg(F.sum("detected").alias("detected"), F.sum("kept").alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "kept"))), lambda s: s["kept"].cast("string")), "|").alias("kept_list"), F.count("*").alias("segments"))


SQL_MERGE_AN = f"SELECT page_id // 8 AS strip, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(kept) AS BIGINT) AS kept, string_agg(kept, '|' ORDER BY page_id) AS kept_list, count(*) AS segments FROM ({SQL_DETECT}) GROUP BY strip"


def q_analytics_lines(spark, sf):
    """Tab-separated report lines of four kinds; pages without a completed outcome give none."""
    b = blocks(spark, sf)
    done = outcomes(spark, sf).filter("status = 'completed'").select("page_id").distinct()
    detect = b.groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", F.concat_ws("\t", F.lit("detect"), "page_id", "n").alias("line"))
    mask = regions(spark, sf).groupBy("page_id").agg(F.count_if("failed").alias("f"), F.count_if(~F.col("failed")).alias("k")).select("page_id", F.concat_ws("\t", F.lit("mask"), "page_id", "k", "f").alias("line"))
    noise = regions(spark, sf).filter("not failed and std_milli > 250").groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", F.concat_ws("\t", F.lit("denoise"), "page_id", "n").alias("line"))
    ocr = ocr_text(spark, sf).groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", F.concat_ws("\t", F.lit("ocr"), "page_id", "n").alias("line"))
    return detect.unionByName(ocr).unionByName(mask).unionByName(noise).join(done, "page_id", "left_semi")


SQL_LINES = with_views(""" SELECT page_id, line FROM (SELECT page_id, 'detect' || chr(9) || page_id || chr(9) || count(*) AS line FROM blocks GROUP BY page_id
UNION ALL SELECT page_id, 'mask' || chr(9) || page_id || chr(9) || count(*) FILTER (NOT failed) || chr(9) || count(*) FILTER (failed) FROM regions GROUP BY page_id
UNION ALL SELECT page_id, 'ocr' || chr(9) || page_id || chr(9) || count(*) FROM ocr_text GROUP BY page_id
UNION ALL SELECT page_id, 'denoise' || chr(9) || page_id || chr(9) || count(*) FROM regions WHERE NOT failed AND std_milli > 250 GROUP BY page_id)
WHERE page_id IN (SELECT page_id FROM outcomes WHERE status = 'completed')""", "blocks", "regions", "outcomes", "ocr_text")


# -- comparison ------------------------------------------------------------------


def q_compare_tensors(spark, sf):
    """Of each row's first and second half: entries that differ in their bits, largest and mean difference, first unequal rounded entry, top-two margin; and the least margins of the table.

    One component of each thirteenth row is not a number, which the largest and
    the mean difference keep; margins are taken without it.
    """
    plain = F.transform("embedding", lambda x: x.cast("double"))
    v = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 13 == 0) & (i == 5), float("nan")).otherwise(x).cast("double"))
    pairs = F.arrays_zip(F.slice(v, 1, 32).alias("a"), F.slice(v, 33, 32).alias("b"))
    gap = F.transform(pairs, lambda p: F.abs(p["a"] - p["b"]))
    top = F.slice(F.sort_array(plain, asc=False), 1, 2)
    whole = F.transform(pairs, lambda p: F.floor(F.abs(F.nanvl(p["a"], F.lit(9.0))) * 4) != F.floor(F.abs(p["b"]) * 4))
    first = F.nullif(F.array_position(whole, True), F.lit(0)).cast("int") - 1
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.size(pairs).alias("n"), F.size(F.filter(pairs, lambda p: ~(p["a"] == p["b"]))).alias("n_diff"), F.round(F.array_max(gap), 6).alias("max_gap"),
        F.round(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / 32, 6).alias("mean_gap"), first.alias("first_far"), F.round(F.get(top, 0) - F.get(top, 1), 6).alias("margin"),
        F.round(F.array_min(F.transform(plain, lambda x: F.abs(F.abs(x) * 255 - F.floor(F.abs(x) * 255) - 0.5))), 6).alias("quant_margin"),
    )
    least = rows.agg(F.min("margin").alias("least_margin"), F.min("quant_margin").alias("least_quant_margin"))
    return rows.join(F.broadcast(least))


SQL_COMPARE = """WITH r AS (SELECT vec_id, 32::INTEGER AS n, CAST(len(list_filter(pairs, lambda p: isnan(p.a) OR p.a <> p.b)) AS INTEGER) AS n_diff, round(CASE WHEN vec_id % 13 = 0 THEN 'nan'::DOUBLE ELSE list_max(gap) END, 6) AS max_gap, round(list_sum(gap) / 32, 6) AS mean_gap,
 CAST(nullif(coalesce(list_position(list_transform(pairs, lambda p: floor(abs(CASE WHEN isnan(p.a) THEN 9.0 ELSE p.a END) * 4) <> floor(abs(p.b) * 4)), true), 0), 0) - 1 AS INTEGER) AS first_far, round(list_sort(v, 'DESC')[1] - list_sort(v, 'DESC')[2], 6) AS margin,
 round(list_min(list_transform(v, lambda x: abs(abs(x) * 255 - floor(abs(x) * 255) - 0.5))), 6) AS quant_margin
FROM (SELECT vec_id, v, list_transform(generate_series(1, 32), lambda i: {'a': CASE WHEN vec_id % 13 = 0 AND i = 6 THEN 'nan'::DOUBLE ELSE v[i] END, 'b': v[i + 32]}) AS pairs,
 list_transform(generate_series(1, 32), lambda i: abs(CASE WHEN vec_id % 13 = 0 AND i = 6 THEN 'nan'::DOUBLE ELSE v[i] END - v[i + 32])) AS gap FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)))
SELECT r.*, (SELECT min(margin) FROM r) AS least_margin, (SELECT min(quant_margin) FROM r) AS least_quant_margin FROM r"""


def q_detection_divergence(spark, sf):
    """Two detector outputs (the second drops, doubles and moves some boxes) paired by index: accounting and per-edge growth."""
    a = blocks(spark, sf).select("page_id", "idx", "x1", "y1", "x2", "y2")
    b = a.filter("(page_id + idx) % 7 <> 0").select("page_id", "idx", (F.col("x1") + F.expr("page_id % 3 - 1").cast("int")).alias("u1"), F.col("x2").alias("u2"))
    b = b.unionByName(b.filter("(page_id + idx) % 11 = 0"))
    many = b.groupBy("page_id", "idx").agg(F.count("*").alias("n"), F.min("u1").alias("u1"), F.min("u2").alias("u2"))
    j = a.join(many, ["page_id", "idx"], "full")
    kind = F.when(F.col("n").isNull(), "unpaired").when(F.col("n") > 1, "duplicate").when(F.col("u1") < F.col("x1"), "grew").when(F.col("u1") > F.col("x1"), "shrank").otherwise("equal")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("u1") - F.col("x1"), F.lit(0))).alias("shift"))


SQL_DIVERGENCE = with_views(""", b0 AS (SELECT page_id, idx, CAST(x1 + page_id % 3 - 1 AS INTEGER) AS u1 FROM blocks WHERE (page_id + idx) % 7 <> 0),
b AS (SELECT page_id, idx, count(*) AS n, min(u1) AS u1 FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE (page_id + idx) % 11 = 0) GROUP BY page_id, idx)
SELECT CASE WHEN n IS NULL THEN 'unpaired' WHEN n > 1 THEN 'duplicate' WHEN u1 < x1 THEN 'grew' WHEN u1 > x1 THEN 'shrank' ELSE 'equal' END AS kind, count(*) AS n, CAST(sum(coalesce(u1 - x1, 0)) AS BIGINT) AS shift
FROM blocks a LEFT JOIN b ON a.page_id = b.page_id AND a.idx = b.idx GROUP BY 1""", "blocks")


def q_mode_means(spark, sf):
    """Mean of each cell over all, over eligible and over commonly eligible runs; a cell joins the last only if it has any."""
    df = durations(spark, sf).select("run_id", F.expr("pos % 4").alias("cell"), F.col("ms"), F.expr("(run_id + pos) % 3 <> 0").alias("eligible"))
    cells = df.select("cell").distinct().count()
    common = df.filter("eligible").groupBy("run_id").agg(F.countDistinct("cell").alias("c")).filter(F.col("c") == cells).select("run_id", F.lit(True).alias("common"))
    j = df.join(common, "run_id", "left")
    m = lambda c: F.round(F.avg(F.when(c, F.col("ms"))), 6)
    return j.groupBy("cell").agg(F.round(F.avg("ms"), 6).alias("full"), m(F.col("eligible")).alias("eligible"), m(F.col("eligible") & F.col("common")).alias("common"))


SQL_MODE = with_views(""", d AS (SELECT run_id, pos % 4 AS cell, ms, (run_id + pos) % 3 <> 0 AS eligible FROM durations),
c AS (SELECT run_id FROM d WHERE eligible GROUP BY run_id HAVING count(DISTINCT cell) = (SELECT count(DISTINCT cell) FROM d))
SELECT cell, round(avg(ms), 6) AS "full", round(avg(ms) FILTER (eligible), 6) AS eligible, round(avg(ms) FILTER (eligible AND run_id IN (SELECT run_id FROM c)), 6) AS common FROM d GROUP BY cell""", "durations")


def q_mask_sweep(spark, sf):
    """Accepted, rescued, failed and dropped regions under three limits of the deviation."""
    limits = F.explode(F.array(F.lit(5000), F.lit(10000), F.lit(15000)))
    df = regions(spark, sf).select("*", limits.alias("max_milli"))
    kind = F.when(F.col("failed"), "failed").when(F.col("thickness").isNull(), "dropped").when(F.col("std_milli") <= F.col("max_milli"), "accepted").when(F.col("std_milli") <= 2 * F.col("max_milli"), "rescued").otherwise("failed")
    return df.groupBy("max_milli", kind.alias("kind")).agg(F.count("*").alias("n"))


SQL_SWEEP = with_views(""" SELECT max_milli, CASE WHEN failed THEN 'failed' WHEN thickness IS NULL THEN 'dropped' WHEN std_milli <= max_milli THEN 'accepted' WHEN std_milli <= 2 * max_milli THEN 'rescued' ELSE 'failed' END AS kind, count(*) AS n
FROM regions, (VALUES (5000), (10000), (15000)) AS l(max_milli) GROUP BY 1, 2""", "blocks", "regions")


def invariants(pages: DataFrame, w: int, h: int) -> DataFrame:
    """pages with the names of the integrity rules that each box breaks: on the canvas, inside its reference, placed without gaps."""
    p = pages.withColumn("n", F.count("*").over(Window.partitionBy("page_id")))
    rules = {"off_canvas": F.expr(f"x1 < 0 or y1 < 0 or x2 > {w} or y2 > {h}"), "reference": ~g.contains_rect(F.col("ref"), F.col("e")), "order": F.col("place") > F.col("n")}
    return p.withColumn("broken", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def q_page_invariants(spark, sf):
    """Boxes of preprocessed pages by the rules they break, on a canvas too small for some, with references and places spoilt for some."""
    p = preprocess(blocks(spark, sf))
    p = p.withColumn("ref", F.when(F.expr("page_id % 5 = 0"), g.translate(F.col("ref"), 40, 0)).otherwise(F.col("ref"))).withColumn("place", F.when(F.expr("page_id % 7 = 0"), F.col("place") + 1).otherwise(F.col("place")))
    found = invariants(p, 500, 600)
    return found.select("page_id", "idx", F.explode_outer("broken").alias("rule")).groupBy(F.coalesce("rule", F.lit("sound")).alias("rule")).agg(F.count("*").alias("n"))


SQL_INVARIANTS = f"""WITH p AS ({LAYOUT['preprocess']}), q AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, place + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS spoilt,
 CASE WHEN page_id % 5 = 0 THEN 40 ELSE 0 END + ref_x1 AS left_edge FROM p),
r AS (SELECT x2 > 500 OR y2 > 600 AS a, left_edge > e_x1 AS b, spoilt > n AS c FROM q)
SELECT 'off_canvas' AS rule, count(*) AS n FROM r WHERE a HAVING count(*) > 0 UNION ALL SELECT 'reference', count(*) FROM r WHERE b HAVING count(*) > 0 UNION ALL SELECT 'order', count(*) FROM r WHERE c HAVING count(*) > 0
UNION ALL SELECT 'sound', count(*) FROM r WHERE NOT (a OR b OR c) HAVING count(*) > 0"""

QUERIES = {
    "text_post_process": q_text_post_process, "ocr_csv": q_ocr_csv, "ocr_txt": q_ocr_txt, "ocr_analytics": q_ocr_analytics, "ocr_report": q_ocr_report, "token_decode": q_token_decode, "discover_inputs": q_discover_inputs,
    "cache_discovery": q_cache_discovery, "artifact_resolution": q_artifact_resolution, "verify_artifacts": q_verify_artifacts, "batch_summary": q_batch_summary, "failed_steps": q_failed_steps,
    "bench_summary": q_bench_summary, "detect_analytics": q_detect_analytics, "merge_analytics": q_merge_analytics, "analytics_lines": q_analytics_lines, "compare_tensors": q_compare_tensors,
    "detection_divergence": q_detection_divergence, "mode_means": q_mode_means, "mask_sweep": q_mask_sweep, "page_invariants": q_page_invariants,
}
ORACLES = {
    "text_post_process": SQL_POST, "ocr_csv": SQL_CSV, "ocr_txt": SQL_TXT, "ocr_analytics": SQL_OCR_ANALYTICS, "ocr_report": SQL_OCR_REPORT, "token_decode": SQL_DECODE, "discover_inputs": SQL_DISCOVER, "cache_discovery": SQL_CACHE,
    "artifact_resolution": SQL_ARTIFACT, "verify_artifacts": SQL_VERIFY, "batch_summary": SQL_BATCH, "failed_steps": SQL_FAILED, "bench_summary": SQL_BENCH, "detect_analytics": SQL_DETECT,
    "merge_analytics": SQL_MERGE_AN, "analytics_lines": SQL_LINES, "compare_tensors": SQL_COMPARE, "detection_divergence": SQL_DIVERGENCE, "mode_means": SQL_MODE, "mask_sweep": SQL_SWEEP,
    "page_invariants": SQL_INVARIANTS,
}
