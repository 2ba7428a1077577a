"""Image files and stage checkpoints as sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import INPUT_SUFFIXES, suffix

SCHEMA_VERSION = 1
#: Chunks of a PNG looked at before the pixel data.
MAX_CHUNKS = 64
RECT = "struct<x1:int,y1:int,x2:int,y2:int>"
#: Fixed schemas of the stage checkpoints.
RAW_PAGE = f"schema_version int, original_path string, base_image struct<path:string>, raw_mask struct<path:string>, scale double, image_size array<int>, blocks array<struct<rect:{RECT},language:string,confidence:float,mask_coverage:float>>"
MASK_DATA = f"schema_version int, original_path string, regions array<struct<rect:{RECT},std_deviation:double,failed:boolean,thickness:int>>"


def image_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Supported image files of the folders (not below them), each path once; content is read only when used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths)
    return files.filter(suffix(F.col("path")).isin(*INPUT_SUFFIXES)).dropDuplicates(["path"])


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels by the JVM's readers; a file that cannot be decoded is a failed row without pixels."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.*", (F.col("image.width") < 0).alias("failed"))


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("int")


def png_header(content: Column) -> Column:
    """(w, h, depth, mode, one_bit) from the first bytes, without decoding; null for other files."""
    kind, depth = _number(content, 25, 1), _number(content, 24, 1)
    mode = F.when(kind == 0, "L").when(kind == 4, "LA").when(kind == 6, "RGBA").otherwise("RGB")
    fields = F.struct(_number(content, 16, 4).alias("w"), _number(content, 20, 4).alias("h"), depth.alias("depth"), mode.alias("mode"), ((depth == 1) & (kind == 0)).alias("one_bit"))
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", fields)


def png_dpi(content: Column) -> Column:
    """Dots per inch of the pHYs chunk where it counts in metres, else null.

    Chunks are walked one after another from the header on, up to the pixel
    data, so bytes that only look like a chunk are passed over.
    """
    start = F.struct(F.lit(8).alias("at"), F.lit(None).cast("int").alias("dpi"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        kind = F.substring(content, s["at"] + 5, 4).cast("string")
        size = F.conv(F.hex(F.substring(content, s["at"] + 1, 4)), 16, 10).cast("long")
        metre = F.hex(F.substring(content, s["at"] + 17, 1)) == "01"
        density = F.round(F.conv(F.hex(F.substring(content, s["at"] + 9, 4)), 16, 10).cast("double") * 0.0254).cast("int")
        found = kind == "pHYs"
        ends = found | (kind == "IDAT") | (F.length(kind) < 4)
        next_ = F.least(s["at"] + 12 + size, F.lit(2_000_000_000)).cast("int")
        return F.when(s["done"], s).otherwise(F.struct(F.coalesce(next_, s["at"]).alias("at"), F.when(found & metre, density).alias("dpi"), ends.alias("done")))

    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png, F.aggregate(F.sequence(F.lit(1), F.lit(MAX_CHUNKS)), start, step, lambda s: s["dpi"]))


def read_jpeg_header(head: bytes) -> tuple[int, int, int, int | None] | None:
    """(w, h, channels, dpi) of a JPEG's first bytes: frame segment and JFIF density (per inch, or per centimetre times 2.54)."""
    if head[:2] != b"\xff\xd8":
        return None
    at, dpi = 2, None
    while at + 9 < len(head) and head[at] == 0xFF:
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if marker == 0xE0 and head[at + 4 : at + 9] == b"JFIF\0" and at + 14 <= len(head):
            unit, density = head[at + 11], int.from_bytes(head[at + 12 : at + 14], "big")
            dpi = {1: density, 2: round(density * 2.54)}.get(unit)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big"), head[at + 9], dpi
        at += 2 + size
    return None


def jpeg_headers(files: DataFrame) -> DataFrame:
    """(path, w, h, channels, dpi) of the JPEG files of a listing; only their first 64 KiB reach Python."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [(p, *h) for p, c in zip(batch["path"], batch["head"], strict=True) if (h := read_jpeg_header(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "w", "h", "channels", "dpi"]).astype({"dpi": "Int32"})

    return files.select("path", F.substring("content", 1, 65536).alias("head")).mapInPandas(run, "path string, w int, h int, channels int, dpi int")


def netpbm_one_bit(content: Column) -> Column:
    return F.substring(content, 1, 2).isin(bytearray(b"P1"), bytearray(b"P4"))


def coerced_mode(mode: Column, out_suffix: Column) -> Column:
    """Colour mode after writing: JPEG and PPM lose alpha (flattened on white), TIFF widens grey-alpha, PPM has colour only."""
    ppm, jpeg = out_suffix == ".ppm", out_suffix.isin(".jpg", ".jpeg")
    return F.when(ppm, "RGB").when(jpeg & (mode == "LA"), "L").when(jpeg & (mode == "RGBA"), "RGB").when(out_suffix.isin(".tif", ".tiff") & (mode == "LA"), "RGBA").otherwise(mode)


def cleaned_mode(mode: Column, all_achromatic: Column) -> Column:
    """Mode of a cleaned page: grey only where the page was and every fitted colour is."""
    return F.when(mode.isin("L", "LA") & all_achromatic, "L").otherwise("RGB")


def mock_blocks(pages: DataFrame, boxes: list[tuple[int, int, int, int]], confidence: float = 1.0) -> DataFrame:
    """The same boxes on every page, for runs without a detector."""
    each = F.posexplode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True))) for b in boxes)))
    return pages.select("*", each).select(*pages.columns, F.col("pos").alias("idx"), "col.*", F.lit(confidence).alias("confidence"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token) of a token list, a line each; small enough to broadcast, so it is read as one value."""
    text = F.regexp_replace("value", "\r?\n$", "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(text, "\r?\n"))).select(F.col("pos").alias("token_id"), F.col("col").alias("token"))


def write_checkpoint(pages: DataFrame, path: str) -> None:
    """One JSON line per page, with the schema's version; pages with an image or mask that has no path are refused."""
    without = " or ".join(f"{c} is null or {c}.path is null" for c in ("base_image", "raw_mask") if c in pages.columns)
    if without and not pages.filter(without).isEmpty():
        raise ValueError("a page's image has no path")
    pages.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str = RAW_PAGE) -> DataFrame:
    """Pages of a checkpoint; another schema version is an error."""
    pages = spark.read.schema(schema).json(path)
    if not pages.filter(F.col("schema_version") != SCHEMA_VERSION).isEmpty():
        raise ValueError("checkpoint of another schema version")
    return pages


def unreadable(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """Pages whose image is not among the listed files."""
    return pages.join(listing.select(F.col("path").alias("have")), F.col("base_image.path") == F.col("have"), "left_anti")


def replay_blocks(pages: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded detector output (stem, blocks) joined to pages by the stem of their path."""
    from folio.functions.text import stem

    return pages.withColumn("stem", stem(F.col("original_path"))).join(recorded, "stem")
