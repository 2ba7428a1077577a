"""String functions: recognised text, quoting, paths and cache names; all plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that post-processing strips, readable suffixes, known cache suffixes and their artifacts.
SPACES = "\\u0009-\\u000D\\u001C-\\u001F\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
INPUT_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp", ".dib", ".jp2", ".ppm")
OUTPUT_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp", ".dib", ".ppm")
CACHE_SUFFIXES = ("#raw.json", "#clean.json", "#mask_data.json", "_base.png", "_mask.png", "_clean.png", "_text.png")


def post_process(text: Column) -> Column:
    """Without white space; an ellipsis is three dots, runs of dots stay dots, ASCII becomes full width."""
    out = F.regexp_replace(text, f"[{SPACES}]", "")
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, "[・.](?=[・.])|(?<=[・.])[・.]", ".")
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    return F.translate(out, narrow, "".join(chr(ord(c) + 0xFEE0) for c in narrow))


def full_match(text: Column, pattern: str) -> Column:
    """The whole text matches; dots match line ends, and no trailing line end is forgiven."""
    return text.rlike(rf"(?s)\A(?:{pattern})\z")


def quote_csv(field: Column) -> Column:
    return F.when(field.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case dotted extension of the file name, or empty; a leading dot alone is a name."""
    return F.lower(F.regexp_extract(file_name(path), r"[^/](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def is_supported_input(path: Column) -> Column:
    return suffix(path).isin(*INPUT_SUFFIXES)


def is_output_suffix(value: Column) -> Column:
    """In the list of formats that can be written; some inputs are read only."""
    return F.lower(value).isin(*OUTPUT_SUFFIXES)


def normalise_suffix(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when((low == "") | low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def artifact_path(path: Column, label: str, out_suffix: Column) -> Column:
    return F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), stem(path), F.lit(label), out_suffix)


def cache_name(uuid: Column, page_stem: Column, tail: Column) -> Column:
    return F.concat_ws("_", uuid, F.concat(page_stem, tail))


def segment_name(uuid: Column, page_stem: Column, number: Column) -> Column:
    return F.format_string("%s_%s_seg%03d.png", uuid, page_stem, number)


def parse_cache_name(name: Column) -> Column:
    """(uuid, stem, tail) of a cache file, null when it is none; longer known tails are tried first."""
    tails = "|".join(t.replace(".", r"\.") for t in sorted(CACHE_SUFFIXES, key=lambda t: (-len(t), t)))
    pattern = rf"^([0-9a-f]{{8}})_(.+?)({tails}|_seg[0-9]{{3}}\.png)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("uuid"), part(2).alias("stem"), part(3).alias("tail")))


def is_digest(value: Column) -> Column:
    return value.rlike(r"\A[0-9a-f]{64}\z")


def is_commit(value: Column) -> Column:
    return value.rlike(r"\A[0-9a-f]{40}\z")


def parsed_date(value: Column) -> Column:
    return F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(value, "yyyy-MM-dd"))


def decode_tokens(ids: Column, vocab: Column) -> Column:
    """Joined vocabulary entries (an array column) of ids; the first five ids are special and skipped."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i > 4), lambda i: F.coalesce(F.get(vocab, i), F.lit(""))), "")


def banned_next(ids: Column, n: int = 3) -> Column:
    """Tokens that would repeat an n-gram after the last n - 1 ids, in order of place."""
    last = F.slice(ids, F.greatest(F.size(ids) - (n - 2), F.lit(1)), F.lit(n - 1))
    starts = F.when(F.size(ids) >= n, F.sequence(F.lit(1), F.size(ids) - (n - 1))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(ids, i, F.lit(n - 1)) == last)
    return F.transform(hits, lambda i: F.element_at(ids, i + (n - 1)))


def shell_quoted(value: Column) -> Column:
    """value as one word of a POSIX shell; plain words stay."""
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(value.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), value).otherwise(quoted)


def detector_choice(value: Column) -> Column:
    """(kind, folder) of ``onnx``, ``mock`` or ``replay:FOLDER``; nulls for anything else."""
    folder = F.when(value.startswith("replay:") & (F.length(value) > 7), F.substring(value, F.lit(8), F.length(value)))
    kind = F.when(value.isin("onnx", "mock"), value).when(folder.isNotNull(), "replay")
    return F.struct(kind.alias("kind"), folder.alias("folder"))
