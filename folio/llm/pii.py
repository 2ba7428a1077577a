"""Personal data: regular expressions propose, checksums confirm, context adjusts (DataFrame functions only).

Base kinds, leftmost and non-overlapping per kind: ``email``; ``ip`` with parts
of at most 255; ``card`` with 14 to 19 digits passing Luhn; ``phone`` with a
plus sign and 10 to 15 digits.  A match that fails is dropped, without retry.
The method adds ``iban`` (mod-97 must give 1), ``ssn`` and ``local_phone``
(both only with a context word near, and outside every base span).

Positions are code points, end exclusive.  A span's score starts from its kind,
rises with a context word of its kind within ``CONTEXT`` code points before it,
and falls with a word that speaks of examples.  Base spans are kept whatever
their score.  Null text counts as empty, an empty table gives no rows, repeated
rows stay.  Work grows with a text's length and with n log n of its n matches:
positions are running sums by doubling, and characters near a match are taken
from the text's bytes, which can be reached without counting characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.batches import free_name

CONTEXT = 40
#: Kinds in the order of ties.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
# The guards before the first group only keep a failing run from being tried at each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
WORDS = {
    "email": "mail|contact|write", "ip": "ip|address|server|host", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank", "ssn": "ssn|social security", "local_phone": "phone|call|tel|mobile|fax",
}
NOT_REAL = "example|sample|dummy"
RISE, FALL, KEEP = 0.3, 0.2, 0.5


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Remainder of an account number with its first four characters moved behind and letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c)))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: ~F.exists(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") > 255)),
    "card": lambda m: F.when(F.length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(False),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
    "iban": lambda m: mod97(m) == 1,
    "ssn": lambda m: F.lit(True),
    "local_phone": lambda m: F.lit(True),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative join, by doubling: log n passes over n elements."""

    def doubled(a: Column, k: Column) -> Column:
        return let(F.call_function("shiftleft", F.lit(1), k), lambda n: F.transform(a, lambda x, i: F.when(i < n, x).otherwise(join(F.get(a, i - n), x))))

    def passes(a: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)
        return F.when(F.size(a) > 1, F.aggregate(rounds, a, doubled)).otherwise(a)

    return let(values, passes)


def located(text: Column, found: Column, pattern: str) -> Column:
    """(start, end, byte_start, byte_end, match) of matches from the text between them."""

    def total(p: Column, size: Callable[[Column], Column]) -> Column:
        return running(F.transform(p["found"], lambda m, i: size(F.get(p["gaps"], i)) + size(m)), lambda a, b: a + b)

    def place(p: Column, ends: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            end, byte_end = F.get(ends["chars"], i), F.get(ends["bytes"], i)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), (byte_end - F.octet_length(m)).alias("byte_start"), byte_end.alias("byte_end"), m.alias("match"))

        return F.transform(p["found"], one)

    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, lambda p: let(F.struct(total(p, F.length).alias("chars"), total(p, F.octet_length).alias("bytes")), lambda ends: place(p, ends)))


def clear_of(base: Column, added: Column) -> Column:
    """The added spans that overlap no base span.

    In the order of base starts and added ends, an added span is clear when no
    base span before it reaches beyond its start.
    """
    event = lambda s, key, tag, reach: F.struct(key.alias("key"), F.lit(tag).alias("tag"), reach.alias("reach"), s.alias("span"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b, b["start"], 1, b["end"])), F.transform(added, lambda s: event(s, s["end"], 0, F.lit(0)))))

    def clear(e: Column) -> Column:
        reached = running(F.transform(e, lambda x: x["reach"]), F.greatest)
        return let(reached, lambda r: F.transform(F.filter(e, lambda x, i: (x["tag"] == 0) & (F.get(r, i) <= x["span"]["start"])), lambda x: x["span"]))

    return F.when(F.size(added) > 0, let(events, clear)).otherwise(added)


SPANS = "array<struct<start:int,order:int,end:int,kind:string,score:double,byte_start:int,byte_end:int>>"


def with_spans(docs: DataFrame, out_col: str = "pii", text_col: str = "text") -> DataFrame:
    """docs and an array of spans (see SPANS) sorted by start, then kind."""
    names: dict[str, str] = {}
    text = free_name("pii_text", docs.columns)
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    t = F.col(text)
    for kind in (*BASE, *ADDED):
        names[kind] = free_name(f"pii_{kind}", out.columns)
        out = out.withColumn(names[kind], F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)))

    def spans(kind: str) -> Column:
        order = (*BASE, *ADDED).index(kind)
        found = F.col(names[kind])

        def score(raw: Column, s: Column) -> Column:
            first = F.greatest(s["byte_start"] - 4 * CONTEXT, F.lit(0))  # a character takes four bytes at most
            near = F.lower(F.right(F.substring(raw, first + 1, s["byte_start"] - first).cast("string"), F.lit(CONTEXT)))
            n = F.lit(SCORES[kind]) + F.when(near.rlike(WORDS[kind]), RISE).otherwise(0.0) - F.when(near.rlike(NOT_REAL), FALL).otherwise(0.0)
            return F.round(F.least(F.lit(1.0), n), 2)

        def span(raw: Column, s: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), score(raw, s).alias("score"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end"))

        kept = F.filter(located(t, found, PATTERNS[kind]), lambda s: CHECKS[kind](s["match"]))
        scored = let(t.cast("binary"), lambda raw: F.transform(kept, lambda s: span(raw, s)))
        return F.when(F.exists(found, CHECKS[kind]), scored).otherwise(F.array()).cast(SPANS)

    base, added = free_name("pii_base", out.columns), free_name("pii_added", out.columns)
    out = out.withColumn(base, F.concat(*map(spans, BASE))).withColumn(added, F.filter(F.concat(*map(spans, ADDED)), lambda s: s["score"] >= KEEP))
    return out.withColumn(out_col, F.array_sort(F.concat(F.col(base), clear_of(F.col(base), F.col(added))))).drop(text, base, added, *names.values())


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, digest of the base spans, all spans, and the largest score (null without spans)."""
    found = with_spans(docs.select(F.col(id_col), F.col(text_col)), "pii", text_col)
    spans = F.col("pii")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["order"] < len(BASE))
    return found.select(
        id_col, *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans"),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""
    part = lambda raw, at, size: F.substring(raw, at + 1, size).cast("string")

    def build(p: Column) -> Column:
        raw, ends = p["raw"], p["ends"]

        def piece(s: Column, i: Column) -> Column:
            new = lambda at: F.when(s["byte_start"] >= at, F.concat(part(raw, at, s["byte_start"] - at), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
            return let(F.coalesce(F.get(ends, i - 1), F.lit(0)), new)

        return F.concat(F.array_join(F.transform(p["spans"], piece), ""), part(raw, F.element_at(ends, -1), F.lit(2_147_483_647)))

    reach = running(F.transform(spans, lambda s: s["byte_end"]), F.greatest)
    return let(F.struct(text.cast("binary").alias("raw"), spans.alias("spans"), reach.alias("ends")), build)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data in its text replaced; null texts stay null."""
    name = free_name("pii", docs.columns)
    t = F.col(text_col)
    out = with_spans(docs, name, text_col)
    return out.withColumn(text_col, F.when(F.size(name) > 0, redacted(t, F.col(name))).otherwise(t)).select(*docs.columns)


def _sql_kind(kind: str, pattern: str, check: str) -> str:
    order = (*BASE, *ADDED).index(kind)
    near = f"lower(substr(t, greatest(s - {CONTEXT}, 0) + 1, least(s, {CONTEXT})))"
    return f"""
  SELECT doc_id, s AS s, s + length(m) AS e, {order} AS o, '{kind}' AS kind,
         round(least(1.0, {SCORES[kind]} + CASE WHEN regexp_matches({near}, '{WORDS[kind]}') THEN {RISE} ELSE 0.0 END - CASE WHEN regexp_matches({near}, '{NOT_REAL}') THEN {FALL} ELSE 0.0 END), 2) AS score
  FROM (SELECT doc_id, t, m, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, t, ms, gaps, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS i
              FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM texts) WHERE len(ms) > 0))
  WHERE {check}"""


def report_sql() -> str:
    """The report in DuckDB SQL, for tables without repeated ids."""
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(generate_series(1, length({d})), lambda i: CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER) * (1 + (i + 1) % 2) - CASE WHEN i % 2 = 0 AND CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
    plain = "replace(m, ' ', '')"
    moved = f"substr({plain}, 5) || substr({plain}, 1, 4)"
    iban = f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CAST(CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) % 97 = 1"
    parts = [
        _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right('000' || p, 3) AS INTEGER) > 255)) = 0"),
        _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({d}) BETWEEN 14 AND 19 THEN {luhn_sql} ELSE false END"),
        _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({d}) BETWEEN 10 AND 15"),
        _sql_kind("iban", PATTERNS["iban"], iban),
        _sql_kind("ssn", PATTERNS["ssn"], "true"),
        _sql_kind("local_phone", PATTERNS["local_phone"], "true"),
    ]
    joined = lambda flt: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER ({flt}), '')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT f.* FROM found f WHERE o < {len(BASE)} OR (score >= {KEEP} AND NOT EXISTS (
  SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.o < {len(BASE)} AND b.s < f.e AND f.s < b.e)))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
       sha256({joined(f"o < {len(BASE)}")}) AS base_sha256, {joined("true")} AS spans, max(score) AS max_score
FROM texts d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
