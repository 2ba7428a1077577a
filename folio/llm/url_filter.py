"""URL filtering by a temporal list join (DataFrame functions only).

A list is a set of dated entries ``(kind, pattern, action, valid_from)``.  The
entries of one (kind, pattern) become validity intervals, each ending where the
next begins.  A capture is looked up under its host, every parent domain and
every path prefix, and joined with the entry of each that was active when it
was fetched.  The most specific active entry decides: a longer path prefix
before a shorter one, then the host, then longer domains before shorter.

kinds: ``host`` (exact), ``domain`` (the host or one below it), ``prefix`` (host
and leading path segments).  Patterns are lower case without scheme, port or
trailing slash.  Two entries of one pattern on one day count as the
alphabetically last action.  A capture with a null or unreadable URL, a null
fetch date or no active entry is allowed with a null rule.  Identical captures
give one row.  Without captures there are no rows, without entries all captures
are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def url_host(url: Column) -> Column:
    """Lower-case host without credentials, port and trailing dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_segments(url: Column) -> Column:
    """Non-empty path segments, lower case."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(F.lower(path), "/"), lambda x: x != "")


def lookup_keys(host: Column, segments: Column, max_depth: int, fewest: int = 1) -> Column:
    """Array of (kind, pattern, weight) under which an entry may name the capture: its host, parent domains of at least ``fewest`` labels, path prefixes."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    one = lambda kind, pattern, weight: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), weight.cast("int").alias("weight"))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: n - i + 1 >= fewest)
    domains = F.transform(places, lambda i: one("domain", F.array_join(F.slice(labels, i, n), "."), n - i))
    keys = F.concat(F.array(one("host", host, F.lit(1000))), domains)
    if max_depth:
        depth = F.least(F.size(segments), F.lit(max_depth))
        prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: one("prefix", F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i), "/")), 1000 + i))
        keys = F.when(depth > 0, F.concat(keys, prefixes)).otherwise(keys)
    return keys


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, action, valid_from, valid_to): valid_to is exclusive, null for the last."""
    dated = entries.filter("kind is not null and pattern is not null and action is not null and valid_from is not null").groupBy("kind", "pattern", "valid_from").agg(F.max("action").alias("action"))
    following = F.lead("valid_from").over(Window.partitionBy("kind", "pattern").orderBy("valid_from"))
    return dated.withColumn("valid_to", following).select("kind", "pattern", "action", "valid_from", "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id, url, fetched, blocked, and the deciding rule's kind, pattern and start of every capture."""
    active = validity_intervals(entries)
    # keys that no entry can have are not made: deeper prefixes, and domains of fewer labels, such as a top-level one that every other capture shares
    prefix, domain = F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1), F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    bounds = active.agg(F.max(prefix).alias("depth"), F.min(domain).alias("fewest")).first()
    depth, fewest = bounds.depth or 0, bounds.fewest or 1_000
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched"))
    keyed = rows.withColumn("host", url_host(F.col("url"))).withColumn("segments", url_segments(F.col("url")))
    keyed = keyed.select("id", "url", "fetched", F.explode_outer(F.when(F.col("host").isNotNull(), lookup_keys(F.col("host"), F.col("segments"), depth, fewest))).alias("k"))
    keyed = keyed.select("id", "url", "fetched", "k.kind", "k.pattern", "k.weight")
    a = active.withColumnsRenamed({"kind": "a_kind", "pattern": "a_pattern"})
    on = (F.col("kind") == F.col("a_kind")) & (F.col("pattern") == F.col("a_pattern")) & (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    joined = keyed.join(a, on, "left")
    rule = F.when(F.col("a_kind").isNotNull(), F.struct("weight", "action", "kind", "pattern", "valid_from"))
    best = joined.groupBy("id", "url", "fetched").agg(F.max(rule).alias("rule"))
    return best.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(time_col),
        F.coalesce(F.col("rule.action") == BLOCK, F.lit(False)).alias("blocked"),
        F.col("rule.kind").alias("rule_kind"), F.col("rule.pattern").alias("rule_pattern"), F.col("rule.valid_from").alias("rule_from"),
    )


def _number(text: Column) -> Column:
    """A stable small number of a string, the same in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def dated_pages(pages: DataFrame) -> DataFrame:
    """The table has no fetch time; one of 366 days follows from page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def sample_list(pages: DataFrame) -> DataFrame:
    """The tables have no list; dated entries follow from the hosts, parent domains and first path segments seen."""
    url = F.col("url")
    seen = pages.select(url_host(url).alias("host"), F.get(url_segments(url), 0).alias("segment")).filter("host is not null").distinct()
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    entry = lambda action, date: F.struct(F.lit(action).alias("action"), date.alias("valid_from"))
    n = _number(F.col("pattern"))
    hosts = seen.select(F.lit("host").alias("kind"), F.col("host").alias("pattern")).distinct().filter(n % 3 == 0)
    hosts = hosts.select("kind", "pattern", F.explode(F.array(entry(BLOCK, day("2024-01-01", n % 200)), entry(ALLOW, day("2024-03-01", n % 200)), entry(BLOCK, day("2024-05-01", n % 200)))).alias("e"))
    domains = seen.select(F.lit("domain").alias("kind"), F.regexp_replace("host", r"^[^.]+\.", "").alias("pattern")).distinct().filter((n % 4 == 0) & F.col("pattern").contains("."))
    domains = domains.select("kind", "pattern", F.explode(F.array(entry(BLOCK, day("2024-02-01", n % 150)))).alias("e"))
    prefixes = seen.filter("segment is not null").select(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "segment").alias("pattern")).distinct().filter(n % 5 == 0)
    prefixes = prefixes.select("kind", "pattern", F.explode(F.array(entry(ALLOW, day("2024-01-15", n % 300)))).alias("e"))
    return hosts.unionByName(domains).unionByName(prefixes).select("kind", "pattern", "e.action", "e.valid_from")


FILTER_SQL = r"""
WITH seen AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
         list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)), '/'), lambda x: x <> '') AS seg
  FROM pages),
names AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM seen WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'domain', regexp_replace(host, '^[^.]+\.', '') FROM seen WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'prefix', host || '/' || seg[1] FROM seen WHERE host IS NOT NULL AND len(seg) > 0),
numbered AS (SELECT kind, pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS INTEGER) AS n FROM names),
entries AS (
  SELECT kind, pattern, 'block' AS action, CAST(DATE '2024-01-01' + n % 200 AS DATE) AS valid_from FROM numbered WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT kind, pattern, 'allow', CAST(DATE '2024-03-01' + n % 200 AS DATE) FROM numbered WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT kind, pattern, 'block', CAST(DATE '2024-05-01' + n % 200 AS DATE) FROM numbered WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT kind, pattern, 'block', CAST(DATE '2024-02-01' + n % 150 AS DATE) FROM numbered WHERE kind = 'domain' AND n % 4 = 0 AND contains(pattern, '.')
  UNION ALL SELECT kind, pattern, 'allow', CAST(DATE '2024-01-15' + n % 300 AS DATE) FROM numbered WHERE kind = 'prefix' AND n % 5 = 0),
active AS (SELECT *, lead(valid_from) OVER (PARTITION BY kind, pattern ORDER BY valid_from) AS valid_to FROM entries),
keys AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS pattern, 1000 AS weight FROM seen
  UNION ALL SELECT page_id, url, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'), len(string_split(host, '.')) - i
    FROM (SELECT *, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM seen WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, url, fetched, 'prefix', host || '/' || seg[1], 1001 FROM seen WHERE len(seg) > 0),
ranked AS (
  SELECT k.page_id, k.url, k.fetched, a.action, a.kind, a.pattern, a.valid_from,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched ORDER BY (a.kind IS NULL), k.weight DESC) AS r
  FROM keys k LEFT JOIN active a ON k.kind = a.kind AND k.pattern = a.pattern AND a.valid_from <= k.fetched AND (a.valid_to IS NULL OR k.fetched < a.valid_to))
SELECT page_id, url, fetched, coalesce(action = 'block', false) AS blocked, kind AS rule_kind, pattern AS rule_pattern, valid_from AS rule_from
FROM ranked WHERE r = 1
"""
