"""Sharded storage with size-tiered compaction and a versioned manifest.

Arrivals are written as small immutable Parquet shards.  Compaction puts shards
below the target size into tiers of similar size and merges the runs of a tier
into files of about the target size; a shard is rewritten once per tier it
rises, so at most a logarithmic number of times.  A merge reads whole shards
into one task each, without a shuffle.

The state is a manifest per version, which lists what the version adds and
removes, and every ``FULL_EVERY`` versions all shards.  A commit writes the next
manifest aside and renames it to its name, which fails if another writer was
first; readers see a whole version or the one before.  Replaced shards are
deleted after the commit unless kept for older readers.

Every row of every arrival is in exactly one live shard, duplicates, nulls and
very long texts included.  An empty arrival adds no shard.  Columns missing from
an arrival are null; new columns are refused.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import free_name
from folio.llm.storage import Files, new_path

TARGET = 128 << 20
#: A tier's shards differ by less than this factor; so many of them are merged even below the target.
FANOUT = 4
SMALLEST = 1 << 20
#: Merged files of one job, and jobs at a time.
JOB_GROUPS, JOBS = 256, 4
FULL_EVERY = 32
#: Arrivals that the report deals a table into.
ARRIVALS = 6


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: dict | None
    shards: tuple[Shard, ...]


def plan_merges(shards: list[Shard], target: int = TARGET, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups of similarly sized shards to merge; none when nothing is due."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if s.bytes < target:
            tiers.setdefault(math.floor(math.log(max(s.bytes, SMALLEST), fanout)), []).append(s)
    groups = []
    for _, tier in sorted(tiers.items()):
        group: list[Shard] = []
        for s in tier:
            group.append(s)
            if sum(x.bytes for x in group) >= target:
                groups.append(group)
                group = []
        if len(group) >= fanout:
            groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """A folder of shards with its manifests."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.files = Files(spark, self.root)

    def manifest(self) -> Manifest:
        """The latest committed version: the last full list and what was added and removed since."""
        names = sorted(self.files.sizes(f"{self.root}/manifest", ".json"))
        later = []
        for name in reversed(names):
            raw = json.loads(self.files.read(name))
            if raw["full"]:
                break
            later.append(raw)
        else:
            if not names:
                return Manifest(0, None, ())
        shards = {s["path"]: s["bytes"] for s in raw["added"]}
        for raw in reversed(later):
            for path in raw["removed"]:
                del shards[path]
            shards |= {s["path"]: s["bytes"] for s in raw["added"]}
        return Manifest(raw["version"], raw["schema"], tuple(Shard(p, n) for p, n in shards.items()))

    def commit(self, base: Manifest, schema: dict | None, added: list[Shard], removed: set[str] = frozenset()) -> Manifest:
        """Publish the version after base; fails if it exists."""
        new = Manifest(base.version + 1, schema, (*(s for s in base.shards if s.path not in removed), *added))
        aside = f"{self.root}/pending-{uuid.uuid4().hex}"
        folder = f"{self.root}/manifest"
        self.files.fs.mkdirs(self.files.path(folder))
        full = new.version % FULL_EVERY == 1
        listed = new.shards if full else added
        self.files.write(aside, json.dumps({"version": new.version, "schema": schema, "full": full, "added": [asdict(s) for s in listed], "removed": [] if full else sorted(removed)}))
        self.files.rename_new(aside, f"{folder}/v{new.version:09d}.json")
        return new

    def _write(self, rows: DataFrame, by: str | None = None) -> list[Shard]:
        """Shards of the rows' partitions, by the values of a column if it is given."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        folders = [folder] if by is None else self.files.folders(folder)
        return [Shard(p, n) for f in folders for p, n in sorted(self.files.sizes(f, ".parquet").items())]

    def _fitted(self, base: Manifest, rows: DataFrame) -> tuple[dict, DataFrame]:
        """The store's schema and the rows in it."""
        if base.schema is not None:
            known = T.StructType.fromJson(base.schema)
            if extra := set(rows.columns) - set(known.names):
                raise ValueError(f"columns not in the store: {sorted(extra)}")
            rows = rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known))
        return base.schema or json.loads(rows.schema.json()), rows

    def append(self, rows: DataFrame) -> Manifest:
        """Add an arrival; each of its partitions becomes a shard."""
        base = self.manifest()
        schema, rows = self._fitted(base, rows)
        return self.commit(base, schema, self._write(rows))

    def append_each(self, rows: DataFrame, arrival: Column) -> Iterator[Manifest]:
        """Add the rows as one arrival after another, by a number that is null nowhere; they are written in one pass, and committed one by one as the caller goes on."""
        base = self.manifest()
        schema, rows = self._fitted(base, rows)
        name = free_name("arrival", rows.columns)
        parts: dict[str, list[Shard]] = {}
        for shard in self._write(rows.withColumn(name, arrival), name):
            parts.setdefault(shard.path.rsplit("/", 2)[1], []).append(shard)
        if not parts:
            yield self.commit(base, schema, [])
        for _, shards in sorted(parts.items()):
            yield self.commit(self.manifest(), schema, shards)

    def compact(self, keep_old: bool = False) -> Manifest:
        """Merge until no tier has enough shards; one commit per round.

        A merged file is one task's; a round's files are written by a few jobs
        at a time of many tasks each.
        """
        now = self.manifest()
        while groups := plan_merges(list(now.shards), self.target, self.fanout):
            jobs = [groups[i : i + JOB_GROUPS] for i in range(0, len(groups), JOB_GROUPS)]
            merge = lambda job, now=now: self._write(reduce(DataFrame.unionAll, [self._read(now, [s.path for s in g]).coalesce(1) for g in job]))
            with ThreadPoolExecutor(JOBS) as pool:
                merged = [s for made in pool.map(inheritable_thread_target(self.spark)(merge), jobs) for s in made]
            gone = {s.path for g in groups for s in g}
            now = self.commit(now, now.schema, merged, gone)
            if not keep_old:
                for path in gone:
                    self.files.delete(path)
        return now

    def _read(self, manifest: Manifest, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(manifest.schema)).parquet(*paths)

    def rows(self, manifest: Manifest | None = None) -> DataFrame:
        """All rows of a version, with the hidden file metadata."""
        manifest = manifest or self.manifest()
        if not manifest.shards:
            return self.spark.createDataFrame([], T.StructType.fromJson(manifest.schema) if manifest.schema else T.StructType())
        return self._read(manifest, [s.path for s in manifest.shards])


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, arrivals: int = ARRIVALS) -> DataFrame:
    """Store docs as several arrivals, compacting after each, and list id, n_bytes, shard file, its size and the version of every row.

    An arrival holds the rows whose id has its remainder; all rows are stored.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, new_path(spark, "shards"), target)
    for _ in store.append_each(docs, F.pmod(F.xxhash64(id_col), F.lit(arrivals))):
        final = store.compact()
    if not final.shards:
        return spark.createDataFrame([], T.StructType([docs.schema[id_col], *T.StructType.fromDDL("n_bytes long, shard string, shard_bytes long, version int")]))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return store.rows(final).select(F.col(id_col), size.alias("n_bytes"), F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(final.version).alias("version"))
