"""Approximate nearest neighbours by collision counting.

1. Every vector gets a place in a tree of median splits along principal
   directions, fitted on at most ``SAMPLE`` vectors; a leaf's vectors are dealt
   into blocks of bounded size.  Every vector is indexed.
2. A block keeps, for each of m random projections, its vectors in sorted
   order.  A query looks at a window centred on its own projection in every
   sorted array; a vector collides in each window that holds it, and one that
   collides in at least ``THRESHOLD`` of the m windows is verified by its exact
   distance.  In the leaf of the query itself the windows widen by a constant
   factor (virtual rehashing: no second index is built) until the kth verified
   distance lies within the radius the windows stand for and enough vectors were
   verified, or the windows hold the block.
3. With that kth distance a query visits the other leaves, but those whose
   vectors are all farther: a leaf's extent along orthonormal directions bounds
   its distance from below.  There one window of that radius is enough.

A task reads a block's vectors once, indexes them once and answers the block's
queries as they pass, so neither the queries nor the data gather anywhere.

Vectors that are null, zero or hold null or non-finite components take no part;
neither do rows with a null id.  Vectors meet only those of their own
dimension.  Equal distances go to the smaller id; rows that share an id are
separate rows, each with its own neighbours.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.batches import bound_batches, tidied
from folio.llm.storage import Scratch, saved

BLOCK_ROWS = 8192
QUERY_ROWS = 256
PROJECTIONS = 48
#: Share of the windows that a candidate must be in; share of a block to verify at least; factor of widening.
THRESHOLD, VERIFY, WIDEN = 0.6, 0.02, 1.15
#: Windows reach this share of the kth distance before a search ends; at 0.84 a vector at that distance has its threshold of collisions half of the time.
REACH = 0.98
#: Vectors that the tree is fitted on, its leaves and its directions at most.
SAMPLE, LEAVES, DIRECTIONS = 20_000, 4096, 16
KEY = ["dim", "leaf", "sub"]


@dataclass
class Tree:
    """Median splits: node i goes to 2i + 1 (below its cut) or 2i + 2; leaves are numbered from 0."""

    centre: np.ndarray
    directions: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    depth: int

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the directions, and the leaf, of every vector."""
        at = (vectors - self.centre) @ self.directions
        node = np.zeros(len(at), np.int64)
        for _ in range(self.depth):
            below = at[np.arange(len(at)), self.axis[node]] < self.cut[node]
            node = 2 * node + np.where(below, 1, 2)
        return at, (node - (2**self.depth - 1)).astype(np.int32)


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    """A tree of at least so many leaves, with a split where the sample varies most."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    centre = sample.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((sample - centre).T).reshape(sample.shape[1], -1))
    directions = vectors[:, ::-1][:, :DIRECTIONS]
    at = (sample - centre) @ directions
    axis, cut = np.zeros(2**depth, np.int64), np.zeros(2**depth)
    members = [np.arange(len(at))]
    for node in range(2**depth - 1):
        own = at[members[node]]
        if len(own) > 1:
            axis[node] = int(own.var(axis=0).argmax())
            cut[node] = float(np.median(own[:, axis[node]]))
        below = own[:, axis[node]] < cut[node]
        members += [members[node][below], members[node][~below]]
        members[node] = members[node][:0]
    return Tree(centre, directions, axis, cut, depth)


class BlockIndex:
    """The sorted projections of a block."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        keys = vectors @ self.lines
        order = np.argsort(keys, axis=0, kind="stable")
        self.ranked = np.ascontiguousarray(np.take_along_axis(keys, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int, within: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """(distance, id) of the k nearest found of each query; the row of that number is left out.

        With a distance for each query, one window of that radius is looked at.
        """
        n = len(self.ids)
        ranked, order = self.ranked, self.order
        centre = queries @ self.lines
        need = math.ceil(THRESHOLD * PROJECTIONS)
        least = min(n, k + 1 + math.ceil(VERIFY * n))
        best: list[list[tuple[float, int]]] = [[] for _ in rows]
        hits = np.zeros((len(rows), n), np.uint8)
        was_lo = np.stack([np.searchsorted(ranked[i], centre[:, i], "left") for i in range(PROJECTIONS)])
        was_hi = was_lo.copy()
        lo, hi = np.empty_like(was_lo), np.empty_like(was_lo)
        verified = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        spread = float(np.median(ranked[:, -1] - ranked[:, 0])) or 1.0
        half = np.full(len(rows), spread / 64) if within is None else np.where(np.isfinite(within), within / REACH, 2 * spread + np.abs(centre).max())
        while open_.size:
            for i in range(PROJECTIONS):
                lo[i, open_] = np.searchsorted(ranked[i], centre[open_, i] - half[open_], "left")
                hi[i, open_] = np.searchsorted(ranked[i], centre[open_, i] + half[open_], "right")
            whole = ((lo == 0) & (hi == n)).all(axis=0)
            still = []
            for q in open_:
                parts = [order[i, a:b] for i in range(PROJECTIONS) for a, b in ((lo[i, q], was_lo[i, q]), (was_hi[i, q], hi[i, q])) if a < b]
                before = hits[q] >= need
                if parts:
                    hits[q] += np.bincount(np.concatenate(parts), minlength=n).astype(np.uint8)
                was_lo[:, q], was_hi[:, q] = lo[:, q], hi[:, q]
                new = np.nonzero((hits[q] >= need) & ~before)[0]
                if new.size:
                    verified[q] += len(new)
                    new = new[self.rows[new] != rows[q]]
                    gap = self.vectors[new] - queries[q]
                    distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    best[q] = sorted(best[q] + list(zip(distance.tolist(), self.ids[new].tolist(), strict=True)))[:k]
                if within is None and not whole[q] and not (len(best[q]) == k and verified[q] >= least and best[q][-1][0] * REACH <= half[q]):
                    still.append(q)
            open_ = np.array(still, np.int64)
            half = half * WIDEN
        return best


def _usable(df: DataFrame, id_col: str, vector_col: str, asked: Column) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))


def _matrix(batch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _searched(data: DataFrame, asked: DataFrame, k: int, bounded: bool) -> DataFrame:
    """(query, query_id, id, score) of the k nearest found in each block that a query is sent to."""
    sides = data.select(*KEY, F.lit(0).alias("side"), "row", "id", "v", F.lit(None).cast("double").alias("within"))
    sides = sides.unionByName(asked.select(*KEY, F.lit(1).alias("side"), "row", "id", "v", "within"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*KEY, "side")], axis=1)
            cuts = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))[0].tolist() if len(keys) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                dim, side = int(keys[lo, 0]), int(keys[lo, -1])
                if tuple(keys[lo, :-1]) != key:
                    key, held, index = tuple(keys[lo, :-1]), [], None
                own = batch.slice(lo, hi - lo)
                rows, ids, vectors = own.column("row").to_numpy(), own.column("id").to_numpy(), _matrix(own, "v", dim)
                if side == 0:
                    held.append((rows, ids, vectors))
                    continue
                if index is None and held:
                    index, held = BlockIndex(*map(np.concatenate, zip(*held, strict=True))), []
                if index is None:
                    continue
                within = own.column("within").to_numpy(zero_copy_only=False) if bounded else None
                for at in range(0, len(rows), QUERY_ROWS):
                    some = slice(at, at + QUERY_ROWS)
                    found = index.search(rows[some], vectors[some], k, within[some] if bounded else None)
                    out = [(r, i, v, d) for r, i, best in zip(rows[some].tolist(), ids[some].tolist(), found, strict=True) for d, v in best]
                    columns = list(zip(*out, strict=True)) if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "query_id", "id", "score"])

    return sides.repartition(*KEY).sortWithinPartitions(*KEY, "side").mapInArrow(tidied(run), "query long, query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column | DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), id and score (Euclidean distance) of the k nearest found of each query.

    Queries are the rows of vectors that meet a condition, each searched among
    all rows but itself; or the rows of another table, searched among all.
    """
    bound_batches(vectors.sparkSession)
    with Scratch(vectors.sparkSession, "nearest") as scratch:
        found = saved(_nearest(vectors, queries, k, id_col, vector_col, block_rows, scratch), "nearest-found")
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _nearest(vectors: DataFrame, queries: Column | DataFrame, k: int, id_col: str, vector_col: str, block_rows: int, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    foreign = isinstance(queries, DataFrame)
    data = scratch.saved(_usable(vectors, id_col, vector_col, F.lit(False) if foreign else queries).withColumn("row", F.monotonically_increasing_id()), "rows")
    if foreign:
        asked = scratch.saved(_usable(queries, id_col, vector_col, F.lit(True)).withColumn("row", -1 - F.monotonically_increasing_id()), "asked")
    main = data.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim")).alias("m"), F.sum("n").alias("all")).first()
    n, dim = main.m or (0, 0)
    leaves = min(LEAVES, math.ceil(n / block_rows))
    tree = None
    if leaves > 1:
        sample = data.filter(F.col("dim") == dim).select("v").sample(min(1.0, 1.2 * SAMPLE / n), seed=11).limit(SAMPLE).collect()
        tree = fit_tree(np.array([r.v for r in sample]), leaves) if len(sample) > 1 else None
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.num_rows
            leaf, at = np.zeros(rows, np.int32), [None] * rows
            own = np.nonzero(batch.column("dim").to_numpy(zero_copy_only=False) == dim)[0]
            if shared.value is not None and len(own):
                where, leaf[own] = shared.value.place(_matrix(batch.take(pa.array(own)), "v", dim))
                for i, row in zip(own.tolist(), where.tolist(), strict=True):
                    at[i] = row
            names = ["row", "id", "asked", "dim", "v"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(leaf), pa.array(at, pa.list_(pa.float64()))], names=[*names, "leaf", "at"])

    kinds = "row long, id long, asked boolean, dim int, v array<double>, leaf int, at array<double>"
    placed = scratch.saved(data.select("row", "id", "asked", "dim", "v").mapInArrow(tidied(place), kinds), "placed")
    goes = placed.filter("asked") if not foreign else asked.select("row", "id", "asked", "dim", "v").mapInArrow(tidied(place), kinds)
    # blocks of each leaf of the main dimension, at most LEAVES rows; the rest is dealt by its number
    sizes = placed.filter(F.col("dim") == dim).groupBy("leaf").agg(F.count("*").alias("n"), *(f(F.get("at", i)).alias(f"{name}{i}") for i in range(min(DIRECTIONS, dim)) for name, f in (("lo", F.min), ("hi", F.max)))).collect()
    subs = [(int(dim), r.leaf, max(1, math.ceil(r.n / block_rows))) for r in sizes]
    table = F.broadcast(spark.createDataFrame(subs, "dim int, leaf int, subs int"))
    subs_else = max(1, math.ceil(((main["all"] or 0) - n) / block_rows))
    dealt = lambda df: df.join(table, ["dim", "leaf"], "left").withColumn("subs", F.coalesce("subs", F.when(F.col("dim") == dim, 0).otherwise(subs_else)))
    everywhere = lambda df: df.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    blocks = dealt(placed).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    blocks = scratch.saved(blocks.select(*KEY, "row", "id", "v"), "blocks")
    at_home = everywhere(dealt(goes).filter("subs > 0")).withColumn("within", F.lit(None).cast("double"))
    first = scratch.saved(_ranked(_searched(blocks, at_home, k, False), k), "first")
    if tree is None:
        return first
    reach = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("within"))
    bounds = sorted(sizes, key=lambda r: r.leaf)
    low, high = (np.array([[r[f"{name}{i}"] for i in range(min(DIRECTIONS, dim))] for r in bounds]) for name in ("lo", "hi"))
    extents = spark.sparkContext.broadcast((np.array([r.leaf for r in bounds], np.int32), low, high))

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, low, high = extents.value
        for batch in batches:
            others = []
            for at, home, within in zip(_matrix(batch, "at", low.shape[1]), batch.column("leaf").to_pylist(), batch.column("within").to_pylist(), strict=True):
                gap = np.maximum(np.maximum(low - at, at - high), 0)
                near = np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-9) <= within
                others.append(numbers[near & (numbers != home)])
            names = ["row", "id", "dim", "v", "within"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(others, pa.list_(pa.int32()))], names=[*names, "leaves"])

    away = goes.filter(F.col("dim") == dim).join(reach, "row", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    away = away.select("row", "id", "dim", "v", "leaf", "at", "within").mapInArrow(tidied(route), "row long, id long, dim int, v array<double>, within double, leaves array<int>")
    away = everywhere(dealt(away.withColumn("leaf", F.explode("leaves"))))
    return _ranked(first.drop("rank").unionByName(_searched(blocks, away, k, True)), k)
