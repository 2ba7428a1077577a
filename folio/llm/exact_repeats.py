"""Removal of repeated byte strings, found by merging Burrows-Wheeler transforms.

A byte goes when a string of ``window`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same one.  Strings are
judged on the input and never cross documents.

1. Texts are cut into runs of windows with a common anchor (``runs``).  Equal
   runs within a task, then runs of equal anchor in a shuffle, are compared by
   two 64-bit numbers, of the anchor and of the run: of equal runs only the
   earliest stays in question.
2. What stays and shares its anchor with a different run is cut into blocks of
   neighbouring windows, dealt out by the bytes all windows of the block share.
   Equal blocks again leave the earliest.  The different ones of all groups are
   batched and indexed: each shard's transform is built, the transforms are
   merged by interleave refinement, and intervals with a common prefix of
   ``window`` bytes give the equal windows (``bwt_merge``).
3. The ranges of each document are joined to its text.

Rows that share an id are one document that may be listed repeatedly: the
ranges found in any of them apply to each.  Rows with a null id neither lose
nor cause anything.  Null text counts as empty.  Ids that are not integers
count in Spark's order of them.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import bound_batches, text_slices, tidied
from folio.llm.bwt_merge import repeats
from folio.llm.runs import WINDOW, anchored_runs
from folio.llm.storage import release, saved

SLICE_CHARS = 1_000_000
#: Runs combined at once in a task; more only means that fewer repeats are found before the shuffle.
COMBINE = 1_000_000
#: Windows of a block, and bytes indexed at once.
BLOCK = 13
INDEX_BYTES = 1_500_000


def later(group: np.ndarray, doc: np.ndarray, at: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that fall into equal groups: (row numbers that come strictly after their group's first, the firsts).

    With a second number, rows are of one group when both are equal.
    """
    none = np.zeros(0, np.int64)
    if not len(group):
        return none, none
    order = np.argsort(group, kind="stable")
    new = _changes(group[order])
    if second is not None:
        other = _changes(second[order])
        if (other & ~new).any():  # two groups share the first number
            order = np.lexsort((second, group))
            new, other = _changes(group[order]), _changes(second[order])
        new |= other
    first = np.nonzero(new)[0]
    size = np.diff(np.append(first, len(order)))
    alone = order[first[size == 1]]
    many = np.repeat(size > 1, size)
    rows, number = order[many], np.cumsum(new)[many]
    by_place = np.lexsort((at[rows], doc[rows], number))
    rows, number = rows[by_place], number[by_place]
    starts = np.nonzero(_changes(number))[0]
    head = rows[np.repeat(starts, np.diff(np.append(starts, len(rows))))]
    after = (doc[rows] != doc[head]) | (at[rows] != at[head])
    return rows[after], np.concatenate([alone, rows[starts]])


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    return np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])


def same_run(fp: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """With fp beside it, equal where both 64-bit numbers are; alone it only brings them together."""
    return fp * np.int64(0x2545F491) ^ digest


def _pack(lo, hi, anchor):
    return (lo << 16) | ((hi - lo) << 8) | (anchor - lo)


def _unpack(span):
    lo = span >> 16
    return lo, lo + ((span >> 8) & 255), lo + (span & 255)


def _table(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _find_runs(batches: Iterator) -> Iterator:
    """(done, fp, digest, doc, span) of every run that is not yet known to repeat, and done ones."""
    held: list[dict] = []

    def combined():
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        held.clear()
        gone, kept = later(same_run(c["fp"], c["digest"]), c["doc"], c["span"], c["fp"])
        rows = np.concatenate([gone, kept])
        done = np.arange(len(rows)) < len(gone)
        out = {"done": done, **{k: c[k][rows] for k in ("fp", "digest", "doc", "span")}}
        out["fp"] = np.where(done, out["doc"] * np.int64(0x9E3779B97F4A7C1), out["fp"])
        for i in range(0, len(rows), 50_000):
            yield _table({k: v[i : i + 50_000] for k, v in out.items()})

    size = 0
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        for lo, hi in text_slices(texts, SLICE_CHARS):
            r = anchored_runs([t.encode("utf-8", "replace") if t else b"" for t in texts[lo:hi]])
            held.append({"fp": r["fp"], "digest": r["digest"], "doc": ids[lo:hi][r["text"]].astype(np.int64), "span": _pack(r["lo"], r["hi"], r["anchor"])})
            size += len(r["lo"])
            if size >= COMBINE:
                yield from combined()
                size = 0
    if held:
        yield from combined()


def _compare_runs(batches: Iterator) -> Iterator:
    """(doc, span, check) of runs that repeat (check false) or may do so in part (true); rows come sorted by fp."""
    names = ("fp", "digest", "doc", "span")
    held = {k: np.zeros(0, np.int64) for k in names}

    def judged(c):
        size = np.diff(np.append(np.nonzero(np.concatenate([[True], c["fp"][1:] != c["fp"][:-1]]))[0], len(c["fp"])))
        many = np.repeat(size > 1, size)
        c = {k: v[many] for k, v in c.items()}
        if not len(c["fp"]):
            return
        gone, first = later(same_run(c["fp"], c["digest"]), c["doc"], c["span"], c["fp"])
        fps, inverse, times = np.unique(c["fp"][first], return_inverse=True, return_counts=True)
        check = first[times[inverse] > 1]
        rows = np.concatenate([gone, check])
        yield _table({"doc": c["doc"][rows], "span": c["span"][rows], "check": np.arange(len(rows)) >= len(gone)})

    for batch in batches:
        done = batch.column("done").to_numpy(zero_copy_only=False)
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        if done.any():
            yield _table({"doc": c["doc"][done], "span": c["span"][done], "check": np.zeros(int(done.sum()), bool)})
        c = {k: np.concatenate([held[k], v[~done]]) for k, v in c.items()}
        if not len(c["fp"]):
            continue
        cut = int(np.searchsorted(c["fp"], c["fp"][-1], "left"))
        held = {k: v[cut:] for k, v in c.items()}
        if cut:
            yield from judged({k: v[:cut] for k, v in c.items()})
        elif len(held["fp"]) > COMBINE:  # one anchor all along: keep the first of each run only
            gone, first = later(held["digest"], held["doc"], held["span"])
            yield _table({"doc": held["doc"][gone], "span": held["span"][gone], "check": np.zeros(len(gone), bool)})
            held = {k: v[np.sort(first)] for k, v in held.items()}
    if len(held["fp"]):
        yield from judged(held)


def _cut_blocks(batches: Iterator) -> Iterator:
    """(key, doc, lo, shift, bytes) of the blocks of the runs in question; lo is the first window, shift its place in the block."""
    import xxhash

    for batch in batches:
        out: dict[str, list] = {"key": [], "doc": [], "lo": [], "shift": [], "bytes": []}
        for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace")
            for lo, hi, anchor in (_unpack(s) for s in spans):
                if hi + WINDOW > len(raw):
                    continue  # of another text under the same id
                for k in range((anchor - hi) // BLOCK, (anchor - lo) // BLOCK + 1):
                    near, far = k * BLOCK, k * BLOCK + BLOCK - 1
                    first, last = max(lo, anchor - far), min(hi, anchor - near)
                    out["key"].append(xxhash.xxh3_64_intdigest(raw[anchor - near : anchor - far + WINDOW], k) - (1 << 63))
                    out["doc"].append(doc)
                    out["lo"].append(first)
                    out["shift"].append(first - (anchor - far))
                    out["bytes"].append(raw[first : last + WINDOW])
            if len(out["key"]) > 50_000:
                yield _block_table(out)
                out = {k: [] for k in out}
        if out["key"]:
            yield _block_table(out)


def _block_table(out: dict):
    import pyarrow as pa

    kinds = {"key": pa.int64(), "doc": pa.int64(), "lo": pa.int32(), "shift": pa.int32(), "bytes": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def equal_windows(blocks: list[tuple[int, int, bytes]], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(doc, lo, hi) of windows of the blocks (doc, lo, bytes) that equal an earlier one."""
    place, kind = repeats([b for _, _, b in blocks], window)
    if not len(place):
        return
    ends = np.cumsum([len(b) for _, _, b in blocks])
    owner = np.searchsorted(ends, place, "right")
    doc = np.array([d for d, _, _ in blocks], np.int64)[owner]
    start = np.array([lo for _, lo, _ in blocks], np.int64)
    size = np.array([len(b) for _, _, b in blocks], np.int64)
    at = start[owner] + place - (ends[owner] - size[owner])
    gone, _ = later(kind, doc, at)
    order = np.lexsort((at[gone], doc[gone]))
    d, a = doc[gone][order], at[gone][order]
    if len(d):
        cut = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > a[:-1] + 1)]))[0]
        last = np.append(cut[1:], len(d)) - 1
        yield from zip(d[cut].tolist(), a[cut].tolist(), a[last].tolist(), strict=True)


def _merge_blocks(batches: Iterator) -> Iterator:
    """(doc, lo, hi) of the repeated windows; rows come sorted by key."""
    import pyarrow as pa

    found: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, bytes]] = []
    size = 0
    key, firsts = None, {}

    def table():
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        found.clear()
        return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc", "lo", "hi"), columns, strict=True)})

    def close():
        nonlocal size, waiting
        if len(firsts) > 1:
            waiting += [(d, lo, b) for (_, b), (d, lo) in firsts.items()]
            size += sum(len(b) for _, b in firsts)
        if size >= INDEX_BYTES:
            found.extend(equal_windows(waiting))
            waiting, size = [], 0

    for batch in batches:
        for k, doc, lo, shift, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "lo", "shift", "bytes")), strict=True):
            if k != key:
                close()
                key, firsts = k, {}
            here, was = (doc, lo), firsts.get((shift, raw))
            if was is None or here < was:
                firsts[shift, raw] = here
            if was is not None and here != was:
                d, at = max(here, was)
                found.append((d, at, at + len(raw) - WINDOW))
        if found:
            yield table()
    close()
    if waiting:
        found.extend(equal_windows(waiting))
    yield table()


def _strip(batches: Iterator) -> Iterator:
    """Counts and digest of every text without its repeated bytes."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for text, los, his in zip(batch.column("text").to_pylist(), batch.column("los").to_pylist(), batch.column("his").to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace") if text else b""
            gone = removed_spans(len(raw), los or [], his or [])
            at, parts = 0, []
            for a, b in gone:
                parts.append(raw[at:a])
                at = b
            kept = b"".join([*parts, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(size: int, los: list[int], his: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal ranges of bytes covered by the windows that start in lo..hi."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(los, his, strict=True)):
        end = min(size, hi + window)
        if lo >= end:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lo, hi): ranges of starts of windows that also start earlier."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    runs = texts.filter(F.octet_length("text") >= WINDOW).mapInArrow(tidied(_find_runs), "done boolean, fp long, digest long, doc long, span long")
    judged = saved(runs.repartition("fp").sortWithinPartitions("fp").mapInArrow(tidied(_compare_runs), "doc long, span long, check boolean"), "runs")
    release(spark)
    asked = judged.filter("check").groupBy("doc").agg(F.collect_set("span").alias("spans"))
    parts = texts.withColumnRenamed("id", "doc").join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "spans")
    blocks = parts.mapInArrow(tidied(_cut_blocks), "key long, doc long, lo int, shift int, bytes binary")
    merged = saved(blocks.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(_merge_blocks), "doc long, lo long, hi long"), "windows")
    release(spark)
    lo = F.shiftrightunsigned("span", 16)
    whole = judged.filter("not check").select("doc", lo.alias("lo"), (lo + F.shiftrightunsigned("span", 8).bitwiseAND(F.lit(255))).alias("hi"))
    return whole.unionByName(merged)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, text): integer ids are their own numbers, others get numbers that rise in their order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return rows.withColumn("number", F.col("id").cast("long"))
    places = saved(rows.select("id").filter("id is not null").distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()), "places")
    return rows.join(places, "id", "left")


def exact_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed ranges) and kept_sha256 of every row."""
    rows = numbered(docs, id_col, text_col)
    found = repeated_windows(rows, "number", "text").groupBy(F.col("doc").alias("own")).agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    found = found.select("own", F.col("r.lo").alias("los"), F.col("r.hi").alias("his"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(found.hint("shuffle_hash"), F.col("number") == F.col("own"), "left").select("id", "text", "los", "his")
    return joined.mapInArrow(tidied(_strip), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
