"""Near duplicates by BagMinHash signatures, bands and verified multiset overlap.

1. One pass over the texts gives each document a digest of its words and a
   signature of its weighted word shingles, kept as band hashes and a short
   sketch.  Documents of equal digest are one class from here on, represented
   by the smallest id, so copies never meet again.
2. Representatives that share a band hash are candidates.  First every member
   of a bucket meets the bucket's smallest id; the exact weighted Jaccard of
   the whole texts decides, and linked documents become components.
3. Then, within buckets that still hold several components, members of
   different components meet, so a link between two texts that share a bucket
   can only be left out where the two are connected already.

A bucket of many members is dealt out in parts with its leader, and a leader's
text travels once to every part, not to every member.  Sketches spare texts a
comparison when their estimated similarity is so far below the threshold that
chance is out of the question (see ``SKETCH_GAP``; None compares all).

Null texts and texts without words are classes of their own, and rows with a
null id have a null class.  Rows that share an id are one document.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.bagminhash import signatures
from folio.llm.batches import bound_batches, text_slices, tidied
from folio.llm.components import connected_components
from folio.llm.shingles import mix, multisets, normalised, shingles, similarity
from folio.llm.storage import Scratch, saved

THRESHOLD = 0.8
#: At similarity 0.8 a pair shares none of the bands with probability 3e-6.
BANDS, ROWS = 32, 5
#: Two bits of every register, in five numbers.  At similarity 0.8 the sketches differ in 32 +- 6.5 bits.
SKETCH_WORDS, SKETCH_GAP = 5, 61
#: Rounds of leaders before groups are compared in blocks of so many documents and bytes at most, so many shingles at once.
ROUNDS = 2
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 4_000_000, 2048
SLICE_CHARS = 1_000_000
#: Members of a bucket, or of one leader's pairs, that go to one task with the leader.
PART = 500
#: So many ids are broadcast at most; beyond, the texts are shuffled to them.
BROADCAST_IDS = 250_000


def sketches(signature: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(mix(signature)[:, :, None].view(np.uint8)[:, :, :1], axis=2)[:, :, :2].reshape(len(signature), -1)
    return np.packbits(bits, axis=1).view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, bands, sketch); all but id null where a text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    factors = np.array([3, 5, 7, 11, 13], np.uint64)

    def run(batches):
        import pyarrow as pa

        def lists(rows: np.ndarray, width: int, none: np.ndarray):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()), mask=pa.array(none))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_slices(texts, SLICE_CHARS):
                words = [normalised(t) for t in texts[lo:hi]]
                sig = signatures(*multisets(*shingles(words)), hi - lo, BANDS * ROWS)
                bands = mix((sig.reshape(-1, BANDS, ROWS) * factors).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                none = np.array([not w for w in words], bool)
                keys = pa.array([hashlib.blake2b(w, digest_size=16).digest() if w else None for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), keys, lists(bands, BANDS, none), lists(sketches(sig), SKETCH_WORDS, none)], names=["id", "key", "bands", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    return rows.mapInArrow(tidied(run), f"id {kind}, key binary, bands array<long>, sketch array<long>")


def alike(a: str, b: str, gap: int | None) -> Column:
    """Whether two sketches leave the threshold possible."""
    if gap is None:
        return F.lit(True)
    words = (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS))
    return sum(words, F.lit(0)) <= gap


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, text) of the ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return scratch.saved(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "candidates")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose texts have at least the threshold of weighted Jaccard.

    The pairs of one a are dealt out in parts; each part's rows arrive sorted,
    the text of a first, then those of its bs, and are compared as they pass.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), id_col, text_col, scratch)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")
    dealt = pairs.join(parts, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("part"), "b")
    dealt = scratch.saved(dealt, "dealt")
    firsts = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast(kind).alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")
    rows = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        group, leaders, seen = None, [], set()
        for batch in batches:
            texts, second = batch.column("text").to_pylist(), batch.column("b")
            first = second.is_null().to_pylist()
            groups = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True))
            keep = []
            for lo, hi in text_slices(texts, SLICE_CHARS):
                words = [normalised(t) for t in texts[lo:hi]]
                doc, h, n = multisets(*shingles(words))
                order = np.lexsort((h, doc))
                h, n = h[order], n[order]
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    own = h[at[k] : at[k + 1]], n[at[k] : at[k + 1]]
                    if groups[lo + k] != group:
                        group, leaders, seen = groups[lo + k], [], set()
                    if first[lo + k]:
                        if words[k] not in seen:  # rows that share an id may hold several texts
                            seen.add(words[k])
                            leaders.append(tuple(x.copy() for x in own))
                    elif any(similarity(x, own) >= threshold for x in leaders):
                        keep.append(lo + k)
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"])

    edges = scratch.saved(rows.mapInArrow(tidied(run), f"a {kind}, b {kind}").distinct(), "edges")
    scratch.drop(texts, dealt)
    return edges


def _mixed(shared: DataFrame, found: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The buckets' members with their components, of buckets that hold several components."""
    if found is None:
        return shared.withColumn("component", F.col("rep"))
    members = scratch.saved(shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members")
    mixed = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    out = scratch.saved(members.join(mixed, "band", "left_semi"), "mixed")
    scratch.drop(members)
    return out


def _with_least(members: DataFrame, least: Column) -> DataFrame:
    """members with l, the least of their bucket; a bucket's n members are dealt out in parts, of which each gets it."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    firsts = members.groupBy("band", "part", "n").agg(F.min(least).alias("l")).groupBy("band", "n").agg(F.min("l").alias("l"))
    return members.join(firsts.select("band", "l", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["band", "part"])


def _leader_pairs(members: DataFrame, turn: int, gap: int | None) -> DataFrame:
    """(a, b): each bucket's leader of this turn with the members of other components."""
    order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    joined = _with_least(members, F.struct(order.alias("order"), "rep", "sketch", "component")).filter(F.col("component") != F.col("l.component"))
    joined = joined.select("rep", "sketch", F.col("l.rep").alias("leader"), F.col("l.sketch").alias("leader_sketch")).filter(alike("sketch", "leader_sketch", gap))
    return joined.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between small numbers."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(x), top(y)
        if i != j:
            parent[j] = i
            out.append((x, y))
    return out


def block_links(texts: list[str], left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (a spanning forest) between the texts numbered in left and those in right."""
    docs, hashes, sizes = [], [], np.zeros(len(texts), np.int64)
    for lo, hi in text_slices(texts, SLICE_CHARS):
        d, h, n = multisets(*shingles([normalised(t) for t in texts[lo:hi]]))
        sizes[lo:hi] = np.bincount(d, n, hi - lo).astype(np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # the times of a shingle are items of their own
        docs.append(np.repeat(d, n) + lo)
        hashes.append(mix(np.repeat(h, n) + step.astype(np.uint64)))
    doc, item = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])
    if not len(doc):
        return []
    order = np.argsort(item)
    doc, item = doc[order], item[order]
    new = np.concatenate([[True], item[1:] != item[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    doc, column = doc[shared], column[shared]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    row_of = np.full(len(texts), -1), np.full(len(texts), -1)
    row_of[0][left], row_of[1][right] = np.arange(len(left)), np.arange(len(right))
    overlap = np.zeros((len(left), len(right)), np.float32)
    bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        width = int(column[hi - 1]) - k * COLUMNS + 1
        sides = []
        for rows, n in zip(row_of, (len(left), len(right)), strict=True):
            own = rows[doc[lo:hi]]
            m = np.zeros((n, width), np.float32)
            m[own[own >= 0], (column[lo:hi] - k * COLUMNS)[own >= 0]] = 1
            sides.append(m)
        overlap += sides[0] @ sides[1].T
    i, j = np.nonzero(overlap >= threshold * (sizes[left][:, None] + sizes[right][None, :] - overlap) - 1e-3)
    both = overlap[i, j].astype(np.float64)
    a, b = left[i], right[j]
    ok = (a != b) & (both / np.maximum(sizes[a] + sizes[b] - both, 1) >= threshold)
    return forest(a[ok], b[ok])


def _group_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect what is linked within the groups of the members' buckets.

    A group's members are cut into blocks, and blocks meet in pairs.  A large
    component has blocks of its own, which do not meet each other: its members
    are connected already.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    groups = connected_components(_with_least(members, F.col("rep")).select(F.col("l").alias("a"), F.col("rep").alias("b")))
    groups = groups.select(F.col("node").alias("id"), F.col("component").alias("g"))
    texts = _texts(docs, groups.select("id"), id_col, text_col, scratch)
    bytes_ = texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    nodes = groups.join(members.select(F.col("rep").alias("id"), "component").distinct(), "id").join(bytes_, "id", "left")
    nodes = scratch.saved(nodes.select("id", "g", "component", F.coalesce("bytes", F.lit(0)).alias("bytes")), "nodes")
    sizes = nodes.groupBy("g", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    large = (F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES)
    sizes = sizes.select("g", "component", "n", "bytes", F.when(large, F.col("component")).alias("own"))
    count = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    blocks = sizes.groupBy("g", "own").agg(count.alias("blocks")).withColumnsRenamed({"g": "g2", "own": "own2"})
    place = sizes.join(blocks, (F.col("g") == F.col("g2")) & F.col("own").eqNullSafe(F.col("own2"))).select("g", "component", "own", "blocks")
    dealt = nodes.join(place, ["g", "component"]).select("id", "g", "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k"))
    dealt = scratch.saved(dealt.withColumn("block", F.xxhash64("own", "k")), "blocks")
    each = dealt.select("g", "own", "block").distinct()
    other = each.select("g", F.col("own").alias("own2"), F.col("block").alias("j"))
    met = each.withColumnRenamed("block", "i").join(other, "g").filter((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)))
    met = scratch.saved(met.select("g", "i", "j"), "met")
    sides = met.select("g", "i", "j", F.col("i").alias("block")).union(met.filter("i < j").select("g", "i", "j", F.col("j").alias("block")))
    placed = dealt.select("g", "block", "id").join(sides, ["g", "block"]).select("g", "i", "j", "block", "id")

    def link(rows):
        block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
        found = block_links(rows.column("text").to_pylist(), np.nonzero(block == i)[0], np.nonzero(block == j)[0], threshold)
        ids = rows.column("id")
        return rows.from_arrays([ids.take([x for x, _ in found]), ids.take([y for _, y in found])], names=["a", "b"]) if found else rows.select(["id", "id"]).slice(0, 0).rename_columns(["a", "b"])

    return scratch.saved(placed.join(texts, "id").groupBy("g", "i", "j").applyInArrow(link, f"a {kind}, b {kind}"), "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sketch_gap: int | None = SKETCH_GAP) -> DataFrame:
    """id, class_id (the smallest id of its near duplicates) and kept (whether it is that document).

    What is left behind in the shared folder is the table of ids and classes
    that the result reads.
    """
    bound_batches(docs.sparkSession)
    with Scratch(docs.sparkSession, "near-duplicates") as scratch:
        by_id = saved(_classes(docs, id_col, text_col, threshold, sketch_gap, scratch), "near-duplicate-classes")
    nameless = docs.filter(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("class_id"))
    return by_id.unionByName(nameless).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, gap: int | None, scratch: Scratch) -> DataFrame:
    """(id, class_id) of every row with an id."""
    sig = scratch.saved(signed(docs, id_col, text_col), "signatures")
    reps = scratch.saved(sig.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    banded = reps.select("rep", "sketch", F.explode("bands").alias("band"))
    several = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low < high").select("band", "n")
    shared = scratch.saved(banded.join(several, "band"), "buckets")
    edges = met = found = None
    for turn in range(ROUNDS):
        members = _mixed(shared, found, scratch)
        pairs = _leader_pairs(members, turn, gap)
        pairs = scratch.saved(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"), "pairs")
        if turn:
            scratch.drop(members)
        if pairs.isEmpty():
            break
        new = verified(pairs, docs, id_col, text_col, threshold, scratch)
        edges = new if edges is None else edges.unionByName(new)
        met = pairs if met is None else met.unionByName(pairs)
        found = connected_components(edges)
    members = _mixed(shared, found, scratch)
    if edges is not None and not members.isEmpty():
        found = connected_components(edges.unionByName(_group_links(members, docs, id_col, text_col, threshold, scratch)))
    if found is None:
        found = reps.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    classes = reps.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("class_id"))
    return sig.select("id", "key").join(classes, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class; rows with a null id stay."""
    gone = saved(near_duplicates(docs, id_col, text_col, threshold).filter("not kept").select(id_col).distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
