"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are put in lower case, ASCII punctuation and white space become
single spaces, and the UTF-8 bytes are compared.  An item of n bytes may differ
by k = floor(error_rate * n) edits; cut into k + 1 pieces, one piece is intact
in every such occurrence.  All pieces of all items are found in one pass over a
text, and around each hit the whole item is verified with Myers' bit-parallel
edit distance.

Items of fewer than ``SHORT`` normalised bytes are looked for exactly, as whole
words, for with an edit or inside a word they would be found anywhere.

The items are broadcast in blocks of at most ``block_bytes``, which bounds what
a worker compiles of them (some 60 times as much); a larger benchmark takes more
passes.  Null items and items without a letter or digit are never found; null
and empty texts have no hits.  Several occurrences of an item in a text, and
rows of the benchmark that share an id, are one hit with the smallest distance.
Very long texts are searched whole.  Empty tables give no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import shingles
from folio.llm.batches import append_columns, free_name
from folio.llm.storage import saved

#: Items below so many normalised bytes are looked for exactly; items compiled at once; items whose masks are kept.
SHORT = 24
BLOCK_BYTES = 2_000_000
KEPT_MASKS = 2000


def normalised(text: str) -> str:
    """Normalised bytes, one character each."""
    return shingles.normalised(text).decode("latin-1")


def edit_search(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between the pattern and any substring of text, and the first place where one ends."""
    pv, mv, score, best, where = (1 << m) - 1, 0, m, m, 0
    full, top = pv, 1 << (m - 1)
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, where = score, i
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, where


class Matcher:
    """Finds items in texts within their error budgets."""

    def __init__(self, items: Iterable[tuple[object, str]], error_rate: float, short: int = SHORT):
        import ahocorasick

        self.items: list[tuple[object, str, int, bool]] = []
        self.masks: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            text = normalised(text)
            if not text:
                continue
            k = 0 if len(text) < short else min(math.floor(error_rate * len(text)), len(text) - 1)
            for j in range(k + 1):
                lo, hi = len(text) * j // (k + 1), len(text) * (j + 1) // (k + 1)
                pieces.setdefault(text[lo:hi], []).append((len(self.items), lo))
            self.items.append((item, text, k, len(text) < short))
        self.pieces = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.pieces.add_word(piece, (len(piece), owners))
        if pieces:
            self.pieces.make_automaton()
        self.any = bool(pieces)

    def _masks(self, number: int) -> dict[str, int]:
        """Places of each character in an item; made when first verified, some are kept."""
        if number not in self.masks:
            if len(self.masks) >= KEPT_MASKS:
                self.masks.clear()
            masks = self.masks[number] = {}
            for i, c in enumerate(self.items[number][1]):
                masks[c] = masks.get(c, 0) | 1 << i
        return self.masks[number]

    def hits(self, text: str | None) -> list[tuple[object, int]]:
        """(item id, smallest distance) of the items found, in the order of the benchmark."""
        if not text or not self.any:
            return []
        text = normalised(text)
        found: dict[object, int] = {}
        starts: dict[int, set[int]] = {}
        for end, (size, owners) in self.pieces.iter(text):
            for number, offset in owners:
                starts.setdefault(number, set()).add(end - size + 1 - offset)
        for number, at in sorted(starts.items()):
            item, whole, k, words = self.items[number]
            if words:
                if any((s == 0 or text[s - 1] == " ") and text[s + len(whole) : s + len(whole) + 1] in ("", " ") for s in at):
                    found[item] = 0
                continue
            done = -1
            for start in sorted(at):
                lo, hi = max(0, start - k), min(len(text), start + len(whole) + k)
                if hi <= done or found.get(item) == 0:
                    continue  # its window was searched with the one before
                distance, _ = (0, 0) if text.startswith(whole, max(0, start)) else edit_search(self._masks(number), len(whole), text[lo:hi])
                done = hi if distance else done
                if distance <= k:
                    found[item] = min(distance, found.get(item, distance))
        return list(found.items())


def with_leaks(docs: DataFrame, benchmark: DataFrame, out_col: str = "leaks", error_rate: float = 0.06, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs and an array of (item_id, distance) of the benchmark items found in its text.

    One pass over docs for a benchmark of one block; each further block's pass
    reads what the pass before it wrote.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    kind = T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("distance", T.IntegerType())]))
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    parts = []
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared = sc.broadcast(sorted((r.i, r.t) for r in own.collect()))

        def start(shared=shared):
            matcher = Matcher(shared.value, error_rate)
            return lambda texts: [([{"item_id": i, "distance": d} for i, d in matcher.hits(t)],) for t in texts]

        name = out_col if blocks == 1 else free_name(f"{out_col}_{b}", docs.columns)
        docs = append_columns(docs, text_col, [T.StructField(name, kind)], start)
        if blocks > 1:
            docs = saved(docs, "leaks")
        parts.append(name)
    if blocks == 1:
        return docs
    best = F.transform(F.array_distinct(F.transform(F.concat(*parts), lambda x: x["item_id"])), lambda i: F.struct(i.alias("item_id"), F.array_min(F.transform(F.filter(F.concat(*parts), lambda x: x["item_id"] == i), lambda x: x["distance"])).alias("distance")))
    return docs.withColumn(out_col, best).drop(*parts)


def leak_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row (id, item_id, distance) for each document row and benchmark item found in it."""
    found = with_leaks(docs.select(F.col(id_col), F.col(text_col)), benchmark, "leaks", text_col=text_col, **options)
    return found.select(id_col, F.explode("leaks").alias("leak")).select(id_col, "leak.item_id", "leak.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark item is found."""
    name = free_name("leaks", docs.columns)
    return with_leaks(docs, benchmark, name, **options).filter(F.size(name) == 0).drop(name)
