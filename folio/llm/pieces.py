"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units that no piece crosses (a run of word marks
with what follows it).  The units not seen before are concatenated and indexed
by a suffix array sorted to the length of the longest piece; every piece of the
vocabulary is binary-searched in it, all pieces at once, for its range of
occurrences.  Very long units are indexed window by window.  The occurrences are the edges of the batch; sorted by position
they are relaxed from left to right.  For a merge-ranked model an edge relaxes
its end when it may follow the last piece of its start in a canonical encoding,
which leaves one path.  Characters without a piece fall back to byte pieces.

Null text encodes as null and decodes as null; empty text as an empty list.
Very long texts are cut between units, so memory does not follow their length
but for the ids themselves.  An empty table gives no rows, repeated rows stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import bound_batches, free_name, text_slices, tidied
from folio.llm.merges import LONG_WORD, PAIR_BITS, IntTable, MergeTables, relax, relax_long

MARK = "▁"
#: Characters of text cut into units at once, of new units indexed at once, and of one very long unit.
SLICE_CHARS, INDEX_CHARS, WINDOW_CHARS = 500_000, 200_000, 100_000
#: Memory for remembered units, and what one takes besides its characters.
MEMO_BYTES, UNIT_BYTES = 32_000_000, 200


@dataclass
class PieceModel:
    pieces: list[str]
    tables: MergeTables
    #: Pieces that text can match, in the order of their texts, and those texts as code points padded with 0.
    ids: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    byte_ids: np.ndarray
    #: Byte of a byte piece, else -1.
    byte_of: np.ndarray
    units: str
    dummy_prefix: bool

    @property
    def other(self) -> int:
        """Stands for a character that no piece has."""
        return len(self.pieces)

    def piece_lengths(self) -> np.ndarray:
        """Characters of every piece, 1 for the stand-in."""
        out = np.ones(self.other + 1, np.int32)
        out[self.ids] = self.lengths
        return out


def compile_pieces(path: str) -> PieceModel:
    """Tables of a merge-ranked ``.model`` file with byte fallback and identity normalisation."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
        raise ValueError("only merge-ranked models without text normalisation are supported")
    pieces = [p.piece for p in proto.pieces]
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL}
    byte_ids = np.zeros(256, np.int32)
    byte_of = np.full(len(pieces), -1, np.int16)
    for i, p in enumerate(proto.pieces):
        if p.type == pb.ModelProto.SentencePiece.BYTE:
            byte_of[i] = int(p.piece[1:-1], 16)
            byte_ids[byte_of[i]] = i
    rank = np.full(len(pieces) + 1, -1, np.int64)
    left, right = np.zeros(len(pieces) + 1, np.int32), np.zeros(len(pieces) + 1, np.int32)
    scores = [p.score for p in proto.pieces]
    keys, values = [], []
    by_rank = sorted((i for t, i in normal.items() if len(t) > 1), key=lambda i: -scores[i])
    for r, i in enumerate(by_rank):
        text = pieces[i]
        rank[i] = r
        own = [(a, b) for k in range(1, len(text)) if (a := normal.get(text[:k])) is not None and (b := normal.get(text[k:])) is not None]
        keys += [(a << PAIR_BITS) | b for a, b in own]
        values += [i] * len(own)
    whole = set()
    made_of = dict(zip(keys, values, strict=True))
    for i in by_rank:  # a piece splits into the one pair that stands until the last merge
        parts = merged([normal.get(c, -1) for c in pieces[i]], made_of, rank, rank[i])
        if len(parts) == 2 and made_of.get((parts[0] << PAIR_BITS) | parts[1]) == i:
            left[i], right[i] = parts
            whole.add(i)
    tables = MergeTables(rank, left, right, IntTable(np.array(keys, np.int64), np.array(values, np.int32)))
    normal = {t: i for t, i in normal.items() if len(t) == 1 or i in whole}  # others never come out of merging
    texts = sorted(normal)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.zeros((len(texts), lengths.max()), np.uint32)
    for row, t in enumerate(texts):
        codes[row, : len(t)] = [ord(c) for c in t]
    if any(MARK in t.lstrip(MARK) for t in texts):
        raise ValueError("a piece crosses a word mark")
    single = "" if any("\n" in t for t in texts) else "\n"
    units = f"{single}|{MARK}+[^{MARK}{single}]*|[^{MARK}{single}]+".removeprefix("|")
    return PieceModel(pieces, tables, np.array([normal[t] for t in texts], np.int32), codes, lengths, byte_ids, byte_of, units, norm.add_dummy_prefix)


def merged(parts: list[int], made_of: dict[int, int], rank: np.ndarray, limit: int) -> list[int]:
    """parts after all merges that rank before the limit, the best first, of equals the leftmost."""
    while len(parts) > 1:
        best, at = limit, -1
        for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
            made = made_of.get((a << PAIR_BITS) | b) if a >= 0 and b >= 0 else None
            if made is not None and rank[made] < best:
                best, at = rank[made], k
        if at < 0:
            break
        parts = [*parts[:at], made_of[(parts[at] << PAIR_BITS) | parts[at + 1]], *parts[at + 2 :]]
    return parts


@dataclass
class SuffixIndex:
    """Start positions in the order of the first ``depth`` characters, with the packed keys of the first few of them."""

    text: np.ndarray
    order: np.ndarray
    #: Distinct characters; their ranks from 1 are packed, ``bits`` each, ``step`` in a key.
    alphabet: np.ndarray
    bits: int
    step: int
    keys: np.ndarray


def suffix_index(whole: np.ndarray, size: int, depth: int) -> SuffixIndex:
    """The first size characters of whole, behind which depth more are there to look at: packed keys, then rank doubling."""
    text = whole[:size]
    alphabet, rank = np.unique(text, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    first = step = min(depth, 62 // bits)
    codes = np.zeros(len(text) + step, np.int64)
    codes[: len(text)] = rank + 1
    key = codes[: len(text)].copy()
    for i in range(1, step):
        key = (key << bits) | codes[i : i + len(text)]
    packed = key
    while True:
        order = np.argsort(key)
        if step >= depth:
            return SuffixIndex(whole, order, alphabet, bits, first, packed[order])
        ordered = key[order]
        rank = np.zeros(len(text) + step, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        key = rank[: len(text)] * (len(text) + 2) + rank[step:]
        step *= 2


def occurrence_ranges(index: SuffixIndex, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix order that starts with each row of codes.

    All rows are searched by their packed first characters, those that are
    longer and present so far then by the characters behind.
    """
    width = codes.shape[1]
    inside = np.arange(width)[None, :] < lengths[:, None]
    place = np.minimum(np.searchsorted(index.alphabet, codes), len(index.alphabet) - 1)
    rows = np.nonzero(((index.alphabet[place] == codes) | ~inside).all(axis=1))[0]
    lo, hi = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    low = np.zeros(len(rows), np.int64)
    for i in range(index.step):
        low = (low << index.bits) | np.where(inside[rows, i], place[rows, i] + 1, 0)
    missing = np.maximum(index.step - lengths[rows], 0)
    lo[rows] = np.searchsorted(index.keys, low, "left")
    hi[rows] = np.searchsorted(index.keys, low + (np.int64(1) << (missing * index.bits)), "left")
    rows = rows[(lengths[rows] > index.step) & (lo[rows] < hi[rows])]
    if not len(rows):
        return lo, hi
    behind = np.arange(index.step, width)
    want, counts = codes[rows][:, index.step :], inside[rows][:, index.step :]

    def bound(after: bool) -> np.ndarray:
        a, b = lo[rows], hi[rows]
        act = np.arange(len(rows))
        while act.size:
            mid = (a[act] + b[act]) // 2
            seen = index.text[index.order[mid][:, None] + behind[None, :]]
            differs = (seen != want[act]) & counts[act]
            first = differs.argmax(axis=1)
            line = np.arange(len(act))
            any_ = differs[line, first]
            less = any_ & (seen[line, first] < want[act][line, first])
            less |= after & ~any_
            a[act] = np.where(less, mid + 1, a[act])
            b[act] = np.where(less, b[act], mid)
            act = act[a[act] < b[act]]
        return a

    lo[rows], hi[rows] = bound(False), bound(True)
    return lo, hi


class Encoder:
    """Encodes texts; remembers units seen before."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.units = re.compile(model.units)
        self.edge = re.compile(f"(?<!{MARK}){MARK}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text, as little-endian int32."""
        out = []
        for lo, hi in text_slices(texts, SLICE_CHARS):
            some = [t.replace(" ", MARK) for t in texts[lo:hi]]
            if self.model.dummy_prefix:
                some = [MARK + t if t else t for t in some]
            if hi - lo == 1 and len(some[0]) > SLICE_CHARS:
                out.append(b"".join(self._slice([part])[0] for part in self._parts(some[0])))
            else:
                out += self._slice(some)
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """A very long text in parts of about SLICE_CHARS, cut between units."""
        lo = 0
        while lo < len(text):
            cut = len(text)
            if lo + SLICE_CHARS < len(text):
                near = [m.start() for m in self.edge.finditer(text, lo + 1, lo + SLICE_CHARS)]
                far = None if near else self.edge.search(text, lo + SLICE_CHARS)
                cut = near[-1] if near else far.start() if far else len(text)
            yield text[lo:cut]
            lo = cut

    def _slice(self, texts: list[str]) -> list[bytes]:
        per_text = [self.units.findall(t) for t in texts]
        if self.held > MEMO_BYTES:
            self.memo, self.held = {}, 0
        some: list[str] = []
        size = 0
        long: dict[str, bytes] = {}
        for unit in set().union(*per_text).difference(self.memo) if per_text else ():
            if len(unit) > LONG_WORD:
                long[unit] = self._long(unit)
                continue
            if size + len(unit) > INDEX_CHARS:
                self._learn(some)
                some, size = [], 0
            some.append(unit)
            size += len(unit) + 1
        if some:
            self._learn(some)
        get = self.memo.__getitem__ if not long else lambda u: long.get(u) or self.memo[u]
        return [b"".join(map(get, units)) for units in per_text]

    def _edges(self, text: np.ndarray, size: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every occurrence of a piece that starts in the first size characters, and of characters without one; none at the ends."""
        m = self.model
        index = suffix_index(text, len(text) - m.codes.shape[1], m.codes.shape[1])
        lo, hi = occurrence_ranges(index, m.codes, m.lengths)
        n = hi - lo
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = index.order.astype(np.int32)[np.repeat((lo - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)]
        if size < len(index.order):  # what lies behind was only looked at
            own = at < size
            at, row = at[own], row[own]
        length, token = m.lengths.astype(np.int32)[row], m.ids[row]
        covered = np.zeros(size, bool)
        covered[at[length == 1]] = True
        covered[ends] = True
        bare = np.nonzero(~covered)[0].astype(np.int32)
        if len(bare):
            at = np.concatenate([at, bare])
            length = np.concatenate([length, np.ones(len(bare), np.int32)])
            token = np.concatenate([token, np.full(len(bare), m.other, np.int32)])
        return at, length, token

    def _learn(self, units: list[str]) -> None:
        """Index the units together and remember their pieces."""
        m = self.model
        text = np.frombuffer(("\0".join(units) + "\0" * (m.codes.shape[1] + 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int32, len(units))
        ends = np.cumsum(size + 1, dtype=np.int32) - 1
        starts = ends - size
        n = int(ends[-1]) + 1
        at, length, token = self._edges(text, n, ends)
        unit = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)[at]
        last, count = relax(m.tables, at, at + length, token, at + length - starts[unit], n, starts)
        del at, length, token, unit
        total = count[ends].astype(np.int64)
        stop = np.cumsum(total)
        out = np.zeros(int(total.sum()), np.int32)
        where = np.zeros(len(out), np.int32)
        node, k, act = ends.copy(), stop - 1, np.nonzero(total)[0]
        piece_len = m.piece_lengths()
        while act.size:
            t = last[node[act]]
            out[k[act]] = t
            node[act] -= piece_len[t]
            where[k[act]] = node[act]
            k[act] -= 1
            act = act[node[act] > starts[act]]
        odd = np.zeros(len(units), bool)
        odd[np.repeat(np.arange(len(units)), total)[out == m.other]] = True
        raw = out.tobytes()
        for i, (u, lo, hi) in enumerate(zip(units, (stop - total).tolist(), stop.tolist(), strict=True)):
            ids = self._fall_back(out[lo:hi], u, where[lo:hi] - starts[i]) if odd[i] else raw[4 * lo : 4 * hi]
            self.memo[u] = ids
            self.held += UNIT_BYTES + 2 * len(u) + len(ids)

    def _long(self, unit: str) -> bytes:
        """Pieces of one very long unit, indexed window by window."""
        m = self.model
        width, none = m.codes.shape[1], np.zeros(0, np.int32)

        def edges(lo: int, hi: int):
            text = np.frombuffer((unit[lo : hi + width] + "\0" * (width + 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
            at, length, token = self._edges(text, hi - lo, none)
            return at + lo, length, token

        last, counts = relax_long(m.tables, len(unit), edges, WINDOW_CHARS)
        out = np.zeros(int(counts[-1]), np.int32)
        where = np.zeros(len(out), np.int64)
        piece_len, node = m.piece_lengths(), len(unit)
        for k in range(len(out) - 1, -1, -1):
            out[k] = last[node]
            node -= int(piece_len[out[k]])
            where[k] = node
        return self._fall_back(out, unit, where) if (out == m.other).any() else out.tobytes()

    def _fall_back(self, ids: np.ndarray, unit: str, where: np.ndarray) -> bytes:
        """Byte pieces for the characters without a piece."""
        raw, byte_ids, other = ids.tobytes(), self.model.byte_ids, self.model.other
        parts, done = [], 0
        for k in np.nonzero(ids == other)[0].tolist():
            parts += [raw[4 * done : 4 * k], byte_ids[np.frombuffer(unit[where[k]].encode("utf-8", "replace"), np.uint8)].tobytes()]
            done = k + 1
        return b"".join([*parts, raw[4 * done :]])


class Decoder:
    """Texts of piece ids."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.raw = [bytes([b]) if b >= 0 else p.replace(MARK, " ").encode() for p, b in zip(model.pieces, model.byte_of.tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "piece_ids", check_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those of keep, if given) and the piece ids of the text; no shuffle.

    With check_col also whether decoding the ids gives the text back (null for
    null texts).  A column of docs named like an output, case aside, is
    replaced by it.  Only kept columns travel back, so without the text in keep
    a row costs its ids.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compile_pieces(path))
    new = {c.lower() for c in (out_col, check_col) if c}
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    if check_col:
        schema = schema.add(check_col, T.BooleanType())
    text = text_col if text_col in rest and isinstance(docs.schema[text_col].dataType, T.StringType) else free_name("piece_text", [*docs.columns, *new])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, hi in text_slices(texts, SLICE_CHARS):
                some = texts[lo:hi]
                ids = encoder.encode([t or "" for t in some])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=pa.array([t is None for t in some], pa.bool_()))]
                if check_col:
                    made.append(pa.array([None if t is None else decoder.decode(x) == t for t, x in zip(some, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in rest), *made], names=schema.names)

    sent = docs.select(*rest) if text in rest else docs.select(*rest, F.col(text_col).cast("string").alias(text))
    return sent.mapInArrow(tidied(run), schema)


def decode_pieces(docs: DataFrame, path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """All columns of docs and the text that the piece ids stand for; no shuffle."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compile_pieces(path))
    rest = [c for c in docs.columns if c.lower() != out_col.lower()]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(ids_col)
            values, bounds, gone = column.values.to_numpy(zero_copy_only=False).astype(np.int32), column.offsets.to_numpy(), column.is_null().to_pylist()
            texts = [None if no else decoder.decode(values[a:b].tobytes()) for a, b, no in zip(bounds[:-1], bounds[1:], gone, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=schema.names)

    return docs.select(*rest).mapInArrow(tidied(run), schema)


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, ids_sha256 (of the ids as little-endian int32) and round_trip (decoding gives the text back).

    Encodes and decodes in one pass; null text counts as empty.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compile_pieces(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            counts, digests, same = [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in text_slices(texts, SLICE_CHARS):
                for text, ids in zip(texts[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    same.append(decoder.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["id", "n_pieces", "ids_sha256", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), f"id {kind}, n_pieces long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)
