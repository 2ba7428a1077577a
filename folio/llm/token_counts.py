"""Token counts by a compiled finite-state tokenizer.

``compile_tokenizer`` turns a word-end BPE vocabulary into a deterministic
transducer over a word's bytes: a symbol trie proposes the tokens that end at
each position, exactly one of them agrees with the last token of the position
where it starts, and that transition adds one to the count it carries.

Text is cut into chunks at any position, words included.  A chunk's map sends
a state, the fragment of a word that is pending before it, to the number of
tokens it emits and the fragment pending behind it.  It is stored as what a
state is joined to (``head``), the tokens emitted between the first and the
last gap (``count``) and what stays pending (``tail``).  Maps compose
associatively; those of every text are combined as a balanced prefix scan.  A
special string is a map that emits one token and leaves nothing pending.

Results: null text counts as empty (0 tokens, 0 bytes).  Special strings inside
a text count as one token each, as the library's default has it.  An empty
table gives no rows, repeated rows stay, and of a very long text only its chunk
maps are held beside it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.batches import bound_batches, tidied
from folio.llm.merges import LONG_WORD, PAIR_BITS, IntTable, MergeTables, relax, relax_long

SYMBOL_BITS = 10
#: Added to a word's last byte.
WORD_END = 256
CHUNK = 1 << 16
#: Bytes of a very long word relaxed at once.
WINDOW_BYTES = 100_000
#: Characters of text worked on at once, and words remembered by a worker; both bound memory only.
SLICE_CHARS = 2_000_000
MEMO_WORDS = 300_000

#: Fixed values of the vocabulary's pre-tokenizer: its pattern and what counts as white space there.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ANY_TEXT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
PLAIN_TEXT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zµß-öø-ÿ]+|[0-9]|[^ \t\n\x0b\x0c\ra-zµß-öø-ÿ0-9]+")
#: Outside these characters the general pattern is used.
PLAIN_ONLY = re.compile(r"[\t\n\r -~¡-©«-±´-¸»¿-ÿ]*\Z")
GAP = re.compile(f"[{SPACE}]")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write it, to the byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Transducer:
    tables: MergeTables
    trie: IntTable
    accepts: np.ndarray
    specials: list[str]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (a pre-token with its word end)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int32)
        short = np.nonzero(size <= LONG_WORD)[0]
        if len(short):
            out[short] = self._lock_step([raw[i] for i in short], size[short])
        for i in np.nonzero(size > LONG_WORD)[0]:
            out[i] = self._long(raw[i])
        return out

    def _lock_step(self, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        stop = np.cumsum(size)
        symbols[stop - 1] += WORD_END
        word = np.repeat(np.arange(len(size)), size)
        start, length, token = self._edges(symbols, np.arange(len(symbols)), stop[word])
        shift, ends = start + word[start], stop + np.arange(len(size))  # a node more than bytes in each word
        _, count = relax(self.tables, shift, shift + length, token, start - (stop - size)[word[start]] + length, len(symbols) + len(size), ends - size)
        return count[ends]

    def _long(self, raw: bytes) -> int:
        longest = self.longest()

        def edges(lo: int, hi: int):
            symbols = np.frombuffer(raw[lo : hi + longest], np.uint8).astype(np.int64)
            if hi + longest >= len(raw):
                symbols[-1] += WORD_END
            start, length, token = self._edges(symbols, np.arange(hi - lo), np.full(hi - lo, len(symbols)))
            return start + lo, length, token

        return int(relax_long(self.tables, len(raw), edges, WINDOW_BYTES)[1][-1])

    def longest(self) -> int:
        """Bytes of the longest token at most: a symbol's parent has the smaller number, so depths follow in one pass."""
        used = self.trie.keys >= 0
        parent, child = self.trie.keys[used] >> SYMBOL_BITS, self.trie.values[used]
        depth = np.zeros(len(self.accepts), np.int64)
        for p, c in sorted(zip(parent.tolist(), child.tolist(), strict=True), key=lambda x: x[1]):
            depth[c] = depth[p] + 1
        return int(depth.max())

    def _edges(self, symbols: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of the tokens that start at the places and end within their limits."""
        node = np.zeros(len(at), np.int64)
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        depth = 0
        while at.size:
            node = self.trie.get((node << SYMBOL_BITS) | symbols[at + depth]).astype(np.int64)
            depth += 1
            go = node >= 0
            at, node, limit = at[go], node[go], limit[go]
            token = self.accepts[node]
            hit = token >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), token[hit]))
            go = at + depth < limit
            at, node, limit = at[go], node[go], limit[go]
        start, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, length, token.astype(np.int32)


def compile_tokenizer(path: str) -> Transducer:
    """Compile a ``.json`` BPE vocabulary with word ends into integer tables."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    vocab: dict[str, int] = model["vocab"]
    size = max(vocab.values()) + 1
    rank = np.full(size, -1, np.int64)
    left, right = np.zeros(size, np.int32), np.zeros(size, np.int32)
    keys, values = [], []
    for r, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        made = vocab[a + b]
        keys.append((vocab[a] << PAIR_BITS) | vocab[b])
        values.append(made)
        if rank[made] < 0:
            rank[made], left[made], right[made] = r, vocab[a], vocab[b]
    pairs = IntTable(np.array(keys, np.int64), np.array(values, np.int32))
    to_byte = byte_symbols()
    specials = [x["content"] for x in spec["added_tokens"]]
    edges: dict[int, int] = {}
    accepts = [-1]
    for token, number in vocab.items():
        if token in specials:
            continue
        ends = token.endswith(suffix)
        body = [to_byte[c] for c in (token[: -len(suffix)] if ends else token)]
        if ends:
            body[-1] += WORD_END
        node = 0
        for symbol in body:
            key = (node << SYMBOL_BITS) | symbol
            if key not in edges:
                edges[key] = len(accepts)
                accepts.append(-1)
            node = edges[key]
        accepts[node] = number
    trie = IntTable(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
    return Transducer(MergeTables(rank, left, right, pairs), trie, np.array(accepts, np.int32), specials)


@dataclass(frozen=True)
class ChunkMap:
    """From the fragment pending before a chunk to the tokens emitted and the fragment pending behind it.

    Without a gap (count None) nothing is emitted: the chunk only lengthens the fragment.
    """

    head: str
    count: int | None
    tail: str


SPECIAL = ChunkMap("", 1, "")


def cut(chunk: str) -> tuple[str, str, str]:
    """What stands before the first gap, between the first and the last, and behind the last; all before where there is none."""
    gap = GAP.search(chunk)
    if gap is None:
        return chunk, "", ""
    last = max(map(chunk.rfind, SPACE)) + 1
    return chunk[: gap.start()], chunk[gap.start() : last], chunk[last:]


def compose(a: ChunkMap, b: ChunkMap, emitted: int) -> ChunkMap:
    """First a, then b; emitted are the tokens of the fragment that both close (see joint)."""
    if a.count is None:
        return ChunkMap(a.head + b.head, b.count, b.tail)
    if b.count is None:
        return ChunkMap(a.head, a.count, a.tail + b.head)
    return ChunkMap(a.head, a.count + emitted + b.count, b.tail)


def joint(a: ChunkMap, b: ChunkMap) -> str:
    """The fragment that is complete once a and b meet."""
    return "" if a.count is None or b.count is None else a.tail + b.head


def pre_tokens(text: str) -> list[str]:
    return (PLAIN_TEXT if PLAIN_ONLY.match(text) else ANY_TEXT).findall(text)


def normalised(text: str) -> str:
    """Composed, lower case character by character (so without the final sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Counter:
    """Counts tokens of texts; remembers the counts of words seen before."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.memo: dict[str, int] = {}
        self.split = re.compile("|".join(map(re.escape, transducer.specials))) if transducer.specials else None

    def emitted(self, parts: list[str]) -> list[int]:
        """Tokens of each part, which begins and ends with a word's border."""
        per_part = [pre_tokens(p) if p else () for p in parts]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        new = list(set().union(*per_part).difference(self.memo))
        long: dict[str, int] = {}
        for i in range(0, len(new), 100_000):
            some = new[i : i + 100_000]
            for word, n in zip(some, self.transducer.counts(some).tolist(), strict=True):
                (self.memo if len(word) <= LONG_WORD else long)[word] = n
        get = self.memo.__getitem__ if not long else lambda w: long[w] if w in long else self.memo[w]
        return [sum(map(get, words)) for words in per_part]

    def chunks(self, text: str, size: int) -> Iterator[str | None]:
        """The text in chunks, with None for a special string."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.transducer.specials) else [text]
        for k, part in enumerate(parts):
            if k:
                yield None
            part = normalised(part)
            for i in range(0, len(part), size):
                yield part[i : i + size]

    def count(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        per_text: list[list[ChunkMap]] = [[] for _ in texts]
        waiting: list[tuple[int, str, str, str]] = []
        size = 0

        def close() -> None:
            for (i, head, middle, tail), n in zip(waiting, self.emitted([w[2] for w in waiting]), strict=True):
                per_text[i].append(ChunkMap(head, n if middle else None, tail))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.chunks(text, chunk):
                if part is None:
                    close()
                    per_text[i].append(SPECIAL)
                    continue
                waiting.append((i, *cut(part)))
                size += len(part)
                if size > SLICE_CHARS:
                    close()
                    size = 0
        close()
        return self.scan(per_text)

    def scan(self, per_text: list[list[ChunkMap]]) -> list[int]:
        """Tokens of each text from the maps of its chunks, neighbours composed until one is left."""
        while any(len(maps) > 1 for maps in per_text):
            pairs = [(a, b) for maps in per_text for a, b in zip(maps[::2], maps[1::2], strict=False)]
            made = iter([compose(a, b, n) for (a, b), n in zip(pairs, self.emitted([joint(a, b) for a, b in pairs]), strict=True)])
            per_text = [[next(made) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)] for maps in per_text]
        whole = [maps[0] if maps else ChunkMap("", None, "") for maps in per_text]
        heads, tails = self.emitted([m.head for m in whole]), self.emitted([m.tail for m in whole])
        return [a + (m.count or 0) + b for m, a, b in zip(whole, heads, tails, strict=True)]


def slices(texts: Iterable[str | None], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about limit characters."""
    some, size = [], 0
    for text in texts:
        text = text or ""
        if some and size + len(text) > limit:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; other columns are left out.

    Rows with a null id stay.  No shuffle: one pass over the id and text columns.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(shared.value)
        for batch in batches:
            tokens = [n for some in slices(batch.column("text").to_pylist()) for n in counter.count(some)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(tidied(run), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
