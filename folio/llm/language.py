"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of signs.  An n-gram's vector binds
(multiplies) its letters' vectors, each permuted by its place; a document's
vector bundles (sums) those of its n-grams, and a language's prototype bundles
the documents labelled with it, each at unit length.  A document gets the
language whose prototype has the largest cosine with it.

Letters are compared in lower case; all that is not a letter separates words.
Bundling is linear, so the n-grams of many documents are counted first and
multiplied with the n-gram vectors at once: the same sums, in one product.

Null text, and text without a letter (by Unicode, on every plane), gets ``und``
with score 0; so does every text when no labelled document has a letter.  Equal
cosines go to the first language by name.  Repeated rows are separate rows, an
empty table gives none, other columns never enter.  A very long text is bundled
part by part, n-grams are multiplied block by block, so memory follows neither
a text's length nor its number of distinct n-grams.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import append_columns, bound_batches, free_name, text_slices, tidied

DIM = 1024
GRAM = 3
#: Letter codes; 0 is a gap.  Letters beyond the first LETTERS - 1 share codes.
LETTER_BITS = 10
LETTERS = 1 << LETTER_BITS
UNKNOWN = "und"
#: Characters bundled at once, n-grams multiplied at once and n-gram vectors kept; all three bound memory only.
SLICE_CHARS, GRAM_BLOCK, KEPT_GRAMS = 500_000, 1 << 13, 1 << 15
#: Prototypes travel to every worker: 8 KB each.
MAX_LANGUAGES = 2000


@cache
def letter_codes() -> np.ndarray:
    """Code of every code point."""
    out = np.zeros(0x110000, np.int16)
    seen: dict[str, int] = {}
    for c in map(chr, range(len(out))):
        if c.isalpha():
            low = c.lower()[0]
            if low not in seen:
                seen[low] = 1 + len(seen) if len(seen) < LETTERS - 1 else 1 + ord(low) % (LETTERS - 1)
            out[ord(c)] = seen[low]
    return out


@cache
def letter_vectors() -> np.ndarray:
    """Vector of every letter code at every place: row [place, code]."""
    signs = np.random.default_rng(20_240_229).integers(0, 2, (LETTERS, DIM), np.int8) * 2 - 1
    mix = np.random.default_rng(7).permutation(DIM)
    rows = [signs]
    for _ in range(GRAM - 1):
        rows.append(rows[-1][:, mix])
    return np.stack(rows)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    vectors = letter_vectors()
    out = np.ones((len(codes), DIM), np.int8)
    for place in range(GRAM):
        out *= vectors[place, (codes >> (LETTER_BITS * place)) & (LETTERS - 1)]
    return out


class Bundler:
    """Vectors of texts; keeps the vectors of some n-grams seen."""

    def __init__(self):
        self.known = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, DIM), np.int8)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, zero where it has no letter."""
        out = np.zeros((len(texts), DIM), np.float32)
        for lo, hi in text_slices(texts, SLICE_CHARS):
            if hi - lo == 1 and len(texts[lo] or "") > SLICE_CHARS:
                out[lo] = self._long(texts[lo])
            else:
                out[lo:hi] = self._sums(*self._letters([f" {t} " if t else "" for t in texts[lo:hi]]), hi - lo)
        return out

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code, text number) of the letters and of single gaps between them."""
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        points = np.frombuffer(b"".join(raw), np.uint32)
        code = letter_codes()[points]
        doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) // 4 for r in raw])
        keep = code != 0
        keep[1:] |= (code[:-1] != 0) | (doc[1:] != doc[:-1])
        keep[:1] = True
        return code[keep], doc[keep]

    def _long(self, text: str) -> np.ndarray:
        """The vector of one very long text; what the last two places of a part held goes on to the next."""
        total, carry = np.zeros(DIM, np.float64), np.zeros(0, np.int16)
        text = f" {text} "
        for i in range(0, len(text), SLICE_CHARS):
            code, _ = self._letters([text[i : i + SLICE_CHARS]])
            if len(carry) and carry[-1] == 0 and code[0] == 0:
                code = code[1:]
            code = np.concatenate([carry, code])
            total += self._sums(code, np.zeros(len(code), np.int32), 1)[0]
            carry = code[-(GRAM - 1) :]
        return total.astype(np.float32)

    def _sums(self, code: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        out = np.zeros((n_docs, DIM), np.float32)
        n = len(code) - GRAM + 1
        if n <= 0:
            return out
        present = np.nonzero(np.bincount(code, minlength=1))[0]
        base = len(present)
        small = np.zeros(int(present[-1]) + 1, np.int64)
        small[present] = np.arange(base)
        local = small[code]
        gram = np.zeros(n, np.int64)
        for place in range(GRAM):
            gram += local[place : place + n] * base**place
        inside = doc[:n] == doc[GRAM - 1 :]
        gram, doc = gram[inside], doc[:n][inside]
        if base**GRAM <= 1 << 22:
            used = np.nonzero(np.bincount(gram, minlength=base**GRAM))[0]
            to = np.zeros(base**GRAM, np.int32)
            to[used] = np.arange(len(used))
            gram = to[gram]
        else:
            used, gram = np.unique(gram, return_inverse=True)
        full = np.zeros(len(used), np.int64)
        for place in range(GRAM):
            full |= present[used // base**place % base] << (LETTER_BITS * place)
        for first in range(0, len(used), GRAM_BLOCK):
            width = min(GRAM_BLOCK, len(used) - first)
            own = slice(None) if len(used) <= GRAM_BLOCK else (gram >= first) & (gram < first + width)
            self._add(out, doc[own], gram[own] - first, self._vectors(full[first : first + width]))
        return out

    @staticmethod
    def _add(out: np.ndarray, doc: np.ndarray, gram: np.ndarray, vectors: np.ndarray) -> None:
        """Add the n-grams' vectors to the rows of their texts, by products of counts; doc rises."""
        width = len(vectors)
        rows = max(1, (1 << 21) // max(1, width))
        bounds = np.searchsorted(doc, np.arange(0, len(out) + rows, rows))
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            first = k * rows
            here = min(rows, len(out) - first)
            if lo < hi and here > 0:
                counts = np.bincount((doc[lo:hi] - first).astype(np.int64) * width + gram[lo:hi], minlength=here * width)
                out[first : first + here] += counts.reshape(here, width).astype(np.float32) @ vectors

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        if len(self.known) > KEPT_GRAMS:
            self.__init__()
        new = np.setdiff1d(codes, self.known)
        if len(new):
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.vectors = np.concatenate([self.vectors, gram_vectors(new)])[order]
            self.known = known[order]
        return self.vectors[np.searchsorted(self.known, codes)].astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))[:, None]
    return rows / np.where(length == 0, 1, length)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Unit prototype of each language of docs, from all its rows with a language.

    Sums are combined within partitions first; what reaches the driver is one
    vector of DIM numbers for each distinct language.  A column with more than
    max_languages values is refused before any vector is collected, for it
    holds something else than languages.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    if rows.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} distinct languages in {lang_col}")

    def run(batches):
        import pyarrow as pa

        table = lambda sums: pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})
        bundler, sums = Bundler(), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lo, hi in text_slices(texts, SLICE_CHARS):
                vectors = unit(bundler.bundle(texts[lo:hi]))
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + vectors[langs[lo:hi] == lang].sum(axis=0, dtype=np.float64)
                if len(sums) > 256:
                    yield table(sums)
                    sums = {}
        if sums:
            yield table(sums)

    partial = rows.mapInArrow(tidied(run), "lang string, v array<double>")
    total = partial.groupBy("lang").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    sums = {r.lang: r.v.toArray() for r in total.collect()}
    return {lang: v / norm for lang, v in sorted(sums.items()) if (norm := float(np.linalg.norm(v))) > 0}


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], lang_out: str = "lang_pred", score_out: str = "score", text_col: str = "text") -> DataFrame:
    """docs and the predicted language with its cosine (0 to 1); no shuffle."""
    names = list(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([profiles[n] for n in names]).reshape(len(names), DIM))

    def start():
        bundler, prototypes = Bundler(), shared.value.T

        def work(texts):
            vectors = bundler.bundle(texts)
            if not names:
                return [(UNKNOWN, 0.0)] * len(texts)
            cosine = unit(vectors) @ prototypes
            best = cosine.argmax(axis=1)
            none = ~vectors.any(axis=1)
            return [(UNKNOWN, 0.0) if no else (names[b], float(min(1.0, max(0.0, c[b])))) for b, c, no in zip(best, cosine, none, strict=True)]

        return work

    return append_columns(docs, text_col, [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())], start, SLICE_CHARS)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of learning; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    profiles = learn_profiles(docs.filter(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return with_language(rows, profiles, text_col=text_col).select(id_col, "held_out", "lang_pred", "score")


def without_unknown(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in which a language is recognised with at least min_score."""
    lang, score = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    profiles = learn_profiles(docs.filter(~held_out(id_col)), text_col, lang_col)
    found = with_language(docs, profiles, lang, score, text_col)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
