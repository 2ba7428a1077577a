"""Multisets of word shingles of many texts at once.

Words are runs without ASCII white space and punctuation, in lower case.  A shingle is
``SIZE`` consecutive words; a text of fewer words has one shingle of them all,
a text without words none.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SIZE = 5
#: Bytes hashed at once; powers are kept for so many.
BLOCK = 1 << 16
#: ASCII control characters and punctuation become spaces.
BLANK = bytes(32 if b < 32 or b == 127 or chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
_ODD = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of a well-known hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@cache
def block_powers() -> tuple[np.ndarray, np.ndarray]:
    """The first BLOCK powers of an odd number and of its inverse, modulo 2**64."""
    base, inverse = np.full(BLOCK, _ODD, np.uint64), np.full(BLOCK, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def block_factors(k: int) -> tuple[np.uint64, np.uint64]:
    """What the powers of block k have before those of block 0."""
    return np.uint64(pow(_ODD, k * BLOCK, 1 << 64)), np.uint64(pow(_ODD, -k * BLOCK, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers; nothing of them is kept."""
    factors = np.array([block_factors(k) for k in range(-(-n // BLOCK))], np.uint64).reshape(-1, 2)
    up, down = block_powers()
    return (factors[:, :1] * up).ravel()[:n], (factors[:, 1:] * down).ravel()[:n]


@cache
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def normalised(text: str | None) -> bytes:
    """The words of a text, in lower case, with single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(BLANK).split()) if text else b""


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of bytes that end in a space; block by block, so only words are held."""
    up, down = block_powers()
    codes = byte_codes()
    carry = np.uint64(0)
    before, after, at, back = [np.zeros(1, np.uint64)], [np.zeros(1, np.uint64)], [np.full(1, -1)], [np.ones(1, np.uint64)]
    for k, lo in enumerate(range(0, len(raw), BLOCK)):
        some = raw[lo : lo + BLOCK]
        factor, inverse = block_factors(k)
        step = codes[some] * up[: len(some)]
        total = np.cumsum(step) * factor + carry
        carry = total[-1]
        gap = np.nonzero(some == 32)[0]
        before.append(total[gap] - step[gap] * factor)  # sums up to a gap, without and with it
        after.append(total[gap])
        at.append(gap + lo)
        back.append(down[gap] * inverse)  # a word begins one place on
    before, after, at, back = map(np.concatenate, (before, after, at, back))
    back[1:] *= np.uint64(pow(_ODD, -1, 1 << 64))
    full = np.nonzero(at[:-1] + 1 < at[1:])[0]
    return at[full] + 1, mix((before[full + 1] - after[full]) * back[full])


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle of normalised texts, in order of place."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts, words = word_hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    count = np.bincount(doc, minlength=len(texts))
    out = np.zeros(len(words), np.uint64)
    for j in range(min(SIZE, len(words))):  # words beyond a short text's end leave out what they would add
        part = np.zeros(len(words), np.uint64)
        part[: len(words) - j] = words[j:] * np.uint64((_ODD * (2 * j + 3)) % (1 << 64))
        if j:
            same = np.zeros(len(words), bool)
            same[: len(words) - j] = doc[j:] == doc[: len(words) - j]
            part[~same] = 0
        out += part
    rank = np.arange(len(words)) - (np.cumsum(count) - count)[doc]
    keep = rank <= np.maximum(count[doc] - SIZE, 0)
    return doc[keep], mix(out[keep])


def multisets(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, times) of the distinct shingles, sorted by text number."""
    if not len(doc):
        return doc, hashes, np.zeros(0, np.int64)
    order = np.argsort(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    d, h = doc[order], hashes[order]
    first = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))[0]
    times = np.diff(np.append(first, len(d)))
    d, h = d[first], h[first]
    order = np.argsort(d, kind="stable")
    return d[order], h[order], times[order]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, times); 0 when both are empty."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)
