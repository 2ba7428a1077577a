"""Anchored runs: which windows of a text could be equal to windows elsewhere.

Every window of ``WINDOW`` bytes names one anchor, the ``GRAM``-byte string in
it with the smallest hash (the leftmost of equals).  Equal windows name equal
anchors at equal places, so only windows with equal anchors need comparing.
Neighbouring windows of one anchor form a run ``lo..hi`` of window starts.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from folio.llm.shingles import byte_codes, mix, powers

WINDOW = 100
GRAM = 36
#: Bytes of one text worked on at once.
PART = 1 << 20


@cache
def other_codes() -> np.ndarray:
    return mix(byte_codes() + np.uint64(0x2545F4914F6CDD1D))


def _sums(raw: np.ndarray, codes: np.ndarray, up: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[raw] * up[: len(raw)])])


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def anchored_runs(texts: list[bytes], window: int = WINDOW, gram: int = GRAM, part: int = PART) -> dict[str, np.ndarray]:
    """Runs of all texts: text number, lo and hi (inclusive window starts), anchor, fp (of the anchor) and digest (of the run's bytes).

    A text longer than part is worked on in overlapping parts; a run at their border becomes two.
    """
    found = [_runs([], window, gram)]
    some: list[bytes] = []
    first = 0

    def close(upto: int) -> None:
        nonlocal some, first
        if some:
            runs = _runs(some, window, gram)
            found.append({**runs, "text": runs["text"] + first})
        some, first = [], upto

    for i, text in enumerate(texts):
        if len(text) <= part:
            some.append(text)
            continue
        close(i + 1)
        for at in range(0, len(text) - window + 1, part):
            runs = _runs([text[at : at + part + window - 1]], window, gram)
            found.append({**runs, "text": runs["text"] + i, **{k: runs[k] + at for k in ("lo", "hi", "anchor")}})
    close(len(texts))
    return _joined(found)


def _runs(texts: list[bytes], window: int, gram: int) -> dict[str, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - gram + 1
    none = np.zeros(0, np.int64)
    if len(raw) < window:
        return {"text": none, "lo": none, "hi": none, "anchor": none, "fp": none, "digest": none}
    up, down = powers(len(raw) + 1)
    total = _sums(raw, byte_codes(), up)
    grams = mix((total[gram:] - total[:n]) * down[:n])
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = window - gram + 1
    step = 1
    while step * 2 <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < width:
        packed = np.minimum(packed[: len(packed) - (width - step)], packed[width - step :])
    anchor = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    at = np.arange(len(anchor))
    inside = at + window <= (start + sizes)[text]
    at, anchor, text = at[inside], anchor[inside], text[inside]
    if not len(at):
        return {"text": none, "lo": none, "hi": none, "anchor": none, "fp": none, "digest": none}
    first = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])]))[0]
    last = np.append(first[1:], len(at)) - 1
    lo, hi, anchor, text = at[first], at[last], anchor[first], text[first]
    total = _sums(raw, other_codes(), up)
    digest = mix(mix((total[hi + window] - total[lo]) * down[lo]) + ((anchor - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    base = start[text]
    return {"text": text, "lo": lo - base, "hi": hi - base, "anchor": anchor - base, "fp": grams[anchor].view(np.int64), "digest": digest.view(np.int64)}
