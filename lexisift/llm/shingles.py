"""Word n-grams of whole texts as 64-bit hashes, in numpy over a batch of texts at once."""

from __future__ import annotations

import numpy as np

N = 3
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower case, cut at ASCII white space) and, with one more entry than texts, where each text's begin.

    A word's hash is its polynomial in bytes, from prefix sums modulo 2**64.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), dtype=np.uint64)])
    words = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    words = mix(words + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, bounds)


def grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of n-grams with repeats, bounds of each text's, sequence hash of each text, number of words).

    A text of fewer than n words, but one at least, has one n-gram: all of its words.
    """
    words, at = word_hashes(texts)
    count = np.diff(at)
    own = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate([[0], np.cumsum(own)])
    first = np.repeat(at[:-1] - bounds[:-1], own) + np.arange(bounds[-1])
    size = np.repeat(np.minimum(count, n), own)
    out = size.astype(np.uint64)
    for j in range(n):
        live = size > j
        more = words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else words
        out = np.where(live, mix(out * _P + more), out)
    place = np.arange(len(words)) - np.repeat(at[:-1], count)
    folded = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + mix(place.astype(np.uint64) + _P)), dtype=np.uint64)])
    whole = mix(folded[at[1:]] - folded[at[:-1]] + count.astype(np.uint64))
    return out, bounds, whole, count
