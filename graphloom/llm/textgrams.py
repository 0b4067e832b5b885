"""Hashes of words and word n-grams for whole batches of texts, in numpy.

A word is a run without ASCII white space, taken as it stands. Texts are handled as UTF-8
bytes in blocks of bounded size; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P, np.uint64)]))
            _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)]))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words start (one entry more than texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    _grow(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)])])
        words = (sums[ends] - sums[starts]) * _inverse[starts]
        words += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(words), np.concatenate([np.zeros(1, np.int64), np.searchsorted(starts, ends_of_texts)])


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of consecutive words, text by text; a text of fewer words has one gram of all it has, an empty one none."""
    counts = np.diff(offsets)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(grams)])
    out = np.zeros(int(out_offsets[-1]), np.uint64)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            m = len(words) - n + 1
            rolled = np.zeros(m, np.uint64)
            for k in range(n):
                rolled = rolled * np.uint64(0xA0761D6478BD642F | 1) + words[k : k + m]
            rolled = mix64(rolled)
        long = np.flatnonzero(counts >= n)
        if len(long):
            size = grams[long]
            at = np.repeat(offsets[long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            to = np.repeat(out_offsets[long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            out[to] = rolled[at]
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            x = np.uint64(counts[i])
            for w in words[offsets[i] : offsets[i + 1]]:
                x = x * np.uint64(0xA0761D6478BD642F | 1) + w
            out[out_offsets[i]] = mix64(np.array([x]))[0]
    return out, out_offsets


def blocks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
