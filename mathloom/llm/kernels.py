"""Array kernels over batches of texts, used inside Arrow map functions.

A batch is laid out as one array of code points; word boundaries, word hashes and word n-gram
hashes are then computed for all its texts at once, without a Python step per word.
Words are maximal runs of letters and digits of any script, lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

_MAX_CODE = 0x110000
_U = np.uint64
MAX_CHARS = 2_000_000


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(_MAX_CODE)), dtype=bool, count=_MAX_CODE)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (arithmetic modulo 2^64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.empty(size, dtype=_U)
    out[0] = 1
    if size > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.multiply.accumulate(np.full(size - 1, base, dtype=_U))
    return out


def powers(base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, at least ``size`` of them."""
    return _powers(base, 1 << max(10, int(size).bit_length()))


def chunks(texts: Sequence[str | None], max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Split a batch into index ranges of bounded total length; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > max_chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offset where each text begins (n + 1 of them)."""
    parts = [(t.lower() if lower else t) if t else "" for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)), out=offsets[1:])
    raw = "".join(parts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32), offsets


class Words:
    """Word hashes of a batch: ``hashes`` of all words in order, ``offsets`` per text."""

    __slots__ = ("hashes", "offsets")

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        self.hashes = hashes
        self.offsets = offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(texts: Sequence[str | None]) -> Words:
    codes, offsets = code_points(texts)
    if not len(codes):
        return Words(np.zeros(0, dtype=_U), np.zeros(len(texts) + 1, dtype=np.int64))
    mask = alnum_table()[codes]
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[offsets] = True
    before = np.empty(len(codes), dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | begins[:-1]))
    per_text = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, dtype=_U), per_text)
    kept = np.flatnonzero(mask)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    value = (codes[kept].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    value ^= value >> _U(32)
    value *= powers(0xD6E8FEB86659FD93, lengths.max())[place]
    hashes = mix64(np.add.reduceat(value, first) + lengths.astype(_U))
    return Words(hashes, per_text)


def take(w: Words, at: np.ndarray) -> Words:
    """The words of the texts at the given places."""
    counts = w.counts[at]
    offsets = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return Words(w.hashes[np.repeat(w.offsets[:-1][at] - offsets[:-1], counts) + np.arange(offsets[-1])], offsets)


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and their offsets per text."""
    counts = np.maximum(w.counts - (k - 1), 0)
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, dtype=_U), offsets
    rolled = np.zeros(len(w.hashes) - k + 1, dtype=_U)
    for j in range(k):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + w.hashes[j : len(w.hashes) - k + 1 + j]
    at = np.repeat(w.offsets[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    return mix64(rolled[at]), offsets


def distinct_ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word hashes of each text, ascending within the text, and their offsets.

    The text's number takes the upper bits and 40 or more bits of the hash the rest, so that one
    plain sort serves the whole batch.
    """
    grams, offsets = ngrams(w, k)
    n = len(offsets) - 1
    if not len(grams):
        return grams, np.zeros(n + 1, dtype=np.int64)
    bits = max(1, int(n).bit_length())
    if bits > 24:
        raise ValueError("batch of too many texts")
    owner = np.repeat(np.arange(n, dtype=_U), np.diff(offsets))
    keys = (owner << _U(64 - bits)) | (grams >> _U(bits))
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    own = (keys >> _U(64 - bits)).astype(np.int64)
    hashes = (keys << _U(bits)) >> _U(24) << _U(24)
    out = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(own, minlength=n), out=out[1:])
    return hashes, out


def sequence_hash(w: Words) -> np.ndarray:
    """One hash of each text's whole word sequence; 0 for a text without words."""
    counts = w.counts
    out = np.zeros(len(counts), dtype=_U)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    place = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], counts)
    value = w.hashes * powers(0xA0761D6478BD642F, counts.max())[place]
    out[some] = mix64(np.add.reduceat(value, w.offsets[:-1][some]) + counts[some].astype(_U))
    return out


def jaccard(a: Words, b: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared and united numbers of distinct k-word sequences of the texts paired by position."""
    ha, oa = distinct_ngrams(a, k)
    hb, ob = distinct_ngrams(b, k)
    n = len(oa) - 1
    na, nb = np.diff(oa), np.diff(ob)
    if not n:
        return na, nb
    bits = max(1, int(n).bit_length())
    fold = lambda h, c: (np.repeat(np.arange(n, dtype=_U), c) << _U(64 - bits)) | (h >> _U(bits))
    keys = np.concatenate((fold(ha, na), fold(hb, nb)))
    keys.sort()
    twice = keys[1:][keys[1:] == keys[:-1]]
    shared = np.bincount((twice >> _U(64 - bits)).astype(np.int64), minlength=n)
    return shared, na + nb - shared
