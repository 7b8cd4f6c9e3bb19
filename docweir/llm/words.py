"""Words of whole texts as 64-bit fingerprints, for a batch of texts at a time.

A word is ``[^\\x20\\x09-\\x0D]+``: bytes between ASCII white space.  Everything
here is array work over the UTF-8 bytes of a slice of texts; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Regular expression of a word, for the JVM and for Python.
WORD = r"[^\x20\x09-\x0D]+"

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def keys(seed: int, n: int) -> np.ndarray:
    """``n`` odd pseudo-random multipliers, the same on every machine."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) | np.uint64(1)


_BYTE_KEYS = keys(1, 256)
_places = keys(2, 1024)


def _place_keys(n: int) -> np.ndarray:
    global _places
    if n > len(_places):
        _places = keys(2, 2 * n)
    return _places


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of an array, sorted (one sort; ``np.unique`` builds a hash table first)."""
    x = np.sort(x)
    return x[np.flatnonzero(np.r_[True, x[1:] != x[:-1]])] if len(x) else x


class Words:
    """Words of several texts in one row of fingerprints.

    ``hashes[bounds[i]:bounds[i + 1]]`` are those of text ``i``.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        self.hashes, self.bounds = hashes, bounds

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of every ``size`` consecutive words of a text, and the place of their first words.

        Words of different texts never share a window.
        """
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j, key in enumerate(keys(3, size)):
            total += self.hashes[j:n + j] * key
        fits = np.zeros(len(self.hashes) + 1, np.int32)
        last = np.maximum(self.bounds[1:] - size + 1, self.bounds[:-1])
        np.add.at(fits, self.bounds[:-1], 1)
        np.add.at(fits, last, -1)
        at = np.flatnonzero(np.cumsum(fits[:n]) > 0)
        return mix(total[at]), at

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The texts that own the words at these places."""
        return np.searchsorted(self.bounds, at, side="right") - 1


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of their ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def words_of(texts: pa.Array, lower: bool = False, head: int | None = None) -> Words:
    """Fingerprint every word, or the first ``head`` bytes of it; ``lower`` folds A-Z first."""
    raw, ends = raw_bytes(texts)
    inside = _WORD_BYTE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    letters = raw[inside]
    if lower:
        letters = _LOWER[letters]
    begin = np.cumsum(inside)[starts] - 1
    lengths = np.diff(begin, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    values = _BYTE_KEYS[letters] * _place_keys(int(lengths.max()))[place]
    if head is not None:
        values[place >= head] = 0
        lengths = np.minimum(lengths, head)
    summed = np.add.reduceat(values, begin)
    return Words(mix(summed + lengths.astype(np.uint64)), np.searchsorted(starts, ends))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20,
           rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches between rows so that a slice holds about ``limit`` bytes of text and at most ``rows`` rows.

    A longer text is a slice of its own; no text is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(size, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to
