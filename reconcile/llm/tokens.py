"""Words of whole Arrow text columns and 64-bit hashes of them, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time (a longer text is taken whole).
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash's base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES)
        powers = []
        for base in (_BASE, _INVERSE):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            powers.append(np.multiply.accumulate(factors))
        _powers = tuple(powers)
    return _powers


class Words:
    """Words of some rows: hashes in order; row r has words ``first[r]`` up to ``first[r + 1]``."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        start, end = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[start:end] if end > start else np.zeros(0, np.uint8)
        offsets = offsets - start
        inside = ~_SPACE[data]
        # A row's end parts words as a space does.
        joins = inside[:-1] & inside[1:] if len(data) else np.zeros(0, bool)
        inner = offsets[(offsets > 0) & (offsets < len(data))] - 1
        joins[inner] = False
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~joins
        ends[:-1] &= ~joins
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        powers, inverse = powers_to(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        letters = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        np.cumsum(letters * powers[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.end] - sums[self.begin]) * inverse[self.begin])

    def ngrams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on, across rows; shorter at the end."""
        return sequence_hash([self.hashes[i : len(self.hashes) - size + 1 + i] for i in range(size)])


def sequence_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of word hashes, given by position; order and length count."""
    total = np.uint64(len(columns))
    # Factors without a relation among them: with multiples of one, words that change places two by two would cancel.
    factors = mix(np.arange(1, len(columns) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    for column, factor in zip(columns, factors):
        total = total + column * factor
    return mix(np.asarray(total, np.uint64))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes; a longer row is one of its own."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > most:
            yield start, row
            start, held = row, 0
        held += int(length)
    if start < len(lengths):
        yield start, len(lengths)

