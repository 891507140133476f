"""Words of whole texts and their hashes, for one Arrow batch at a time, in numpy.

Texts are taken as UTF-8. All rules here split at ASCII bytes, so bytes serve as well as
characters. Hashes are 64 bits wide, the same in every process, and need no state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text of so many bytes is handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Words of so many bytes are hashed at a time; sums and powers take eight bytes for each.
HASHED_BYTES = 1 << 18

WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words are all but white space.
SPACED = ~WHITE
#: Words are ASCII digits, lower-case ASCII letters and all beyond ASCII.
LETTERED = np.array([b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE, _STEP = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, made as far as they are needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


@dataclass
class Words:
    """Words of the texts of a slice: `first[d] .. first[d + 1]` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A word's hash does not depend on where it stands, so blocks of words are hashed one by one."""
        out = np.empty(len(self.start), U)
        cuts = np.searchsorted(self.start, np.arange(0, len(self.data), HASHED_BYTES)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(out)]):
            if a < b:
                out[a:b] = self._hashed(self.start[a:b], self.end[a:b])
        return out

    def _hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        data = self.data[start[0]: end[-1]]
        start, end = start - start[0], end - start[0]
        up, down = _BYTES.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(U))

    def joined(self, keep: np.ndarray, d: int) -> bytes:
        """The kept words of text d, joined by one space."""
        data = self.data.tobytes()
        a, b = self.first[d], self.first[d + 1]
        return b" ".join(
            data[s:e] for s, e in zip(self.start[a:b][keep].tolist(), self.end[a:b][keep].tolist()))


def spans(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place in `at`."""
    up, down = _WORDS.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mixed((total[at + n] - total[at]) * down[at] + U(n))


def places(first: np.ndarray, n: int) -> np.ndarray:
    """Words from which n words follow within their text, that word included."""
    counts = np.diff(first)
    long = counts >= n
    inside = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - (n - 1), -1)
    return np.flatnonzero(np.cumsum(inside[:-1]))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words within a text, and the word each window starts at."""
    at = places(first, n)
    return spans(hashes, at, n), at


def words_of(texts: pa.Array, word: np.ndarray, lower: bool) -> Words:
    """Words of the texts; null has none. `word` says of each byte whether it belongs to one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]: offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[cut] |= inside[1:-1][cut]
    before = cut[cut > 0] - 1
    end[before] |= inside[1:-1][before]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text. No text is cut."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts: those that have any word, and where their words begin (for reduceat)."""
    some = np.flatnonzero(np.diff(first))
    return some, first[:-1][some]
