"""Vectorised text primitives shared by the corpus operators.

Texts reach Python as Arrow record batches. Everything here works on the code
points of a whole run of rows at once; no loop runs over rows or characters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters worked on at once; a longer single text is a chunk of its own.
CHUNK_CHARS = 1 << 18

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@dataclass
class Chunk:
    """Rows ``start`` to ``stop`` of a batch as code points; row i spans ``offsets[i]`` to ``offsets[i + 1]``."""

    start: int
    stop: int
    points: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def text(self, a: int, b: int) -> str:
        return self.points[a:b].astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        """Row (within the chunk) of each character position, given in ascending or any order."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[Chunk]:
    """Cut a string column in runs of whole rows of about ``limit`` bytes. Null rows are empty and not ``valid``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) or pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(n, bool)
    _, offs, data = column.buffers()
    ends = np.frombuffer(offs, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        stop = min(stop, n)
        part, rel = raw[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        blob = part.tobytes()
        try:
            points = np.frombuffer(blob.decode("utf-8").encode("utf-32-le"), np.uint32)
            if len(points) != len(part):
                heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                rel = heads[rel]
        except UnicodeDecodeError:
            texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(rel[:-1], rel[1:])]
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            rel = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        yield Chunk(start, stop, points, rel.astype(np.int64), valid[start:stop])
        start = stop


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point (Unicode L*, N*, white space, the rest)."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        k = unicodedata.category(c)[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
        elif c.isspace() and i not in (0x1C, 0x1D, 0x1E, 0x1F):
            out[i] = SPACE
    return out


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """Lower case of each code point where that is one character."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i).lower()
        if len(c) == 1:
            out[i] = ord(c)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def _sums(values: np.ndarray, before: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return _mixed(total[before + lengths] - total[before] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_pairs(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, twice: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two 64-bit hashes of each span of code points, equal for equal spans wherever they stand.

    A hash is the sum, over the span, of a random-looking number for each pair of a character and its
    place in the span. There is no algebra between places, so texts of a rule (such as Thue-Morse words)
    don't fall together, as they do under polynomials modulo a power of two.
    """
    lengths = (ends - starts).astype(np.int64)
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(before, lengths)
    x = points[place + np.repeat(starts, lengths)].astype(np.uint64)
    place <<= 21  # a code point has 21 bits
    x |= place.view(np.uint64)
    x = _mixed(x)
    first = _sums(x, before, lengths)
    if not twice:
        return first, None
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return first, _sums(x, before, lengths)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first hash of ``span_pairs``."""
    return span_pairs(points, starts, ends, twice=False)[0]


def text_hash(word: str) -> int:
    """``span_hashes`` of one string."""
    p = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(span_hashes(p, np.array([0]), np.array([len(p)]))[0])


def runs(labels: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of equal labels; a run never crosses a row."""
    if not len(labels):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(labels) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(labels[1:], labels[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key, keys ascending."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[first], np.add.reduceat(c, first)) if len(k) else (k, c)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in an ascending array, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)
