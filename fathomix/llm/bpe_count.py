"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut in spans by the usual pattern of byte-level vocabularies (contractions, words,
numbers, other signs, each with one blank before, and white space). In a span every byte is a
symbol; a heap holds the adjacent pairs by rank, a doubly linked list the symbols. The
lowest-rank pair (the leftmost of equals) is popped and merged until none is left. The count
is bytes minus merges; no identifier is made. A span that repeats is merged once a worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_batches
from .lookup import groups
from .text import LETTER, OTHER, SPACE, Chunk, chunks, find, kinds, runs, span_pairs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ID = 20  # bits of an id in a pair's key


class Ranks:
    """Merge ranks of a vocabulary file (a line: base64 of the bytes, rank), and the spans counted so far."""

    def __init__(self, ranks: dict[bytes, int], most: int = 3_000_000):
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {ranks[t[:k]] << _ID | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.most = most
        self._forget()

    def count(self, span: bytes) -> int:
        """Symbols left when no adjacent pair merges."""
        n = len(span)
        if n < 2:
            return n
        pairs, byte = self.pairs, self.byte
        symbol = [byte[b] for b in span]
        rank = [pairs.get(a << _ID | b, -1) for a, b in zip(symbol, symbol[1:])]
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if rank[i] != r:  # merged away, or another pair by now
                continue
            j = after[i]
            k = after[j]
            symbol[i] = r
            rank[j] = -1
            after[i] = k
            n -= 1
            if k < len(symbol):
                before[k] = i
                r = rank[i] = pairs.get(symbol[i] << _ID | symbol[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                r = rank[h] = pairs.get(symbol[h] << _ID | symbol[i], -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return n

    def counts_of(self, c: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Count of each span of a chunk. Spans are known by two 64-bit hashes; one that shares the first alone is counted each time."""
        hashes, others = span_pairs(c.points, starts, ends)
        some, first, at, odd = groups(hashes, others)
        if len(self.keys) > self.most:
            self._forget()
        text = None

        def fresh(spans: np.ndarray) -> list[int]:
            nonlocal text
            text = text or c.text(0, len(c.points))
            return [self.count(text[x:y].encode("utf-8", "surrogatepass")) for x, y in zip(starts[spans].tolist(), ends[spans].tolist())]

        known = find(self.keys, some)
        new = np.flatnonzero(known < 0)
        if len(new):
            where = np.searchsorted(self.keys, some[new])
            counts = np.array(fresh(first[new]), np.int64)
            self.keys = np.insert(self.keys, where, some[new])
            self.others = np.insert(self.others, where, others[first[new]])
            self.counts = np.insert(self.counts, where, counts)
            known = find(self.keys, some)
        odd |= (self.others[known] != others[first])[at]
        out = self.counts[known][at]
        if odd.any():
            out[odd] = fresh(np.flatnonzero(odd))
        return out

    def _forget(self) -> None:
        self.keys, self.others, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY) -> Ranks:
    """The ranks of a file, read once a worker."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans, by the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[points]
    s, e = runs(kind, offsets)
    k = kind[s]
    edge = np.zeros(len(points) + 1, bool)
    edge[s] = True
    edge[-1] = True
    row_end = np.zeros(len(points) + 1, bool)
    row_end[offsets] = True
    # white space before something: its last character goes alone, or with what follows if it is a blank
    before = (k == SPACE) & ~row_end[e]
    last = e[before] - 1
    edge[last] = True
    joins = points[last] == 32
    edge[last[joins] + 1] = False
    # contractions: a lone apostrophe that no blank joins, then letters
    alone = np.flatnonzero((k == OTHER) & (e - s == 1) & ~row_end[e])
    alone = alone[(points[s[alone]] == 39) & edge[s[alone]]]
    alone = alone[k[alone + 1] == LETTER]
    if len(alone):
        a, b = s[alone + 1], e[alone + 1]
        c1, c2 = points[a], points[np.minimum(a + 1, len(points) - 1)]
        two = (b - a > 1) & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        takes = np.where(np.isin(c1, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
        a, takes = a[takes > 0], takes[takes > 0]
        edge[a] = False
        edge[a + takes] = True
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each text; a null text gives null, an empty one 0.

    Rows with a null or repeated id give a row each; an empty table gives none. Texts of any length are counted whole.
    Other columns, of whatever names, aren't read.
    ``vocabulary`` must be readable on every worker.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for c in chunks(batch.column(1)):
            a, b = spans(c.points, c.offsets)
            row = np.searchsorted(c.offsets, a, side="right") - 1
            n = np.bincount(row, weights=v.counts_of(c, a, b), minlength=c.stop - c.start).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.start, c.stop - c.start), pa.array(n, mask=~c.valid)], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, n_tokens long")
