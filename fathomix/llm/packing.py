"""Packing by power-of-two decomposition.

A document of n tokens is cut in pieces whose lengths are powers of two: as many of the
longest length as fit, then the binary digits of the rest, longest first. Pieces of equal
length form a bucket, which the column ``power`` names, so a batch drawn from one bucket holds equally long sequences
without padding, and no sequence crosses documents.

A token is a run of characters other than blanks, tabs and line ends, with those before
it (at a text's end also those after it), so the pieces of a document, joined, are the document. A run of more than
``LONGEST`` characters is cut in tokens of that many, so that a piece is bounded also where a text has no blanks.

Pieces are cut where the documents lie: as they follow each other and leave nothing out, a batch's pieces
are its texts' bytes with other ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_batches
from .text import ragged, runs

#: Characters of a token, without the blanks before it.
LONGEST = 64
TOKEN = rf"[ \t\n\r]*[^ \t\n\r]{{1,{LONGEST}}}(?:[ \t\n\r]+\z)?|[ \t\n\r]+\z"
#: log2 of the longest piece.
MAX_POWER = 11
#: Bytes of texts that are cut at once; a longer text is by itself.
_PART = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\n\r"]] = True


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of rows of UTF-8 bytes, and how many each row has; row i spans ``offsets[i]`` to ``offsets[i + 1]``."""
    blank = _BLANK[data]
    s, e = runs(blank, offsets)
    word = ~blank[s] if len(s) else np.zeros(0, bool)
    s, e = s[word], e[word]
    # the runs that may be too long: every LONGESTth character starts a token
    long = np.flatnonzero(e - s > LONGEST)
    if len(long):
        size = e[long] - s[long]
        at = ragged(s[long], size)
        head = (data[at] & 0xC0) != 0x80
        number = np.cumsum(head) - head
        number -= np.repeat(number[np.cumsum(size) - size], size)
        more = at[head & (number % LONGEST == 0) & (number > 0)]
        # a token ends where the next one of its run starts, or with its run
        ends = np.sort(np.concatenate([e, more]))
    else:
        ends = e
    row = np.searchsorted(offsets, ends, side="left") - 1
    n = np.bincount(row, minlength=len(offsets) - 1)
    # the last token of a row takes what is left of it
    filled = np.flatnonzero(n)
    ends = ends.copy()
    ends[np.cumsum(n)[filled] - 1] = offsets[filled + 1]
    only = np.flatnonzero((n == 0) & (np.diff(offsets) > 0))
    if len(only):  # rows of blanks are one token
        ends = np.sort(np.concatenate([ends, offsets[only + 1]]))
        n[only] = 1
    return ends, n


def pieces(n: np.ndarray, max_power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first token and power of the pieces of rows of n tokens, in order."""
    full = n >> max_power
    row, start, power = [np.repeat(np.arange(len(n)), full)], [ragged(np.zeros(len(n), np.int64), full) << max_power], [np.full(int(full.sum()), max_power)]
    for k in range(max_power - 1, -1, -1):
        some = np.flatnonzero(n >> k & 1)
        row.append(some)
        start.append(n[some] >> (k + 1) << (k + 1))  # after the longer digits
        power.append(np.full(len(some), k))
    row, start, power = (np.concatenate(x) for x in (row, start, power))
    order = np.lexsort((start, row))
    return row[order], start[order], power[order]


def pack(docs: DataFrame, max_power: int = MAX_POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, power, n_tokens, text): the pieces of every document.

    ``piece`` and ``start`` count from 0, ``n_tokens`` is 2 ** ``power``, the bucket. Null and empty texts have no
    piece; a text of blanks only is one token. A row with a null id is packed under the null id; repeated rows
    are packed each. A text of any length is packed whole. Other columns, of whatever names, aren't read; an empty
    table gives no rows. No shuffle: each document is cut where it is read.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(1)
        column = pc.fill_null(column, "") if column.null_count else column
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = min(len(column), max(a + 1, int(np.searchsorted(ends, ends[a] + _PART, side="right")) - 1))
            part, offsets = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            last, n = token_ends(part, offsets)
            row, start, power = pieces(n, max_power)
            first = np.cumsum(n) - n
            cuts = np.concatenate([[0], last[first[row] + start + (1 << power) - 1]])
            new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            piece = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
            texts = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(part.tobytes())]) if len(part) >= 1 << 31 else pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(part.tobytes())])
            if len(row):
                cols = [piece, start, power, 1 << power]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), *(pa.array(x.astype(np.int32)) for x in cols), texts], names=["doc_id", "piece", "start", "power", "n_tokens", "text"])
            a = b

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, piece int, start int, power int, n_tokens int, text string")
