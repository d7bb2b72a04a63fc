"""Secret scan by sliding-window entropy.

Maximal runs of ``ALPHABET`` are cut at the signs / _ + - in segments. Segments that people write
are known: words (of one case, capitalised, or joined capitalised ones) in which no more
consonants follow each other than in words, short numbers, and words or numbers with a short number or
ending. A candidate is what is left of a run when known segments at its start and end
are taken off, if that has at least ``min_length`` characters, half of which or more aren't in known segments. It
belongs to the narrowest character class that holds all its characters: ``hex``
(0-9, a-f of one case), ``letters`` (small ones, the first of which may be a capital), ``alnum`` or ``base64``. A window of ``window`` characters slides over it;
its Shannon entropy comes from counts that change by one character in and one out. The
candidate is a secret when its highest entropy reaches the limit of its class and the
allow-list does not know it.

Allow-list: known segments, candidates without a letter (numbers), UUIDs, and candidates that hold a
placeholder.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_batches
from .text import Chunk, chunks, runs

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
PLACEHOLDERS = ("EXAMPLE", "example", "XXXX", "xxxx", "placeholder", "PLACEHOLDER", "changeme")
SEPARATORS = "/_+-"
# what people write: consonants in a row are few in words; the patterns read each segment in one way only
_LOWER = "[A-Z]?[b-df-hj-np-tv-xz]{0,4}(?:[aeiouy]+[b-df-hj-np-tv-xz]{1,4})*[aeiouy]*"
_UPPER = "[B-DF-HJ-NP-TV-XZ]{0,3}(?:[AEIOUY]+[B-DF-HJ-NP-TV-XZ]{1,3})*[AEIOUY]*"
_JOINED = "[a-z]{2,}(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,}){2,}"
#: A known segment, for regular expressions of Python and of SQL.
KNOWN = f"(?:(?:{_LOWER}|{_UPPER}|{_JOINED})[0-9]{{0,4}}|[0-9]{{1,6}}[a-z]{{0,2}})"
_KNOWN = re.compile(KNOWN)
_SEGMENT = re.compile(rf"[^{SEPARATORS}]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_LETTERS = re.compile(r"[A-Z]?[a-z]+")
_ALNUM = re.compile(r"[0-9A-Za-z]+")


@dataclass(frozen=True)
class Rules:
    """``limits``: bits a character that a window must reach, by class."""

    min_length: int = 20
    window: int = 20
    limits: dict[str, float] = field(default_factory=lambda: {"hex": 2.8, "letters": 3.7, "alnum": 3.1, "base64": 3.4})


def _candidate_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in ALPHABET]] = True
    return table


_TABLE = _candidate_table()


def long_runs(c: Chunk, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a chunk that are long enough."""
    inside = _TABLE[c.points]
    s, e = runs(inside, c.offsets)
    if not len(s):
        return s, e
    keep = inside[s] & (e - s >= rules.min_length)
    return s[keep], e[keep]


def core(run: str) -> tuple[int, int]:
    """Start and end of what is left of a run without the known segments at its ends; equal where all are known."""
    parts = [m.span() for m in _SEGMENT.finditer(run)]
    first, last = 0, len(parts)
    while first < last and _KNOWN.fullmatch(run, *parts[first]):
        first += 1
    while first < last and _KNOWN.fullmatch(run, *parts[last - 1]):
        last -= 1
    return (parts[first][0], parts[last - 1][1]) if first < last else (0, 0)


def character_class(text: str) -> str:
    """hex, letters, alnum or base64."""
    return "hex" if _HEX.fullmatch(text) else "letters" if _LETTERS.fullmatch(text) else "alnum" if _ALNUM.fullmatch(text) else "base64"


def max_entropy(text: str, window: int) -> float:
    """Highest Shannon entropy (bits) of a window; n log2 n of the counts is kept up to date, one character in and one out."""
    window = min(window, len(text))
    if not window:
        return 0.0
    plogp = [0.0, 0.0, *(n * math.log2(n) for n in range(2, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for ch in text[:window]:
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        total += plogp[n + 1] - plogp[n]
    least = total
    for old, new in zip(text, text[window:]):
        if old != new:
            n = counts[old]
            counts[old] = n - 1
            total += plogp[n - 1] - plogp[n]
            n = counts.get(new, 0)
            counts[new] = n + 1
            total += plogp[n + 1] - plogp[n]
            least = min(least, total)
    return round(math.log2(window) - least / window, 6)


def allowed(text: str) -> bool:
    """Whether the allow-list suppresses a candidate."""
    if not any(ch.isalpha() for ch in text) or _UUID.fullmatch(text) or any(p in text for p in PLACEHOLDERS):
        return True
    return 2 * sum(len(x) for x in _SEGMENT.findall(text) if not _KNOWN.fullmatch(x)) < len(text)


def secrets(c: Chunk, rules: Rules) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, class, entropy) of the secrets of a chunk, positions within the chunk."""
    for a, b in zip(*(x.tolist() for x in long_runs(c, rules))):
        run = c.text(a, b)
        x, y = core(run)
        text = run[x:y]
        if y - x < rules.min_length or _UUID.fullmatch(run) or allowed(text):
            continue
        kind = character_class(text)
        entropy = max_entropy(text, rules.window)
        if entropy >= rules.limits[kind]:
            yield a + x, a + y, kind, entropy


def scan(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, kind, entropy): a row for each secret, ``start`` counting characters from 0.

    Null and empty texts have none. A row with a null id gives findings with a null id; repeated rows give
    repeated findings. Texts of any length are scanned whole. Other columns, of whatever names, aren't read; an
    empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch.column(1)):
            found = list(secrets(c, rules))
            if not found:
                continue
            a, b, kind, entropy = zip(*found)
            a, b = np.array(a), np.array(b)
            row = c.rows_of(a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row + c.start)), pa.array(a - c.offsets[row]), pa.array(b - a), pa.array(kind, pa.string()), pa.array(entropy, pa.float64())],
                names=["doc_id", "start", "length", "kind", "entropy"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, start long, length long, kind string, entropy double")


def redact(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """The documents with each secret replaced by ``mark``; other columns, and texts without a secret, are unchanged.

    ``length_col`` names a column of the text's length in characters, which is brought up to date where the text changes.
    Every row stays, with a null or empty text, a null id or repeated too. An empty table gives no rows.
    """
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column, changed = batch.column(at), {}
        for c in chunks(column):
            found: dict[int, list] = {}
            for a, b, _, _ in secrets(c, rules):
                found.setdefault(int(c.rows_of(np.array([a]))[0]), []).append((a, b))
            for row, spans in found.items():
                out, last = [], int(c.offsets[row])
                for a, b in spans:
                    out += [c.text(last, a), mark]
                    last = b
                changed[c.start + row] = "".join([*out, c.text(last, int(c.offsets[row + 1]))])
        if changed:
            mask = np.zeros(len(column), bool)
            mask[list(changed)] = True
            order = sorted(changed)
            columns = list(batch.columns)
            columns[at] = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in order], column.type))
            if length_at is not None:
                kind = columns[length_at].type
                columns[length_at] = pc.replace_with_mask(columns[length_at], pa.array(mask), pa.array([len(changed[i]) for i in order]).cast(kind))
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch

    return map_batches(docs, work, docs.schema)
