"""Quality rules by divergence from the language.

For each language the whole corpus gives two references: the histogram of character
classes, and the histogram of its common words (the ``top`` words by count, without those tied
at the last place if they don't all fit, and one bin for the rest). A document is compared with the references of its own
language by Jensen-Shannon distance (base 2, so 0 to 1) and rejected where a distance
exceeds its limit. A rule judges only documents of a minimum length; shorter ones pass it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import check_languages, map_batches, map_partition
from .text import LETTER, chunks, find, kinds, lowered, merge_counts, runs, span_hashes

CLASSES = ("lower", "upper", "letter", "number", "space", "punctuation", "other")
PUNCTUATION = ".,;:!?'\"()-"


@dataclass(frozen=True)
class Rules:
    """Limits and guards. ``min_chars`` guards the class rule, ``min_words`` the word rule.

    A histogram of n words strays from its source by about 1 / sqrt(n), so the limit of the
    word rule is ``max_words + word_noise / sqrt(n)``.
    """

    top: int = 30
    max_class: float = 0.25
    max_words: float = 0.22
    word_noise: float = 1.1
    min_chars: int = 150
    min_words: int = 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(sys.maxunicode + 1, 6, np.uint8)
    for i in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(i))
        if k[0] == "L":
            out[i] = {"Ll": 0, "Lu": 1}.get(k, 2)
        elif k[0] == "N":
            out[i] = 3
    out[[9, 10, 12, 13, 32]] = 4
    out[[ord(c) for c in PUNCTUATION]] = 5
    return out


def class_counts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, classes) counts."""
    n, c = len(offsets) - 1, len(CLASSES)
    row = np.repeat(np.arange(n) * c, np.diff(offsets))
    return np.bincount(row + classes()[points], minlength=n * c).reshape(n, c)


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of letters, lower-cased."""
    kind = kinds()[points]
    s, e = runs(kind, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = kind[s] == LETTER
    s, e = s[keep], e[keep]
    return span_hashes(lowered()[points], s, e), np.searchsorted(offsets, s, side="right") - 1


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of histograms p and q (counts; q's rows may be broadcast), rounded to 6 places; 0 where p is empty."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        d = np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))
    return np.where(total[:, 0] > 0, np.round(d, 6), 0.0)


@dataclass
class Reference:
    """Of one language: class counts, and common words as ascending hashes with counts; ``rest`` counts all other words."""

    classes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    rest: int


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of a partition: words by hash, and under the flag ``word`` = false the classes by number, then all words."""
    kept: dict[str, tuple[list, list]] = {}
    per_class: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0)
        for c in chunks(batch.column(1)):
            names, code = np.unique(np.array(langs.slice(c.start, c.stop - c.start).fill_null("").to_pylist(), object), return_inverse=True)
            cc = class_counts(c.points, c.offsets)
            h, r = words(c.points, c.offsets)
            for k, name in enumerate(names):
                keys, counts = np.unique(h[code[r] == k], return_counts=True)
                ks, cs = kept.setdefault(name, ([], []))
                ks.append(keys)
                cs.append(counts)
                if len(ks) > 16:
                    k1, c1 = merge_counts(ks, cs)
                    kept[name] = ([k1], [c1])
                per_class[name] = per_class.get(name, 0) + cc[code == k].sum(axis=0)
    for name, (ks, cs) in kept.items():
        keys, counts = merge_counts(ks, cs)
        cls = np.arange(len(CLASSES) + 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (len(keys) + len(cls)), pa.string()),
                pa.array(np.concatenate([keys.view(np.int64), cls])),
                pa.array(np.concatenate([counts, per_class[name], [counts.sum()]]).astype(np.int64)),
                pa.array(np.concatenate([np.ones(len(keys), bool), np.zeros(len(cls), bool)])),
            ],
            names=["lang", "hash", "n", "word"],
        )


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> dict[str, Reference]:
    """References of each language, counted over all documents; what comes to the driver is ``top`` + 1 words a language."""
    check_languages(docs, lang_col)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    counts = map_partition(rows, _count, "lang string, hash long, n long, word boolean").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    # a row number alone, so that each task keeps only its best before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang", "word").orderBy(F.desc("n"), "hash"))
    found: dict[str, Reference] = {}
    by: dict[str, list] = {}
    for x in counts.withColumn("k", rank).where(F.col("k") <= max(rules.top, len(CLASSES)) + 1).collect():
        by.setdefault(x.lang, []).append(x)
    for lang, xs in by.items():
        cls = np.zeros(len(CLASSES), np.int64)
        for x in xs:
            if not x.word and x.hash < len(cls):
                cls[x.hash] = x.n
        # the word after the last tells whether those tied at the last place all fit
        least = max((x.n for x in xs if x.word and x.k == rules.top + 1), default=0)
        common = sorted((np.int64(x.hash).view(np.uint64), x.n) for x in xs if x.word and x.k <= rules.top and x.n > least)
        hashes, n = np.array([c[0] for c in common], np.uint64), np.array([c[1] for c in common], np.int64)
        total_words = next((x.n for x in xs if not x.word and x.hash == len(cls)), 0)
        found[lang] = Reference(cls, hashes, n, int(total_words - n.sum()))
    return found


def measure(points: np.ndarray, offsets: np.ndarray, langs: np.ndarray, refs: dict[str, Reference]) -> tuple[np.ndarray, ...]:
    """Class distance, word distance, characters and words of each row."""
    n = len(offsets) - 1
    cc = class_counts(points, offsets)
    h, r = words(points, offsets)
    n_words = np.bincount(r, minlength=n)
    d_class, d_words = np.zeros(n), np.zeros(n)
    for lang in set(langs.tolist()):
        mine, ref = langs == lang, refs.get(lang)
        if ref is None:
            continue
        d_class[mine] = js_distance(cc[mine], ref.classes[None, :])
        width = len(ref.hashes) + 1
        slot = np.cumsum(mine) - 1
        use = mine[r]
        at = find(ref.hashes, h[use])
        at[at < 0] = width - 1
        hist = np.bincount(slot[r[use]] * width + at, minlength=int(mine.sum()) * width).reshape(-1, width)
        d_words[mine] = js_distance(hist, np.append(ref.counts, ref.rest)[None, :])
    return d_class, d_words, np.diff(offsets), n_words


def _judge(batch: pa.RecordBatch, text: int, lang: int, refs: dict[str, Reference], rules: Rules):
    for c in chunks(batch.column(text)):
        langs = np.array(batch.column(lang).slice(c.start, c.stop - c.start).fill_null("").to_pylist(), object)
        d_class, d_words, n_chars, n_words = measure(c.points, c.offsets, langs, refs)
        bad_class = (d_class > rules.max_class) & (n_chars >= rules.min_chars)
        bad_words = (d_words > rules.max_words + rules.word_noise / np.sqrt(np.maximum(n_words, 1))) & (n_words >= rules.min_words)
        yield c, d_class, d_words, bad_class, bad_words


def judged(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, class_distance, word_distance, keep): the two distances of each document and whether it passes.

    A null text gives null distances and isn't kept. An empty text has distances 0 and passes, being shorter
    than either guard. A null language is a language of its own, the same as an empty one. Rows with a null or repeated id give a row
    each; an empty table gives none. Words tied at the last place of the common ones are left out if they don't all fit.
    Texts of any length are read whole; other columns, of whatever names, aren't read.
    """
    refs = references(docs, rules, text_col, lang_col)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c, d_class, d_words, bad_class, bad_words in _judge(batch, 1, 2, refs, rules):
            null = ~c.valid
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.start, c.stop - c.start), pa.array(d_class, mask=null), pa.array(d_words, mask=null), pa.array(~(bad_class | bad_words | null))],
                names=["doc_id", "class_distance", "word_distance", "keep"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return map_batches(rows, work, "doc_id long, class_distance double, word_distance double, keep boolean")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that ``judged`` keeps, all columns unchanged, in one pass after the references.

    Documents with a null text go; empty and short ones stay. Rows with a null id and repeated rows are judged each; other columns,
    of whatever names and types, pass through. An empty table gives no rows.
    """
    refs = references(docs, rules, text_col, lang_col)
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = np.concatenate([~(bc | bw) & c.valid for c, _, _, bc, bw in _judge(batch, text, lang, refs, rules)])
        yield batch.filter(pa.array(keep))

    return map_batches(docs, work, docs.schema)
