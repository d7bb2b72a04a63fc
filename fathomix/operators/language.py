"""Language by ranked character n-grams: the distance of a text's profile from each language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = 500
#: Longest n-gram.
MOST = 4
#: Letters by rank: a to z, then the Latin-1 letters. Four ranks of six bits make a number that sorts as the n-gram does.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xE0, 0x100)))
_CHUNK = 1 << 19


def grams(word: Column, most: int = MOST) -> Column:
    """All n-grams of 1 to ``most`` letters of a word; none crosses a word's end."""
    none = F.expr("cast(array() as array<string>)")
    one = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substr(word, i, F.lit(n)))).otherwise(none)
    return F.concat(*(one(n) for n in range(1, most + 1)))


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rank = np.zeros(256, np.int64)
    rank[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
    return np.where(points < 256, rank[np.minimum(points, 255)], 0)


def _top(texts: list[str], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram number and place of the ``top`` n-grams of each text."""
    parts = [np.append(_symbols(t), 0) for t in texts]
    x, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    whole, keys = x > 0, []
    gram = np.zeros(len(x), np.int64)
    for n in range(MOST):
        shifted = np.zeros(len(x), np.int64)
        shifted[: len(x) - n] = x[n:]
        whole &= shifted > 0
        gram = gram | shifted << (6 * (MOST - 1 - n))
        keys.append((row << 24 | gram)[whole])
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    row = keys >> 24
    order = np.lexsort((keys, -counts, row))
    keys, row = keys[order], row[order]
    first = np.searchsorted(row, np.arange(len(texts)))
    place = np.arange(len(keys)) - first[row]
    keep = place < top
    return row[keep], (keys & 0xFFFFFF)[keep], place[keep]


def _spell(grams: np.ndarray) -> list[str]:
    some, at = np.unique(grams, return_inverse=True)
    names = np.array(["".join(LETTERS[r - 1] for k in (18, 12, 6, 0) if (r := g >> k & 63)) for g in some.tolist()], object)
    return names[at].tolist() if len(some) else []


def profiles(docs: DataFrame, did: str = "did", text: str = "text", top: int = 100) -> DataFrame:
    """(did, gram, place): the ``top`` n-grams of each whole text by falling count, ties by gram; places count from 0.

    A profile needs its document alone, so it is made where the document lies, without a shuffle. Texts
    that are null or hold no letter have no row; rows that repeat an id give their profiles each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                row, gram, place = _top(texts[a:b], top)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(_spell(gram), pa.string()), pa.array(place.astype(np.int32))], names=["did", "gram", "place"])

    return docs.select(F.col(did).cast("long").alias("did"), F.col(text).alias("text")).mapInArrow(work, "did long, gram string, place int")


def _words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-zà-ÿ]+", "_"), "_"), lambda w: w != "")


def train(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = 100) -> DataFrame:
    """(lang, gram, place): profiles of whole corpora. Words are counted first, so that only distinct ones are cut in n-grams."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_words(F.col(text))).alias("w"))
    words = rows.groupBy("lang", "w").agg(F.count("*").alias("n"))
    counted = words.select("lang", "n", F.explode(grams(F.col("w"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("place", place).where(F.col("place") <= top).select("lang", "gram", (F.col("place") - 1).cast("int").alias("place"))


def _numbers(grams: list[str]) -> np.ndarray:
    """The numbers that ``_top`` gives n-grams."""
    rank = {c: i for i, c in enumerate(LETTERS, 1)}
    return np.array([sum(rank[c] << (6 * (MOST - 1 - k)) for k, c in enumerate(g)) for g in grams], np.int64)


#: Rows of models that are sent to every task.
MOST_MODEL_ROWS = 1_000_000


class Models:
    """Ranked n-grams of each language, for distances in batches."""

    def __init__(self, models: DataFrame):
        rows = models.select("lang", "gram", "place").limit(MOST_MODEL_ROWS + 1).collect()
        if len(rows) > MOST_MODEL_ROWS:
            raise ValueError(f"more than {MOST_MODEL_ROWS} rows of language models")
        self.langs, self.tables = sorted({r.lang for r in rows}), []
        for lang in self.langs:
            mine = [r for r in rows if r.lang == lang]
            gram, place = _numbers([r.gram for r in mine]), np.array([r.place for r in mine], np.int64)
            order = np.argsort(gram)
            self.tables.append((gram[order], place[order]))

    def nearest(self, texts: list[str], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Language (by number, -1 for a text without a letter) and distance of each text."""
        row, gram, place = _top(texts, top)
        far = np.empty((len(self.langs), len(texts)))
        for k, (known, at) in enumerate(self.tables):
            i = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            off = np.where(known[i] == gram, np.abs(place - at[i]), MISSING)
            far[k] = np.bincount(row, weights=off, minlength=len(texts))
        some = np.bincount(row, minlength=len(texts)) > 0
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts), np.int64)
        return np.where(some, far.argmin(axis=0), -1), far.min(axis=0).astype(np.int64)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Rows of a batch that are worked on together."""
    ends, a = np.cumsum([len(t) for t in texts]), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHUNK, side="right")))
        yield a, b
        a = b


def classify(docs: DataFrame, models: DataFrame, did: str = "doc_id", text: str = "text", top: int = 100) -> DataFrame:
    """(did, lang, distance): the language of the smallest sum of place differences; an n-gram that a model lacks counts MISSING.

    Ties go to the language first in order; a text without a letter has no row. The models, ``top`` rows a
    language, go to every task; distances are computed in the batch that makes the profiles, without a shuffle.
    """
    known = Models(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*known.langs, None], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                best, far = known.nearest(texts[a:b], top)
                rows = np.flatnonzero(best >= 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + a)), pa.array(names[best[rows]], pa.string()), pa.array(far[rows])], names=["did", "lang", "distance"])

    return docs.select(F.col(did).cast("long").alias("did"), F.col(text).alias("text")).mapInArrow(work, "did long, lang string, distance long")


def tag(docs: DataFrame, models: DataFrame | None = None, lang: str = "lang", text: str = "text", top: int = 100, fixed: str | None = None) -> DataFrame:
    """The documents with their language column filled: ``fixed`` for all if given, else what is known stays and the rest is classified.

    What this writes is the cache: a tagged document isn't classified again. Texts without a letter stay untagged.
    """
    have = docs if lang in docs.columns else docs.withColumn(lang, F.lit(None).cast("string"))
    if fixed is not None:
        return have.withColumn(lang, F.lit(fixed))
    known, at, body = Models(models), have.columns.index(lang), have.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*known.langs, None], object)
        for batch in batches:
            labels = np.array(batch.column(at).to_pylist(), object)
            rows = np.flatnonzero(np.equal(labels, None))
            texts = [t or "" for t in batch.column(body).take(pa.array(rows)).to_pylist()]
            for a, b in _runs(texts):
                labels[rows[a:b]] = names[known.nearest(texts[a:b], top)[0]]
            columns = list(batch.columns)
            columns[at] = pa.array(labels, pa.string()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return have.mapInArrow(work, have.schema)
