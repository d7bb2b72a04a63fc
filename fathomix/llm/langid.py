"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ``order`` over lower-cased letters (every run of other
characters is one boundary symbol): absolute discounting on the counts of the highest
order, continuation counts below, a uniform floor over the alphabet at the bottom. Its
tables are ascending arrays of 64-bit n-gram hashes with the counts beside them. A text
goes to the language of the lowest cross-entropy in bits a symbol.

Rejection is calibrated on labelled texts held out of training. A language's model gives
its own held-out texts a mean cross-entropy, and those of the other languages a higher one
(with a single language, the bits of a uniform symbol stand for it). A text is rejected when
its cross-entropy is past ``cut`` of the way from the first to the second by more than
``max_z`` standard errors of a text of its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import check_languages, map_batches
from .text import LETTER, Chunk, chunks, find, kinds, lowered, mix

BOUNDARY, UNKNOWN = 0, 1


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the labelled texts that models are fitted on; one in ``hold_out`` of them calibrates."""

    order: int = 3
    per_language: int = 300
    hold_out: int = 4
    cut: float = 0.5
    max_z: float = 3.0
    #: Rare letters of the training texts (seen fewer times than this, in all languages) are UNKNOWN.
    min_letter: int = 5


@dataclass
class Level:
    """One order of a model: n-gram hashes with counts, context hashes with total and number of followers, the discount."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    followers: np.ndarray
    discount: float


@dataclass
class Model:
    lang: str
    levels: list[Level]
    size: int
    mean: float = 0.0
    foreign: float = 0.0
    variance: float = 0.0


@dataclass
class Identifier:
    """Models of all languages over one alphabet."""

    letters: np.ndarray
    order: int
    models: list[Model]
    cut: float
    max_z: float
    _table: np.ndarray | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    def __getstate__(self):
        return {**self.__dict__, "_table": None}


def symbols(c: Chunk, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk and their rows' offsets: letters by index, one BOUNDARY for a run of other characters; none at a row's ends."""
    points = lowered()[c.points]
    table = np.zeros(0x110000, np.uint8 if len(letters) < 250 else np.uint32)
    table[kinds() == LETTER] = UNKNOWN
    table[letters] = np.arange(len(letters)) + 2
    sym = table[points]
    keep = sym != BOUNDARY
    keep[1:] |= keep[:-1]  # the first of a run of others
    if len(c.offsets) > 1 and len(sym):
        starts = c.offsets[:-1][c.offsets[:-1] < len(sym)]
        keep[starts] &= sym[starts] != BOUNDARY
    where = np.concatenate([[0], np.cumsum(keep)])
    offsets = where[c.offsets]
    out = sym[keep]
    # a boundary at a row's end says nothing: drop it
    filled = np.flatnonzero(np.diff(offsets) > 0)
    ends = offsets[1:][filled] - 1
    trailing = ends[out[ends] == BOUNDARY]
    if len(trailing):
        mask = np.ones(len(out), bool)
        mask[trailing] = False
        where = np.concatenate([[0], np.cumsum(mask)])
        out, offsets = out[mask], where[offsets]
    return out, offsets


def codes(sym: np.ndarray, offsets: np.ndarray, order: int, size: int) -> np.ndarray:
    """Number of the n-gram that ends at each symbol; before a row's start stand boundaries (symbol 0)."""
    x = sym.astype(np.int64)
    out = x.copy()
    place = np.arange(len(x)) - np.repeat(offsets[:-1], np.diff(offsets))
    scale = 1
    for back in range(1, order):
        scale *= size
        shifted = np.zeros(len(x), np.int64)
        shifted[back:] = x[:-back] if back < len(x) else 0
        shifted[place < back] = 0
        out += shifted * scale
    return out


def _hash(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) + np.uint64(0x51ED270B))


def _sorted(code: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    h = _hash(code)
    order = np.argsort(h)
    return (h[order], *(v[order] for v in values))


def train(lang: str, code: np.ndarray, order: int, size: int) -> Model:
    """Model from the n-gram numbers of its texts."""
    levels, grams, counts = [], *np.unique(code, return_counts=True)
    for n in range(order, 0, -1):
        context = grams // size  # a code's lowest digit is its last symbol
        context = grams // size if n > 1 else np.zeros(len(grams), np.int64)
        seen, at = np.unique(context, return_inverse=True)
        totals = np.bincount(at, weights=counts).astype(np.int64)
        followers = np.bincount(at)
        one, two = int((counts == 1).sum()), int((counts == 2).sum())
        discount = one / (one + 2 * two) if one else 0.5
        g, c = _sorted(grams, counts)
        s, t, f = _sorted(seen, totals, followers)
        levels.append(Level(g, c, s, t, f, discount))
        # continuation counts: in how many contexts the shorter n-gram is seen
        grams, counts = np.unique(grams % size ** (n - 1), return_counts=True) if n > 1 else (grams, counts)
    return Model(lang, levels, size)


def log_probability(model: Model, code: np.ndarray) -> np.ndarray:
    """log2 P of the last symbol of each n-gram given the rest."""
    order, size = len(model.levels), model.size
    p = np.full(len(code), 1.0 / size)
    for n in range(1, order + 1):
        level = model.levels[order - n]
        gram = code % size**n
        context = gram // size if n > 1 else np.zeros(len(code), np.int64)
        g, s = find(level.grams, _hash(gram)), find(level.contexts, _hash(context))
        count = np.where(g >= 0, level.counts[g], 0)
        total = np.where(s >= 0, level.totals[s], 1)
        kept = np.where(s >= 0, level.discount * level.followers[s] / total, 1.0)
        p = np.maximum(count - level.discount, 0) / total + kept * p
    return np.log2(p)


def _scores(who: Identifier, code: np.ndarray) -> np.ndarray:
    """(n, languages) log2 P. Each n-gram is looked up in the sorted arrays once a worker, or once a call where the alphabet is large."""
    cells = who.size**who.order
    if cells > 1 << 22:
        some, at = np.unique(code, return_inverse=True)
        return np.stack([log_probability(m, some) for m in who.models], axis=1)[at]
    if who._table is None:
        who._table = np.full((cells, len(who.models)), np.nan)
    fresh = np.zeros(cells, bool)
    fresh[code] = True
    fresh = np.flatnonzero(fresh)
    fresh = fresh[np.isnan(who._table[fresh, 0])]
    if len(fresh):
        who._table[fresh] = np.stack([log_probability(m, fresh) for m in who.models], axis=1)
    return who._table[code]


def cross_entropies(who: Identifier, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, languages) mean bits a symbol, symbols of each row, (rows, languages) mean squared bits."""
    sym, offsets = symbols(c, who.letters)
    n = np.diff(offsets)
    total = np.zeros((len(n), len(who.models)))
    square = np.zeros_like(total)
    if len(sym):
        bits = -_scores(who, codes(sym, offsets, who.order, who.size))
        filled = np.flatnonzero(n)
        total[filled] = np.add.reduceat(bits, offsets[:-1][filled], axis=0, dtype=np.float64)
        square[filled] = np.add.reduceat(np.square(bits), offsets[:-1][filled], axis=0, dtype=np.float64) if who.max_z == math.inf else 0
    return total / np.maximum(n, 1)[:, None], n, square / np.maximum(n, 1)[:, None]


def fit(texts: list[tuple[str, str]], settings: Settings = Settings()) -> Identifier:
    """Identifier from (language, text) pairs; every ``hold_out``-th text of a language calibrates, the others train.

    A language with fewer than twice ``hold_out`` texts trains on all and is calibrated on the same, so its limit is tight.
    """
    by: dict[str, list[str]] = {}
    for lang, text in texts:
        by.setdefault(lang, []).append(text)
    whole = np.concatenate([next(chunks(pa.array(["\n".join(x)]))).points for x in by.values()] or [np.zeros(0, np.uint32)])
    whole = lowered()[whole]
    letters, times = np.unique(whole[kinds()[whole] == LETTER], return_counts=True)
    who = Identifier(letters[times >= settings.min_letter].astype(np.int64), settings.order, [], settings.cut, math.inf)
    held = {}
    for lang in sorted(by):
        mine = by[lang]
        held[lang] = mine[:: settings.hold_out] if len(mine) >= 2 * settings.hold_out else mine
        used = [t for i, t in enumerate(mine) if i % settings.hold_out] if len(mine) >= 2 * settings.hold_out else mine
        code = []
        for c in chunks(pa.array(used)):
            sym, offsets = symbols(c, who.letters)
            code.append(codes(sym, offsets, who.order, who.size))
        if sum(map(len, code)):
            who.models.append(train(lang, np.concatenate(code), who.order, who.size))
    means = np.full((len(who.models), len(who.models)), math.log2(who.size))
    for k, model in enumerate(who.models):
        parts = [cross_entropies(who, c) for c in chunks(pa.array(held[model.lang]))]
        mean, n, square = (np.concatenate(x) for x in zip(*parts))
        if n.sum():
            means[k] = (mean * n[:, None]).sum(axis=0) / n.sum()
            model.variance = float((square[:, k] * n).sum() / n.sum() - means[k, k] ** 2)
    for k, model in enumerate(who.models):
        others = np.delete(means[:, k], k)
        model.mean, model.foreign = float(means[k, k]), float(others.mean() if len(others) else math.log2(who.size))
    who.max_z = settings.max_z
    who._table = None
    return who


def sample(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Up to ``per_language`` labelled rows of each language, first in the order of the MD5 of their ids, the ids and the texts, less those with a null text. Rows are bounded, not ids."""
    check_languages(docs, lang_col)
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    label = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    # ids first, from two narrow columns; then the texts of their rows, again no more than per_language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ids = label.withColumn("k", place).where(F.col("k") <= settings.per_language).select("doc_id", "lang").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # bounded: per_language ids of each language
    some = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc_nulls_last("text")))
    found = some.withColumn("k", place).where(F.col("k") <= settings.per_language).where("text is not null").collect()
    found.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    return [(r.lang, r.text) for r in found]


def decide(who: Identifier, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best model (-1: none), its cross-entropy, symbols, and whether each row is accepted."""
    n_rows = c.stop - c.start
    if not who.models:
        return np.full(n_rows, -1), np.zeros(n_rows), np.zeros(n_rows, np.int64), np.zeros(n_rows, bool)
    h, n, _ = cross_entropies(who, c)
    best = h.argmin(axis=1)
    bits = h[np.arange(n_rows), best]
    mean, foreign, variance = (np.array([getattr(m, x) for m in who.models])[best] for x in ("mean", "foreign", "variance"))
    limit = mean + who.cut * np.maximum(foreign - mean, 0) + who.max_z * np.sqrt(variance / np.maximum(n, 1))
    return np.where(n > 0, best, -1), bits, n, (n > 0) & (bits <= limit) & c.valid


def identify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, bits, n_symbols, accepted) of each document.

    ``language`` is the best model's, also of a rejected text; null where there is no letter. A null or empty
    text, and one without letters, has 0 symbols and isn't accepted. Equal entropies go to the language first
    in order. Where no row is labelled there is no model and nothing is accepted. Rows with a null or repeated
    id give a row each; an empty table gives none. Other columns, of whatever names, aren't read. Texts of any length are read whole.
    """
    who = fit(sample(docs, settings, id_col, text_col, lang_col), settings)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.array([m.lang for m in who.models] + [None], object)
        for c in chunks(batch.column(1)):
            best, bits, n, accepted = decide(who, c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.start, c.stop - c.start), pa.array(names[best], pa.string()), pa.array(np.round(bits, 6), mask=n == 0), pa.array(n.astype(np.int64)), pa.array(accepted)],
                names=["doc_id", "language", "bits", "n_symbols", "accepted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, language string, bits double, n_symbols long, accepted boolean")


def keep_known(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", set_lang: bool = False) -> DataFrame:
    """The documents that ``identify`` accepts, all columns unchanged; with ``set_lang`` the language column gets the identified language.

    Null and empty texts, and those without letters, aren't accepted. Rows with a null id and repeated rows are judged each
    by their texts; other columns, of whatever names and types, pass through. An empty table gives no rows.
    """
    who = fit(sample(docs, settings, id_col, text_col, lang_col), settings)
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        judged = [decide(who, c) for c in chunks(batch.column(text))]
        best, keep = (np.concatenate([j[k] for j in judged]) for k in (0, 3))
        if set_lang:
            names = np.array([m.lang for m in who.models] + [None], object)
            columns = list(batch.columns)
            columns[lang] = pa.array(names[best], pa.string()).cast(columns[lang].type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch.filter(pa.array(keep))

    return map_batches(docs, work, docs.schema)
