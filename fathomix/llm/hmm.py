"""Hidden Markov language model.

Training. Tokens (runs of letters, numbers or other signs, lower-cased, figures as 0) are counted over
all documents; the ``vocabulary`` most frequent are symbols of their own, every other token
is one of ``rare_bins`` symbols by its length and ending. The states start as classes of the
most frequent symbols: their left and right neighbours are counted over all documents, and
symbols with like neighbours are put together. Each Baum-Welch round runs
scaled forward and backward recursions over every document where it lies and adds up, for
a partition, the expected uses of each state, transition and (state, symbol); a shuffle by
symbol adds those of all partitions, and the driver gets one row for each symbol. Rounds end
when one raises the log-likelihood of the corpus by less than ``gain`` of it.

Scoring. The scaled forward recursion gives the exact likelihood of each whole document:
the logarithms of the scales, added. A rare token has the probability of its bin times that
of the word within the bin, which comes from the counts of all the corpus's rare words. As no
state takes part in the latter, training needs only the bins, and the logarithms join in
at the end: the table of counts grows with the corpus and stays distributed.

Documents of a partition run side by side, longest first, so that a step of the recursion
is one operation for all documents that are long enough; numbers lie state by state. Counts of
a round are made in single precision and added in double; likelihoods are in double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, map_batches, map_partition
from .text import NUMBER, SPACE, chunks, kinds, lowered, mix, runs, span_hashes

#: Tokens whose recursions run side by side (bounds memory).
BLOCK = 800_000
#: Tokens of a partition from which blocks are made.
GATHER = 5_000_000


@dataclass(frozen=True)
class Settings:
    states: int = 8
    vocabulary: int = 30_000
    rare_bins: int = 256
    #: The most Baum-Welch rounds; they end before where one gains less than ``gain`` of the log-likelihood.
    rounds: int = 20
    gain: float = 0.004
    #: Symbols, the most frequent ones, of which classes are made to start from, and how many of them count as neighbours.
    classed: int = 4000
    neighbours: int = 64
    #: Share of a classed symbol that its class's state emits at the start.
    share: float = 0.6
    seed: int = 11
    #: Added to every expected count, so that no symbol is impossible.
    smoothing: float = 0.01


@dataclass
class Model:
    """start (H), step (H, H) and emit (symbols, H) probabilities; ``words`` are the ascending hashes of the vocabulary."""

    words: np.ndarray
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


@dataclass
class Tokens:
    """Tokens of a chunk: prepared characters, start and end of each, its hash and its row."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray

    def bins(self, some: np.ndarray, rare_bins: int) -> np.ndarray:
        """The rare bin of some tokens (by index): by length and the last two characters."""
        s, e = self.starts[some], self.ends[some]
        ending = span_hashes(self.points, np.maximum(s, e - 2), e)
        size = np.minimum(e - s, 15).astype(np.uint64)
        return (mix(ending + size * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(rare_bins)).astype(np.int64)


def tokens_of(points: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The tokens of rows of code points."""
    x = lowered()[points]
    kind = kinds()[points]
    x[kind == NUMBER] = 48
    s, e = runs(kind, offsets)
    keep = kind[s] != SPACE if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    return Tokens(x, s, e, span_hashes(x, s, e), np.searchsorted(offsets, s, side="right") - 1)


def symbols(words: pd.Index, rare_bins: int, t: Tokens) -> np.ndarray:
    """Symbol of each token: its place in the vocabulary, or past it the bin of its class."""
    at = words.get_indexer(t.hashes).astype(np.int64)
    rare = np.flatnonzero(at < 0)
    at[rare] = len(words) + t.bins(rare, rare_bins)
    return at


def _added(keys: list[np.ndarray], bins: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of counts by key; a key has one bin."""
    code, some = pd.factorize(np.concatenate(keys))
    first = np.empty(len(some), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return some, np.concatenate(bins)[first], np.bincount(code, weights=np.concatenate(counts), minlength=len(some)).astype(np.int64)


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(hash, bin, n) of each token type of all documents, kept in the shared folder; ``bin`` is where it goes if it's rare."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bins, counts = [], [], []
        for batch in batches:
            for c in chunks(batch.column(0)):
                t = tokens_of(c.points, c.offsets)
                code, some = pd.factorize(t.hashes)
                first = np.empty(len(some), np.int64)
                first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                keys.append(some)
                bins.append(t.bins(first, settings.rare_bins))
                counts.append(np.bincount(code, minlength=len(some)))
                if len(keys) > 32:
                    keys, bins, counts = ([x] for x in _added(keys, bins, counts))
        if not keys:
            return
        k, b, n = _added(keys, bins, counts)
        for a in range(0, len(k), 100_000):
            some = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), pa.array(b[some]), pa.array(n[some])], names=["hash", "bin", "n"])

    return cut(map_partition(docs.select("text"), work, "hash long, bin long, n long").groupBy("hash").agg(F.min("bin").alias("bin"), F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the most frequent tokens of all documents, with counts; of equal counts the smaller hashes."""
    words, counts, _ = most_frequent(word_counts(docs, settings), settings)
    return words, counts


def most_frequent(counts: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``vocabulary`` of counted tokens, and the number of tokens of each rare bin."""
    # how many tokens are as frequent: small, and tells from which count on they fit
    times = counts.groupBy("n").count().orderBy(F.desc("n")).collect()
    times_of = {r["n"]: r["count"] for r in times}
    least, room = 0, settings.vocabulary
    for r in times:
        room -= r["count"]
        if room < 0:
            least = r["n"]
            break
    top = counts.where(F.col("n") > least)
    if room < 0:
        # of those tied at the last place the smallest hashes
        tied = room + times_of[least]
        top = top.unionAll(counts.where(F.col("n") == least).orderBy("hash").limit(tied))
    top = top.toPandas()
    k, n = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(k)
    rare = np.zeros(settings.rare_bins, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        rare[r["bin"]] = r["n"]
    np.subtract.at(rare, top["bin"].to_numpy(np.int64), n)
    return k[order], n[order], rare


def initial(words: np.ndarray, counts: np.ndarray, settings: Settings) -> Model:
    """States that differ at random in what they emit and prefer to stay."""
    rng = np.random.default_rng(settings.seed)
    h, v = settings.states, len(words) + settings.rare_bins
    base = np.concatenate([counts, np.full(settings.rare_bins, max(1.0, counts.sum() / max(1, len(counts) * 4)))]).astype(float)
    emit = base[:, None] * rng.gamma(1.0, 1.0, (v, h))
    step = np.full((h, h), 1.0 / h) + np.eye(h) + rng.random((h, h)) * 0.1
    return Model(words, np.full(h, 1.0 / h), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def neighbour_counts(sym: np.ndarray, offsets: np.ndarray, classed: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """(2, classed, neighbours) counts: how often each symbol (its number in ``classed``, -1 for none) comes right after, and right before, each neighbour."""
    inside = np.ones(max(0, len(sym) - 1), bool)
    edges = offsets[1:-1]
    inside[edges[(edges > 0) & (edges < len(sym))] - 1] = False
    n, m = int(classed.max(initial=-1)) + 1, int(neighbours.max(initial=-1)) + 1
    out = np.zeros((2, n, m), np.int64)
    for k, (x, y) in enumerate(((sym[1:], sym[:-1]), (sym[:-1], sym[1:]))):
        a, b = classed[x], neighbours[y]
        use = inside & (a >= 0) & (b >= 0)
        out[k] = np.bincount(a[use] * m + b[use], minlength=n * m).reshape(n, m)
    return out


def classes(counts: np.ndarray, totals: np.ndarray, settings: Settings) -> np.ndarray:
    """A class for each symbol of ``neighbour_counts``: k-means of the leading components of its shrunk neighbour distributions."""
    sides = []
    for m in counts:
        m = np.column_stack([m, np.maximum(totals - m.sum(axis=1), 0)]).astype(float)
        base = m.sum(axis=0) / max(1.0, m.sum())
        sides.append(np.sqrt((m + 50 * base) / (m.sum(axis=1) + 50)[:, None]) - np.sqrt(base))
    x, weight = np.concatenate(sides, axis=1), np.sqrt(np.maximum(totals, 1).astype(float))
    y = x * np.sqrt(weight)[:, None]
    _, vectors = np.linalg.eigh(y.T @ y)
    z = x @ vectors[:, ::-1][:, : settings.states]
    rng, best, least = np.random.default_rng(settings.seed), np.zeros(len(z), np.int64), math.inf
    for _ in range(8):
        centres = z[rng.choice(len(z), p=weight / weight.sum())][None]
        while len(centres) < settings.states:
            p = ((z[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * weight
            if not p.sum() > 0:
                break
            centres = np.concatenate([centres, z[rng.choice(len(z), p=p / p.sum())][None]])
        for _ in range(40):
            far = ((z[:, None] - centres[None]) ** 2).sum(axis=2)
            own = far.argmin(axis=1)
            centres = np.array([np.average(z[own == k], axis=0, weights=weight[own == k]) if (own == k).any() else c for k, c in enumerate(centres)])
        cost = float((far.min(axis=1) * weight).sum())
        if cost < least:
            best, least = own, cost
    return best


def from_classes(words: np.ndarray, totals: np.ndarray, top: np.ndarray, own: np.ndarray, settings: Settings) -> Model:
    """States that are the classes of the symbols ``top``, each of which is mostly emitted by its own; transitions nearly even."""
    h = settings.states
    emit = np.repeat((totals[:, None] + 1.0) / h, h, axis=1)
    emit[top] *= 1 - settings.share
    emit[top, own] += settings.share * totals[top]
    step = np.full((h, h), 0.8 / h) + 0.2 * np.eye(h)
    return Model(words, np.full(h, 1.0 / h), step, emit / emit.sum(axis=0))


def _lanes(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of documents, longest first: (indexes, how many are longer than t, for each t)."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    ends = np.cumsum(size[order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, side="right")))
        some = order[a:b]
        longest = size[some]
        yield some, np.searchsorted(-longest, -np.arange(longest[0]), side="left")
        a = b


def _gathered_symbols(sym: np.ndarray, begin: np.ndarray, active: list[int]) -> np.ndarray:
    """Time-major: all first symbols, then all second ones, ..."""
    return sym[np.concatenate([begin[:n] + t for t, n in enumerate(active)])]


def forward(model: Model, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log-likelihood (natural) of each document; 0 for one without tokens."""
    out = np.zeros(len(offsets) - 1)
    back = np.ascontiguousarray(model.step.T)
    for some, active in _lanes(offsets):
        active = active.tolist()
        e = model.emit[_gathered_symbols(sym, offsets[some], active)]
        alpha, total, at = None, np.zeros(len(some)), 0
        for n in active:
            x = e[at : at + n].T
            alpha = model.start[:, None] * x if alpha is None else (back @ alpha[:, :n]) * x
            scale = alpha.sum(axis=0)
            alpha /= scale
            total[:n] += np.log(scale)
            at += n
        out[some] = total
    return out


@dataclass
class Counts:
    """Expected counts of a set of documents."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    log_likelihood: float


def expected(model: Model, sym: np.ndarray, offsets: np.ndarray) -> Counts:
    """The counts of one Baum-Welch round."""
    v, h = model.emit.shape
    start, step, used, log_likelihood = np.zeros(h), np.zeros((h, h)), np.zeros((h, v)), 0.0
    emit, ahead = model.emit.astype(np.float32), model.step.astype(np.float32)
    back, first = np.ascontiguousarray(ahead.T), model.start.astype(np.float32)[:, None]
    for some, active in _lanes(offsets):
        lengths = active.tolist()
        row = np.concatenate([[0], np.cumsum(active)]).tolist()
        s = _gathered_symbols(sym, offsets[some], lengths)
        rows_e = emit[s]
        # a step's numbers lie state by state: e, alpha are (h, n) blocks one after another
        e, alpha, scale = np.empty(len(s) * h, np.float32), np.empty(len(s) * h, np.float32), np.empty(len(s), np.float32)
        at = [(row[t] * h, (row[t] + n) * h, n) for t, n in enumerate(lengths)]
        before = None
        for t, (p, q, n) in enumerate(at):
            x, y = e[p:q].reshape(h, n), alpha[p:q].reshape(h, n)
            np.copyto(x, rows_e[row[t] : row[t] + n].T)
            if t:
                np.matmul(back, before[:, :n], out=y)
                y *= x
            else:
                np.multiply(first, x, out=y)
            c = scale[row[t] : row[t] + n]
            np.add.reduce(y, axis=0, out=c)
            y /= c
            # e becomes emission over scale
            x /= c
            before = y
        log_likelihood += float(np.log(scale, dtype=np.float64).sum())
        # alpha becomes the state posterior
        beta = None
        for t in range(len(at) - 1, 0, -1):
            (p, q, n), (b, d, m) = at[t], at[t - 1]
            x = e[p:q].reshape(h, n)
            if beta is not None:
                x *= beta
                alpha[p:q].reshape(h, n)[...] *= beta
            step += alpha[b:d].reshape(h, m)[:, :n] @ x.T
            beta = ahead @ x if m == n else np.concatenate([ahead @ x, np.ones((h, m - n), np.float32)], axis=1)
        p, q, n = at[0]
        if beta is not None:
            alpha[p:q].reshape(h, n)[...] *= beta
        start += alpha[p:q].reshape(h, n).sum(axis=1)
        posterior = e.reshape(h, -1)  # the room of e serves again
        for t, (p, q, n) in enumerate(at):
            posterior[:, row[t] : row[t] + n] = alpha[p:q].reshape(h, n)
        for k in range(h):
            used[k] += np.bincount(s, weights=posterior[k], minlength=v)
    return Counts(start, step * model.step, np.ascontiguousarray(used.T), log_likelihood)


def update(model: Model, counts: Counts, smoothing: float) -> Model:
    """The model that the expected counts give."""
    share = lambda x, axis: (x + smoothing) / (x + smoothing).sum(axis=axis, keepdims=True)
    return Model(model.words, share(counts.start, 0), share(counts.step, 1), share(counts.emit, 0))


def _width(n_symbols: int) -> str:
    """Numbers of two bytes where the symbols fit in them."""
    return "<u2" if n_symbols <= 1 << 16 else "<i4"


def _documents(batches: list[pa.RecordBatch], width: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of encoded rows, whose first column holds the symbols' bytes."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for b in batches:
        column = b.column(0)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if data is not None:
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
        sizes.append(np.diff(ends))
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.frombuffer(whole.tobytes(), width).astype(np.int64), np.cumsum(np.concatenate(sizes)) // np.dtype(width).itemsize


def _gathered(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they hold GATHER tokens: enough to run side by side, and memory doesn't grow with the partition."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.column(0).nbytes // np.dtype(width).itemsize
        if n >= GATHER:
            yield some
            some, n = [], 0
    if some:
        yield some


def _blobs(values: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    """A binary value for each row, which holds its values' bytes."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    if ends[-1] < 1 << 31:
        blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])
        return blob if not null.any() else pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), blob)
    raw = values.tobytes()
    return pa.array([None if x else raw[a:b] for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), null.tolist())], pa.binary())


def encoded(docs: DataFrame, words: np.ndarray, settings: Settings) -> DataFrame:
    """(doc_id, symbols, rare) of each document, null for a null text: the bytes of its symbols' numbers, and of the hashes of its rare tokens."""
    width = _width(len(words) + settings.rare_bins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(words)
        for batch in batches:
            for c in chunks(batch.column(1)):
                t = tokens_of(c.points, c.offsets)
                sym, n_rows = symbols(index, settings.rare_bins, t), c.stop - c.start
                rare = sym >= len(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.start, n_rows),
                        _blobs(sym.astype(width), np.bincount(t.rows, minlength=n_rows), ~c.valid),
                        _blobs(t.hashes[rare].view(np.int64), np.bincount(t.rows[rare], minlength=n_rows), ~c.valid),
                    ],
                    names=["doc_id", "symbols", "rare"],
                )

    return map_partition(docs.select("doc_id", "text"), work, "doc_id long, symbols binary, rare binary")


def _sum_rows(total: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """(key, numbers) of the rows of a table that aren't 0, keys from ``first``."""
    some = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some + first), *(pa.array(np.ascontiguousarray(total[some, k])) for k in range(total.shape[1]))], names=["key", *(f"s{k}" for k in range(total.shape[1]))])


def start_model(rows: DataFrame, words: np.ndarray, totals: np.ndarray, settings: Settings) -> Model:
    """The model that training starts from: classes by neighbours, which are counted over all encoded documents. ``totals`` counts each symbol."""
    order = np.argsort(-totals, kind="stable")
    top = order[: settings.classed][totals[order[: settings.classed]] > 0]
    if len(top) <= settings.states:
        return initial(words, totals[: len(words)], settings)
    near = min(settings.neighbours, len(top))
    classed, neighbours = np.full(len(totals), -1), np.full(len(totals), -1)
    classed[top], neighbours[top[:near]] = np.arange(len(top)), np.arange(near)
    width = _width(len(totals))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(top), near), np.int64)
        for some in _gathered(batches, width):
            total += neighbour_counts(*_documents(some, width), classed, neighbours)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["key", "n"])

    got = map_partition(rows.select("symbols").where("symbols is not null"), work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # one row for each pair of a classed symbol and a neighbour: bounded by the settings
    found = got.toPandas()
    counts = np.zeros(2 * len(top) * near, np.int64)
    counts[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return from_classes(words, totals, top, classes(counts.reshape(2, len(top), near), totals[top], settings), settings)


def one_round(rows: DataFrame, model: Model) -> Counts:
    """Expected counts over all encoded documents: summed in each partition, then by symbol across them."""
    v, h = model.emit.shape
    names, width = [f"s{k}" for k in range(h)], _width(v)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows: log-likelihood in the first place, transitions from each state, starts; then the symbols
        total = np.zeros((h + 2 + v, h))
        for some in _gathered(batches, width):
            c = expected(model, *_documents(some, width))
            total[0, 0] += c.log_likelihood
            total[1 : h + 1] += c.step
            total[h + 1] += c.start
            total[h + 2 :] += c.emit
        yield from _sum_rows(total, -2 - h)

    schema = "key long, " + ", ".join(f"{x} double" for x in names)
    got = map_partition(rows.select("symbols").where("symbols is not null"), work, schema).groupBy("key").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    whole = np.zeros((h + 2 + v, h))
    whole[got["key"].to_numpy(np.int64) + 2 + h] = got[names].to_numpy(float)
    return Counts(whole[h + 1], whole[1 : h + 1], whole[h + 2 :], float(whole[0, 0]))


def train(rows: DataFrame, model: Model, settings: Settings) -> tuple[Model, list[float]]:
    """The model after rounds over encoded documents, until they gain little, and the corpus log-likelihood before each."""
    seen = []
    for _ in range(settings.rounds):
        c = one_round(rows, model)
        model = update(model, c, settings.smoothing)
        seen.append(c.log_likelihood)
        if len(seen) > 1 and seen[-1] - seen[-2] < settings.gain * abs(seen[-2]):
            break
    return model, seen


def score(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, bits_per_token) of each document under the model trained on all of them.

    A null text gives nulls; one without a token has likelihood 1 (logarithm 0) and null bits. Rows with a
    null or repeated id train and score a row each. Whole texts of any length count. A rare token counts
    as its bin and, within it, by its share of the bin's tokens in all documents. Other columns, of whatever
    names, aren't read. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = word_counts(texts, settings)
    words, counts, rare = most_frequent(kept, settings)
    # the row number is that of the row as it is kept, so that ids may be null or repeat
    rows = cut(encoded(texts, words, settings).withColumn("row", F.monotonically_increasing_id()))
    model, _ = train(rows, start_model(rows, words, np.concatenate([counts, rare]), settings), settings)
    width = _width(len(words) + settings.rare_bins)

    def explode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, offsets = _documents([batch], "<i8")
        n = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(1).to_numpy(), n)), pa.array(hashes)], names=["row", "hash"])

    # logarithms of the counts of a row's rare words (0 for those seen once); those of their bins' totals come off where the symbols are
    words_of = map_batches(rows.select("rare", "row").where("length(rare) > 0"), explode, "row long, hash long")
    within = words_of.join(kept.where("n > 1").select("hash", F.log("n").alias("log_n")), "hash").groupBy("row").agg(F.sum("log_n").alias("within"))
    totals = np.concatenate([np.zeros(len(words)), np.log(np.maximum(rare, 1))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches, width):
            sym, offsets = _documents(some, width)
            sums = np.concatenate([[0.0], np.cumsum(totals[sym])])[offsets]
            n, ll = np.diff(offsets), forward(model, sym, offsets) - np.diff(sums)
            null = np.concatenate([~np.asarray(b.column(0).is_valid()) for b in some])
            number, ids = (pa.chunked_array([b.column(k) for b in some]).combine_chunks() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([number, ids, pa.array(n, mask=null), pa.array(ll, mask=null)], names=["row", "doc_id", "n_tokens", "classes"])

    scored = map_partition(rows.select("symbols", "row", "doc_id"), work, "row long, doc_id long, n_tokens long, classes double")
    total = (F.col("classes") + F.coalesce("within", F.lit(0.0))).alias("log_likelihood")
    joined = scored.join(within, "row", "left").select("doc_id", "n_tokens", total)
    return joined.withColumn("bits_per_token", F.when(F.col("n_tokens") > 0, -F.col("log_likelihood") / F.col("n_tokens") / math.log(2)))
