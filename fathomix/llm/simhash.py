"""Near-duplicate search over SimHash fingerprints with pivot distance tables.

A text's fingerprint has 256 bits (four words): the sign of the sum, over its
distinct lower-cased words and word pairs, of a hashed +-1 vector. Two texts are
near-duplicates iff their fingerprints differ in at most ``max_distance`` bits.

Search. No pair within ``max_distance`` is lost, whatever the number of fingerprints. They are dealt to groups of some ``GROUP_ROWS``, and a task has two
groups, or one with itself, and a share of the blocks below; so a fingerprint travels once for each group and share, and no task's memory grows with the table.
``near_within`` finds the links of a task: fingerprints are a ring of blocks, of which a pair at most
``max_distance`` apart has one from where on every run of blocks differs in fewer bits than its share of ``max_distance + 1``. So the pairs are looked for from
each block in turn, among fingerprints whose bits of that block are close, and the 64 bits from there on reject nearly all strangers.
Pairs in one component are left out, so before that a table of sampled-bit keys links what is easily found. In its buckets of up to ``SMALL`` fingerprints all pairs are
verified, which costs less than any filter before it. In a larger one a pivot table produces the pairs: reference fingerprints are taken from the
bucket, one after another of those that no reference so far is near to, and every member's distance to each is
computed. Members near a reference are linked to it, so among them no pair need be looked at; by the
triangle inequality a pair whose distances to a reference differ by more than ``max_distance`` is discarded
without loss, so that what else may be near a member lies in a range of the sorted table, and is verified. A bucket of so many
strangers that this is too much goes to ``near_within``.

Groups are the connected components of the pairs; the smallest id of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, map_batches, map_partition, without_ids
from .text import LETTER, NUMBER, chunks, kinds, lowered, mix, runs, span_hashes, span_pairs

WORDS = 4
MAX_DISTANCE = 48
#: The fewest key tables.
N_KEYS = 32
#: Chance that two fingerprints at the largest distance share a bucket of some key table.
RECALL = 0.92
#: Fingerprints of a bucket of which all pairs are verified; most references of a bucket, and of those the ones whose distances are kept as its table.
SMALL, N_PIVOTS, N_COLUMNS = 64, 4096, 64
#: References in a row without a neighbour after which a bucket is taken for one of strangers, and how many of those are looked at one by one.
IDLE, ONE_BY_ONE = 8, 4096
#: Pairs of rows up to which all are verified, whatever their blocks, and those compared at a time.
FEW_PAIRS, CHUNK = 1 << 18, 1 << 17
#: Rows of a component from which pairs within it are left out before they are compared.
FAMILY = 256
#: Rows of a group, of which a task has two; tasks that pairs of groups are shared over, if there are fewer; rows from which they are shared more.
GROUP_ROWS, TASKS, SHARE_ROWS = 1 << 20, 64, 4096
#: Bytes of rows that one task takes in, where a pair of groups has fewer.
TASK_BYTES = 64 << 20
_ROW_BYTES = 48
#: Features whose bits are summed at once (bounds memory).
_BLOCK = 1 << 16

SIGNATURE = "doc_id long, text_a long, text_b long, n_features long, f0 long, f1 long, f2 long, f3 long"


def fingerprints(features: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, 4) fingerprints of features (64-bit hashes) that belong to ascending rows; rows without features are 0."""
    sums = np.zeros((n_rows, 64 * WORDS), np.int32)
    count = np.bincount(rows, minlength=n_rows)
    for a in range(0, len(features), _BLOCK):
        h, r = features[a : a + _BLOCK], rows[a : a + _BLOCK]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        for w in range(WORDS):
            x = mix(h + np.uint64((w + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
            sums[r[first], 64 * w : 64 * w + 64] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > count[:, None], axis=1).view(np.uint64).reshape(n_rows, WORDS)


def features(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word and word-pair hashes and their rows, rows ascending."""
    kind = kinds()[points]
    s, e = runs(kind, offsets)
    keep = (kind[s] == LETTER) | (kind[s] == NUMBER) if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    word = span_hashes(points, s, e)
    row = np.searchsorted(offsets, s, side="right") - 1
    same = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[same]
    h, r = np.concatenate([word, pair]), np.concatenate([row, row[1:][same]])
    # sorted by row, then hash: the row takes the top bits, which costs a few bits of hash only for telling doubles
    key = (r.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    pick = order[first]
    return h[pick], r[pick]


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    low = lowered()
    for c in chunks(batch.column(1)):
        points = low[c.points]
        h, r = features(points, c.offsets)
        n = c.stop - c.start
        prints = fingerprints(h, r, n).view(np.int64)
        whole, other = span_pairs(c.points, c.offsets[:-1], c.offsets[1:])
        ids = batch.column(0).slice(c.start, n)
        cols = [whole.view(np.int64), other.view(np.int64), np.bincount(r, minlength=n).astype(np.int64)]
        out = [ids, *map(pa.array, cols), *(pa.array(np.ascontiguousarray(prints[:, w])) for w in range(WORDS))]
        rows = pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SIGNATURE.split(", ")])
        yield rows.filter(pa.array(c.valid)) if not c.valid.all() else rows


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with an id and a text: 128 bits of the exact text, the number of features, four fingerprint words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return map_batches(rows, _sign, SIGNATURE)


def distances(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to one, or to its own in an array as long."""
    # four counts of a byte each, added two and two
    pack = np.bitwise_count(prints ^ one).view(np.uint32)[:, 0]
    half = (pack & np.uint32(0xFF00FF)) + (pack >> np.uint32(8) & np.uint32(0xFF00FF))
    return (half & np.uint32(0xFFFF)) + (half >> np.uint32(16))


def key_width(n: int) -> int:
    """Bits of a key for n fingerprints: four fewer than their logarithm, so that tables hold few strangers in a bucket at any n, and not many tables are needed."""
    return min(56, max(6, int(np.floor(np.log2(max(2, n)))) - 4))


def key_tables(width: int, most: int = MAX_DISTANCE, recall: float = RECALL, least: int = N_KEYS) -> int:
    """How many tables of that width let two fingerprints ``most`` bits apart share a bucket with that chance. The search takes one table, for first links, and doesn't rest on that chance."""
    bits = 64 * WORDS
    same = np.prod([(bits - most - k) / (bits - k) for k in range(width)])
    return max(least, int(np.ceil(np.log1p(-recall) / np.log1p(-same)))) if 0 < same < 1 else least


def key_bits(n_keys: int, width: int, seed: int = 7) -> np.ndarray:
    """(n_keys, width) positions of sampled bits; a table's positions are distinct."""
    rng = np.random.default_rng(seed)
    return np.stack([np.sort(rng.permutation(64 * WORDS)[:width]) for _ in range(n_keys)])


def keys(prints: np.ndarray, bits: np.ndarray, first: int = 0) -> np.ndarray:
    """(n, n_keys) bucket keys; a key holds its table's number, from ``first``."""
    out = np.empty((len(prints), len(bits)), np.uint64)
    for t, positions in enumerate(bits, first):
        k = np.full(len(prints), t, np.uint64)
        for p in positions.tolist():
            k = (k << np.uint64(1)) | ((prints[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1))
        out[:, t - first] = mix(k)
    return out


def bucket_pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of equal keys in an ascending key array, one lag at a time."""
    at, lag = np.arange(len(key)), 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        for a in range(0, len(at), 1 << 19):
            yield at[a : a + (1 << 19)], at[a : a + (1 << 19)] + lag
        lag += 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of ids: each id but the smallest of its component, with the smallest."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while not (label == label[label]).all():
        label = label[label]
    away = label != np.arange(len(ids))
    return ids[away], ids[label[away]]


class Links:
    """Pairs of ids found so far, kept as a forest."""

    def __init__(self):
        self.a, self.b, self.fresh = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.fresh += len(a)
            if self.fresh > 1_000_000:
                a, b = self.forest()
                self.a, self.b, self.fresh = [a], [b], 0

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return forest(np.concatenate(self.a), np.concatenate(self.b)) if self.a else (none, none)


def ring(most: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bits, lengths and quotas of blocks of some ``width`` bits; the quotas add up to ``most + 1``."""
    m = 64 * WORDS // width
    at, share = np.arange(m + 1) * 64 * WORDS // m, np.arange(m + 1) * (most + 1) // m
    return at[:-1], np.diff(at), np.diff(share)


def ring_width(n: int) -> int:
    """Bits of a block among n fingerprints: few enough that its values hold several of them each."""
    return min(16, max(8, int(np.floor(np.log2(max(2, n)))) - 6))


def _from_bit(prints: np.ndarray, at: int) -> np.ndarray:
    """64 bits of each fingerprint from a bit on, round to the first bits after the last."""
    w, r = at // 64, at % 64
    low = prints[:, w] >> np.uint64(r)
    return low | (prints[:, (w + 1) % WORDS] << np.uint64(64 - r)) if r else low


def near_within(
    prints: np.ndarray,
    ids: np.ndarray,
    most: int,
    links: Links,
    label: np.ndarray | None = None,
    side: np.ndarray | None = None,
    share: tuple[int, int] = (0, 1),
) -> None:
    """Links between all rows within the distance, or, with ``side``, between those of False and those of True; none is lost.

    ``label``: a row's component as far as known, named by one of its rows; pairs that others already link are left out.
    ``share`` (i, k): only the i-th of k shares of the blocks to begin at; all shares together lose no link.

    Differences less quotas, summed round the ring, are below 0 for a pair within the distance. So from the block after that where their running sum is
    last at its highest, all running sums are below 0: the first block differs in fewer bits than its quota, and so do the blocks of the 64 bits from there.
    """
    n = len(prints)
    all_a, all_b = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    if not len(all_a) or not len(all_b):
        return
    label = np.arange(n) if label is None else label
    found, family, fresh, waiting, n_waiting, worked = Links(), np.full(n, -1), 1, [], 0, 0
    known = np.flatnonzero(label != np.arange(n))
    found.add(known, label[known])

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal fresh
        found.add(a, b)
        fresh += len(a)

    def verify() -> None:
        nonlocal waiting, n_waiting, worked
        if not waiting:
            return
        a, b = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
        waiting, n_waiting = [], 0
        other = label[a] != label[b]
        a, b = a[other], b[other]
        good = distances(prints[a], prints[b]) <= most
        a, b = a[good], b[good]
        worked += len(other)
        one = np.unique(label[a] * n + label[b], return_index=True)[1]  # one link of two components does
        keep(a[one], b[one])

    def relabel() -> None:
        nonlocal label, family, fresh, worked
        a, b = found.forest()
        found.a, found.b, found.fresh, fresh, worked = [a], [b], 0, 0, 0
        label = np.arange(n)
        label[a] = b
        family = np.where(np.bincount(label, minlength=n)[label] >= FAMILY, label, -1)

    def follow(rows_a: np.ndarray, rows_b: np.ndarray, wa: np.ndarray, wb: np.ndarray, limit: int) -> None:
        """One row of a after another; what it links is one component for the next."""
        la, lb = label[rows_a], label[rows_b]
        for x in range(len(rows_a)):
            other = lb != la[x]
            if not other.any():
                continue
            at = np.flatnonzero(other & (np.bitwise_count(wb ^ wa[x]) <= limit))
            at = at[distances(prints[rows_b[at]], prints[rows_a[x]]) <= most]
            if len(at):
                old, one = np.unique(lb[at], return_index=True)
                keep(np.full(len(one), rows_a[x]), rows_b[at[one]])
                old = np.append(old, la[x])
                la[np.isin(la, old)] = lb[np.isin(lb, old)] = old[0]

    def compare(rows_a: np.ndarray, rows_b: np.ndarray, wa: np.ndarray, wb: np.ndarray, limit: int) -> None:
        nonlocal n_waiting, worked
        if len(rows_b) > CHUNK // 8:
            worked += len(rows_a) * len(rows_b) // 64
            follow(rows_a, rows_b, wa, wb, limit)
            return
        step = max(1, CHUNK // max(1, len(rows_b)))
        for x in range(0, len(rows_a), step):
            hit = np.flatnonzero(np.bitwise_count(wa[x : x + step, None] ^ wb) <= limit)
            if len(hit):
                i, j = np.divmod(hit, len(rows_b))
                waiting.append((rows_a[x + i], rows_b[j]))
                n_waiting += len(hit)
                if n_waiting > CHUNK:
                    verify()

    if len(all_a) * len(all_b) <= FEW_PAIRS:
        follow(all_a, all_b, np.zeros(len(all_a), np.uint64), np.zeros(len(all_b), np.uint64), 0)
    else:
        # large families first, by references as in by_pivots
        free, idle = np.ones(n, bool), 0
        while idle < IDLE and free.any():
            p = int(free.argmax())
            near = np.flatnonzero(free & (distances(prints, prints[p]) <= most))
            free[near] = False
            idle += len(near) < FAMILY
            keep(np.full(len(near), p), near)
        first, length, quota = ring(most, ring_width(max(len(all_a), len(all_b))))
        for k in range(share[0], len(first), share[1]):
            if quota[k] < 1:
                continue
            if fresh:
                relabel()
            run = (k + np.arange(len(first))) % len(first)
            run = run[np.cumsum(length[run]) <= 64]
            limit, bits = int(quota[run].sum()) - 1, int(length[run].sum())
            window = _from_bit(prints, int(first[k])) & np.uint64(2**bits - 1)
            value = (window & np.uint64(2 ** int(length[k]) - 1)).astype(np.int64)
            order_a = all_a[np.argsort(value[all_a], kind="stable")]
            order_b = order_a if side is None else all_b[np.argsort(value[all_b], kind="stable")]
            wa, wb = window[order_a], window[order_b]
            values = np.arange(2 ** int(length[k]))
            flips = values[np.bitwise_count(values) < quota[k]]
            place = np.searchsorted(value[order_b], np.arange(len(values) + 1))
            held, start = np.unique(value[order_a], return_index=True)
            for v, x, y in zip(held.tolist(), start.tolist(), [*start[1:].tolist(), len(order_a)]):
                close = flips ^ v
                if side is None:
                    close = close[close >= v]
                low = place[close]
                size = place[close + 1] - low
                end = np.cumsum(size)
                at = np.repeat(low - end + size, size) + np.arange(end[-1])
                if not len(at):
                    continue
                of_a = family[order_a[x:y]]
                if (of_a < 0).all():
                    compare(order_a[x:y], order_b[at], wa[x:y], wb[at], limit)
                    continue
                of_b = family[order_b[at]]
                for f in np.unique(of_a).tolist():
                    mine = x + np.flatnonzero(of_a == f)
                    theirs = at[of_b != f] if f >= 0 else at
                    if len(theirs):
                        compare(order_a[mine], order_b[theirs], wa[mine], wb[theirs], limit)
                if fresh and worked > 16 * n:  # by then what can be left out is worth more than to find it
                    relabel()
            verify()
    a, b = found.forest()
    links.add(ids[a], ids[b])


def near_pairs_of(prints: np.ndarray, ids: np.ndarray, key: np.ndarray, most: int, links: Links | None = None) -> Links:
    """Links between ids that share a key and whose fingerprints are within the distance; pairs that others already link may be left out."""
    links = Links() if links is None else links
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    size = np.diff(edge)
    few = np.repeat((size > 1) & (size <= SMALL), size)
    some, same = order[few], key[few]
    near, own = np.ascontiguousarray(prints[some]), ids[some]
    for i, j in bucket_pairs(same):
        good = distances(near[i], near[j]) <= most
        links.add(own[i[good]], own[j[good]])
    for a in np.flatnonzero(size > SMALL).tolist():
        at = order[edge[a] : edge[a + 1]]
        by_pivots(np.ascontiguousarray(prints[at]), ids[at], most, links)
    return links


def by_pivots(prints: np.ndarray, ids: np.ndarray, most: int, links: Links) -> int:
    """Links of one large bucket by a pivot table (see the module); how many distances were computed."""
    m = len(prints)
    free, done, table, idle, used = np.ones(m, bool), np.zeros(m, bool), [], 0, 0
    edges = Links()
    while used < N_PIVOTS and idle < IDLE and free.any():
        p = int(free.argmax())
        d = distances(prints, prints[p])
        near = np.flatnonzero(d <= most)
        idle = idle + 1 if len(near) == 1 else 0
        free[near], done[p], used = False, True, used + 1
        if len(table) < N_COLUMNS:
            table.append(d.astype(np.uint16))
        edges.add(np.full(len(near) - 1, p), near[near != p])
    away, root = edges.forest()
    label = np.arange(m)
    label[away] = root
    links.add(ids[away], ids[root])
    # what was no reference and isn't in the largest component may have other links
    rest = np.flatnonzero((label != np.bincount(label).argmax()) & ~done)
    cost = used * m
    if len(rest) > ONE_BY_ONE:
        near_within(prints, ids, most, links, label)
        return cost
    if not len(rest):
        return cost
    table = np.stack(table)
    own = table[:, rest].argmin(axis=0)
    for pivot in np.unique(own).tolist():
        order = np.argsort(table[pivot], kind="stable")
        far, sorted_prints = table[pivot][order].astype(np.int64), prints[order]
        mine = rest[own == pivot]
        low = np.searchsorted(far, table[pivot][mine].astype(np.int64) - most, side="left")
        high = np.searchsorted(far, table[pivot][mine].astype(np.int64) + most, side="right")
        for x, lo, hi in zip(mine.tolist(), low.tolist(), high.tolist()):
            near = order[lo:hi][distances(sorted_prints[lo:hi], prints[x]) <= most]
            near = near[label[near] != label[x]]
            links.add(np.full(len(near), ids[x]), ids[near])
            cost += hi - lo
    return cost


def _edges_of_buckets(distinct: DataFrame, n: int, most: int, n_shares: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the distance: every two groups meet in a task, or in one for each share of the blocks."""
    groups = max(1, -(-n // group_rows))
    pairs = groups * (groups + 1) // 2
    blocks = len(ring(most, ring_width(min(n, group_rows)))[0])
    shares = n_shares or max(1, min(blocks, -(-TASKS // pairs), n // SHARE_ROWS))
    usual = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(pairs * shares, max(usual, n * groups * shares * _ROW_BYTES // TASK_BYTES))
    names = ["rep", "f0", "f1", "f2", "f3"]

    def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group = (mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        for other in range(groups):
            low, high = np.minimum(group, other), np.maximum(group, other)
            pair = low * groups - low * (low - 1) // 2 + high - low
            second = pa.array(group > other)
            for i in range(shares):
                task = pair * shares + i
                cols = [pa.array((task % parts).astype(np.int32)), pa.array(task), second, *(batch.column(c) for c in names)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "task", "second", *names])

    def links_of(prints: np.ndarray, ids: np.ndarray, second: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
        links, easy, own = Links(), Links(), np.arange(len(ids))
        width = key_width(len(ids))
        near_pairs_of(prints, own, keys(prints, key_bits(1, width, seed=share))[:, 0], most, easy)
        away, root = easy.forest()
        own[away] = root
        links.add(ids[away], ids[root])
        near_within(prints, ids, most, links, own, second if second.any() else None, (share, shares))
        return links.forest()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := list(batches)):
            return
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        del batches
        task, second, ids = rows.column(1).to_numpy(), rows.column(2).to_numpy(zero_copy_only=False), rows.column(3).to_numpy()
        prints = np.stack([rows.column(4 + i).to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
        order = np.argsort(task, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            # a pair of groups of which one is empty has nothing to join
            mine = int(task[at[0]])
            if second[at].all() or (mine // shares not in alone and not second[at].any()):
                continue
            a, b = links_of(np.ascontiguousarray(prints[at]), ids[at], second[at], mine % shares)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    alone = {g * groups - g * (g - 1) // 2 for g in range(groups)}
    met = map_batches(distinct.select(*names), meet, "part int, task long, second boolean, rep long, f0 long, f1 long, f2 long, f3 long")
    return map_partition(met.repartitionById(parts, F.col("part")), join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): each id of the edges (a, b) that isn't the smallest of its connected component, with the smallest.

    Large-star and small-star rounds in turn until nothing moves; each round is cut in the shared folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: larger neighbours of each node go to the smallest of it and its neighbours
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.c).where("b > c").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").distinct())
        marks = [d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (now, new)]
        if marks[0] == marks[1]:
            return new.select(F.col("a").alias("id"), F.col("b").alias("root"))
        now = new


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_distance: int = MAX_DISTANCE,
    n_shares: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, keep_id): each document that has a smaller-numbered near or exact copy, with the one of its group that stays.

    Rows with a null id or text take no part. Texts without a word (empty ones too) are copies only of equal
    texts. All pairs of fingerprints within ``max_distance`` count, however many there are. Rows that repeat an id with the same text count as one; an id with several texts joins the groups
    of each. Whole texts count, of any length; other columns, of whatever names, aren't read. An empty table gives no rows.
    ``group_rows``: a task has at most two groups of some that many fingerprints; ``n_shares``: how many tasks share two groups, which else follows from their number.
    """
    sig = cut(signatures(docs, id_col, text_col))
    return _groups(sig, max_distance, n_shares, group_rows)


def _groups(sig: DataFrame, most: int = MAX_DISTANCE, n_shares: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    prints = ["f0", "f1", "f2", "f3"]
    # equal fingerprints (or, without a word, equal texts) first: one row goes on for each
    words = F.col("n_features") > 0
    same = [F.when(words, F.col("f0")).otherwise(F.col("text_a")).alias("k0"), F.when(words, F.col("f1")).otherwise(F.col("text_b")).alias("k1"), F.when(words, F.col("f2")).alias("k2"), F.when(words, F.col("f3")).alias("k3")]
    keyed = sig.select("doc_id", *same)
    reps = cut(keyed.groupBy("k0", "k1", "k2", "k3").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    many = reps.where("n > 1").select("k0", "k1", "k2", "k3", "rep")
    equal = keyed.join(many, [keyed[c].eqNullSafe(many[c]) for c in ("k0", "k1", "k2", "k3")]).select(keyed.doc_id.alias("a"), F.col("rep").alias("b"))
    distinct = reps.where("k2 is not null").select("rep", *(F.col(f"k{i}").alias(c) for i, c in enumerate(prints)))
    near = _edges_of_buckets(distinct, reps.count(), most, n_shares, group_rows)
    return components(equal.unionAll(near)).select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of copies, columns unchanged.

    Rows with a null id or text stay as they are; of rows that repeat both an id and its text one stays. Columns of whatever
    names and types pass through. An empty table gives no rows.
    """
    sig = cut(signatures(docs, id_col, text_col))
    kept = without_ids(docs, _groups(sig).withColumnRenamed("doc_id", id_col), id_col)
    again = sig.groupBy("doc_id", "text_a", "text_b").count().where("count > 1").select(F.col("doc_id").alias(id_col)).distinct()
    if not again.isEmpty():
        rest = kept.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col])
        kept = kept.join(again, id_col, "left_anti").select(*docs.columns).unionAll(rest)
    return kept
