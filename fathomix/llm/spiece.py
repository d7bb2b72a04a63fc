"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

Merging always joins the adjacent pair whose joined piece has the best score. The same
segmentation is found without merging: from the left, take the longest piece that starts at
the position (one pass of an Aho-Corasick automaton over the reversed text gives it for every
position); it may follow the piece before it only if re-merging the two would not join
across their border first; if it may not, try its next shorter prefix, and if none is left,
mark the position as failed in a bitfield, take back the piece before it and shorten that.

Blanks are the piece character U+2581, one of which is put before a text. Pieces hold it
at their start only, but for pieces of blanks alone, whose score is below all others. So a
text falls in words, each with one blank before it, and runs of blanks, which merge last. Words
that repeat are encoded once; all the distinct words of a chunk go through the steps together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_batches
from .lookup import IntMap, SpanCache
from .text import Chunk, chunks, ragged, runs, span_pairs

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
_CELLS = 1 << 21
#: Characters encoded at once: fewer than elsewhere, as an encoder's tables are large.
_CHUNK = 1 << 19
#: Words longer than this are encoded one by one.
LONG_WORD = 64


def read_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and types (1 normal, 6 byte) of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a merge-type model that keeps the text as it is is needed")
    return [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces]


def merge(symbols: list, rank) -> list:
    """Plain merging of neighbours by lowest rank, the leftmost of equals; ``rank(a, b)`` is None where they don't join."""
    text, after, before = list(symbols), [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
    heap: list = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (r := rank(text[a], text[b])) is not None:
            heapq.heappush(heap, (r, a, b, text[a], text[b]))

    for i in range(len(text) - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, x, y = heapq.heappop(heap)
        if text[a] != x or text[b] != y or after[a] != b:
            continue
        text[a], text[b], after[a] = x + y, None, after[b]
        if after[b] >= 0:
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [t for t in text if t is not None]


class Pieces:
    """A vocabulary prepared for encoding. Ranks: single characters first, then pieces in the order in which merging prefers them."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int]):
        normal = [i for i, t in enumerate(types) if t == 1]
        blank = chr(BLANK)
        self.blank_id = {len(pieces[i]): i for i in normal if set(pieces[i]) == {blank}}
        if any(blank in pieces[i][1:] for i in normal if set(pieces[i]) != {blank}):
            raise ValueError("a piece holds a blank past its start")
        single = [i for i in normal if len(pieces[i]) == 1]
        longer = sorted((i for i in normal if len(pieces[i]) > 1 and set(pieces[i]) != {blank}), key=lambda i: (-scores[i], i))
        order = {pieces[i]: k for k, i in enumerate(longer)}
        split, reached = {}, []
        for i in longer:  # the last merge that makes the piece; a piece that merging never makes is left out
            parts = self._halves(pieces[i], order)
            if parts:
                split[pieces[i]] = parts
                reached.append(i)
        ids = single + reached
        self.ids = np.array(ids, np.int32)
        self.texts = [pieces[i] for i in ids]
        rank = {t: r for r, t in enumerate(self.texts)}
        n, self.n_single = len(ids), len(single)
        self.size = np.array([len(t) for t in self.texts], np.int32)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        for t, (a, b) in split.items():
            self.left[rank[t]], self.right[rank[t]] = rank[a], rank[b]
        self.shorter = np.array([next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in self.texts], np.int32)
        pairs = {rank[t[:k]] << 20 | rank[t[k:]]: r for r, t in enumerate(self.texts) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        self.pairs = IntMap(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self._automaton()
        self.size_list, self.shorter_list, self.fit_of = self.size.tolist(), self.shorter.tolist(), {}
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(pieces[i]) for i in single]] = True
        self.known[BLANK] = False
        self.byte_id = np.zeros(256, np.int32)
        for i, t in enumerate(types):
            if t == 6:
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        self.unknown_id = types.index(2) if 2 in types else 0
        self.has_bytes = 6 in types
        # bytes of each id, for decoding
        raw = [bytes([int(p[1:-1], 16)]) if t == 6 else b"" if t == 3 else p.replace(blank, " ").encode() for p, t in zip(pieces, types)]
        self.byte_size = np.array([len(b) for b in raw], np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_pool = np.frombuffer(b"".join(raw), np.uint8)
        self.cache = SpanCache()

    @staticmethod
    def _halves(text: str, order: dict[str, int]) -> tuple[str, str] | None:
        own = order[text]
        parts = merge(list(text), lambda a, b: r if (r := order.get(a + b)) is not None and r < own else None)
        return tuple(parts) if len(parts) == 2 else None

    def _automaton(self) -> None:
        """Aho-Corasick over the reversed pieces: edges, failure links, longest piece at each state."""
        edges: list[dict[int, int]] = [{}]
        own = [-1]
        for r, t in enumerate(self.texts):
            s = 0
            for ch in reversed(t):
                c = ord(ch)
                if c not in edges[s]:
                    edges[s][c] = len(edges)
                    edges.append({})
                    own.append(-1)
                s = edges[s][c]
            own[s] = r
        fail, out, queue = [0] * len(edges), own[:], [*edges[0].values()]
        for s in queue:
            for c, to in edges[s].items():
                f = fail[s]
                while f and c not in edges[f]:
                    f = fail[f]
                fail[to] = edges[f].get(c, 0)
                if out[to] < 0:
                    out[to] = out[fail[to]]
                queue.append(to)
        flat = [(s << 21 | c, to) for s, e in enumerate(edges) for c, to in e.items()]
        self.edges = IntMap(np.array([k for k, _ in flat], np.int64), np.array([v for _, v in flat], np.int32))
        self.fail, self.out = np.array(fail, np.int64), np.array(out, np.int32)
        self.edge_of, self.fail_list, self.out_list = dict(flat), fail, out

    def longest(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rank of the longest piece that starts at each position of the words, which come longest first."""
        out = np.empty(len(points), np.int32)
        state = np.zeros(len(offsets) - 1, np.int64)
        size = np.diff(offsets)
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            at = offsets[1 : n + 1] - 1 - t
            c = points[at].astype(np.int64)
            s = state[:n]
            to = self.edges.get(s << 21 | c).astype(np.int64)
            lost = np.flatnonzero(to < 0)
            while len(lost):
                root = s[lost] == 0
                to[lost[root]] = 0
                lost = lost[~root]
                s[lost] = self.fail[s[lost]]
                to[lost] = self.edges.get(s[lost] << 21 | c[lost])
                lost = lost[to[lost] < 0]
            state[:n] = to
            out[at] = self.out[to]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a: undoing their merges from the last one back, no pair across the border joins earlier."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            x, y, lim = a[left], b[left], limit[left]
            joined = self.pairs.get(x << 20 | y)
            bad = (joined >= 0) & (joined < lim)
            out[left[bad]] = False
            left, x, y = left[~bad], x[~bad], y[~bad]
            first = x > y  # undo the later of the two merges
            # the side to undo is a single character: undo the other
            first_stuck, second_stuck = self.right[x] == x, self.left[y] == y
            undo_a = np.where(first, ~first_stuck, second_stuck & ~first_stuck)
            undo_b = ~undo_a & ~second_stuck
            limit[left] = np.where(undo_a, x, y + 1)
            a[left] = np.where(undo_a, self.right[x], x)
            b[left] = np.where(undo_b, self.left[y], y)
            left = left[undo_a | undo_b]
        return out

    def encode_words(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of known characters (a leading blank allowed), as (count a word, ranks)."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        counts = np.zeros(len(size), np.int64)
        parts: list[np.ndarray] = []
        a = int(np.searchsorted(-size[order], -LONG_WORD, side="left"))
        for w in order[:a].tolist():
            parts.append(np.array(self.encode_long(points[offsets[w] : offsets[w + 1]].tolist()), np.int32))
            counts[w] = len(parts[-1])
        while a < len(order):
            most = max(1, int(size[order[a]]))
            b = min(len(order), a + max(1, _CELLS // (most + 1)))
            some = order[a:b]
            off = np.concatenate([[0], np.cumsum(size[some])])
            n, ranks = self._encode(points[ragged(offsets[some], size[some])], off)
            counts[some] = n
            parts.append(ranks)
            a = b
        # from longest first back to the order given
        got = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.cumsum(counts[order]) - counts[order]
        starts = np.empty(len(order), np.int64)
        starts[order] = begin
        return counts, got[ragged(starts, counts)]

    def encode_long(self, points: list[int]) -> list[int]:
        """Ranks of one word: the same steps without arrays."""
        n, edge, fail, out = len(points), self.edge_of, self.fail_list, self.out_list
        best, s = [0] * n, 0
        for i in range(n - 1, -1, -1):
            c = points[i]
            while (to := edge.get(s << 21 | c)) is None and s:
                s = fail[s]
            s = to or 0
            best[i] = out[s]
        size, shorter, fits = self.size_list, self.shorter_list, self._fits
        open_, stack, at = bytearray(b"\1") * (n + 1), [], 0
        piece = best[0]
        while at < n:
            end = at + size[piece]
            if open_[end] and (not stack or fits(stack[-1], piece)):
                stack.append(piece)
                at = end
                piece = best[at] if at < n else -1
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:
                open_[at] = 0
                piece = stack.pop()
                at -= size[piece]
        return stack

    def _fits(self, a: int, b: int) -> bool:
        """``compatible`` of one pair, remembered."""
        key = a << 20 | b
        if (known := self.fit_of.get(key)) is None:
            if len(self.fit_of) > 500_000:
                self.fit_of.clear()
            known = self.fit_of[key] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known

    def _encode(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(offsets) - 1, np.diff(offsets)
        most = int(size.max()) if n else 0
        best = self.longest(points, offsets)
        stack = np.zeros((n, most), np.int32)
        open_ = np.ones((n, most + 1), bool)  # positions not known to fail
        depth, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        now = np.full(n, -1, np.int32)
        live = np.flatnonzero(size > 0)
        now[live] = best[offsets[:-1][live]]
        while len(live):
            piece, d, p = now[live], depth[live], place[live]
            end = p + self.size[piece]
            good = open_[live, end]
            check = np.flatnonzero(good & (d > 0))
            if len(check):
                w = live[check]
                good[check] = self.compatible(stack[w, d[check] - 1], piece[check])
            w, g = live[good], good
            stack[w, d[g]] = piece[g]
            depth[w] += 1
            place[w] = end[g]
            more = end[g] < size[w]
            now[w[more]] = best[offsets[:-1][w[more]] + end[g][more]]
            bad = ~g
            w, cut = live[bad], self.shorter[piece[bad]]
            short = cut >= 0
            now[w[short]] = cut[short]
            w = w[~short]
            open_[w, place[w]] = False
            depth[w] -= 1
            last = stack[w, depth[w]]
            now[w] = last
            place[w] -= self.size[last]
            live = live[place[live] < size[live]]
        keep = np.arange(most)[None, :] < depth[:, None]
        return depth, stack[keep]

    @lru_cache(maxsize=100_000)  # noqa: B019 - one vocabulary a worker
    def blanks(self, n: int) -> tuple[int, ...]:
        """Ids of a run of n blanks that no word takes: equal scores, so the leftmost pair joins first."""
        return tuple(self.blank_id[x] for x in merge([1] * n, lambda a, b: 0 if a + b in self.blank_id else None))

    def encode(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids a row, ids) of rows of code points."""
        n_rows = len(offsets) - 1
        filled = np.flatnonzero(np.diff(offsets) > 0)
        # one blank before each text that isn't empty
        x = np.insert(points, offsets[:-1][filled], BLANK)
        off = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        x = np.where(x == 32, np.uint32(BLANK), x)
        label = np.where(x == BLANK, 0, np.where(self.known[x], 1, 2)).astype(np.uint8)
        s, e = runs(label, off)
        kind = label[s]
        row = np.searchsorted(off, s, side="right") - 1
        sizes, starts = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        source = kind.copy()
        # words, with the blank before them
        word = np.flatnonzero(kind == 1)
        before = word - 1
        spaced = (word > 0) & (kind[before] == 0) & (row[before] == row[word]) if len(word) else np.zeros(0, bool)
        ws = s[word] - spaced
        hashes = span_pairs(x, ws, e[word])

        def make(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = ws[first], e[word[first]]
            n, ranks = self.encode_words(x[ragged(a, b - a)], np.concatenate([[0], np.cumsum(b - a)]))
            return n, self.ids[ranks]

        at, count = self.cache.lists(*hashes, make)
        # a word whose first piece is the blank alone takes none
        alone = spaced & (self.cache.pool[at] == self.blank_id[1]) if len(word) else spaced
        starts[word], sizes[word] = at + alone, count - alone
        pools, base = [self.cache.pool], len(self.cache.pool)
        # runs of blanks, less the one that the word after them takes
        blank = np.flatnonzero(kind == 0)
        length = e[blank] - s[blank]
        taken = np.zeros(len(s), bool)
        taken[before[spaced & ~alone]] = True
        length = length - taken[blank]
        for n in np.unique(length).tolist():
            if n:
                ids = np.array(self.blanks(n), np.int32)
                here = blank[length == n]
                starts[here], sizes[here] = base, len(ids)
                pools.append(ids)
                base += len(ids)
        # other characters, by their bytes
        other = np.flatnonzero(source == 2)
        if len(other):
            chars = x[ragged(s[other], e[other] - s[other])]
            if self.has_bytes:
                some, inverse = np.unique(chars, return_inverse=True)
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in some.tolist()]
                width = np.array([len(r) for r in raw])
                first = np.cumsum(width) - width
                flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
                ids = flat[ragged(first[inverse], width[inverse])]
                per = width[inverse]
            else:
                ids, per = np.full(len(chars), self.unknown_id, np.int32), np.ones(len(chars), np.int64)
            total = np.concatenate([[0], np.cumsum(per)])
            edge = np.concatenate([[0], np.cumsum(e[other] - s[other])])
            starts[other] = base + total[edge[:-1]]
            sizes[other] = total[edge[1:]] - total[edge[:-1]]
            pools.append(ids)
        ids = np.concatenate(pools)[ragged(starts, sizes)]
        return np.bincount(row, weights=sizes, minlength=n_rows).astype(np.int64), ids

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes a row, UTF-8 bytes): pieces joined, U+2581 as blank, without the first blank."""
        size = self.byte_size[ids]
        data = self.byte_pool[ragged(self.byte_start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        begin, end = ends[edge[:-1]], ends[edge[1:]]
        first = begin[end > begin]
        drop = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        n = end - begin
        n[np.flatnonzero(end > begin)[data[first] == 32]] -= 1
        return n, data[keep]


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY) -> Pieces:
    """The vocabulary of a model file, prepared once a worker."""
    return Pieces(*read_model(path))


def _utf8(points: np.ndarray) -> bytes:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def same_text(c: Chunk, n: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each row's decoded bytes are the row's text, U+2581 taken for a blank."""
    points = np.where(c.points == BLANK, np.uint32(32), c.points)
    want = np.frombuffer(_utf8(points), np.uint8)
    if len(want) == len(data) and (want == data).all():
        return np.ones(len(n), bool)
    wide = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[c.offsets]
    got = np.concatenate([[0], np.cumsum(n)])
    return np.array([data[a:b].tobytes() == want[x:y].tobytes() for a, b, x, y in zip(got[:-1], got[1:], wide[:-1], wide[1:])], bool)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): the piece ids of each text, and whether decoding gives the text back.

    The ids are those of plain merging. A null text gives null ids, count and round_trip; an empty one no ids. U+2581 in a text counts as a
    blank. Characters outside the vocabulary become byte pieces. Rows with a null or repeated id give a row
    each; an empty table gives none. Texts of any length are encoded whole. Other columns, of whatever names, aren't read.
    ``vocabulary`` must be readable on every worker.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for c in chunks(batch.column(1), _CHUNK):
            counts, ids = v.encode(c.points, c.offsets)
            same = same_text(c, *v.decode(counts, ids)) if check else np.ones(len(counts), bool)
            null = ~c.valid
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(null, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.start, c.stop - c.start), lists, pa.array(counts.astype(np.int32), mask=null), pa.array(same, mask=null)],
                names=["doc_id", "ids", "n_pieces", "round_trip"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, ids array<int>, n_pieces int, round_trip boolean")


def decode_lists(v: Pieces, lists: pa.ListArray) -> pa.Array:
    """Texts of lists of ids, all at once."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    known = np.asarray(flat.is_valid()) if flat.null_count else np.ones(len(flat), bool)
    ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known &= (ids >= 0) & (ids < len(v.byte_size))
    row = np.repeat(np.arange(len(size)), size)
    null = ~np.asarray(lists.is_valid())
    null[row[~known]] = True
    use = ~null[row]
    n, data = v.decode(np.where(null, 0, size), ids[use])
    ends = np.concatenate([[0], np.cumsum(n)])
    if len(data) < 1 << 31:
        raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), raw.cast(pa.string()))
        except pa.ArrowInvalid:  # some row isn't UTF-8
            pass
    blob = data.tobytes()
    return pa.array([None if x else blob[a:b].decode("utf-8", "replace") for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), null.tolist())], pa.string())


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of piece ids. Null lists, and those with a null or unknown id, give null; an empty one gives an empty text; invalid UTF-8 becomes U+FFFD.

    Rows with a null or repeated id give a row each; an empty table gives none. Other columns, of whatever names, aren't read.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), decode_lists(load(vocabulary), batch.column(1))], names=["doc_id", "text"])

    return map_batches(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), work, "doc_id long, text string")
