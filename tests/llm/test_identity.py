"""Spans are known by what they are, not by a hash that a rule can defeat."""

import base64

import numpy as np
import pyarrow as pa
import pytest

from fathomix.llm import bpe_count, lookup, simhash, spiece, text


def thue_morse(a: str, b: str, power: int) -> tuple[str, str]:
    x, y = a, b
    for _ in range(power):
        x, y = x + y, y + x
    return x, y


def points_of(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


@pytest.mark.parametrize("signs", ["th", "er", "!?", "ab"])
def test_thue_morse_words_differ(signs):
    x, y = thue_morse(*signs, 11)
    both = points_of(x + y)
    for h in text.span_pairs(both, np.array([0, len(x)]), np.array([len(x), 2 * len(x)])):
        assert h[0] != h[1]


def test_counts_of_thue_morse_words():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe_count.VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for signs in ("th", "er"):
        rows = list(thue_morse(*signs, 11))
        c = next(text.chunks(pa.array([" ".join(rows)])))
        a, b = bpe_count.spans(c.points, c.offsets)
        assert bpe_count.load().counts_of(c, a, b).tolist() == [len(library.encode_ordinary(t)) for t in (rows[0], " " + rows[1])]


def test_pieces_of_thue_morse_words():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spiece.VOCABULARY)
    v, rows = spiece.load(), [*thue_morse("t", "h", 11), *thue_morse("e", "r", 11)]
    c = next(text.chunks(pa.array([" ".join(rows)])))
    n, ids = v.encode(c.points, c.offsets)
    assert ids.tolist() == library.encode(" ".join(rows)) and spiece.same_text(c, *v.decode(n, ids)).all()


def test_texts_without_words_are_copies_only_of_equal_ones(spark):
    x, y = thue_morse("!", "?", 11)
    rows = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in simhash.near_duplicates(rows).collect()} == {3: 1}


def test_a_shared_first_hash_is_seen_through(monkeypatch):
    """With a first hash of two values, the second one tells the spans apart: nothing is taken for another."""
    rows = ["the cat sat on the mat", "a cat, a dog and the other cat", "catalogue of cats"] * 3
    c = next(text.chunks(pa.array(rows)))
    want_counts, want_ids = [], []
    for weak in (False, True):
        v, pieces = bpe_count.Ranks.__new__(bpe_count.Ranks), spiece.load()
        v.__dict__.update(bpe_count.load().__dict__)
        v._forget()
        monkeypatch.setattr(pieces, "cache", lookup.SpanCache())
        if weak:
            real = text.span_pairs
            poor = lambda *a, **k: (lambda h, g: (h & np.uint64(1), g))(*real(*a, **k))
            monkeypatch.setattr(bpe_count, "span_pairs", poor)
            monkeypatch.setattr(spiece, "span_pairs", poor)
        for _ in range(2):  # the second time from what is remembered
            a, b = bpe_count.spans(c.points, c.offsets)
            want_counts.append(v.counts_of(c, a, b).tolist())
            want_ids.append(pieces.encode(c.points, c.offsets)[1].tolist())
    assert all(x == want_counts[0] for x in want_counts) and all(x == want_ids[0] for x in want_ids)
