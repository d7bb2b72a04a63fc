"""Boolean retrieval: a query tree to the segments (did, seg) that match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import All, And, Not, Or, Phrase, Range, Term
from .index import Index

KEY = ["did", "seg"]


def hits(index: Index, node, by_document: bool = False, expansion: DataFrame | None = None) -> DataFrame:
    """(did, seg), each once.

    ``by_document``: a document matches as a whole, and all its segments, the head too, are hits.
    ``expansion`` (term, expanded): a term also matches where one of its expansions stands.
    """
    if by_document:
        docs = _match(index, node, ["did"], expansion)
        return index.segments.join(docs, "did", "left_semi").select(*KEY)
    return _match(index, node, KEY, expansion)


def in_bag(node) -> tuple[Column, bool]:
    """A condition on a bag's ``terms`` that holds wherever the node matches a segment of text, and whether it holds nowhere else.

    A phrase may begin in an earlier segment, so it has only one that it needs: its last term.
    """
    if isinstance(node, Term):
        return F.array_contains("terms", node.term), True
    if isinstance(node, Range):
        return F.exists("terms", lambda t: t.between(node.low, node.high)), True
    if isinstance(node, Phrase):
        return (F.array_contains("terms", node.terms[-1]) if node.terms else F.lit(False)), len(node.terms) < 2
    if isinstance(node, All):
        return F.lit(True), True
    if isinstance(node, Not):
        inner, whole = in_bag(node.node)
        return (~inner if whole else F.lit(True)), whole
    parts = [in_bag(n) for n in node.nodes]
    both = (lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b)
    return reduce(both, [c for c, _ in parts]), all(w for _, w in parts)


def conjunction(index: Index, terms: list[str], without: list[str] = (), key: list[str] = KEY) -> DataFrame:
    """Segments with all of ``terms`` and none of ``without``: one scan and one aggregate, a bit for each term."""
    every = [*dict.fromkeys(terms), *dict.fromkeys(without)]
    bit = F.lit(0)
    for i, t in enumerate(every):
        bit = F.when(F.col("term") == t, 1 << i).otherwise(bit)
    mask = index.postings.where(F.col("term").isin(every)).groupBy(*key).agg(F.bit_or(bit.cast("long")).alias("mask"))
    return mask.where(F.col("mask") == (1 << len(set(terms))) - 1).select(*key)


def _match(index: Index, node, key: list[str], expansion: DataFrame | None) -> DataFrame:
    again = lambda n: _match(index, n, key, expansion)
    if isinstance(node, Term):
        if expansion is not None:
            more = expansion.where(F.col("term") == node.term).select(F.col("expanded").alias("term"))
            either = index.postings.join(more, "term", "left_semi").select(*key)
            return index.postings.where(F.col("term") == node.term).select(*key).unionByName(either).distinct()
        found = index.postings.where(F.col("term") == node.term).select(*key)
        return found if key == KEY else found.distinct()
    if isinstance(node, Range):
        return index.postings.where(F.col("term").between(node.low, node.high)).select(*key).distinct()
    if isinstance(node, Phrase):
        return phrase(index, node.terms).select(*key).distinct()
    if isinstance(node, All):
        return index.segments.select(*key).distinct() if key != KEY else index.segments.select(*key)
    if isinstance(node, Not):
        return index.segments.select(*key).distinct().join(again(node.node), key, "left_anti")
    if isinstance(node, Or):
        return reduce(DataFrame.unionByName, map(again, node.nodes)).distinct()
    if isinstance(node, And):
        plain = [n.term for n in node.nodes if isinstance(n, Term)] if expansion is None else []
        barred = [n.node.term for n in node.nodes if isinstance(n, Not) and isinstance(n.node, Term)] if plain else []
        rest = [n for n in node.nodes if not (plain and (isinstance(n, Term) or isinstance(n, Not) and isinstance(n.node, Term)))]
        if set(plain) & set(barred):
            return index.segments.select(*key).distinct().where("false")
        if plain and len(plain) + len(barred) < 63:
            found = conjunction(index, plain, barred, key)
        else:
            rest, found = list(node.nodes), None
        # what narrows first, complements after it
        for n in sorted(rest, key=lambda n: isinstance(n, Not)):
            if found is None:
                found = again(n)
            elif isinstance(n, Not):
                found = found.join(again(n.node), key, "left_anti")
            else:
                found = found.join(again(n), key, "left_semi")
        return found
    raise TypeError(f"no query node: {node!r}")


def phrase(index: Index, terms: tuple[str, ...]) -> DataFrame:
    """Segments in which the terms, one right after the other, end. A phrase may begin in an earlier segment.

    Each place of a term votes for the start it implies; a start with a vote for every place is a match.
    """
    if not terms:
        return index.segments.select(*KEY).where("false")
    if len(terms) == 1:
        return index.text_postings.where(F.col("term") == terms[0]).select(*KEY)
    size = index.config.segment_size
    places = F.lit(None).cast("array<int>")
    for t in dict.fromkeys(terms):
        places = F.when(F.col("term") == t, F.array(*(F.lit(i) for i, x in enumerate(terms) if x == t))).otherwise(places)
    at = (F.col("seg") - 1) * size + F.col("pos") - 1
    votes = index.places.where(F.col("term").isin(*set(terms))).select("did", at.alias("at"), F.explode(places).alias("i"))
    whole = votes.groupBy("did", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
    return whole.select("did", (F.floor((F.col("start") + len(terms) - 1) / size) + 1).cast("int").alias("seg")).distinct()
