"""Query expansion: tables (term, expanded)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index


def merge(*maps: DataFrame) -> DataFrame:
    """The union of expansion tables."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.distinct()


def expand(terms: DataFrame, expansion: DataFrame) -> DataFrame:
    """(term): the terms and all their expansions, each once."""
    more = expansion.join(terms, "term", "left_semi").select(F.col("expanded").alias("term"))
    return terms.select("term").unionByName(more).distinct()


def add_to_postings(postings: DataFrame, expansion: DataFrame) -> DataFrame:
    """Postings with, in every segment, also what its terms expand to."""
    more = postings.join(expansion, "term").select("did", "seg", F.col("expanded").alias("term"), F.lit("lemma").alias("kind"))
    return postings.select("did", "seg", "term", "kind").unionByName(more).distinct()


def frequencies(index: Index, expansion: DataFrame) -> DataFrame:
    """(term, n): how many postings each term has after ``add_to_postings``.

    What one term alone expands to is in the segments of that term, so its number is that term's frequency; only expansions of several terms need
    their segments together. If segments are there twice (documents that share an id), postings are counted each once.
    """
    if not index.segments.groupBy("did", "seg").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return add_to_postings(index.postings, expansion).groupBy("term").agg(F.count("*").alias("n"))
    freq = index.norm.select("term", F.col("freq").alias("n"))
    pairs = expansion.select("term", "expanded").distinct()
    sources = pairs.groupBy("expanded").agg(F.count("*").alias("k"), F.min("term").alias("term"))
    lone = sources.where("k = 1").join(freq, "term").select(F.col("expanded").alias("term"), "n")
    once = freq.unionByName(lone)
    if sources.where("k > 1").isEmpty():
        return once.groupBy("term").agg(F.sum("n").alias("n"))
    some = pairs.join(sources.where("k > 1").select("expanded"), "expanded", "left_semi")
    several = index.postings.join(some, "term").select("did", "seg", F.col("expanded").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n"))
    return once.unionByName(several).groupBy("term").agg(F.sum("n").alias("n"))


def reverse(expansion: DataFrame) -> DataFrame:
    """The table from expansions to terms."""
    return expansion.select(F.col("expanded").alias("term"), F.col("term").alias("expanded"))


def lemmas(lexicon: DataFrame, longest: int = 32) -> DataFrame:
    """(term, expanded = ``lemma:stem``) of the alphabetic tokens of a language with a stemmer. Runs over distinct terms, never over postings."""
    from ..functions.stem import LANGUAGES, stem

    some = lexicon.where((F.col("kind") == "token") & F.col("lang").isin(*LANGUAGES) & F.col("term").rlike("^[a-zà-ÿ]+$") & (F.length("term") <= longest))
    return some.select("term", F.concat(F.lit("lemma:"), stem(F.col("term"), F.col("lang"))).alias("expanded"))
