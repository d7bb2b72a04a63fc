"""Co-occurrence scores: how strongly each term belongs to the segments of a cue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..plans.query import Node
from .index import Index


def cueset(index: Index, terms: list[str], expansion: DataFrame | None = None) -> DataFrame:
    """(did, seg) with any of the cues or their expansions, frequent tokens left out."""
    wanted = index.lexicon.where(F.col("term").isin(terms) & ~F.col("is_frequent")).select("term")
    if expansion is not None:
        more = expansion.where(F.col("term").isin(terms)).select(F.col("expanded").alias("term")).join(index.lexicon.where("not is_frequent").select("term"), "term", "left_semi")
        wanted = wanted.unionByName(more).distinct()
    return index.postings.join(wanted, "term", "left_semi").select("did", "seg").distinct()


def counts(index: Index, cues: DataFrame | Node, layered: bool = True) -> DataFrame:
    """(term, kind, cnt): in how many cue segments (or segments that match a query tree) each term is. Reads the cue segments' bags; partial sums before the shuffle by term."""
    return index.contents(cues, layered).groupBy("term", "kind").agg(F.count("*").alias("cnt"))


def selected_layers(n_cues: int, config: IndexConfig = IndexConfig()) -> list[int]:
    """Bands that can score: the smaller of the band's limit and the number of cue segments must be more than ``layer_threshold`` of the larger. The open band follows the last limit."""
    if not n_cues:
        return []
    limits = config.layers
    used = [i for i, most in enumerate(limits) if min(most, n_cues) / max(most, n_cues) > config.layer_threshold]
    return used + [len(limits)] if len(limits) - 1 in used else used


def in_selected_layers(n_cues: Column, layer: Column, config: IndexConfig = IndexConfig()) -> Column:
    """``selected_layers`` as a condition on rows, for plans that don't wait for the number of cue segments."""
    limits = config.layers
    out = F.lit(False)
    for i, most in [*enumerate(limits), (len(limits), limits[-1])]:
        share = F.least(F.lit(most), n_cues) / F.greatest(F.lit(most), n_cues)
        out = out | ((layer == i) & (share > config.layer_threshold))
    return out


def jaccard(cnt: Column, freq: Column, n_cues: Column) -> Column:
    """cnt / (freq + cues - cnt), 0 without a frequency, at most 1."""
    return F.when(F.coalesce(freq, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), cnt / (freq + n_cues - cnt)))


def conditional(cnt: Column, freq: Column) -> Column:
    """cnt / freq: how likely a segment of the term is a cue segment."""
    return F.when(F.coalesce(freq, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), cnt / freq))


#: Terms with at least this share of all counts are looked up where rows lie; they are as many as its inverse at most.
COMMON = 1e-6


def sums(rows: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
    """(*key, score): the summed scores of each key's terms, each row (*key, term) counting, and 0 for those without a score.

    Common terms have most rows; their scores are broadcast (``1 / COMMON`` at most) and summed where the rows lie.
    Rows of other terms alone are shuffled. Without counts (cnt) of the terms all rows are.
    """
    if "cnt" not in scored.columns:
        return rows.join(scored.select("term", "score"), "term", "left").groupBy(*key).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))
    # said of all uses, so that they share what they shuffle
    scored = scored.where("term is not null")
    least = scored.agg((F.coalesce(F.sum("cnt"), F.lit(0)) * COMMON).alias("least"))
    ranked = scored.select("term", "score", "cnt").crossJoin(F.broadcast(least))
    common = F.broadcast(ranked.where("cnt >= least").select("term", F.coalesce("score", F.lit(0.0)).alias("score")))
    near = rows.select(*key, "term").join(common, "term", "left").select(*key, F.coalesce("score", F.lit(0.0)).alias("score"))
    far = rows.select(*key, "term").join(common, "term", "left_anti").join(ranked.where("cnt < least").select("term", "score"), "term")
    return near.unionByName(far.select(*key, F.coalesce("score", F.lit(0.0)).alias("score"))).groupBy(*key).agg(F.sum("score").alias("score"))


def quantise(score: Column, least: float = 1e-5) -> Column:
    """A score in steps of ``least``, one step at least."""
    return F.greatest(F.lit(1), F.floor(score / least)) * least


def normalise(cnts: DataFrame, norm: DataFrame, cues: DataFrame | None, n_docs: Column | None = None) -> DataFrame:
    """(term, cnt, freq, score): Jaccard with the number of cue segments, or without cues the conditional share.

    With ``n_docs`` metadata terms use it in the place of the number of cue segments. The cue count is a
    one-row table that joins in, so the whole is one plan.
    """
    both = cnts.join(norm, "term", "left")
    if cues is None:
        return both.select("term", "cnt", "freq", conditional(F.col("cnt"), F.col("freq")).alias("score"))
    n = cues.agg(F.count("*").alias("n_cues"))
    size = F.col("n_cues") if n_docs is None else F.when(F.col("kind") == "token", F.col("n_cues")).otherwise(n_docs)
    return both.crossJoin(F.broadcast(n)).select("term", "cnt", "freq", jaccard(F.col("cnt"), F.col("freq"), size).alias("score"))


def scores(index: Index, cues: DataFrame | Node, layered: bool = True, select: bool = False) -> DataFrame:
    """(term, cnt, freq, score) of every term that shares a segment with the cues; ``select`` leaves out the frequency bands that cannot score.

    Cues may be a query tree: their contents are then read where the bags lie, without a shuffle, if a bag tells of itself whether it matches.
    """
    here = cues if isinstance(cues, DataFrame) else index.matching(cues)
    if not select:
        return normalise(counts(index, cues, layered), index.norm, here)
    n = here.agg(F.count("*").alias("n_cues"))
    both = counts(index, cues, layered=False).join(index.lexicon.where("layer is not null").select("term", "kind", "freq", "layer"), ["term", "kind"])
    some = both.crossJoin(F.broadcast(n)).where(in_selected_layers(F.col("n_cues"), F.col("layer"), index.config))
    return some.select("term", "cnt", "freq", jaccard(F.col("cnt"), F.col("freq"), F.col("n_cues")).alias("score"))


def top_terms(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n best terms, ties by term."""
    return scored.orderBy(F.desc("score"), "term").limit(n)


def score_list(scored: DataFrame, terms: DataFrame) -> DataFrame:
    """(score): sum over a list of terms, repeated ones each time."""
    return terms.join(scored.select("term", "score"), "term", "left").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))
