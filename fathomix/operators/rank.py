"""Ranking: documents of the hits by the summed scores of what their segments hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Node
from . import score
from .index import Index


def segment_scores(index: Index, hits: DataFrame | Node, scored: DataFrame) -> DataFrame:
    """(did, seg, score): for each hit segment with a layered term, the sum of its terms' scores; terms that only filter add nothing."""
    posts = index.contents(hits).select("did", "seg", F.when(F.col("kind") != "meta_norank", F.col("term")).alias("term"))
    return score.sums(posts, scored, ["did", "seg"])


def with_prior(segments: DataFrame, priors: DataFrame | None) -> DataFrame:
    """Segment scores times the document's prior, 1 where it has none."""
    if priors is None:
        return segments
    return segments.join(priors, "did", "left").select("did", "seg", (F.col("score") * F.coalesce("prior", F.lit(1.0))).alias("score"))


def rank(index: Index, hits: DataFrame | Node, scored: DataFrame, priors: DataFrame | None = None, depth: int | None = None, mode: str = "exact", top_segments: int | None = None) -> DataFrame:
    """(did, score), best first, ties by did, scores to 6 places. Hits are segments, or a query tree: see ``score.scores``.

    ``exact`` sums all hit segments of a document; ``top_segments`` only those among the best
    ``top_segments`` (rank depth of the index by default) with a positive score. ``auto`` counts the hits first: up to
    ``exact_up_to`` of the index are ranked exactly, more by their top segments.
    """
    if mode == "auto":
        here = hits if isinstance(hits, DataFrame) else index.matching(hits)
        mode = "exact" if here.limit(index.config.exact_up_to + 1).count() <= index.config.exact_up_to else "top_segments"
    segments = with_prior(segment_scores(index, hits, scored), priors)
    if mode == "top_segments":
        segments = segments.where("score > 0").withColumn("r", F.round("score", 9)).orderBy(F.desc("r"), "did", "seg").limit(top_segments or index.config.rank_depth)
    docs = segments.groupBy("did").agg(F.round(F.sum("score"), 6).alias("score"))
    return docs.orderBy(F.desc("score"), "did").limit(depth or index.config.rank_depth)


def merge_ranked(ranked: list[DataFrame], depth: int = 1000) -> DataFrame:
    """The best of several ranked lists."""
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.desc("score"), "did").limit(depth)
