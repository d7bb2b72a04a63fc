"""Duplicates and sites: one of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Node
from .hits import hits
from .index import Index


def _one(rows: DataFrame, by: list, order: list) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def one_per_content(index: Index, segments: DataFrame | Node | None = None) -> DataFrame:
    """(did, seg): of segments with the same tokens in the same order the last one."""
    return index.decode(segments).groupBy(F.md5("text").alias("h")).agg(F.max(F.struct("did", "seg")).alias("m")).select("m.did", "m.seg")


def one_per_site(segments: DataFrame, sites: DataFrame) -> DataFrame:
    """(did, seg): of each site the segment of the greatest (did, seg); those without a site stay."""
    both = segments.join(sites, "did", "left")
    named = both.where("site is not null").groupBy("site").agg(F.max(F.struct("did", "seg")).alias("m")).select("m.did", "m.seg")
    return named.unionByName(both.where("site is null").select("did", "seg"))


def only_site(segments: DataFrame, sites: DataFrame, site: str) -> DataFrame:
    """Segments of one site."""
    return segments.join(sites.where(F.col("site") == site.lower()), "did", "left_semi")


def one_result_each(ranked: DataFrame, docs: DataFrame, collapse_sites: bool = True, sites: DataFrame | None = None) -> DataFrame:
    """Ranked rows (did, score) of which no better one has the same body or, with ``collapse_sites``, the same site; docs: (did, site, body).

    Ranked rows are a list of some depth, which goes to where the documents lie. ``sites`` (did, site), where they aren't in docs, join what is left.
    """
    order = [F.desc("score"), "did"]
    rows = docs.join(F.broadcast(ranked), "did").withColumn("digest", F.md5(F.coalesce("body", F.lit("")))).drop("body")
    if sites is not None:
        rows = rows.join(sites, "did", "left")
    if collapse_sites:
        rows = rows.withColumn("own", F.coalesce("site", F.concat(F.lit("did:"), F.col("did").cast("string"))))
        rows = _one(rows, ["own"], order).drop("own")
    return _one(rows, ["digest"], order).select("did", "score")


def filter_hits(index: Index, segments: DataFrame | Node, sites: DataFrame | None = None, priors: DataFrame | None = None, site: str | None = None) -> DataFrame:
    """(did, seg): hits as scoring and ranking take them.

    Of documents with a prior of 1 only (where there are priors), of equal contents the last segment, and of each site
    the last one, or with ``site`` all of that site.
    """
    if priors is not None:
        segments = (segments if isinstance(segments, DataFrame) else hits(index, segments)).join(priors.where("prior = 1").select("did"), "did", "left_semi")
    segments = one_per_content(index, segments)
    if sites is None:
        return segments
    return only_site(segments, sites, site) if site else one_per_site(segments, sites)
