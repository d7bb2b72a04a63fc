"""Search from a query's text to a page of results."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, hits, present, rank, score
from ..operators.index import Index
from .query import And, Query, parse


#: Segments that are broadcast.
FEW = 200_000


@dataclass
class Searcher:
    """An index with its documents (did, url, title, body, site) and what was asked before.

    The flow is that of a node of a search cluster. Cue segments and hit segments are filtered in the same way: of documents
    with a prior of 1 only (where there are priors), one segment of each content, one of each site (or all of the site
    that is asked for). The number of cue segments then tells which frequency bands can score; ranks sum those scores.

    Scores depend on the cues alone and ranks on keys, cues and modifiers, so that is what they are kept by.
    The ``keep`` last frames of each kind are cached; ``forget`` frees all.
    """

    index: Index
    docs: DataFrame
    priors: DataFrame | None = None
    page_size: int = 10
    keep: int = 32
    mode: str = "exact"
    _scores: OrderedDict = field(default_factory=OrderedDict, repr=False)
    _ranks: OrderedDict = field(default_factory=OrderedDict, repr=False)
    _hits: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def _kept(self, cache: OrderedDict, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in cache:
            cache[key] = make().cache()
            while len(cache) > self.keep:
                cache.popitem(last=False)[1].unpersist()
        cache.move_to_end(key)
        return cache[key]

    def _filtered(self, nodes: tuple, site: str | None = None) -> DataFrame:
        """Hits after the filters; few of them go to the bags, where many would move the bags."""
        node = And(nodes) if len(nodes) > 1 else nodes[0]
        found = self._kept(self._hits, (nodes, site), lambda: dedup.filter_hits(self.index, node, self.docs.select("did", "site"), self.priors, site))
        return F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found

    def scores(self, query: Query) -> DataFrame:
        return self._kept(self._scores, query.canonical[1], lambda: score.scores(self.index, self._filtered(query.cues), select=True))

    def ranked(self, query: Query) -> DataFrame:
        """(did, score) of the whole result, no two of the same body or (unless one site is asked for) site."""

        def make() -> DataFrame:
            best = rank.rank(self.index, self._filtered(query.keys, query.mods.get("site")), self.scores(query), self.priors, mode=self.mode)
            rows = self.docs.select("did", "site", "body")
            return dedup.one_result_each(best, rows, collapse_sites="site" not in query.mods)

        return self._kept(self._ranks, query.canonical, make)

    def search(self, text: str, offset: int = 0) -> DataFrame:
        """(did, score, url, title, snippet), a page of them from ``offset``; ``score:`` as a modifier gives (term, shown) instead.

        Words that no document has are dropped; a query without a key left gives no row.
        """
        query = self.parse(text)
        if not query.keys:
            return self.docs.select("did", F.lit(0.0).alias("score"), "url", "title", F.lit("").alias("snippet")).where("false")
        if "score" in query.mods:
            return present.explain_scores(self.scores(query))
        page = present.page(self.ranked(query), offset, self.page_size)
        shown = self.docs.join(F.broadcast(page), "did")
        words = [t for n in query.keys for t in getattr(n, "terms", None) or (n.term,)]
        sentences = present.sentence_scores(shown.select("did", "body"), words, self.scores(query), "did", "body")
        out = shown.join(present.snippets(sentences, words), "did", "left")
        return out.select("did", "score", "url", present.short_title(F.col("title")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet")).orderBy(F.desc("score"), "did")

    def parse(self, text: str) -> Query:
        """The query, unknown words dropped: a lookup of its few words in the norm table."""
        first = parse(text)
        words = {t for n in (*first.keys, *first.cues) for t in getattr(n, "terms", None) or (n.term,)}
        known = {r.term for r in self.index.norm.where(F.col("term").isin(sorted(words))).select("term").collect()} if words else set()
        return parse(text, known)

    def total(self, query: Query) -> DataFrame:
        """(n): hit segments, before any filter of copies and sites."""
        return hits.hits(self.index, And(query.keys) if len(query.keys) > 1 else query.keys[0]).agg(F.count("*").alias("n"))

    def forget(self) -> None:
        for df in (*self._scores.values(), *self._ranks.values(), *self._hits.values()):
            df.unpersist()
        self._hits.clear()
        self._scores.clear()
        self._ranks.clear()


