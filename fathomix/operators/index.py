"""The tables of an index, all lazy or read from where they were written: bags, postings, segments, lexicon.

A document is cut in segments of a fixed number of tokens, numbered from 1; segment 0, the
head, holds its metadata attributes. The unit of every count is the segment: a term that a segment
repeats counts once. The base table is that of *bags*, a row for each segment with its tokens in order: positions and
postings come from it without a shuffle, and whoever needs the contents of some segments reads those bags only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.tokens import tokens
from ..plans.query import Node


def bags(docs: DataFrame, config: IndexConfig = IndexConfig(), did: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(did, seg, terms), with ``lang`` also (lang): the tokens of each segment in order. No shuffle."""
    more = [F.col(lang).alias("lang")] if lang else []
    size = config.segment_size
    rows = docs.select(F.col(did).alias("did"), *more, tokens(F.col(text), config.max_token_length).alias("t"))
    # null without tokens, and so no row: a condition on rows would be evaluated by a second pass over the text
    parts = F.when(F.size("t") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / size).cast("int")), lambda i: F.slice("t", i * size + 1, size)))
    found = rows.select("did", *(["lang"] if lang else []), F.posexplode(parts).alias("p", "terms"))
    return found.select("did", (F.col("p") + 1).cast("int").alias("seg"), "terms", *(["lang"] if lang else []))


def heads(docs: DataFrame, attributes: dict[str, str], did: str = "doc_id", lang: str | None = None) -> DataFrame:
    """(did, seg = 0, term, kind, and ``lang`` if documents have it): metadata of each document; ``attributes`` maps a column to its kind (lang, meta_rank or meta_norank)."""
    pairs = F.array(*(F.struct(F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("term"), F.lit(kind).alias("kind")) for c, kind in attributes.items()))
    more = [F.col(lang).alias("lang")] if lang else []
    rows = docs.select(F.col(did).alias("did"), *more, F.lit(0).alias("seg"), F.explode(pairs).alias("m")).where("m.term is not null")
    return rows.select("did", "seg", "m.term", "m.kind", *(["lang"] if lang else [])).distinct()


def layer_of(freq: Column, limits: tuple[int, ...]) -> Column:
    """Frequency band: the first whose limit is not below ``freq``."""
    out = F.when(freq <= limits[0], 0)
    for i, most in enumerate(limits[1:], 1):
        out = out.when(freq <= most, i)
    return out.otherwise(len(limits))


#: Tokens that are put in the order of terms at a time.
RUN = 2_000_000


def by_term(bags: DataFrame, places: bool = False) -> DataFrame:
    """Postings (did, seg, term, kind, and ``lang`` where known) or places (did, seg, pos, term) of bags, in runs of ``RUN`` tokens, each in the order of terms and documents.

    No shuffle and no sort of a whole partition: written, every file is a block of documents with an order of its own, and column indexes tell which of
    its pages hold a term.
    """
    lang = "lang" in bags.columns and not places
    kind = bags.schema["did"].dataType.simpleString()
    schema = f"did {kind}, seg int, " + ("pos int, term string" if places else "term string, kind string" + (", lang string" if lang else ""))
    run = RUN

    def inverted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").chunk(0)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[coded.indices.to_numpy()] << 32
        row = np.repeat(np.arange(len(size)), size)
        code |= np.arange(len(row)) if places else row
        code.sort()
        if not places and len(code):
            code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        names, low, start = coded.dictionary.take(pa.array(order)), code & 0xFFFFFFFF, np.cumsum(size) - size
        where = row[low] if places else low
        for at in range(0, len(code), 1 << 16):
            some = slice(at, at + (1 << 16))
            rows = pa.array(where[some])
            out = {"did": table.column("did").chunk(0).take(rows), "seg": table.column("seg").chunk(0).take(rows)}
            if places:
                out["pos"] = pa.array((low[some] - start[where[some]] + 1).astype(np.int32))
            out["term"] = names.take(pa.array(code[some] >> 32))
            if not places:
                out["kind"] = pa.repeat("token", len(rows))
            if lang:
                out["lang"] = table.column("lang").chunk(0).take(rows)
            yield pa.RecordBatch.from_pydict(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n >= run:
                yield from inverted(held)
                held, n = [], 0
        if n:
            yield from inverted(held)

    return bags.select("did", "seg", "terms", *(["lang"] if lang else [])).mapInArrow(work, schema)


@dataclass
class Index:
    """Tables of documents. ``bags`` and ``head`` (which may be None) carry the document's ``lang`` where it has one, so that no table joins it in."""

    bags: DataFrame
    config: IndexConfig = IndexConfig()
    head: DataFrame | None = None
    priors: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, config: IndexConfig = IndexConfig(), attributes: dict[str, str] | None = None, did: str = "doc_id", text: str = "text", lang: str | None = None) -> Index:
        return cls(bags(docs, config, did, text, lang), config, heads(docs, attributes, did, lang) if attributes else None)

    @classmethod
    def of_attributes(cls, rows: DataFrame, config: IndexConfig = IndexConfig()) -> Index:
        """An index of (did, term) rows in any order: each document is one segment of attributes."""
        return cls(rows.groupBy("did").agg(F.collect_set("term").alias("terms")).select("did", F.lit(1).alias("seg"), "terms"), config)

    @property
    def _lang(self) -> list[str]:
        return [c for c in self.bags.columns if c == "lang"]

    @property
    def positions(self) -> DataFrame:
        """(did, seg, pos, term, and ``lang`` where known): each token; ``pos`` counts from 1 within the segment."""
        found = self.bags.select("did", "seg", *self._lang, F.posexplode("terms").alias("p", "term"))
        return found.select("did", "seg", (F.col("p") + 1).cast("int").alias("pos"), "term", *self._lang)

    @cached_property
    def places(self) -> DataFrame:
        """(did, seg, pos, term): positions to look terms up in; a written index has them in the order of terms."""
        return self.positions.select("did", "seg", "pos", "term")

    @cached_property
    def text_postings(self) -> DataFrame:
        return self.bags.select("did", "seg", F.explode(F.array_distinct("terms")).alias("term"), *self._lang)

    @cached_property
    def postings(self) -> DataFrame:
        """(did, seg, term, kind, and ``lang`` where known), each once."""
        text = self.text_postings.withColumn("kind", F.lit("token"))
        return text.unionByName(self.head) if self.head is not None else text

    @cached_property
    def segments(self) -> DataFrame:
        """(did, seg, n_tokens), head segments with 0 where there are heads."""
        text = self.bags.select("did", "seg", F.size("terms").cast("long").alias("n_tokens"))
        if self.head is None:
            return text
        return text.unionByName(self.head.select("did", "seg").distinct().withColumn("n_tokens", F.lit(0).cast("long")))

    def some_bags(self, segments: DataFrame | Node) -> DataFrame:
        """Bags of some segments. A query tree that a bag alone answers is a condition on bags; another one narrows them before its hits join."""
        from .hits import hits, in_bag

        if isinstance(segments, DataFrame):
            return self.bags.join(segments.select("did", "seg"), ["did", "seg"], "left_semi")
        condition, whole = in_bag(segments)
        some = self.bags.where(condition)
        return some if whole else some.join(hits(self, segments), ["did", "seg"], "left_semi")

    def some_heads(self, segments: DataFrame | Node) -> DataFrame:
        """Rows of some segments' heads. What a query tree matches there takes the heads alone."""
        from .hits import hits

        here = segments.where("seg = 0") if isinstance(segments, DataFrame) else hits(Index(self.bags.where("false"), self.config, self.head), segments)
        return self.head.join(here.select("did", "seg"), ["did", "seg"], "left_semi")

    def matching(self, node: Node) -> DataFrame:
        """(did, seg) of the segments that ``contents`` of a query tree reads."""
        text = self.some_bags(node).select("did", "seg")
        return text if self.head is None else text.unionByName(self.some_heads(node).select("did", "seg").distinct())

    def contents(self, segments: DataFrame | Node, layered: bool = True) -> DataFrame:
        """(did, seg, term, kind) of some segments (or of those that match a query tree), from their bags alone; ``layered`` leaves frequent tokens out."""
        text = self.some_bags(segments).select("did", "seg", F.explode(F.array_distinct("terms")).alias("term"), F.lit("token").alias("kind"))
        if layered and self.config.n_frequent:
            text = text.join(F.broadcast(self.frequent), "term", "left_anti").select("did", "seg", "term", "kind")
        if self.head is None:
            return text
        return text.unionByName(self.some_heads(segments).select("did", "seg", "term", "kind"))

    @property
    def frequent(self) -> DataFrame:
        """(term) of the frequent tokens, ``n_frequent`` a language at most."""
        return self.lexicon.where("is_frequent").select("term")

    @cached_property
    def norm(self) -> DataFrame:
        """(term, freq): in how many segments a term is."""
        return self.postings.groupBy("term").agg(F.count("*").alias("freq"))

    @cached_property
    def lexicon(self) -> DataFrame:
        """(term, kind, freq, lang, is_frequent, layer); ``lang`` is that of the first document (by id) with one, ``layer`` null for frequent terms.

        Frequent: the ``n_frequent`` tokens of each language by falling frequency, ties by term.
        """
        posts = Index.postings.func(self)
        if "lang" in posts.columns:
            # by language first: counts and least documents have a fixed width, so that rows are summed where they lie and not sorted
            each = posts.groupBy("term", "kind", "lang").agg(F.count("*").alias("n"), F.min("did").alias("did"))
            lang = F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col("did")))
            base = each.groupBy("term", "kind").agg(F.sum("n").alias("freq"), lang.alias("lang"))
        else:
            base = posts.groupBy("term", "kind").agg(F.count("*").alias("freq")).withColumn("lang", F.lit(None).cast("string"))
        if not self.config.n_frequent:
            return base.withColumn("is_frequent", F.lit(False)).withColumn("layer", layer_of(F.col("freq"), self.config.layers))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("freq"), "term"))
        # n_frequent rows a language at most, so the join is a broadcast
        frequent = base.where("kind = 'token'").withColumn("k", place).where(F.col("k") <= self.config.n_frequent).select("term", "kind", F.lit(True).alias("f"))
        full = base.join(F.broadcast(frequent), ["term", "kind"], "left")
        return full.select("term", "kind", "freq", "lang", F.coalesce("f", F.lit(False)).alias("is_frequent"), F.when(F.col("f").isNull(), layer_of(F.col("freq"), self.config.layers)).alias("layer"))

    @cached_property
    def layered(self) -> DataFrame:
        """Postings that score and rank: all but those of frequent tokens."""
        if not self.config.n_frequent:
            return self.postings
        return self.postings.join(F.broadcast(self.frequent), "term", "left_anti")

    @cached_property
    def info(self) -> DataFrame:
        """One row: documents, segments (heads included) and distinct terms."""
        a = self.segments.agg(F.countDistinct("did").alias("n_docs"), F.count("*").alias("n_segments"))
        return a.crossJoin(self.postings.agg(F.countDistinct("term").alias("n_terms")))

    # access paths

    def inverted(self, term: str, by_document: bool = False) -> DataFrame:
        """Where a term is: (did, seg), or (did)."""
        found = self.postings.where(F.col("term") == term.lower())
        return found.select("did").distinct() if by_document else found.select("did", "seg")

    def forward(self, layer: int | None = None) -> DataFrame:
        """(did, seg, term, layer) of one frequency band, or of all."""
        some = self.lexicon.where(F.col("layer").isNotNull() if layer is None else F.col("layer") == layer)
        return self.postings.join(some.select("term", "layer"), "term").select("did", "seg", "term", "layer")

    def bag(self, did: int | None = None) -> DataFrame:
        """(did, terms): the layered terms of all segments of a document (or each), a term as often as segments hold it."""
        rows = self.layered if did is None else self.layered.where(F.col("did") == did)
        return rows.groupBy("did").agg(F.sort_array(F.collect_list("term")).alias("terms"))

    def decode(self, segments: DataFrame | Node | None = None) -> DataFrame:
        """(did, seg, text): tokens of each segment (or of some) in order."""
        some = self.bags if segments is None else self.some_bags(segments)
        return some.select("did", "seg", F.array_join("terms", " ").alias("text"))

    def docinfo(self) -> DataFrame:
        """(did, first_seg, last_seg, n_tokens, prior): where a document's segments are, and its prior (1 where none is kept)."""
        rows = self.segments.groupBy("did").agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg"), F.sum("n_tokens").alias("n_tokens"))
        if self.priors is None:
            return rows.withColumn("prior", F.lit(1.0))
        return rows.join(self.priors.select("did", "prior"), "did", "left").withColumn("prior", F.coalesce("prior", F.lit(1.0)))

    def peek(self, least: str = "", most: int = 100) -> DataFrame:
        """Lexicon rows in the order of terms from ``least`` on: a listing that reads the row groups it shows."""
        return self.lexicon.where(F.col("term") >= least).orderBy("term", "kind").limit(most)

    def lookup(self, terms: list[str]) -> DataFrame:
        """Lexicon rows of terms, without regard to case."""
        return self.lexicon.where(F.col("term").isin([t.lower() for t in terms]))

    def frequency(self, term: str) -> DataFrame:
        return self.norm.where(F.col("term") == term.lower())

    # storage

    def write(self, path: str) -> None:
        """Two layouts: bags by document, for contents, and postings and places by term in blocks of documents, for lookups and phrases.

        Texts are read once, to write the bags; all else is made from those.
        """
        now = Stored.at(self, path)
        now.write_all()
        spark = self.bags.sparkSession
        if self.priors is not None:
            self.priors.write.mode("overwrite").parquet(f"{path}/priors")
        tables = [t for t, x in (("head", self.head), ("priors", self.priors)) if x is not None]
        spark.createDataFrame([(json.dumps(asdict(self.config) | {"tables": tables}),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def read(cls, spark: SparkSession, path: str, config: IndexConfig | None = None, lexicon: str | None = None) -> Index:
        """A written index; its tables are scans. ``config`` and ``lexicon`` (a path) for one that differs from it only in frequent terms and bands."""
        raw = json.loads(spark.read.text(f"{path}/config").first()[0])
        tables = raw.pop("tables")
        more = {t: spark.read.parquet(f"{path}/{t}") for t in tables}
        out = cls(spark.read.parquet(f"{path}/bags"), config or IndexConfig(**{**raw, "layers": tuple(raw["layers"])}), more.get("head"), more.get("priors"))
        out.__dict__.update(postings=spark.read.parquet(f"{path}/inverted"), places=spark.read.parquet(f"{path}/places"))
        out.__dict__["text_postings"] = out.postings.where("kind = 'token'").drop("kind")
        if lexicon or config is None:
            out.__dict__["lexicon"] = spark.read.parquet(lexicon or f"{path}/lexicon")
            out.__dict__["norm"] = out.lexicon.select("term", "freq")
        return out


@dataclass
class Stored(Index):
    """An index in a folder, with the tables that are there (``done``, shared by all that share the folder).

    Bags and heads always are. Until postings and places are written they come from the bags: to read those once costs a small part of
    what it costs to put all in order, which pays for many queries only. The lexicon is written when it is first asked for.
    """

    path: str = ""
    lexicon_path: str = ""
    done: set | None = None

    @classmethod
    def at(cls, index: Index, path: str) -> Stored:
        """Bags and heads of an index written to a folder."""
        spark = index.bags.sparkSession
        index.bags.write.mode("overwrite").parquet(f"{path}/bags")
        if index.head is not None:
            index.head.write.mode("overwrite").parquet(f"{path}/head")
        head = spark.read.parquet(f"{path}/head") if index.head is not None else None
        return cls(spark.read.parquet(f"{path}/bags"), index.config, head, path=path, lexicon_path=f"{path}/lexicon", done=set())

    def _read(self, path: str) -> DataFrame:
        return self.bags.sparkSession.read.parquet(path)

    @property
    def postings(self) -> DataFrame:
        return self._read(f"{self.path}/inverted") if "inverted" in self.done else Index.postings.func(self)

    @property
    def places(self) -> DataFrame:
        return self._read(f"{self.path}/places") if "places" in self.done else Index.places.func(self)

    @cached_property
    def lexicon(self) -> DataFrame:
        if self.lexicon_path not in self.done:
            Index.lexicon.func(self).sortWithinPartitions("term").write.mode("overwrite").parquet(self.lexicon_path)
            self.done.add(self.lexicon_path)
        return self._read(self.lexicon_path)

    @cached_property
    def norm(self) -> DataFrame:
        return self.lexicon.select("term", "freq")

    def write_all(self) -> None:
        """Whatever isn't written yet."""
        if "inverted" not in self.done:
            by_term(self.bags).write.mode("overwrite").parquet(f"{self.path}/inverted")
            if self.head is not None:
                self.head.sortWithinPartitions("term", "did").write.mode("append").parquet(f"{self.path}/inverted")
            self.done.add("inverted")
        if "places" not in self.done:
            by_term(self.bags, places=True).write.mode("overwrite").parquet(f"{self.path}/places")
            self.done.add("places")
        self.lexicon  # noqa: B018 - written as it is looked at


def frozen(positions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Positions of known terms only: for ingest against a vocabulary that no longer grows."""
    return positions.join(lexicon.select("term"), "term", "left_semi").select("did", "seg", "pos", "term")


def merge_norms(norms: DataFrame) -> DataFrame:
    """(term, freq) of the tables of several blocks: sums."""
    return norms.groupBy("term").agg(F.sum("freq").alias("freq"))


def carry_sites(lexicon: DataFrame, older: DataFrame) -> DataFrame:
    """(term, freq) of a lexicon and, with frequency 0, the sites (terms with a dot) that only an older one has, so that what refers to them stays valid."""
    lost = older.where(F.col("term").contains(".")).join(lexicon, "term", "left_anti")
    return lexicon.select("term", "freq").unionByName(lost.select("term", F.lit(0).cast("long").alias("freq")))
