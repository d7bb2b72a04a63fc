"""Document prior: how normal its text is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index


def top_words(index: Index, n: int | None = None) -> DataFrame:
    """(term): the n most frequent tokens of each language, ties by term.

    How many tokens are as frequent tells from which frequency on they fit; so only those tied at the last place are put in order,
    and no task sorts a language's whole lexicon.
    """
    n = n or index.config.top_words
    some = index.lexicon.where("kind = 'token'").select("term", "lang", "freq")
    # a row for each frequency that some token has
    times = some.groupBy("lang", "freq").agg(F.count("*").alias("times"))
    upto = times.withColumn("upto", F.sum("times").over(Window.partitionBy("lang").orderBy(F.desc("freq"))))
    fits = upto.where(F.col("upto") - F.col("times") < n).select(F.col("lang").alias("l"), F.col("freq").alias("f"), (n - F.col("upto") + F.col("times")).alias("room"), (F.col("upto") <= n).alias("all"))
    both = some.join(fits, F.col("lang").eqNullSafe(F.col("l")) & (F.col("freq") == F.col("f")))
    tied = both.where("not all").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("term"))).where(F.col("k") <= F.col("room"))
    return both.where("all").select("term").unionByName(tied.select("term"))


#: Top words that are sent to every task.
MOST_WORDS = 1_000_000


def normality(index: Index, words: DataFrame) -> DataFrame:
    """(did, prior): the share of a document's windows that hold a top word, 0 without a window.

    A window ends before a token that has ``window`` tokens before it in the segment, and covers
    the ``window + 1`` before that token. A segment's windows need its bag alone, so they are counted where it lies.
    """
    w, top = index.config.window, [r.term for r in words.select("term").distinct().limit(MOST_WORDS + 1).collect()]
    if len(top) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} top words")
    values = pa.array(sorted(top), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flags = pc.is_in(lists.flatten(), values).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(flags)])
            start = np.repeat(np.cumsum(size) - size, size)
            at = np.arange(len(flags))
            full = at - start >= w
            hit = full & (before[at] > before[np.maximum(start, at - w - 1)])
            row = np.repeat(np.arange(len(size)), size)
            windows, hits = (np.bincount(row, weights=x, minlength=len(size)).astype(np.int64) for x in (full, hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(windows), pa.array(hits)], names=["did", "windows", "hits"])

    counted = index.bags.select(F.col("did").cast("long").alias("did"), "terms").mapInArrow(work, "did long, windows long, hits long")
    sums = counted.groupBy("did").agg(F.sum("windows").alias("windows"), F.sum("hits").alias("hits"))
    return sums.select("did", F.when(F.col("windows") > 0, F.col("hits") / F.col("windows")).otherwise(0.0).alias("prior"))


def histogram(priors: DataFrame) -> DataFrame:
    """(bucket, n): documents by tenths of the prior."""
    return priors.groupBy(F.floor(F.col("prior") * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def normal_only(rows: DataFrame, priors: DataFrame, least: float = 1.0) -> DataFrame:
    """Rows of documents whose prior is at least ``least``."""
    return rows.join(priors.where(F.col("prior") >= least).select("did"), "did", "left_semi")
