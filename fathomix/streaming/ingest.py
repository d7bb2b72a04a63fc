"""Incremental ingest: each micro-batch of documents becomes one block of an index.

Blocks are written under ``block=<batch id>`` and overwritten if a batch is run again, so a
restart gives the same index. Frequencies of a block stand beside it; the corpus's are their
sums, which a reader takes, so nothing global is rewritten when a block arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import IndexConfig
from ..operators.index import Index, bags, merge_norms


def write_block(docs: DataFrame, block: int, path: str, config: IndexConfig = IndexConfig(), did: str = "doc_id", text: str = "text") -> None:
    """The bags, postings and norm table of one block; texts are read once, for the bags."""
    spark = docs.sparkSession
    bags(docs, config, did, text).write.mode("overwrite").parquet(f"{path}/bags/block={block}")
    posts = Index(spark.read.parquet(f"{path}/bags/block={block}"), config).text_postings
    posts.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/block={block}")
    posts.groupBy("term").agg(F.count("*").alias("freq")).write.mode("overwrite").parquet(f"{path}/norm/block={block}")


def ingest(stream: DataFrame, path: str, checkpoint: str, config: IndexConfig = IndexConfig(), did: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """Start ingesting a stream of documents; ``once`` takes what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: write_block(df, i, path, config, did, text))
    return (writer.trigger(availableNow=True) if once else writer).start()


def norm(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) over all blocks."""
    return merge_norms(spark.read.parquet(f"{path}/norm").select("term", "freq"))


def read(spark: SparkSession, path: str, config: IndexConfig = IndexConfig()) -> Index:
    """The index of all blocks so far."""
    out = Index(spark.read.parquet(f"{path}/bags").select("did", "seg", "terms"), config)
    out.__dict__["text_postings"] = spark.read.parquet(f"{path}/postings").select("did", "seg", "term")
    out.__dict__["norm"] = norm(spark, path)
    return out


def compact(spark: SparkSession, path: str, out: str, config: IndexConfig = IndexConfig()) -> Index:
    """The blocks so far written as one index in another place, in its two layouts, so that micro-batches leave no small files to readers of it."""
    Index(spark.read.parquet(f"{path}/bags").select("did", "seg", "terms"), config).write(out)
    return Index.read(spark, out)
