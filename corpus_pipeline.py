"""The corpus pipeline: language, quality, copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. Columns of other names pass through, and may clash with no name that a
stage uses, as stages read columns by place. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fathomix.llm import langid, packing, quality, secrets, simhash
from fathomix.llm.cluster import shared_dir
from fathomix.sources.layout import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, which ``lang`` then names; models are fitted on a bounded sample of these documents' own labels.

    Null and empty texts and those without a letter go, as no language is known for them. Unlabelled rows, rows with a null id
    and repeated rows are judged each by their texts.
    """
    return langid.keep_known(docs, set_lang=True)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to the character classes and common words of their language, as the stage before identified it.

    Null texts go; texts too short for a rule pass it. Rows with a null id and repeated rows are judged each.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the smallest id.

    Rows with a null id or text stay; of rows that repeat both an id and its text one stays.
    """
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets masked in the text, and n_chars brought up to date. No row goes; null and empty texts stay as they are."""
    return secrets.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths. Null and empty texts have none; rows with a null id and repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("quality_rules", good_quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SimHash fingerprints and character models have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage returns is written as Parquet in the shared folder and read by the next; it is deleted when that has ended."""
    shared_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _delete(spark, before)
        before = f"{base}/{name}"
    return docs
