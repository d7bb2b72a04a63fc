"""What the corpus operators share on the Spark side."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a key list is broadcast; past it the join is left to shuffle.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (``local`` as its master) may do without: it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fathomix-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch. Spark's own 10,000 rows of any size would make batches of gigabytes from texts of 100 kB.
BATCH_ROWS, BATCH_BYTES = 1024, 64 << 20


def _small_batches(df: DataFrame) -> None:
    """Bound the batches that Python workers get where the session leaves Spark's defaults (batches are cut when the plan runs, so no narrower place than the session is left)."""
    conf = df.sparkSession.conf
    for name, least, value in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 256 << 20, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, None)
        if now is not None and now.isdigit() and int(now) >= least:
            conf.set(key, str(value))


#: Values of a language column from which it is taken for something else.
MOST_LANGUAGES = 10_000


def check_languages(docs: DataFrame, lang_col: str) -> None:
    """What is kept of each language is bounded; so is their number: ValueError past MOST_LANGUAGES."""
    if docs.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``work`` to each record batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    _small_batches(df)
    return df.mapInArrow(each, schema)


def map_partition(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``work`` to the iterator of a partition's batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(b for b in batches if b.num_rows)

    _small_batches(df)
    return df.mapInArrow(each, schema)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key isn't in ``ids`` (few against docs); rows with a null key stay.

    ``ids`` should be cheap to count. It is broadcast up to BROADCAST_ROWS, else both sides are shuffled by key.
    """
    small = ids.select(key)
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return docs.join(small, key, "left_anti").select(*docs.columns)
