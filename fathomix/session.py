"""A session with the settings that the engine's plans are made for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "fathomix", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution (partition sizes and skewed joins at run time), UTC, bounded Arrow batches; ``conf`` wins."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # many small partitions before few large ones: sorts of terms are heavy for their bytes
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``; only a session on one machine may do without, and gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fathomix-"))
    return sc._jsc.sc().getCheckpointDir().get()
