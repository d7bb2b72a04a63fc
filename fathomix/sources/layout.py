"""How scans are laid out over cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer splits than there are cores (a small table in a file or two); else unchanged, so that large tables never shuffle here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
