"""Scans of tables that are smaller than one split."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table smaller than this would be read, and worked on, by one or two tasks.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan is smaller than a split and not cut finely already; a larger table is left as its splits are."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(str(size)) < SPREAD_BYTES and df._jdf.rdd().getNumPartitions() <= 2 * cores else df


def dealt(keys: DataFrame) -> DataFrame:
    """``keys``, narrow rows from which much is made, dealt over all cores however large the table is; one cut finely already is left as its splits are."""
    size = int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(cores * (4 if size >= 1 << 20 else 1)) if keys._jdf.rdd().getNumPartitions() <= 4 * cores else keys
