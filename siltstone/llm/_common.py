"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import spread

#: Words are maximal runs of characters other than ASCII white space.  ``bytes.split``
#: cuts at exactly these six bytes, so ``text.encode().split()`` gives the same words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Resolution of the hash draw used for bounded samples.
DRAWS = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_FORGOTTEN: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: of spark.checkpoint.dir, and where that is unset of the warehouse; removed when the driver ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    own = f"{named.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"
    if own not in _FORGOTTEN:
        _FORGOTTEN.add(own)
        atexit.register(_forget, spark, own)
    return own


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it.

    Cuts lineage with files that outlive any executor, so a lost executor costs its own
    unfinished tasks and nothing before them.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._siltstone_path = path
    return made


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    path = getattr(df, "_siltstone_path", None)
    if path:
        _forget(df.sparkSession, path)


def slices(batch, rows: int, column: str = "text", most_bytes: int = 1 << 24):
    """Slices of an Arrow batch of at most ``rows`` rows and about ``most_bytes`` of ``column``; a longer value is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def fold(doc_id: str, folds: int):
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def bounded_sample(keys: DataFrame, label: str, per_label: int, max_labels: int, seed: int) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, chosen by a hash of ``doc_id``.

    Two passes over (doc_id, label) alone: the counts give each label its share, then a
    hash draw below the share keeps a row.  Only counts of labels reach the driver, and no rows
    are ranked in one task; more than ``max_labels`` labels are an error, so none is dropped in
    silence.  Rows with a null label or a null id take no part.
    """
    keys = keys.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    counts = keys.groupBy(label).count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} values of {label}")
    shares = [(r[label], min(DRAWS, int(DRAWS * per_label / r["count"]) + 1)) for r in counts]
    shares = keys.sparkSession.createDataFrame(shares, f"{label} {keys.schema[label].dataType.simpleString()}, share bigint")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(DRAWS))
    return keys.join(F.broadcast(shares), label).where(draw < F.col("share")).select(*keys.columns)
