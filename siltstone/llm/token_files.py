"""Token-ID output: whole texts as ids in patched frame-of-reference images, in id order.

Documents are range-partitioned and sorted by ``doc_id``; each task tokenizes its range and
writes segments of whole documents, one row each, in a Parquet container under the shared
folder (so Spark's commit protocol covers lost executors and any store works): the
``pfor`` image of the segment's ids, its documents' ids and lengths, and the place of its
first id inside the range.  ``read_back`` decodes the files.

Edge cases: a null text is empty and has the end id alone.  Null ids come first; rows of
equal id follow by text, and repeated rows are written each.  A document is never cut, so
a very long one makes one long segment.  An empty table gives no rows.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from ._common import shared_dir, slices
from .tokenize import WordTokenizer, tokenizer_path

SEGMENT_IDS = 1 << 17
_SEGMENT = "part int, seq int, start_in_part bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, image binary"


def write(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the ids of every text, ``end_id`` appended, in ascending ``doc_id``."""
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        words = WordTokenizer(tokenizer)
        part = TaskContext.get().partitionId()
        seq, start, size, doc_ids, pieces = 0, 0, 0, [], []

        def segment():
            ids = np.concatenate(pieces)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "start_in_part": start, "n_ids": size, "doc_ids": doc_ids, "lengths": [len(p) for p in pieces], "image": pfor.encode(ids)}], schema=schema
            )

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("image", pa.binary())])
        for batch in batches:
            for rows in slices(batch, 256):
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    doc_ids.append(doc_id)
                    pieces.append(np.append(words.encode(text), np.uint32(end_id)))
                    size += len(pieces[-1])
                    if size >= SEGMENT_IDS:
                        yield segment()
                        seq, start, size, doc_ids, pieces = seq + 1, start + size, 0, [], []
        if doc_ids:
            yield segment()

    (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, _SEGMENT).write.parquet(path)
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    files = spark.read.schema(_SEGMENT).parquet(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(pfor.decode(row["image"]).tobytes())
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                starts = ends - np.array(row["lengths"], dtype=np.int64)
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(starts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start_in_part"]), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One row per range: as many as tasks that wrote, which is what bounds the broadcast.
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", F.coalesce(before, F.lit(0)).alias("ids_before"))
    found = files.select("part", "start_in_part", "doc_ids", "lengths", "image").mapInArrow(run, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(ranges), "part").select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
