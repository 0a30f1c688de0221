"""Streaming ingestion: batches of changed sources are merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def ingest(engine: Engine, stream: DataFrame, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Merge a stream of (path, content) into the engine's tables, a batch at a time.

    A batch lists sources that were added or changed, so nothing is pruned.  Of a path that
    occurs more than once in a batch the latest content stays: by the column ``order`` (an event
    time or offset), else by ``modificationTime`` where the stream has it, else by the order in
    which the batch is read; ties go to the greater content.  Merging is idempotent: a batch that is
    repeated after a failure finds its sources unchanged.  A batch costs what it changes.
    """
    by = order or ("modificationTime" if "modificationTime" in stream.columns else None)

    def merge(batch: DataFrame, _: int) -> None:
        placed = batch.select("path", "content", (F.col(by) if by else F.monotonically_increasing_id()).alias("at"))
        rows = placed.groupBy("path").agg(F.max_by("content", F.struct("at", "content")).alias("content")).cache()
        if not rows.isEmpty():
            engine.index_sources(rows, only=rows.select("path"))
        rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
