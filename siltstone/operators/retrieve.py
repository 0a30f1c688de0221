"""Bodies by chunk id, checked against the live sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieve(chunks: DataFrame, ids: DataFrame, live: DataFrame) -> DataFrame:
    """(id, status, text, line_start, line_end, message) for each stored id.

    ``live``: (path, content_hash, text, problem); ``problem`` tells why a path cannot be read.
    ok: the source is as it was.  file: it changed, so the whole live file is the answer.
    unavailable: it is gone or cannot be read.
    """
    own = chunks.join(ids.select("id").distinct(), "id")
    now = live.select(F.col("path").alias("source_path"), F.col("content_hash").alias("live_hash"), F.col("text").alias("live_text"), "problem")
    both = own.join(now, "source_path", "left")
    fresh = F.col("live_hash") == F.col("source_hash")
    gone = F.col("live_hash").isNull() | F.col("problem").isNotNull()
    state = F.when(gone, "unavailable").when(fresh, "ok").otherwise("file")
    ended = F.when(F.col("live_text").endswith("\n") | (F.col("live_text") == ""), 0).otherwise(1)
    lines = F.greatest(F.lit(1), F.length("live_text") - F.length(F.replace("live_text", F.lit("\n"), F.lit(""))) + ended).cast("bigint")
    pick = lambda ok, file: F.when(F.col("status") == "ok", ok).when(F.col("status") == "file", file)
    return both.withColumn("status", state).select(
        "id", "source_path", "status", pick(F.col("text"), F.col("live_text")).alias("text"), pick(F.col("line_start"), F.lit(1).cast("bigint")).alias("line_start"),
        pick(F.col("line_end"), lines).alias("line_end"), F.when(F.col("status") == "unavailable", F.coalesce("problem", F.lit("source is gone"))).alias("message"),
    )
