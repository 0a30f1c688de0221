"""Incremental maintenance: what changed between two versions of a corpus, and the merged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(sources: DataFrame) -> DataFrame:
    """(path, content_hash, content[, ...]) of sources with binary ``content``."""
    return sources.withColumn("content_hash", F.sha2(F.col("content"), 256))


def decoded(sources: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``text`` (null where the content is not UTF-8)."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return sources.withColumns({"valid": valid, "text": F.when(valid, F.decode("content", "UTF-8"))})


def delta(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """(path, action, old_hash, content_hash): action is indexed, unchanged, removed, rejected or evicted.

    ``old``: (path, content_hash, extractor); ``new``: (path, content_hash, extractor, valid).
    The hash is compared before the content is decoded, so an unchanged file stays unchanged.
    A file that is no longer readable as text is evicted if it was stored, else rejected.
    """
    was = old.select("path", F.col("content_hash").alias("old_hash"), F.col("extractor").alias("old_extractor"))
    now = new.select("path", "content_hash", "extractor", "valid")
    same = F.lit(not force) & (F.col("old_hash") == F.col("content_hash")) & (F.col("old_extractor") == F.col("extractor"))
    action = (
        F.when(F.col("content_hash").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(~F.col("valid") & F.col("old_hash").isNotNull(), "evicted").when(~F.col("valid"), "rejected").otherwise("indexed")
    )
    return was.join(now, "path", "full_outer").select("path", action.alias("action"), "old_hash", "content_hash", "extractor")


def report(changes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: discovered, indexed, unchanged, removed, rejected[, chunks_written]."""
    n = lambda *names: F.count(F.when(F.col("action").isin(*names), 1))
    row = changes.agg(
        F.count(F.when(F.col("action") != "removed", 1)).alias("discovered"), n("indexed").alias("indexed"), n("unchanged").alias("unchanged"),
        n("removed").alias("removed"), n("rejected", "evicted").alias("rejected"),
    )
    if chunks is None:
        return row
    written = chunks.join(changes.where("action = 'indexed'").select(F.col("path").alias("source_path")), "source_path", "left_semi").agg(F.count(F.lit(1)).alias("chunks_written"))
    return row.crossJoin(written)


def merged(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose ``key`` is not a touched path, and the rows of ``new``."""
    return old.join(touched.select(F.col("path").alias(key)), key, "left_anti").select(*new.columns).unionByName(new)


def drifted(paths: DataFrame, sources: DataFrame, live: DataFrame) -> DataFrame:
    """(path, position) of listed paths whose live content differs from the stored; a path without either has drifted.

    ``paths``: (position, path), repeats allowed; the first position of each stays.
    """
    first = paths.groupBy("path").agg(F.min("position").alias("position"))
    known = first.join(sources.select("path", "content_hash"), "path", "left").join(live.select("path", F.col("content_hash").alias("live_hash")), "path", "left")
    return known.where(~F.coalesce(F.col("content_hash") == F.col("live_hash"), F.lit(False))).select("path", "position")


def upsert_latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("nth = 1").drop("nth")


def status(sources: DataFrame, chunks: DataFrame, embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, with the model that has most vectors (ties to the lesser name)."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    models = embeddings.groupBy("model_id").agg(F.count(F.lit(1)).alias("embeddings"))
    best = models.agg(F.coalesce(F.max("embeddings"), F.lit(0)).alias("embeddings"), F.min_by("model_id", F.struct(-F.col("embeddings"), "model_id")).alias("embedding_model"))
    symbols = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("symbol").alias("symbols"))
    return count(sources, "sources").crossJoin(symbols).crossJoin(best).crossJoin(count(edges, "edges"))
