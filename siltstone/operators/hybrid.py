"""Blending of lexical and vector hits, and routing by query class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOTAL_ORDER
from .lexical import DIGITS, deduplicated, digest


@dataclass(frozen=True)
class Profile:
    """Pinned lexical hits, the weight of the cosine, and the lexical score that needs no vectors."""

    name: str
    protected: int
    vector_weight: float
    shortcut: float | None


BALANCED = Profile("balanced", 3, 2.0, 2.0)
LEXICAL = Profile("lexical", 3, 1.5, 1.0)
SEMANTIC = Profile("semantic", 1, 4.0, None)
PROFILES = {p.name: p for p in (BALANCED, LEXICAL, SEMANTIC)}
#: The profile of each query class.
ROUTES = {"natural": SEMANTIC, "symbol": LEXICAL}


def candidate_limit(limit: int) -> int:
    return min(max(limit * 20, 100), 1000)


def blend(lexical: DataFrame, vector: DataFrame, chunks: DataFrame, profiles: DataFrame, limit: int = 10) -> DataFrame:
    """Hybrid hits of each query.

    ``lexical`` and ``vector``: (query_id, id, score, rank).  ``profiles``: (query_id,
    protected, vector_weight, shortcut), one row a query.  A query whose lexical list is full
    and whose best lexical score reaches the shortcut takes the lexical list as it is; this is
    a condition in the plan, not a probe by the driver.
    """
    strong = lexical.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lexical"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"))
    told = profiles.join(strong, "query_id", "left").withColumn("short", F.coalesce((F.col("n_lexical") >= limit) & (F.col("best") >= F.col("shortcut")), F.lit(False)))
    both = lexical.select("query_id", "id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank")).join(
        vector.select("query_id", "id", F.col("score").alias("cosine"), F.col("rank").alias("vector_rank")), ["query_id", "id"], "full_outer"
    )
    both = both.join(told.select("query_id", "protected", "vector_weight", "short"), "query_id").where(~F.col("short") | F.col("lexical_rank").isNotNull())
    pinned = ~F.col("short") & (F.col("lexical_rank") <= F.least(F.lit(limit), F.col("protected")))
    similarity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("cosine") + 1) / 2))
    blended = F.coalesce(1 / F.col("lexical_rank"), F.lit(0.0)) + F.coalesce(F.col("vector_weight") * similarity, F.lit(0.0))
    score = F.when(F.col("short"), F.col("lexical_score")).when(pinned, 10 + 1 / F.col("lexical_rank")).otherwise(blended)
    hits = both.withColumns({"pinned": F.coalesce(pinned, F.lit(False)), "score": F.round(score, DIGITS)})
    hits = hits.join(chunks.select("id", "source_path", "byte_start", digest(F.col("text")).alias("digest")), "id")
    in_short = F.when(F.col("short"), F.col("lexical_rank"))
    order = [
        F.asc_nulls_last(in_short), F.desc("pinned"), F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), *TOTAL_ORDER
    ]
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    best = deduplicated(hits.select("query_id", "id", "lexical_rank", "vector_rank", "score", "rank", "digest"), limit)
    return best.join(chunks, "id")
