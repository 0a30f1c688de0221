"""Retrieval quality and token cost over a table of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EvaluationCaseWithoutExpected
from . import headers


def check_cases(cases: DataFrame) -> None:
    """Every case must expect something."""
    bad = cases.where(F.coalesce(F.size("expected"), F.lit(0)) < 1).select("name").limit(1).collect()
    if bad:
        raise EvaluationCaseWithoutExpected(bad[0]["name"])


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(name, first_rank) of each case; null where no hit is relevant.

    ``cases``: (name, expected array<struct<source_path, contains>>); ``hits``: (query_id = name, rank, source_path, text).
    """
    wanted = cases.select("name", F.explode("expected").alias("e")).select("name", F.col("e.source_path").alias("source_path"), F.col("e.contains").alias("part")).distinct()
    met = hits.withColumnRenamed("query_id", "name").join(wanted, ["name", "source_path"]).where(F.col("part").isNull() | F.col("text").contains(F.col("part")))
    return cases.select("name").join(met.groupBy("name").agg(F.min("rank").alias("first_rank")), "name", "left")


def report(ranks: DataFrame) -> DataFrame:
    """One row: cases, hits, hit_rate, mean_reciprocal_rank (misses count 0; no cases give 0)."""
    return ranks.agg(
        F.count(F.lit(1)).alias("cases"), F.count("first_rank").alias("hits"),
        F.round(F.coalesce(F.count("first_rank") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 6).alias("hit_rate"),
        F.round(F.coalesce(F.sum(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 6).alias("mean_reciprocal_rank"),
    )


def token_usage(ranks: DataFrame, hits: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, header_tokens, body_tokens, cold_tokens) of answered cases, a token for four bytes rounded up.

    All returned headers are billed, the body of the first relevant hit, and against them the
    whole file it lies in.  ``sources``: (path, size).
    """
    sized = headers.with_headers(hits).withColumn("header_bytes", headers.header_bytes()).withColumnRenamed("query_id", "name")
    four = lambda c: F.ceil(c / 4).cast("bigint")
    billed = sized.groupBy("name").agg(F.sum(four(F.col("header_bytes"))).alias("header_tokens"))
    answered = ranks.where(F.col("first_rank").isNotNull())
    body = answered.join(sized, (answered["name"] == sized["name"]) & (F.col("first_rank") == F.col("rank"))).select(answered["name"], "source_path", four(F.octet_length("text")).alias("body_tokens"))
    cold = body.join(sources.select(F.col("path").alias("source_path"), four(F.col("size")).alias("cold_tokens")), "source_path", "left")
    return cold.join(billed, "name").select("name", "header_tokens", "body_tokens", "cold_tokens")
