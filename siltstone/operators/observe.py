"""The activity log: lines of ``YYYY-MM-DD HH:MM:SS  tool  detail`` as rows, and what they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of the recent-events view.
RECENT_KINDS = ("find", "retrieve", "find_related", "list_corpora")


def number_after(line: Column, key: str) -> Column:
    """The digits after ``key=``; null without them."""
    return F.nullif(F.regexp_extract(line, key + r"=(\d+)", 1), F.lit("")).cast("bigint")


def parsed(lines: DataFrame) -> DataFrame:
    """(line_no, logged_at, kind, failed, actual_tokens, cold_tokens, value) of rows (line_no, value)."""
    v = F.col("value")
    return lines.select(
        "line_no", F.regexp_extract(v, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)  ", 1).alias("logged_at"), F.regexp_extract(v, r"^\S+ \S+  (serve start|\S+)", 1).alias("kind"),
        v.contains("status=error").alias("failed"), number_after(v, "actual_tok").alias("actual_tokens"), number_after(v, "cold_tok").alias("cold_tokens"), "value",
    )


def stats(log: DataFrame) -> DataFrame:
    """One row: finds, actual_tokens, cold_tokens, ratio of the successful finds."""
    own = log.where((F.col("kind") == "find") & ~F.col("failed"))
    row = own.agg(F.count(F.lit(1)).alias("finds"), F.coalesce(F.sum("actual_tokens"), F.lit(0)).alias("actual_tokens"), F.coalesce(F.sum("cold_tokens"), F.lit(0)).alias("cold_tokens"))
    return row.withColumn("ratio", F.round(F.col("cold_tokens") / F.nullif(F.col("actual_tokens"), F.lit(0)), 6))


def recent(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of the view's kinds, in order."""
    return log.where(F.col("kind").isin(*RECENT_KINDS)).orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def last_serve(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind") == "serve start").agg(F.max("logged_at").alias("last_serve"))


def cold_tokens(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, cold_tokens): bytes of the distinct files hit, over four; null if 0."""
    own = hits.select("query_id", F.col("source_path").alias("path")).distinct().join(sources.select("path", "size"), "path")
    return own.groupBy("query_id").agg(F.nullif(F.floor(F.sum("size") / 4).cast("bigint"), F.lit(0)).alias("cold_tokens"))


def utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def audit_line(at: Column, kind: Column, detail: Column) -> Column:
    """A log line: the kind is padded to twelve characters."""
    return F.concat(at, F.lit("  "), F.rpad(kind, 12, " "), F.lit(" "), detail)
