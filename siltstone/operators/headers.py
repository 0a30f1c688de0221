"""Result headers without bodies, and the byte budget of a result."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import InvalidLimit

MAX_CHARS = 240
MAX_LIMIT = 50
BYTE_BUDGET = 32 * 1024
OVERHEAD = 160


def capped_limit(limit: int) -> int:
    if limit < 1:
        raise InvalidLimit(f"limit {limit}")
    return min(limit, MAX_LIMIT)


def trimmed(text: Column) -> Column:
    return F.when(F.length(text) > MAX_CHARS, F.concat(F.left(text, F.lit(MAX_CHARS)), F.lit("..."))).otherwise(text)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))


def signature(text: Column) -> Column:
    """The declaration line of a code chunk: up to four lines, comments and attributes skipped, cut at the first ``{`` or ``=``."""
    noise = lambda x: reduce(or_, (x.startswith(s) for s in ("//", "#[", "/*", "*", '"""', "'''")), x == "")
    own = F.filter(_lines(text), lambda x: ~noise(x))
    ends = lambda x: x.contains("{") | x.endswith(";") | x.contains(" = ") | x.endswith(":")
    state = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        parts = F.when(acc["done"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(x)))
        return F.struct((acc["done"] | ends(x) | (F.size(parts) >= 4)).alias("done"), parts.alias("parts"))

    joined = F.aggregate(own, state, step, lambda acc: F.array_join(acc["parts"], " "))
    return trimmed(F.trim(F.regexp_extract(joined, r"^[^{=]*", 0)))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x != ""), F.lit(0))


def doc_line(extractor: Column, text: Column) -> Column:
    """The first documentation line by the language's convention; null if there is none."""
    lines = _lines(text)
    rust = _first(F.transform(F.filter(lines, lambda x: x.startswith("///")), lambda x: F.trim(F.substring(x, 4, 1 << 30))))
    block = F.regexp_extract(text, r"^\s*/\*\*([\s\S]*?)(\*/|$)", 1)
    jsdoc = F.when(text.rlike(r"^\s*/\*\*"), _first(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", "")))))
    double = F.regexp_extract(text, r'(?m)^\s*"""([\s\S]*?)("""|\z)', 1)
    single = F.regexp_extract(text, r"(?m)^\s*'''([\s\S]*?)('''|\z)", 1)
    python = _first(_lines(F.when(text.rlike(r'(?m)^\s*"""'), double).otherwise(single)))
    by = F.when(extractor.contains("rust"), rust).when(extractor.contains("typescript") | extractor.contains("tsx"), jsdoc).when(extractor.contains("python"), python)
    return trimmed(by)


def with_headers(hits: DataFrame) -> DataFrame:
    """Adds ``signature`` (code only) and ``synopsis``."""
    code = F.col("extractor").startswith("tree-sitter-")
    # One after the other, so a signature is made once.
    signed = hits.withColumn("signature", F.when(code, signature(F.col("text"))))
    doc = doc_line(F.col("extractor"), F.col("text"))
    return signed.withColumn("synopsis", F.when(code, F.coalesce(doc, F.col("signature"))).otherwise(trimmed(T.first_line(F.col("text")))))


def header_bytes() -> Column:
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (size("id") + size("source_path") + size("source_hash") + size("extractor") + size("signature") + size("synopsis") + OVERHEAD).cast("bigint")


def budgeted(hits: DataFrame, budget: int = BYTE_BUDGET) -> DataFrame:
    """Headers of each query in rank order while their bytes stay within the budget; the first always stays.  Bodies go."""
    sized = with_headers(hits).withColumn("header_bytes", header_bytes())
    total = F.sum("header_bytes").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("bytes_so_far", total).where((F.col("rank") == 1) | (F.col("bytes_so_far") <= budget)).drop("text")


def slim_synopsis() -> Column:
    return F.when(F.col("signature").isNull(), F.col("synopsis"))


def slim(headers: DataFrame) -> DataFrame:
    """The tool answer: no hash, extractor or byte offsets; no synopsis beside a signature."""
    dropped = headers.drop("source_hash", "extractor", "byte_start", "byte_end", "header_bytes", "bytes_so_far")
    return dropped.withColumn("synopsis", slim_synopsis())


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
