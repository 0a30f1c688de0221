"""Evaluation manifests, activity logs and corpus registries."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import InvalidName

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*\Z")
_MANIFEST = "limit int, cases array<struct<name:string,query:string,expected:array<struct<source_path:string,contains:string>>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(limit, name, query, expected), one row for each case."""
    return spark.read.schema(_MANIFEST).json(path, multiLine=True).select("limit", F.explode("cases").alias("c")).select("limit", "c.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a log's lines, in order of file, place and line."""
    at = F.monotonically_increasing_id()  # the split in the upper bits, the line in it in the lower 33
    lines = spark.read.text(path).withColumn("at", at).select("value", F.shiftright("at", 33).alias("split"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    # One row for each split.
    before = F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(splits, "split").select((F.col("before") + F.col("place") + 1).alias("line_no"), "value")


def check_name(name: str) -> str:
    if not _NAME.match(name):
        raise InvalidName(name)
    return name


def set_profile(folder: str, name: str, root: str, **more) -> None:
    """Write a registry entry; a reader sees the old or the new one, never a part."""
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as out:
        json.dump({"name": check_name(name), "root": os.path.realpath(root), **more}, out)
    os.replace(part, os.path.join(folder, f"{name}.json"))


def remove_profile(folder: str, name: str) -> bool:
    try:
        os.remove(os.path.join(folder, f"{check_name(name)}.json"))
    except FileNotFoundError:
        return False
    return True


def profiles(folder: str) -> list[dict]:
    if not os.path.isdir(folder):
        return []
    out = []
    for file in sorted(os.listdir(folder)):
        if file.endswith(".json"):
            with open(os.path.join(folder, file)) as entry:
                out.append(json.load(entry))
    return out


def infer_profile(folder: str, cwd: str) -> dict | None:
    """The registered corpus with the deepest root that holds ``cwd``."""
    cwd = os.path.realpath(cwd)
    inside = [p for p in profiles(folder) if cwd == p["root"] or cwd.startswith(p["root"].rstrip(os.sep) + os.sep)]
    return max(inside, key=lambda p: (len(p["root"]), p["name"]), default=None)


def resolve_corpus(folder: str, explicit: str | None = None, cwd: str | None = None, fallback: str | None = None) -> dict | None:
    """Explicit name, then the root around ``cwd``, then the fallback, then the only one; None asks for a name."""
    known = {p["name"]: p for p in profiles(folder)}
    if explicit:
        return known.get(explicit)
    if cwd and (found := infer_profile(folder, cwd)):
        return found
    if fallback and fallback in known:
        return known[fallback]
    return next(iter(known.values())) if len(known) == 1 else None


def project_config(start: str, name: str = ".siltstone/config.toml") -> str | None:
    """The nearest project file at or above a folder."""
    at = os.path.realpath(start)
    while True:
        if os.path.isfile(path := os.path.join(at, name)):
            return path
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)
