"""Corpora as sources: a directory read by Spark, or a table of documents."""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import InvalidRoot, PathOutsideRoot

VCS = {".git", ".hg", ".svn"}
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass
class _Rule:
    base: str
    pattern: re.Pattern
    keep: bool
    folders_only: bool


@dataclass
class Found:
    files: list[str] = field(default_factory=list)
    rejected: int = 0


def _rules(base: str, path: str) -> list[_Rule]:
    out = []
    with open(path, encoding="utf-8", errors="replace") as lines:
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            folders_only, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            translated = re.escape(line.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            if "[" in line:
                translated = fnmatch.translate(line.lstrip("/")).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
            out.append(_Rule(base, re.compile(("" if anchored else "(?:.*/)?") + translated + r"\Z"), keep, folders_only))
    return out


def _ignored(path: str, folder: bool, rules: list[_Rule]) -> bool:
    hit = False
    for rule in rules:
        if path.startswith(rule.base) and (folder or not rule.folders_only) and rule.pattern.match(path[len(rule.base) :]):
            hit = not rule.keep
    return hit


def excluded(path: str) -> bool:
    """Paths inside version control, and evaluation manifests (they hold the answers)."""
    parts = path.split("/")
    return bool(VCS & set(parts)) or (path.endswith(".json") and any(a == "fixtures" and b == "eval" for a, b in zip(parts, parts[1:], strict=False)))


def discover(root: str, own_files: tuple[str, ...] = ()) -> Found:
    """Relative paths of a directory's files, sorted.  Hidden files count, links are not followed.

    ``own_files``: absolute paths under which the engine itself writes; they are left out.
    """
    if not os.path.isdir(root):
        raise InvalidRoot(root)
    root, found = os.path.realpath(root), Found()
    own = tuple(os.path.realpath(p) for p in own_files)
    above, rules = os.path.dirname(root), []
    while True:  # rules of parents hold too, up to a repository's top
        rules = [r for name in IGNORE_FILES if os.path.isfile(p := os.path.join(above, name)) for r in _shifted(_rules("", p), above, root)] + rules
        if os.path.isdir(os.path.join(above, ".git")) or above == os.path.dirname(above):
            break
        above = os.path.dirname(above)

    def walk(folder: str, prefix: str, rules: list[_Rule]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            found.rejected += 1
            return
        here = rules + [r for name in (".git/info/exclude", *IGNORE_FILES) if os.path.isfile(p := os.path.join(folder, name)) for r in _rules(prefix, p)]
        for entry in entries:
            path = prefix + entry.name
            try:
                entry.name.encode()
            except UnicodeEncodeError:
                found.rejected += 1
                continue
            folder_here = entry.is_dir(follow_symlinks=False)
            if entry.is_symlink() or excluded(path) or _ignored(path, folder_here, here) or any(os.path.join(root, path) == o or os.path.join(root, path).startswith(o + "-") or os.path.join(root, path).startswith(o + "/") for o in own):
                continue
            if folder_here:
                walk(entry.path, path + "/", here)
            elif entry.is_file(follow_symlinks=False):
                found.files.append(path)

    walk(root, "", rules)
    found.files.sort()
    return found


def _shifted(rules: list[_Rule], above: str, root: str) -> list[_Rule]:
    """Rules of a parent folder, told for paths inside the root."""
    lead = os.path.relpath(root, above).replace(os.sep, "/") + "/"
    return [_Rule("", _Lead(lead, r.pattern), r.keep, r.folders_only) for r in rules]


class _Lead:
    def __init__(self, lead: str, pattern: re.Pattern) -> None:
        self.lead, self.pattern = lead, pattern

    def match(self, path: str):
        return self.pattern.match(self.lead + path)


def confined(root: str, path: str) -> str:
    """The relative form of ``path`` inside ``root``; ``\\`` becomes ``/``."""
    root = os.path.realpath(root)
    full = os.path.realpath(os.path.join(root, path))
    if full != root and not full.startswith(root + os.sep):
        raise PathOutsideRoot(path)
    return os.path.relpath(full, root).replace(os.sep, "/")


def safe_relative(path: str) -> bool:
    """A manifest path may neither be absolute nor climb."""
    return not os.path.isabs(path) and ".." not in path.replace("\\", "/").split("/")


def read_files(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """(path, content, size) of files below a root that the executors share."""
    schema = "path string, content binary, size bigint"
    if not files:
        return spark.createDataFrame([], schema)
    root = os.path.realpath(root)
    skipped = [f for f in files if os.path.basename(f)[0] in "._"]  # names that Spark's file listing leaves out
    listed = sorted(set(files) - set(skipped))
    made = spark.createDataFrame([], schema)
    if listed:
        rows = spark.read.format("binaryFile").load([f"file://{os.path.join(root, f)}" for f in listed])
        path = F.expr(f"substring(url_decode(regexp_replace(path, '[+]', '%2B')), {len('file:' + root) + 2})")
        made = rows.select(path.alias("path"), "content", F.col("length").alias("size"))
    if skipped:

        def opened(frames):
            for frame in frames:
                contents = []
                for name in frame["path"]:
                    with open(os.path.join(root, name), "rb") as file:
                        contents.append(file.read())
                yield frame.assign(content=contents, size=[len(c) for c in contents])

        made = made.unionByName(spark.createDataFrame([(f,) for f in skipped], "path string").mapInPandas(opened, schema))
    return made


def from_documents(documents: DataFrame) -> DataFrame:
    """(path, content_hash, text, size) of a table of documents; a row is the file source/doc_id.txt."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    return documents.select(path.alias("path"), F.sha2(text.cast("binary"), 256).alias("content_hash"), text.alias("text"), F.octet_length(text).cast("bigint").alias("size"))
