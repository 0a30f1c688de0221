"""Plain text to chunks: paragraphs, cut at ``MAX_BYTES``, with byte and line spans.

One linear pass over each source, in Arrow batches: a source is chunked inside its own row, so no
shuffle is needed.  A paragraph is a run of lines that are not blank; its span includes the
end of its last line.  A longer one is packed greedily from pieces that end in white space;
a piece that is too long alone is cut at the last character that fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import CHUNKS

MAX_BYTES = 2048
PLAIN = "plain-text-v1"
#: White space of blank lines and of pieces.
_SPACE = " \t\n\x0b\f\r"
_PIECE = re.compile(r"\S*\s|\S+", re.A)
_ROWS = 256


def extractor_id(path: Column) -> Column:
    by_suffix = {".rs": "rust", ".ts": "typescript", ".tsx": "tsx", ".py": "python", ".rb": "ruby"}
    out = None
    for suffix, name in by_suffix.items():
        test = path.endswith(suffix)
        out = F.when(test, f"tree-sitter-{name}-v1") if out is None else out.when(test, f"tree-sitter-{name}-v1")
    return out.otherwise(PLAIN)


def chunk_id(path: Column, source_hash: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws("\0", path, source_hash, F.concat_ws(":", start.cast("string"), end.cast("string"))), 256)


def id_of(path: str, source_hash: str, start: int, end: int) -> str:
    """``chunk_id`` of one chunk."""
    return hashlib.sha256(f"{path}\0{source_hash}\0{start}:{end}".encode("utf-8", "surrogatepass")).hexdigest()


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    """(byte start, lines before, text) of runs of lines that are not blank."""
    at, line, start, first, held = 0, 0, 0, 0, []
    for own in text.split("\n"):
        end = own + "\n"
        if own.strip(_SPACE):
            if not held:
                start, first = at, line
            held.append(end)
        elif held:
            yield start, first, "".join(held)
            held = []
        at, line = at + n_bytes(end), line + 1
    if held:  # the last line has no end of its own
        yield start, first, "".join(held)[:-1]


def _cut(piece: str, limit: int) -> Iterator[str]:
    """A piece in runs of at most ``limit`` bytes, cut between characters."""
    held, size = [], 0
    for c in piece:
        n = n_bytes(c)
        if size + n > limit:
            yield "".join(held)
            held, size = [], 0
        held.append(c)
        size += n
    yield "".join(held)


def packed(text: str, limit: int = MAX_BYTES) -> Iterator[str]:
    """The text in order, each part at most ``limit`` bytes, cut after white space where possible."""
    if n_bytes(text) <= limit:
        yield text
        return
    held, size = [], 0
    for m in _PIECE.finditer(text):
        whole = n_bytes(m[0])
        for part in (m[0],) if whole <= limit else _cut(m[0], limit):
            n = n_bytes(part)
            if held and size + n > limit:
                yield "".join(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield "".join(held)


def spans(text: str) -> Iterator[tuple[int, int, int, int, str]]:
    """(byte start, byte end, first line, last line, text) of the chunks of a source; lines count from 1."""
    for start, lines, paragraph in paragraphs(text):
        for part in packed(paragraph):
            end, breaks = start + n_bytes(part), part.count("\n")
            yield start, end, lines + 1, lines + 1 + breaks - part.endswith("\n"), part
            start, lines = end, lines + breaks


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def chunk_plain(sources: DataFrame) -> DataFrame:
    """Chunks of sources (path, content_hash, text), all read as plain text; a null text has none."""
    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], CHUNKS).schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = []
                for path, source_hash, text in zip(*(c.to_pylist() for c in batch.slice(at, _ROWS).columns), strict=True):
                    rows += [(id_of(path, source_hash, a, b), path, source_hash, a, b, c, d, part, PLAIN, None) for a, b, c, d, part in spans(text or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return sources.select("path", "content_hash", "text").mapInArrow(run, CHUNKS)
