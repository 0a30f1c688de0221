"""The activity log's writer: one line for each event, rotated by size, never in a search's way."""

from __future__ import annotations

import contextlib
import os
from datetime import UTC, datetime

MAX_BYTES = 10 * 1024 * 1024


def line(kind: str, detail: str, at: datetime | None = None) -> str:
    return f"{(at or datetime.now(UTC)).strftime('%Y-%m-%d %H:%M:%S')}  {kind:<12} {detail}\n"


def append(path: str, kind: str, detail: str) -> None:
    """Best effort: a log that cannot be written is no error."""
    with contextlib.suppress(OSError):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        if os.path.exists(path) and os.path.getsize(path) >= MAX_BYTES:
            os.replace(path, path + ".1")
        with open(path, "a") as out:
            out.write(line(kind, detail))


def found(path: str, query: str, results: int, actual_tokens: int, cold_tokens: int | None) -> None:
    saved = f"  ~{cold_tokens / actual_tokens:.1f}x saved" if cold_tokens and actual_tokens else ""
    append(path, "find", f'q="{query}"  results={results}  actual_tok={actual_tokens}' + (f"  cold_tok={cold_tokens}" if cold_tokens else "") + saved)


def retrieved(path: str, chunk_id: str, source_path: str) -> None:
    append(path, "retrieve", f"chunk={chunk_id}  path={source_path}")


def related(path: str, symbol: str, direction: str, results: int) -> None:
    append(path, "find_related", f'symbol="{symbol}"  direction={direction}  results={results}')


def served(path: str, model: str | None, embeddings: str) -> None:
    append(path, "serve start", f"model={model or 'none'}  embeddings={embeddings}")


def listed(path: str, count: int) -> None:
    append(path, "list_corpora", f"count={count}")


def failed(path: str, kind: str, detail: str, message: str) -> None:
    append(path, kind, f'{detail}  status=error  msg="{message}"')
