"""Source code to chunks, symbols and call edges, by scanners of top-level items.

No parser library is at hand, so each language has a scanner of its own: Python is read by
the standard ``ast``, and a file that it refuses by indentation, so one error costs its own item
only; the others blank out strings, regular expressions, here-documents and comments and then
follow brackets (Rust, TypeScript) or block words (Ruby).  A file without any item falls back to
plain text.  Scanning runs in ``mapInArrow``, a file at a time.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import CHUNKS
from .chunking import PLAIN, chunk_plain, extractor_id, id_of

_RUST_ITEM = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:(?:async|unsafe|const|extern(?:\s*\"[^\"]*\")?)\s+)*(fn|impl|struct|enum|type|const|trait|static|mod|macro_rules!)(?![\w])")
_TS_ITEM = re.compile(r"(?:export\b|(?:declare\s+|abstract\s+|async\s+)*(?:function|class|interface|enum|module|namespace)\b|(?:declare\s+)?type\s+\w+|declare\b)")
_RUBY_OPEN = re.compile(r"^(?:class|module|def)\b")
_RUBY_WORD = re.compile(r"(?<![\w.:@$])(class|module|def|do|if|unless|while|until|case|begin|for|end)(?![\w?!:])")
# Words that look like calls in Rust but are not.
_RUST_WORDS = set("if while for match return loop fn in as let mut ref move else unsafe where impl dyn struct enum union trait type use pub crate self Self super box await yield break continue".split())
_GENERIC = r"<[^<>;{}]*>"
for _ in range(5):  # levels of nesting
    _GENERIC = rf"<(?:[^<>;{{}}]|{_GENERIC})*>"
_RUST_CALL = re.compile(rf"(?<![\w#])((?:(?:r#)?[A-Za-z_]\w*\s*::\s*(?:{_GENERIC}\s*::\s*)?)*)((?:r#)?[A-Za-z_]\w*)(\s*!(?!=)\s*(?=[(\[{{])|(?:\s*::\s*{_GENERIC})?\s*\()")
_RAW_STRING = re.compile(r'b?r(#*)"')
_CHARACTER = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'")
# A slash begins a regular expression behind one of these, and not behind a value.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|if|unless|when|and|or|not|while|until|then))[ \t]*\Z")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PERCENT = re.compile(r"%[wWiIqQr]?([\[({<|!/])")
_HEREDOC = re.compile(r"<<[~-]?([\"'`]?)([A-Z_][A-Za-z0-9_]*)\1")
# Where a comment, a string or the like may begin; all that lies between is kept without a look at it.
_STARTS = {"rust": re.compile(r"[/\"']|b?r#*\""), "ts": re.compile(r"[/\"'`]"), "ruby": re.compile(r"[#=<%/\"']"), "here": re.compile(r"[#=<%/\"'\n]")}
_NESTED = re.compile(r"/\*|\*/")
_STRING_BODY = {c: re.compile(rf"[^{c}\\]*(?:\\[\s\S][^{c}\\]*)*") for c in "\"'`"}
_LINE_STRING = {c: re.compile(rf"{c}(?:\\[\s\S]|[^{c}\\\n])*{c}") for c in "\"'"}
_INSIDE = re.compile(r"[^\n]+")
_BRACKET = re.compile(r"[()\[\]{}]")
_ENDING = re.compile(r"[()\[\]{};]")
_SPACE, _WORD = re.compile(r"\s+"), re.compile(r"[\w$]+")
_RUST_HEAD, _RUST_NAME = re.compile(r"[{;]|\bwhere\b"), re.compile(r"\s*(?:mut\s+)?((?:r#)?[A-Za-z_]\w*)")
_RUST_FOR, _RUST_DEFINES = re.compile(r"\bfor\b"), re.compile(r"\b(?:fn|macro_rules!)$")
_RUBY_ENDLESS = re.compile(r"\s*def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s")
_RUBY_LOOP = re.compile(r"\s*(?:while|until|for)\b.*\bdo\b")
_PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">"}


def masked(text: str, language: str) -> str:
    """The text with the insides of comments and strings blanked, every other place kept."""
    out, kept, i, n, here = [], 0, 0, len(text), []
    while m := _STARTS["here" if here else language].search(text, i):
        i = m.start()
        c, two = text[i], text[i : i + 2]
        if language != "ruby" and two == "//" or language == "ruby" and c == "#" and (i == 0 or text[i - 1] != "\\"):
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif language != "ruby" and two == "/*":
            depth, end = 1, n
            for m in _NESTED.finditer(text, i + 2) if language == "rust" else ():
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    end = m.end()
                    break
            if language != "rust":
                end = text.find("*/", i + 2)
                end = n if end < 0 else end + 2
        elif language == "ruby" and text.startswith("=begin", i) and (i == 0 or text[i - 1] == "\n"):
            end = text.find("\n=end", i)
            end = n if end < 0 else end + 5
        elif here and c == "\n":  # the bodies of the here-documents of this line follow it
            end = i + 1
            for name in here:
                m = re.compile(rf"^[ \t]*{name}[ \t]*$", re.M).search(text, end)
                end = m.end() if m else n
            here = []
        elif language == "ruby" and two == "<<" and (m := _HEREDOC.match(text, i)):
            here.append(m[2])
            end = m.end()
        elif language == "ruby" and c == "%" and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "_)] ")  or text[i - 1] == " " and text[i + 1 : i + 2] != " ") and (m := _PERCENT.match(text, i)):
            close, depth, end = _PAIRS.get(m[1], m[1]), 1, m.end()
            while end < n and depth:
                if text[end] == "\\":
                    end += 1
                elif text[end] == close:
                    depth -= 1
                elif text[end] == m[1]:
                    depth += 1
                end += 1
        elif language != "rust" and c == "/" and _BEFORE_REGEX.search(text, max(0, i - 24), i) and (m := _REGEX.match(text, i)):
            end = m.end()
        elif language == "ts" and c in "\"'" and not _LINE_STRING[c].match(text, i):
            i += 1  # an apostrophe of JSX text: no string of this language goes over a line's end
            continue
        elif language == "rust" and (m := _RAW_STRING.match(text, i)) and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            end = text.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
        elif c == '"' or c == "'" and language != "rust" or c == "`" and language == "ts":
            end = _STRING_BODY[c].match(text, i + 1).end() + 1
        elif c == "'" and (m := _CHARACTER.match(text, i)):
            end = m.end()
        else:
            i += 1
            continue
        out += [text[kept:i], _INSIDE.sub(lambda x: " " * len(x[0]), text[i:end])]
        kept = i = min(end, n)
    out.append(text[kept:])
    return "".join(out)


def _close(mask: str, at: int) -> int:
    """The end of the item that goes on at ``at``: a ``;`` or a closed ``{}`` outside brackets."""
    depth = 0
    for m in _ENDING.finditer(mask, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0 and c == "}":
                return m.end()
        elif depth == 0:
            return m.end()
    return len(mask)


def _past(mask: str, at: int) -> int:
    """The end of the brackets that open from ``at`` on."""
    depth = 0
    for m in _BRACKET.finditer(mask, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.end()
    return len(mask)


def _with_lines_above(text: str, start: int, test) -> int:
    """``start`` moved up over the lines directly above for which ``test`` holds."""
    while start:
        above = text.rfind("\n", 0, start - 1) + 1
        if not test(text[above : start - 1].strip()):
            break
        start = above
    return start


def _items(text: str, mask: str, pattern: re.Pattern):
    """(start, end, match) of items at bracket depth 0 that begin a statement."""
    i, n, fresh = 0, len(mask), True
    while i < n:
        c = mask[i]
        if c.isspace():
            i = _SPACE.match(mask, i).end()
        elif fresh and (m := pattern.match(mask, i)):
            end = _close(mask, i)
            yield i, end, m
            i = end
        elif c == "#" and mask[i : i + 2] in ("#[", "#!"):
            depth = 0
            while i < n:
                depth += (mask[i] == "[") - (mask[i] == "]")
                i += 1
                if depth == 0 and mask[i - 1] == "]":
                    break
        elif c in "([{":
            i = _past(mask, i)
            fresh = True
        else:
            fresh = c in ";}" or (fresh and not (c.isalnum() or c in "_\"'"))
            i += 1
            if not fresh and mask[i - 1 : i + 1] != "" and (k := _WORD.match(mask, i - 1)):
                i = k.end()
            if "\n" in mask[i : i + 1]:
                fresh = True


def rust(text: str):
    mask = masked(text, "rust")
    for start, end, m in _items(text, mask, _RUST_ITEM):
        kind, rest = m[1], mask[m.end() : end]
        if kind == "impl":
            head = _RUST_HEAD.split(rest, maxsplit=1)[0]
            if head.lstrip().startswith("<"):
                depth, k = 0, head.index("<")
                for k in range(k, len(head)):  # noqa: B020
                    depth += (head[k] == "<") - (head[k] == ">" and head[k - 1] != "-")
                    if not depth:
                        break
                head = head[k + 1 :]
            symbol = _RUST_FOR.split(head)[-1].split("<")[0].strip() or None
        else:
            name = _RUST_NAME.match(rest)
            symbol = name[1] if name else None
        at = text.rfind("\n", 0, start) + 1
        first = _with_lines_above(text, at, lambda x: x.startswith("///")) if not text[at:start].strip() else at
        calls = []
        for c in _RUST_CALL.finditer(mask, m.end(), end):
            k = c.start()
            while k and mask[k - 1].isspace():
                k -= 1
            before = mask[max(0, k - 16) : k]  # enough for the words looked for
            if before.endswith(".") and not before.endswith("..") or c[2] in _RUST_WORDS or _RUST_DEFINES.search(before):
                continue
            calls.append((c[2], c.start(2), c.end(2)))
        yield (first if first < at else start), end, symbol, calls


def typescript(text: str):
    mask = masked(text, "ts")
    for start, end, _ in _items(text, mask, _TS_ITEM):
        if mask[end : end + 1] == ";":
            end += 1
        above = text[:start].rstrip(" \t")
        first = start
        if above.endswith("*/\n") and (k := above.rfind("/**")) >= 0 and above.find("*/", k) == len(above) - 3:
            first = k
        yield first, end, None, []


_PYTHON_ITEM = re.compile(r"(?:async[ \t]+def|def|class)[ \t]+\w+")
_PYTHON_STRING = re.compile(r"#[^\n]*|(\"\"\"|''')(?:\\[\s\S]|(?!\1)[\s\S])*(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")


def _python_by_indent(text: str):
    """Top-level items of a file with an error: from a decorator, def or class to the next line at the margin."""
    inside = lambda m: m[0][0].replace("#", " ") + "".join(c if c == "\n" else " " if m[0][0] == "#" else "\1" for c in m[0][1:])
    mask = _PYTHON_STRING.sub(inside, text)
    lines, at = [], 0
    for line in mask.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    start, item, end = None, False, 0
    for at, line in [*lines, (len(mask), "end")]:
        if not line.strip():
            continue
        if line[0] not in " \t\1":  # at the margin, and not in a string: what was open ends
            if item and _whole_head(mask[start:end]):
                yield start, end, None, []
            if not (line[0] == "@" or _PYTHON_ITEM.match(line)):
                start, item = None, False
                continue
            if item or start is None:
                start = at
            item = line[0] != "@"
        end = at + len(line.rstrip())


def _whole_head(own: str) -> bool:
    """Whether the head of an item is closed by a colon outside brackets, with a body behind it."""
    head = _PYTHON_ITEM.search(own)
    depth = 0
    for k in range(head.end(), len(own)):
        depth += (own[k] in "([{") - (own[k] in ")]}")
        if own[k] == ":" and not depth:
            return bool(own[k + 1 :].strip())
        if depth < 0:
            return False
    return False


def python(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield from _python_by_indent(text)
        return
    lines = [0]
    data = text.splitlines(keepends=True)
    for line in data:
        lines.append(lines[-1] + len(line))
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            end = lines[node.end_lineno - 1] + len(data[node.end_lineno - 1].encode()[: node.end_col_offset].decode())
            yield lines[top - 1], end, None, []


def ruby(text: str):
    mask = masked(text, "ruby")
    depth, start, at = 0, 0, 0
    for line in mask.splitlines(keepends=True):
        bare = line.strip()
        if not depth and _RUBY_OPEN.match(bare):
            start = at + line.index(bare[0])
        opened = depth > 0 or bool(_RUBY_OPEN.match(bare))
        for m in _RUBY_WORD.finditer(line):
            if m[1] == "end":
                depth -= bool(depth)
            elif m[1] in ("class", "module", "def", "do", "case", "begin", "for"):
                depth += opened and not (m[1] == "def" and _RUBY_ENDLESS.match(line[m.start() :]))
            else:  # a condition opens a block only at the start of a statement; a loop's own `do` is not another
                depth += opened and not line[: m.start()].strip(" \t=(")
        if depth and _RUBY_LOOP.match(line):
            depth -= 1
        at += len(line)
        if opened and not depth:
            end = at - (len(line) - len(line.rstrip()))
            line_start = text.rfind("\n", 0, start) + 1
            first = _with_lines_above(text, line_start, lambda x: x.startswith("#"))
            yield (first if first < line_start else start), end, None, []


_LANGUAGES = {"tree-sitter-rust-v1": rust, "tree-sitter-typescript-v1": typescript, "tree-sitter-tsx-v1": typescript, "tree-sitter-python-v1": python, "tree-sitter-ruby-v1": ruby}


_BREAK = re.compile("\n")


def _byte_starts(text: str):
    """The UTF-8 offset of each character and of the end."""
    if text.isascii():
        return range(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return [0, *np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).tolist()]


def scan(path: str, source_hash: str, text: str, extractor: str) -> list[dict]:
    """Chunk rows of one code file with their ``edges``; empty if it has no item."""
    starts = _byte_starts(text)
    breaks = [m.start() for m in _BREAK.finditer(text)]
    line = lambda i: bisect_right(breaks, i - 1) + 1
    span = lambda a, b: {"byte_start": starts[a], "byte_end": starts[b], "line_start": line(a), "line_end": line(b - 1 if b > a and text[b - 1] == "\n" else b)}
    rows = []
    for a, b, symbol, calls in _LANGUAGES[extractor](text):
        own = span(a, b)
        chunk_id = id_of(path, source_hash, own["byte_start"], own["byte_end"])
        edges = [{"src_chunk_id": chunk_id, "edge_type": "calls", "dst_symbol": name, "confidence": "extracted", **span(x, y)} for name, x, y in calls]
        rows.append({"id": chunk_id, "source_path": path, "source_hash": source_hash, **own, "text": text[a:b], "extractor": extractor, "symbol": symbol, "edges": edges})
    return rows


_EDGE = "struct<src_chunk_id:string,edge_type:string,dst_symbol:string,confidence:string,byte_start:bigint,byte_end:bigint,line_start:bigint,line_end:bigint>"


def extract(sources: DataFrame, plain: bool = True) -> DataFrame:
    """Chunks of sources (path, content_hash, text) with ``edges`` and ``fallback``, each by its path's extractor; not ``plain``: chunks of code alone, by one scan."""
    told = sources.select("path", "content_hash", "text").withColumn("extractor", extractor_id(F.col("path")))
    made = f"{CHUNKS}, edges array<{_EDGE}>"
    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], made).schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for path, source_hash, text, extractor in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    rows += scan(path, source_hash, text, extractor) or [{"source_path": path, "source_hash": source_hash, "text": text, "edges": []}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    scanned = told.where(F.col("extractor") != PLAIN).mapInArrow(run, made)
    code = scanned.where(F.col("id").isNotNull()).withColumn("fallback", F.lit(False))
    if not plain:
        return code
    fallen = scanned.where(F.col("id").isNull()).select(F.col("source_path").alias("path"), F.col("source_hash").alias("content_hash"), "text")
    none = F.array().cast(f"array<{_EDGE}>")
    unscanned = chunk_plain(told.where(F.col("extractor") == PLAIN).select("path", "content_hash", "text")).withColumns({"edges": none, "fallback": F.lit(False)})
    return code.unionByName(unscanned).unionByName(chunk_plain(fallen).withColumns({"edges": none, "fallback": F.lit(True)}))


def edges_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("edges").alias("e")).select("e.*")
