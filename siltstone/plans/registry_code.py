"""Registered queries of code extraction, code headers, sources and table upkeep, and their DuckDB SQL.

Source files are made inside the query: a template for each language, filled with the keys of a
table.  A template is told in pieces, so the SQL adds up the lengths of the pieces and knows nothing
of the scanners.  ``{k}`` stands for the key; a call's name is set between « and ».
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, headers, index, lexical, observe, vector
from ..sources.corpus import safe_relative
from ..sources.scan import dealt, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Piece:
    """A run of a template; one with a ``signature`` is an item."""

    text: str
    signature: str | None = None
    symbol: str | None = None
    synopsis: str | None = None


@dataclass(frozen=True)
class Template:
    table: str
    key: str
    suffix: str
    extractor: str
    pieces: tuple[Piece, ...]


_RUST = Template(
    "part", "p_partkey", ".rs", "tree-sitter-rust-v1",
    (
        Piece("use std::fmt;\n\n// helper_{k}(1) in a comment\n"),
        Piece(
            '/// Adds to part {k}.\n/// A second line.\npub fn add_{k}(a: i32) -> i32 {\n    let s = "fn fake() { }"; /* nested /* call_x() */ */\n'
            '    «helper_{k}»(a); other::«path_{k}»::<Vec<u8>>(s); self.method_{k}();\n    «println»!("é {}", s);\n    a\n}',
            "pub fn add_{k}(a: i32) -> i32", "add_{k}", "Adds to part {k}.",
        ),
        Piece("\n\n"),
        Piece("pub struct Part{k} {\n    id: u64,\n}", "pub struct Part{k}", "Part{k}"),
        Piece("\n"),
        Piece("impl<T> fmt::Display for Part{k} {\n    fn fmt(&self) { «draw_{k}»(self.id) }\n}", "impl<T> fmt::Display for Part{k}", "Part{k}"),
        Piece("\n\n/// Far away.\n\n"),
        Piece("const LIMIT_{k}: u32 = 7;", "const LIMIT_{k}: u32", "LIMIT_{k}"),
        Piece("\n"),
        Piece("macro_rules! m_{k} { () => {} }", "macro_rules! m_{k}", "m_{k}"),
        Piece("\n"),
    ),
)
_TSX = Template(
    "supplier", "s_suppkey", ".tsx", "tree-sitter-tsx-v1",
    (
        Piece("import a from 'b{k}';\n\n"),
        Piece("function greet_{k}(n: string): string {\n  return `Hi ${n} {`;\n}", "function greet_{k}(n: string): string"),
        Piece("\n\n"),
        Piece("/**\n * Holds supplier {k}.\n * More.\n */\nexport class Supplier{k} {\n  test(s: string) { return /[}\"]/.test(s); }\n}", "export class Supplier{k}", synopsis="Holds supplier {k}."),
        Piece("\n\n/** far */\n\n"),
        Piece('export type Kind{k} = "a" | "b";', "export type Kind{k}"),
        Piece("\n"),
        Piece("interface Shape{k} {\n  é: number;\n}", "interface Shape{k}"),
        Piece("\nconst late = 1;\n"),
    ),
)
_PYTHON = Template(
    "customer", "c_custkey", ".py", "tree-sitter-python-v1",
    (
        Piece('"""Module {k}."""\nimport os\n\nVALUE = {k}\n\n\n'),
        Piece('@deco({k})\nasync def é_{k}(a):\n    """\n    Doubles {k}.\n    """\n    return a', "@deco({k}) async def é_{k}(a):", synopsis="Doubles {k}."),
        Piece("\n\n\n"),
        Piece("class Customer{k}:\n    def m(self):\n        return 'class X: pass'", "class Customer{k}:"),
        Piece("\n\nif VALUE:\n    def hidden(): pass\n"),
    ),
)
_RUBY = Template(
    "orders", "o_orderkey", ".rb", "tree-sitter-ruby-v1",
    (
        Piece("require 'x{k}'\n\n"),
        Piece("# Greets {k}.\ndef greet_{k}(n)\n  if n then puts 'end' end\n  [1].each do |x|\n    y if x\n  end\nend", "# Greets {k}. def greet_{k}(n) if n then puts 'end' end [1].each do |x|"),
        Piece("\n\n# far\n\n"),
        Piece("module Order{k}\n  TEXT = <<~EOT\n    class end\n  EOT\n  def self.go; end\nend", "module Order{k} TEXT"),
        Piece("\n"),
    ),
)
#: A file without items: its paragraphs are chunks of plain text.
_BROKEN = Template("nation", "n_nationkey", ".py", "plain-text-v1", (Piece("def broken(:\n", "-"), Piece("\n"), Piece("words of é {k}\nand more", "-")))
TEMPLATES = (_RUST, _TSX, _PYTHON, _RUBY, _BROKEN)


def _plain(text: str) -> str:
    return text.replace("«", "").replace("»", "")


def _filled(text: str, key: str) -> str:
    """SQL of a template's text with the key in it."""
    quoted = text.replace("'", "''")
    return f"replace('{quoted}', '{{k}}', {key}::VARCHAR)" if "{k}" in text else f"'{quoted}'"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content_hash, text) of the made files."""
    made = None
    for t in TEMPLATES:
        key = F.col(t.key).cast("string")
        text = F.replace(F.lit("".join(_plain(p.text) for p in t.pieces)), F.lit("{k}"), key)
        keys = dealt(spark.read.parquet(f"{sf_dir}/{t.table}.parquet").select(t.key))
        own = keys.select(F.concat(F.lit(f"{t.table}/"), key, F.lit(t.suffix)).alias("path"), text.alias("text"))
        made = own if made is None else made.unionByName(own)
    return made.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text")


def _rows_sql(rows: Callable[[Template, str], list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM {t.table}" for t in TEMPLATES for columns in rows(t, t.key))


def _chunk_columns(t: Template, key: str) -> list[str]:
    out, before = [], ""
    whole = _filled("".join(_plain(p.text) for p in t.pieces), key)
    for p in t.pieces:
        text = _plain(p.text)
        if p.signature is not None:
            body = text + "\n" if t is _BROKEN and not text.endswith("\n") and p is not t.pieces[-1] else text
            first = before.count("\n") + 1
            last = first + body.count("\n") - body.endswith("\n")
            start, end = f"strlen({_filled(before, key)})" if before else "0", f"strlen({_filled(before + body, key)})"
            path = f"'{t.table}/' || {key} || '{t.suffix}'"
            symbol = _filled(p.symbol, key) if p.symbol else "NULL::VARCHAR"
            out.append(
                f"{path} AS source_path, '{t.extractor}' AS extractor, {start}::BIGINT AS byte_start, {end}::BIGINT AS byte_end, {first}::BIGINT AS line_start, {last}::BIGINT AS line_end, {symbol} AS symbol,"
                f" {_filled(body, key)} AS text, sha256({path} || chr(0) || sha256({whole}) || chr(0) || ({start})::VARCHAR || ':' || ({end})::VARCHAR) AS id"
            )
        before += text
    return out


def _edge_columns(t: Template, key: str) -> list[str]:
    out, before = [], ""
    for p in t.pieces:
        at = 0
        while t is _RUST and (at := p.text.find("«", at)) >= 0:
            end = p.text.index("»", at)
            lead, name = before + _plain(p.text[:at]), p.text[at + 1 : end]
            line = lead.count("\n") + 1
            out.append(
                f"'{t.table}/' || {key} || '{t.suffix}' AS source_path, {_filled(p.symbol, key)} AS caller, {_filled(name, key)} AS dst_symbol, strlen({_filled(lead, key)})::BIGINT AS byte_start, "
                f"strlen({_filled(lead + name, key)})::BIGINT AS byte_end, {line}::BIGINT AS line_start, {line}::BIGINT AS line_end, 'calls' AS edge_type, 'extracted' AS confidence"
            )
            at = end
        before += _plain(p.text)
    return out


def _header_columns(t: Template, key: str) -> list[str]:
    out, before = [], ""
    for p in t.pieces:
        if p.signature is not None and t is not _BROKEN:
            synopsis = p.synopsis or p.signature
            out.append(
                f"'{t.table}/' || {key} || '{t.suffix}' AS source_path, {'strlen(' + _filled(before, key) + ')' if before else 0}::BIGINT AS byte_start, {_filled(p.signature, key)} AS signature, "
                f"{_filled(synopsis, key) if p.synopsis else 'NULL::VARCHAR'} AS slim_synopsis, {_filled(synopsis, key)} AS synopsis"
            )
        before += _plain(p.text)
    return out


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@_query(_rows_sql(_chunk_columns))
def extract_code(spark, sf_dir):
    """Dispatch by suffix, all languages, the fallback and chunk ids."""
    return code.extract(_files(spark, sf_dir)).select("source_path", "extractor", "byte_start", "byte_end", "line_start", "line_end", "symbol", "text", "id")


@_query(" UNION ALL ".join(f"SELECT {c} FROM {_RUST.table}" for c in _edge_columns(_RUST, _RUST.key)))
def code_calls(spark, sf_dir):
    made = code.extract(_files(spark, sf_dir))
    caller = made.select(F.col("id").alias("src_chunk_id"), "source_path", F.col("symbol").alias("caller"))
    return code.edges_of(made).join(caller, "src_chunk_id").select("source_path", "caller", "dst_symbol", "byte_start", "byte_end", "line_start", "line_end", "edge_type", "confidence")


@_query(
    f"WITH h AS ({_rows_sql(_header_columns)}) SELECT source_path, byte_start, signature, synopsis, "
    "CASE WHEN signature IS NULL THEN synopsis END AS slim_synopsis FROM h"
)
def code_headers(spark, sf_dir):
    """Signatures, documentation lines and the tool answer, which has no synopsis beside a signature."""
    own = headers.with_headers(code.extract(_files(spark, sf_dir), plain=False))
    return own.select("source_path", "byte_start", "signature", "synopsis", headers.slim_synopsis().alias("slim_synopsis"))


# A second reading of the files of documents: bytes that are no UTF-8, other extractors, forced and plain.
_STATES = """second AS (
    SELECT doc_id, coalesce(source, '') || '/' || doc_id || '.txt' AS path, doc_id % 9 = 4 AS edited, doc_id % 5 = 2 AS bad, doc_id % 6 = 1 AS stored_by_other, doc_id % 4 <> 3 AS stored, doc_id % 8 <> 6 AS present FROM documents)"""


def _delta_sql(force: str) -> str:
    return f"""WITH {_STATES} SELECT path, CASE WHEN NOT present THEN 'removed' WHEN stored AND NOT {force} AND NOT edited AND NOT bad AND NOT stored_by_other THEN 'unchanged'
        WHEN bad AND stored THEN 'evicted' WHEN bad THEN 'rejected' ELSE 'indexed' END AS action FROM second WHERE stored OR present"""


def _delta(spark, sf_dir, force: bool) -> DataFrame:
    k = F.col("doc_id")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    base = docs.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), k.cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    old = index.hashed(base.where(k % 4 != 3)).select("path", "content_hash", F.when(k % 6 == 1, "other-v1").otherwise("plain-text-v1").alias("extractor"))
    edited = F.when(k % 5 == 2, F.concat("content", F.unhex(F.lit("C328")))).when(k % 9 == 4, F.concat("content", F.lit(" edited").cast("binary"))).otherwise(F.col("content"))
    new = index.decoded(index.hashed(base.where(k % 8 != 6).withColumn("content", edited))).withColumn("extractor", F.lit("plain-text-v1"))
    return index.delta(old, new, force).select("path", "action")


@_query(_delta_sql("false"))
def index_reject_evict(spark, sf_dir):
    """Content that is not UTF-8 is rejected, or evicted where it was stored; another extractor means a new reading."""
    return _delta(spark, sf_dir, False)


@_query(_delta_sql("true"))
def index_forced(spark, sf_dir):
    return _delta(spark, sf_dir, True)


@_query("""WITH old AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS model_id, embedding AS vector FROM embeddings WHERE vec_id % 5 <> 4),
new AS (SELECT vec_id AS chunk_id, 'a' AS model_id, embedding[2:] AS vector FROM embeddings WHERE vec_id % 2 = 0)
SELECT chunk_id, model_id, len(vector)::INT AS dimensions, list_sum(list_transform(vector, lambda x: floor(1000 * x::DOUBLE)))::BIGINT AS digest FROM (
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.chunk_id = old.chunk_id AND new.model_id = old.model_id))""")
def upsert_embeddings(spark, sf_dir):
    rows = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    old = rows.where("vec_id % 5 <> 4").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("model_id"), F.col("embedding").alias("vector"))
    new = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("a").alias("model_id"), F.slice("embedding", 2, 1000).alias("vector"))
    total = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, x: s + F.floor(F.lit(1000.0) * x.cast("double")))
    return vector.upserted(old, new).select("chunk_id", "model_id", F.size("vector").alias("dimensions"), total.alias("digest"))


@_query("""SELECT vec_id, CASE WHEN embedding IS NULL THEN false ELSE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 END AS valid FROM (
    SELECT vec_id, embedding, CASE vec_id % 7 WHEN 1 THEN embedding[1:63] WHEN 2 THEN list_append(embedding[1:63], 'nan'::FLOAT) WHEN 3 THEN list_append(embedding[1:63], 'inf'::FLOAT)
        WHEN 4 THEN list_append(embedding[1:63], NULL) ELSE embedding END AS v FROM embeddings)""")
def valid_embeddings(spark, sf_dir):
    k, v = F.col("vec_id") % 7, F.col("embedding")
    rows = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    end = lambda x: F.concat(F.slice(v, 1, 63), F.array(F.lit(x).cast("float")))
    made = F.when(k == 1, F.slice(v, 1, 63)).when(k == 2, end(float("nan"))).when(k == 3, end(float("inf"))).when(k == 4, end(None)).otherwise(v)
    return rows.select("vec_id", F.coalesce(vector.is_valid(made, 64), F.lit(False)).alias("valid"))


@_query("""WITH old AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'hashing-v1' ELSE 'old' END AS model_id FROM embeddings)
SELECT coalesce(source, '') || '/' || d.doc_id || '.txt' AS source_path, 'hashing-v1' AS model_id, 8 AS dimensions, o.chunk_id IS NOT NULL AS kept
FROM documents d LEFT JOIN old o ON o.chunk_id = d.doc_id AND o.model_id = 'hashing-v1'""")
def refresh_embeddings(spark, sf_dir):
    """Rows of other models and of gone chunks go, rows of the model stay, missing ones are made."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"))
    stored = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")).select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.when(F.col("vec_id") % 3 == 0, "hashing-v1").otherwise("old").alias("model_id"), F.lit(8).alias("dimensions"), F.array_repeat(F.lit(9.0).cast("float"), 8).alias("vector"),
    )
    made = vector.refreshed(chunks, stored, vector.HashingProvider(8))
    return made.join(chunks.select(F.col("id").alias("chunk_id"), "source_path"), "chunk_id").select("source_path", "model_id", "dimensions", (F.col("vector")[0] == 9).alias("kept"))


@_query("""WITH hits AS (SELECT b.item_id AS query_id, coalesce(source, '') || '/' || doc_id || '.txt' AS path, strlen(coalesce(d.text, '')) AS size FROM documents d JOIN benchmark b ON d.doc_id % 50 = b.item_id % 50)
SELECT query_id, CASE WHEN sum(size) // 4 > 0 THEN (sum(size) // 4)::BIGINT END AS cold_tokens FROM (SELECT DISTINCT * FROM hits) GROUP BY query_id""")
def cold_tokens(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    files = docs.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"))
    hits = files.join(items, F.col("doc_id") % 50 == F.col("query_id") % 50).select("query_id", F.col("path").alias("source_path"))
    return observe.cold_tokens(hits.unionByName(hits), files.select("path", "size"))  # a file counts once


_PATHS = ["a/b.txt", "../up", "/root", "a/../b", "a\\..\\b", "..", "a..b/c", "./a"]


@_query(
    "SELECT o_orderkey, p AS path, NOT starts_with(p, '/') AND NOT list_contains(string_split(replace(p, '\\', '/'), '/'), '..') AS safe FROM (SELECT o_orderkey, ["
    + ", ".join(f"'{p}'" for p in _PATHS) + f"][o_orderkey % {len(_PATHS)} + 1] AS p FROM orders)"
)
def safe_paths(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % len(_PATHS)).cast("int") + 1).alias("path"))

    def test(frames):
        for frame in frames:
            yield frame.assign(safe=[safe_relative(p) for p in frame["path"]])

    return rows.mapInPandas(test, "o_orderkey bigint, path string, safe boolean")


@_query("""WITH t AS (SELECT coalesce(source, '') || '/' || doc_id || '.txt' AS path, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS ts FROM documents
), p AS (SELECT path, len(ts) AS dl, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM t)
SELECT term, path, dl::INT AS dl, count(*) AS tf, min(pos)::INT AS first_position, sum(pos)::BIGINT AS positions_sum FROM p GROUP BY ALL""")
def index_postings(spark, sf_dir):
    """The inverted index that the store keeps."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    chunks = docs.select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = F.aggregate("positions", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return lexical.postings(chunks).select("term", F.col("id").alias("path"), "dl", F.size("positions").cast("bigint").alias("tf"), F.col("positions")[0].alias("first_position"), total.alias("positions_sum"))
