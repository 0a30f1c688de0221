"""Registered queries of the retrieval engine over the test tables, and their DuckDB SQL.

A document stands for the file ``source/doc_id.txt``; in the search queries it is one chunk.
Benchmark items are the table of queries, whole texts.  Scores are rounded to six places and
ranked as rounded in both engines, and every order ends in the total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluate, graph, headers, hybrid, index, lexical, observe, retrieve, vector
from ..sources.corpus import from_documents
from ..sources.scan import spread
from . import registry_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _sources(spark, sf_dir) -> DataFrame:
    return from_documents(_t(spark, sf_dir, "documents"))


def _chunks(spark, sf_dir) -> DataFrame:
    """Each document as one chunk."""
    s = _sources(spark, sf_dir)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return s.select(
        chunking.chunk_id(F.col("path"), F.col("content_hash"), zero, F.col("size")).alias("id"), F.col("path").alias("source_path"), F.col("content_hash").alias("source_hash"),
        zero.alias("byte_start"), F.col("size").alias("byte_end"), one.alias("line_start"), (chunking.newlines(F.col("text")) + 1).cast("bigint").alias("line_end"), "text",
        F.lit(chunking.PLAIN).alias("extractor"), F.lit(None).cast("string").alias("symbol"),
    )


def _items(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# SQL parts.  The corpus, BM25 and the reranker, as common table expressions.
_DOCS = """docs AS (
    SELECT coalesce(source, '') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS hash, strlen(coalesce(text, '')) AS size, doc_id
    FROM documents)"""
_BM25 = f"""{_DOCS}, terms AS (
    SELECT path, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS ts FROM docs
), tf AS (
    SELECT path, term, count(*) AS f, any_value(dl) AS dl FROM (SELECT path, len(ts) AS dl, unnest(ts) AS term FROM terms) GROUP BY path, term
), stat AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM terms
), qt AS (
    SELECT DISTINCT item_id AS query_id, token, strip_accents(token) AS term
    FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark)
), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term
), bm AS (
    SELECT query_id, path, round(sum(greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term), stat GROUP BY query_id, path)"""
_RERANK = f"""{_BM25}, cand AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS r FROM bm) WHERE r <= {{candidates}}
), q AS (
    SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS qs, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS raw FROM benchmark
), q2 AS (
    SELECT query_id, qs, list_distinct(qs) AS uq,
        list_distinct([lower(x) FOR x IN raw IF contains(x, '_') OR (regexp_matches(x, '^.[\\s\\S]*\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}')) OR (strlen(x) > 1 AND regexp_full_match(x, '[\\p{{Lu}}0-9]+'))]) AS sym FROM q
), scored AS (
    SELECT c.query_id, c.path, d.text,
        contains(' ' || array_to_string(d.ts, ' ') || ' ', ' ' || array_to_string(qs, ' ') || ' ')::INT AS phrase,
        len(list_intersect(uq, d.ts)) AS coverage, len(list_intersect(sym, d.head)) AS sig, len(uq) AS nq, c.score AS s
    FROM cand c JOIN (
        SELECT path, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ts,
            regexp_extract_all(lower(coalesce([trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''][1], '')), '[\\p{{L}}\\p{{N}}_]+') AS head FROM docs
    ) d USING (path) JOIN q2 USING (query_id)
), rr AS (
    SELECT *, round(2 * phrase + coverage / nq + sig / nq + s / (1 + abs(s)), 6) AS score FROM scored
), rk AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, coverage DESC, score DESC, path) AS r0 FROM rr
), dd AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY r0) AS nth FROM rk
), hits AS (
    SELECT query_id, path, text, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r0)::INT AS rank FROM dd WHERE nth = 1) WHERE rank <= {{limit}})"""


def _rerank_sql(limit: int) -> str:
    return "WITH RECURSIVE " + _RERANK.replace("{candidates}", str(lexical.rerank_candidates(limit))).replace("{limit}", str(limit))


@_query(f"WITH {_DOCS} SELECT path, hash AS content_hash, 'plain-text-v1' AS extractor, size::BIGINT AS size FROM docs")
def corpus_sources(spark, sf_dir):
    return _sources(spark, sf_dir).select("path", "content_hash", chunking.extractor_id(F.col("path")).alias("extractor"), "size")


@_query(f"""WITH RECURSIVE {_DOCS}, pieces AS (
    SELECT path, text, regexp_extract_all(text, '\\S*\\s|\\S+') AS ps FROM docs WHERE regexp_matches(text, '\\S')
), sums AS (
    SELECT path, text, ps, list_transform(ps, lambda p, i: list_sum(list_transform(ps[1:i], lambda x: strlen(x)))) AS cum FROM pieces WHERE strlen(text) > 2048
), cut AS (
    SELECT path, 0::BIGINT AS a, len(list_filter(cum, lambda c: c <= 2048)) AS k, cum, text FROM sums
    UNION ALL
    SELECT path, cum[k]::BIGINT, len(list_filter(cum, lambda c: c <= cum[k] + 2048)), cum, text FROM cut WHERE k < len(cum)
), spans AS (
    SELECT path, a AS byte_start, cum[k]::BIGINT AS byte_end, text FROM cut UNION ALL SELECT path, 0, strlen(text), text FROM pieces WHERE strlen(text) <= 2048
), told AS (
    SELECT *, decode(encode(text)[1:byte_start]) AS before, decode(encode(text)[byte_start + 1:byte_end]) AS body FROM spans
)
SELECT path AS source_path, byte_start, byte_end::BIGINT AS byte_end, (len(before) - len(replace(before, chr(10), '')) + 1)::BIGINT AS line_start,
    (len(before) - len(replace(before, chr(10), '')) + 1 + len(body) - len(replace(body, chr(10), '')) - CASE WHEN suffix(body, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS line_end, body AS text FROM told""")
def chunk_plain(spark, sf_dir):
    return chunking.chunk_plain(_sources(spark, sf_dir)).select("source_path", "byte_start", "byte_end", "line_start", "line_end", "text")


@_query(f"""WITH {_DOCS}, t AS (SELECT path, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ts FROM docs)
SELECT path, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_unique FROM t""")
def tokenize_stats(spark, sf_dir):
    own = _sources(spark, sf_dir).select("path", T.tokens(F.col("text")).alias("ts"))
    return own.select("path", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_unique"))


@_query(f"""WITH {_DOCS}, m AS (
    SELECT item_id AS query_id, path, ((len(lower(d.text)) - len(replace(lower(d.text), lower(trim(b.text)), ''))) / len(lower(trim(b.text))))::DOUBLE AS score
    FROM docs d JOIN benchmark b ON contains(lower(d.text), lower(trim(b.text))))
SELECT query_id, rank::INT AS rank, path AS source_path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM m) WHERE rank <= 10""")
def find_substring(spark, sf_dir):
    return lexical.find_substring(_chunks(spark, sf_dir), _items(spark, sf_dir)).select("query_id", "rank", "source_path", "score")


@_query(f"""WITH {_BM25} SELECT query_id, rank::INT AS rank, path AS source_path, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM bm) WHERE rank <= 10""")
def find_bm25(spark, sf_dir):
    return lexical.find_bm25(_chunks(spark, sf_dir), _items(spark, sf_dir)).select("query_id", "rank", "source_path", "score")


@_query(_rerank_sql(10) + " SELECT query_id, rank, path AS source_path, score FROM hits")
def find_reranked(spark, sf_dir):
    return lexical.find_reranked(_chunks(spark, sf_dir), _items(spark, sf_dir)).select("query_id", "rank", "source_path", "score")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@_query(f"""WITH t AS (
    SELECT item_id, [x FOR x IN list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda y: regexp_replace(y, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) IF x <> ''] AS ts FROM benchmark
), c AS (
    SELECT item_id, len(ts) AS n, len([x FOR x IN ts IF lower(x) IN ({_STOP})]) AS stop,
        len([x FOR x IN ts IF contains(x, '_') OR contains(x, '::') OR (regexp_matches(x, '^.[\\s\\S]*\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}')) OR (strlen(x) > 1 AND regexp_full_match(x, '[\\p{{Lu}}0-9]+'))]) AS ident FROM t
)
SELECT item_id AS query_id, CASE WHEN stop >= 2 THEN 'natural' WHEN ident >= 1 AND stop = 0 THEN 'symbol' WHEN n >= 6 AND stop >= 1 THEN 'natural' ELSE 'symbol' END AS query_class FROM c""")
def classify_query(spark, sf_dir):
    return _items(spark, sf_dir).select("query_id", T.query_class(F.col("query")).alias("query_class"))


_VECTORS = """vs AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"""


@_query(f"""WITH {_VECTORS}, s AS (
    SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(d.v, q.v), 6) AS score FROM vs q JOIN vs d ON q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def find_vector(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").where("embedding is not null")
    slim = rows.select(F.lit("").alias("source_path"), F.col("vec_id").alias("byte_start"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    return vector.score_vectors(slim, asked, 10).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def missing_embeddings(spark, sf_dir):
    stored = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model_id"))
    return vector.missing(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), stored, "m").select(F.col("id").alias("doc_id"))


@_query("""SELECT 'label-' || label AS model_id, count(*) AS embeddings, max(len(embedding))::INT AS dimensions, sum(len(embedding) * 4)::BIGINT AS storage_bytes FROM embeddings GROUP BY label""")
def embedding_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("model_id"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"))
    return vector.stats(rows)


def _hybrid_sql(profiles: str) -> str:
    return (
        _rerank_sql(hybrid.candidate_limit(10))
        + f""", {_VECTORS}, near AS (
    SELECT * FROM (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (
        SELECT b.item_id AS query_id, d.path, round(list_cosine_similarity(x.v, q.v), 6) AS score
        FROM benchmark b JOIN vs q ON q.vec_id = b.item_id CROSS JOIN vs x JOIN docs d ON d.doc_id = x.vec_id)) WHERE rank <= {hybrid.candidate_limit(10)}
), prof AS ({profiles}
), strong AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN score END) AS best FROM hits GROUP BY query_id
), told AS (SELECT p.*, coalesce(n >= 10 AND best >= shortcut, false) AS short FROM prof p LEFT JOIN strong USING (query_id)
), both_ AS (
    SELECT query_id, path, h.score AS ls, h.rank AS lr, v.score AS cs, v.rank AS vr FROM hits h FULL OUTER JOIN near v USING (query_id, path)
), sc AS (
    SELECT b.*, t.short, NOT short AND lr IS NOT NULL AND lr <= least(10, protected) AS pin,
        round(CASE WHEN short THEN ls WHEN lr <= least(10, protected) THEN 10 + 1.0::DOUBLE / lr
            ELSE coalesce(1.0::DOUBLE / lr, 0) + coalesce(vector_weight * least(1.0, greatest(0.0, (cs + 1) / 2)), 0) END, 6) AS score
    FROM both_ b JOIN told t USING (query_id) WHERE NOT short OR lr IS NOT NULL
), o AS (
    SELECT sc.*, d.text, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN short THEN lr END NULLS LAST, pin DESC, score DESC, lr NULLS LAST, vr NULLS LAST, path) AS r0 FROM sc JOIN docs d USING (path)
), o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY r0) AS nth FROM o)
SELECT query_id, rank, path AS source_path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r0)::INT AS rank FROM o2 WHERE nth = 1) WHERE rank <= 10"""
    )


def _hybrid(spark, sf_dir, profile: str | None) -> DataFrame:
    from .engine import profiles_of

    many = hybrid.candidate_limit(10)
    chunks, items = _chunks(spark, sf_dir), _items(spark, sf_dir)
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"))
    stored = _t(spark, sf_dir, "embeddings").where("embedding is not null")
    slim = stored.join(docs, stored["vec_id"] == docs["doc_id"]).join(chunks.select("id", "source_path"), "source_path").select("id", "source_path", F.lit(0).cast("bigint").alias("byte_start"), F.col("embedding").alias("vector"))
    asked = stored.join(items, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").cast("array<double>").alias("query_vector"))
    own = lexical.find_reranked(chunks, items, many).select("query_id", "id", "score", "rank")
    near = vector.score_vectors(slim, asked, many).select("query_id", "id", "score", "rank")
    return hybrid.blend(own, near, chunks, profiles_of(items, profile), 10).select("query_id", "rank", "source_path", "score")


def _profile_row(p: hybrid.Profile) -> str:
    return f"{p.protected} AS protected, {p.vector_weight}::DOUBLE AS vector_weight, {'NULL' if p.shortcut is None else p.shortcut}::DOUBLE AS shortcut"


def _add_hybrids() -> None:
    for name in hybrid.PROFILES:
        QUERIES[f"find_hybrid_{name}"] = lambda spark, sf_dir, name=name: _hybrid(spark, sf_dir, name)
        ORACLES[f"find_hybrid_{name}"] = _hybrid_sql(f"SELECT item_id AS query_id, {_profile_row(hybrid.PROFILES[name])} FROM benchmark")
    QUERIES["find_routed"] = lambda spark, sf_dir: _hybrid(spark, sf_dir, None)
    routed = " UNION ALL ".join(
        f"SELECT query_id, {_profile_row(hybrid.ROUTES[c])} FROM ({ORACLES['classify_query']}) WHERE query_class = '{c}'" for c in ("natural", "symbol")
    )
    ORACLES["find_routed"] = _hybrid_sql(routed)


_add_hybrids()


# The call graph: an order is a chunk that calls the names of its items' parts and suppliers.
def _graph(spark, sf_dir, with_parts: bool):
    zero = F.lit(0).cast("bigint")
    row = lambda df, key, path, symbol: df.select(F.concat(F.lit(path), F.col(key).cast("string")).alias("id"), F.lit(path).alias("source_path"), F.col(key).cast("bigint").alias("byte_start"), symbol.alias("symbol"))
    part, supplier, orders, items = (_t(spark, sf_dir, n) for n in ("part", "supplier", "orders", "lineitem"))
    chunks = row(part, "p_partkey", "part/", F.col("p_name")).unionByName(row(supplier, "s_suppkey", "supplier/", F.col("s_name"))).unionByName(row(orders, "o_orderkey", "order/", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))))
    site = [F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("src_chunk_id"), F.col("l_linenumber").cast("bigint").alias("byte_start"), F.col("l_linenumber").cast("bigint").alias("byte_end"), zero.alias("line_start"), zero.alias("line_end")]
    edges = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(*site, F.col("s_name").alias("dst_symbol"))
    if with_parts:
        edges = edges.unionByName(items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(*site, F.col("p_name").alias("dst_symbol")))
    return chunks, edges


_GRAPH = """chunks AS (
    SELECT 'part/' AS path, p_partkey AS a, p_name AS symbol FROM part UNION ALL SELECT 'supplier/', s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'order/', o_orderkey, 'order_' || o_orderkey FROM orders
), defs AS (SELECT symbol, count(*) AS definition_count FROM chunks GROUP BY symbol)"""


@_query(f"""WITH {_GRAPH}, e AS (
    SELECT l_orderkey AS o, l_linenumber AS site, s_name AS symbol FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    UNION ALL SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT e.symbol, 'order_' || o AS caller, site::BIGINT AS site, definition_count, definition_count = 1 AS resolved,
    row_number() OVER (PARTITION BY e.symbol ORDER BY o, site)::INT AS rank FROM e JOIN defs USING (symbol)""")
def graph_callers(spark, sf_dir):
    chunks, edges = _graph(spark, sf_dir, True)
    hits = graph.callers(chunks, edges, chunks.select("symbol"))
    return hits.select("symbol", "caller", F.col("call_site.byte_start").alias("site"), "definition_count", "resolved", "rank")


@_query(f"""WITH {_GRAPH}, e AS (SELECT l_orderkey AS o, l_linenumber AS site, s_name AS callee FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'order_' || o AS symbol, callee, c.path || c.a AS definition_id, site::BIGINT AS site, definition_count, definition_count = 1 AS resolved
FROM e JOIN orders ON o_orderkey = o JOIN chunks c ON c.symbol = callee JOIN defs d ON d.symbol = callee""")
def graph_callees(spark, sf_dir):
    chunks, edges = _graph(spark, sf_dir, False)
    hits = graph.callees(chunks, edges, chunks.select("symbol"))
    return hits.select("symbol", "callee", "definition_id", F.col("call_site.byte_start").alias("site"), "definition_count", "resolved")


# Both kinds of calls: a part's name has many definitions, so a site gives a row for each, unresolved.
@_query(f"""WITH {_GRAPH}, e AS (
    SELECT l_orderkey AS o, l_linenumber AS site, s_name AS callee FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    UNION ALL SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'order_' || o AS symbol, callee, c.path || c.a AS definition_id, site::BIGINT AS site, definition_count, definition_count = 1 AS resolved
FROM e JOIN orders ON o_orderkey = o JOIN chunks c ON c.symbol = callee JOIN defs d ON d.symbol = callee""")
def graph_callees_all(spark, sf_dir):
    chunks, edges = _graph(spark, sf_dir, True)
    hits = graph.callees(chunks, edges, chunks.select("symbol"), dealt=True)
    return hits.select("symbol", "callee", "definition_id", F.col("call_site.byte_start").alias("site"), "definition_count", "resolved")


@_query(f"WITH {_GRAPH} SELECT symbol, definition_count, definition_count = 1 AS resolved FROM defs")
def symbol_ambiguity(spark, sf_dir):
    return graph.definitions(_graph(spark, sf_dir, False)[0])


# A second version of the corpus: every tenth document is gone, every seventh edited.
def _second(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    return from_documents(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit(" edited"))).otherwise(F.col("text"))))


_SECOND = f"""{_DOCS}, second AS (
    SELECT path, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS text, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END) AS hash FROM docs WHERE doc_id % 10 <> 0)"""


@_query(f"""WITH {_SECOND} SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'indexed' END AS action
FROM docs o FULL OUTER JOIN second n ON o.path = n.path""")
def index_delta(spark, sf_dir):
    told = lambda s: s.withColumns({"extractor": chunking.extractor_id(F.col("path")), "valid": F.lit(True)})
    return index.delta(told(_sources(spark, sf_dir)), told(_second(spark, sf_dir))).select("path", "action")


@_query(f"WITH {_SECOND} SELECT o.path, o.doc_id AS position FROM docs o LEFT JOIN second n USING (path) WHERE n.hash IS NULL OR n.hash <> o.hash")
def drifted_sources(spark, sf_dir):
    listed = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return index.drifted(listed, _sources(spark, sf_dir), _second(spark, sf_dir)).select("path", "position")


@_query(f"""WITH {_SECOND} SELECT o.path AS source_path, CASE WHEN n.path IS NULL THEN 'unavailable' WHEN n.hash = o.hash THEN 'ok' ELSE 'file' END AS status,
    md5(n.text) AS text_md5, CASE WHEN n.path IS NULL THEN 'source is gone' END AS message FROM docs o LEFT JOIN second n USING (path)""")
def retrieve_freshness(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    live = _second(spark, sf_dir).withColumn("problem", F.lit(None).cast("string"))
    return retrieve.retrieve(chunks, chunks.select("id"), live).select("source_path", "status", F.md5("text").alias("text_md5"), "message")


_HEADER = """h0 AS (
    SELECT query_id, rank, path, coalesce([trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''][1], '') AS line, text FROM hits
), h AS (
    SELECT *, CASE WHEN len(line) > 240 THEN line[1:240] || '...' ELSE line END AS synopsis FROM h0
), hb AS (SELECT *, (64 + strlen(path) + 64 + 13 + strlen(synopsis) + 160)::BIGINT AS header_bytes FROM h)"""


@_query(_rerank_sql(50) + f""", {_HEADER}, t AS (SELECT *, sum(header_bytes) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM hb)
SELECT query_id, rank, path AS source_path, synopsis, header_bytes FROM t WHERE rank = 1 OR so_far <= 32768""")
def headers_budget(spark, sf_dir):
    hits = lexical.find_reranked(_chunks(spark, sf_dir), _items(spark, sf_dir), 50)
    return headers.budgeted(hits).select("query_id", "rank", "source_path", "synopsis", "header_bytes")


def _cases(spark, sf_dir) -> DataFrame:
    """An item that occurs verbatim expects the least path that holds it; the others expect nothing that exists."""
    items, chunks = _items(spark, sf_dir), _chunks(spark, sf_dir)
    found = chunks.join(items, F.col("text").contains(F.col("query"))).groupBy("query_id").agg(F.min("source_path").alias("path"))
    return items.join(found, "query_id", "left").select(F.col("query_id").alias("name"), "query", F.array(F.struct(F.coalesce("path", F.lit("none")).alias("source_path"), F.col("query").alias("contains"))).alias("expected"))


_CASES = _rerank_sql(5) + """, exp AS (
    SELECT b.item_id AS name, min(d.path) AS path FROM benchmark b LEFT JOIN docs d ON contains(d.text, b.text) GROUP BY b.item_id
), ranks AS (SELECT name, min(h.rank) AS first_rank FROM exp LEFT JOIN hits h ON h.query_id = exp.name AND h.path = exp.path GROUP BY name)"""


@_query(_CASES + " SELECT count(*) AS cases, count(first_rank) AS hits, round(count(first_rank) / count(*), 6) AS hit_rate, round(sum(coalesce(1.0::DOUBLE / first_rank, 0)) / count(*), 6) AS mean_reciprocal_rank FROM ranks")
def eval_report(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    hits = lexical.find_reranked(_chunks(spark, sf_dir), cases.select(F.col("name").alias("query_id"), "query"), 5)
    return evaluate.report(evaluate.first_ranks(cases, hits))


@_query(_CASES + f""", {_HEADER} SELECT r.name, b.header_tokens, ceil(strlen(h.text) / 4)::BIGINT AS body_tokens, ceil(strlen(h.text) / 4)::BIGINT AS cold_tokens
FROM ranks r JOIN hits h ON h.query_id = r.name AND h.rank = r.first_rank JOIN (SELECT query_id, sum(ceil(header_bytes / 4))::BIGINT AS header_tokens FROM hb GROUP BY query_id) b ON b.query_id = r.name""")
def eval_tokens(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    hits = lexical.find_reranked(_chunks(spark, sf_dir), cases.select(F.col("name").alias("query_id"), "query"), 5)
    return evaluate.token_usage(evaluate.first_ranks(cases, hits), hits, _sources(spark, sf_dir))


# The activity log: an event is a line.
def _log(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 50 == 0, "serve start").when(e % 7 == 0, "retrieve").otherwise("find")
    detail = F.format_string('q="%s" results=%d actual_tok=%d cold_tok=%d', F.col("event_type"), e % 10, e % 500, e % 5000)
    failed = F.when(e % 11 == 0, " status=error").otherwise("")
    lines = _t(spark, sf_dir, "events").select(e.alias("line_no"), observe.audit_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), kind, F.concat(detail, failed)).alias("value"))
    return observe.parsed(lines)


_LOG = """lines AS (
    SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || '  ' || rpad(CASE WHEN event_id % 50 = 0 THEN 'serve start' WHEN event_id % 7 = 0 THEN 'retrieve' ELSE 'find' END, 12, ' ') || ' '
        || format('q="{}" results={} actual_tok={} cold_tok={}', event_type, event_id % 10, event_id % 500, event_id % 5000) || CASE WHEN event_id % 11 = 0 THEN ' status=error' ELSE '' END AS value FROM events
), log AS (
    SELECT line_no, value[1:19] AS logged_at, regexp_extract(value, '^\\S+ \\S+  (serve start|\\S+)', 1) AS kind, contains(value, 'status=error') AS failed,
        regexp_extract(value, 'actual_tok=(\\d+)', 1)::BIGINT AS actual_tokens, regexp_extract(value, 'cold_tok=(\\d+)', 1)::BIGINT AS cold_tokens, value FROM lines)"""


@_query(f"WITH {_LOG} SELECT count(*) AS finds, sum(actual_tokens)::BIGINT AS actual_tokens, sum(cold_tokens)::BIGINT AS cold_tokens, round(sum(cold_tokens) / sum(actual_tokens), 6) AS ratio FROM log WHERE kind = 'find' AND NOT failed")
def log_stats(spark, sf_dir):
    return observe.stats(_log(spark, sf_dir))


@_query(f"WITH {_LOG} SELECT line_no, logged_at, kind, value FROM log WHERE kind IN ('find', 'retrieve', 'find_related', 'list_corpora') ORDER BY line_no DESC LIMIT 20")
def log_recent(spark, sf_dir):
    return observe.recent(_log(spark, sf_dir), 20).select("line_no", "logged_at", "kind", "value")


@_query(f"WITH {_LOG} SELECT max(logged_at) AS last_serve FROM log WHERE kind = 'serve start'")
def last_serve(spark, sf_dir):
    return observe.last_serve(_log(spark, sf_dir))


@_query("""SELECT page_id, dst, count(*) AS sites FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages) GROUP BY ALL""")
def page_links(spark, sf_dir):
    links = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return links.groupBy("page_id", "dst").agg(F.count(F.lit(1)).alias("sites"))


@_query("""SELECT (SELECT count(*) FROM documents) AS sources, (SELECT count(*) FROM documents) AS chunks, 0::BIGINT AS symbols, (SELECT count(*) FROM embeddings) AS embeddings,
    'm' AS embedding_model, (SELECT count(*) FROM pages) AS edges""")
def corpus_status(spark, sf_dir):
    stored = _t(spark, sf_dir, "embeddings").select(F.lit("m").alias("model_id"))
    return index.status(_sources(spark, sf_dir), _chunks(spark, sf_dir), stored, _t(spark, sf_dir, "pages"))


QUERIES |= registry_code.QUERIES
ORACLES |= registry_code.ORACLES
