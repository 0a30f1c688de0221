"""The facade of the retrieval engine: index, find, retrieve, relate, evaluate, status."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import code, evaluate, graph, headers, hybrid, index, lexical, retrieve, vector
from ..operators.chunking import extractor_id
from ..operators.store import Store
from ..sources import corpus

STRATEGIES = ("substring", "fts", "reranked", "vector", "hybrid", "routed")


class Engine:
    def __init__(self, spark: SparkSession, path: str, provider: vector.Provider | None = None) -> None:
        self.spark, self.store, self.provider = spark, Store(spark, path), provider

    # -- maintenance

    def index(self, root: str, force: bool = False) -> dict:
        """Bring the tables up to the files below ``root``; the report's counts."""
        found = corpus.discover(root, (self.store.path,))
        live = corpus.read_files(self.spark, root, found.files)
        report = self.index_sources(live, os.path.realpath(root), force)
        missed = len(found.files) - report["discovered"]  # vanished between the walk and the read
        return report | {"discovered": len(found.files), "rejected": report["rejected"] + found.rejected + missed}

    def index_sources(self, live: DataFrame, root: str | None = None, force: bool = False, only: DataFrame | None = None) -> dict:
        """Merge live sources (path, content) into the tables; ``only``: the paths (path) that are looked at.

        What is written are the rows of changed sources and the paths of those that went.
        """
        state = self.store.state()
        now = index.decoded(index.hashed(live)).withColumn("extractor", extractor_id(F.col("path")))
        old = self.store.read("sources", state)
        seen = old if only is None else old.join(only.select("path").distinct(), "path", "left_semi").select(*old.columns)
        changes = index.delta(seen, now, force).cache()
        report = index.report(changes).first().asDict()
        row = {"chunks_written": 0, "code_parse_fallbacks": 0}
        if report["indexed"] or report["removed"] or report["rejected"] or state["root"] is None:
            fresh = now.join(changes.where("action = 'indexed'").select("path"), "path", "left_semi")
            made = code.extract(fresh.select("path", "content_hash", "text")).cache()
            row = made.agg(F.count(F.lit(1)).alias("chunks_written"), F.countDistinct(F.when(F.col("fallback"), F.col("source_path"))).alias("code_parse_fallbacks")).first().asDict()
            chunks = made.select(*[c.split()[0] for c in schema.CHUNKS.split(", ")])
            owners = made.select("id", F.col("source_path").alias("owner"))
            self.store.change(
                root, changes.where("action <> 'unchanged' and old_hash is not null").select("path"), base=state, sources=fresh.select("path", "content_hash", "extractor"), chunks=chunks,
                edges=code.edges_of(made).join(owners, F.col("src_chunk_id") == F.col("id")).drop("id"),
                postings=lexical.postings(chunks).join(owners, "id"), lengths=lexical.lengths(chunks).join(owners, "id"),
            )
            made.unpersist()
        changes.unpersist()
        return report | row

    def refresh_source(self, root: str, path: str) -> str:
        """Bring one source up to date: reindexed, pruned or unchanged."""
        path = corpus.confined(root, path)
        live = corpus.read_files(self.spark, root, [path] if os.path.isfile(os.path.join(root, path)) else [])
        report = self.index_sources(live, os.path.realpath(root), only=self.spark.createDataFrame([(path,)], "path string"))
        return "reindexed" if report["indexed"] else "pruned" if report["removed"] or report["rejected"] else "unchanged"

    def refresh_embeddings(self) -> dict:
        if self.provider is None:
            raise schema.MissingEmbeddings("no provider")
        state = self.store.state()
        chunks, old = self.store.read("chunks", state), self.store.read("embeddings", state)
        missing = vector.missing(chunks, old, self.provider.model_id)
        todo, removed = missing.count(), old.where(F.col("model_id") != self.provider.model_id).count()
        if todo or removed:
            # Without rows of other models the missing vectors are added; with them the table is replaced.
            made = vector.refreshed(chunks, old, self.provider) if removed else vector.embed(missing, self.provider)
            owners = chunks.select(F.col("id").alias("chunk_id"), F.col("source_path").alias("owner"))
            self.store.change(None, replaces=("embeddings",) if removed else (), base=state, embeddings=made.join(owners, "chunk_id"))
        now = self.store.read("embeddings")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).alias("bytes")).first()
        return {"model_id": self.provider.model_id, "dimensions": self.provider.dimensions, "embedded": todo, "unchanged": row["n"] - todo, "removed_other_models": removed, "storage_bytes": row["bytes"]}

    def status(self) -> DataFrame:
        return index.status(*(self.store.read(t) for t in ("sources", "chunks", "embeddings", "edges")))

    # -- search

    def has_embeddings(self) -> bool:
        return self.provider is not None and not self.store.read("embeddings").where(F.col("model_id") == self.provider.model_id).isEmpty()

    def search(self, queries: DataFrame, limit: int = 10, strategy: str = "reranked", profile: str = "balanced") -> DataFrame:
        """Ranked hits of a table of queries (query_id, query)."""
        state = self.store.state()
        chunks, index_ = self.store.read("chunks", state), lexical.Index(self.store.read("postings", state), self.store.read("lengths", state))
        if strategy == "substring":
            return lexical.find_substring(chunks, queries, limit)
        if strategy == "fts":
            return lexical.find_bm25(chunks, queries, limit, index_)
        if strategy == "reranked" or strategy == "routed" and not self.has_embeddings():
            return lexical.find_reranked(chunks, queries, limit, index_)
        if strategy not in STRATEGIES:
            raise ValueError(strategy)
        if not self.has_embeddings():
            raise schema.MissingEmbeddings(self.provider.model_id if self.provider else "no provider")
        if strategy == "vector":
            return vector.find_vector(chunks, self.store.read("embeddings"), queries, self.provider, limit)
        many = hybrid.candidate_limit(limit)
        own = lexical.find_reranked(chunks, queries, many, index_).select("query_id", "id", "score", "rank")
        near = vector.find_vector(chunks, self.store.read("embeddings"), queries, self.provider, many).select("query_id", "id", "score", "rank")
        return hybrid.blend(own, near, chunks, profiles_of(queries, profile if strategy == "hybrid" else None), limit)

    def find(self, query: str, limit: int = 10, strategy: str = "reranked", profile: str = "balanced") -> DataFrame:
        """Ranked hits of one query, with bodies."""
        query = lexical.check_query(query, limit)
        if strategy in ("fts", "reranked"):
            lexical.check_terms(query)
        return self.search(self.spark.createDataFrame([(0, query)], "query_id int, query string"), limit, strategy, profile).orderBy("rank")

    def find_headers(self, query: str, limit: int = 10, strategy: str = "reranked") -> DataFrame:
        """Headers of one query without bodies, within the byte budget."""
        return headers.budgeted(self.find(query, headers.capped_limit(limit), strategy)).orderBy("rank")

    def related(self, symbol: str, direction: str = "callers", limit: int | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(symbol,)], "symbol string")
        if direction not in ("callers", "callees"):
            raise ValueError(direction)
        return getattr(graph, direction)(self.store.read("chunks"), self.store.read("edges"), asked, limit)

    def live(self, root: str, paths: list[str]) -> DataFrame:
        """(path, content_hash, text, problem, size) of paths as they are now."""
        inside = [p for p in paths if corpus.safe_relative(p) and os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p))]
        rows = index.decoded(index.hashed(corpus.read_files(self.spark, root, inside)))
        return rows.select("path", "content_hash", "text", F.when(~F.col("valid"), "source is not UTF-8").alias("problem"), "size")

    def retrieve(self, root: str, ids: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        chunks = self.store.read("chunks")
        paths = [r[0] for r in chunks.join(asked, "id", "left_semi").select("source_path").distinct().collect()]  # at most one for each id
        return retrieve.retrieve(chunks, asked, self.live(root, paths))

    def drifted(self, root: str, paths: list[str]) -> list[str]:
        asked = self.spark.createDataFrame(list(enumerate(paths)), "position int, path string")
        return [r["path"] for r in index.drifted(asked, self.store.read("sources"), self.live(root, paths)).orderBy("position").collect()]

    def evaluate(self, cases: DataFrame, limit: int = 5, strategy: str = "reranked") -> DataFrame:
        """One row of quality for cases (name, query, expected)."""
        evaluate.check_cases(cases)
        hits = self.search(cases.select(F.col("name").alias("query_id"), "query"), limit, strategy)
        return evaluate.report(evaluate.first_ranks(cases, hits))


def profiles_of(queries: DataFrame, profile: str | None) -> DataFrame:
    """(query_id, protected, vector_weight, shortcut); without a profile each query is routed by its class."""
    from ..functions.text import query_class

    def value(pick, kind: str):
        if profile:
            return F.lit(pick(hybrid.PROFILES[profile])).cast(kind)
        natural, symbol = (F.lit(pick(hybrid.ROUTES[c])).cast(kind) for c in ("natural", "symbol"))
        return F.when(query_class(F.col("query")) == "natural", natural).otherwise(symbol)

    return queries.select("query_id", value(lambda p: p.protected, "int").alias("protected"), value(lambda p: p.vector_weight, "double").alias("vector_weight"), value(lambda p: p.shortcut, "double").alias("shortcut"))
