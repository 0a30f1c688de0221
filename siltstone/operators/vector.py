"""Embedding tables and exact cosine search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EmbeddingDimensions, MissingEmbeddings
from .lexical import DIGITS, ranked
from .nearest import KEYS, Best, result_type


class Provider(Protocol):
    """What the engine needs of an embedding model."""

    model_id: str
    dimensions: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


@dataclass
class KeywordProvider:
    """A deterministic model: component i is 1 if the text holds a word of group i."""

    groups: tuple[tuple[str, ...], ...] = (("alpha", "first"), ("beta", "second"))
    model_id: str = "keyword-v1"

    @property
    def dimensions(self) -> int:
        return len(self.groups)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [[float(any(w in t.lower() for w in group)) for group in self.groups] for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


@dataclass
class HashingProvider:
    """A deterministic model without weights: signed hashing of words, normalised."""

    dimensions: int = 64
    model_id: str = "hashing-v1"

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                v[h % self.dimensions] += 1.0 if h & (1 << 31) else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double arithmetic; 0 if either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def is_valid(vector: Column, dimensions: int) -> Column:
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def missing(chunks: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """Chunks without a vector of the model."""
    return chunks.join(embeddings.where(F.col("model_id") == model_id).select(F.col("chunk_id").alias("id")), "id", "left_anti")


def embed(chunks: DataFrame, provider: Provider) -> DataFrame:
    """Embedding rows of chunks; a vector of wrong size or with a non-finite component fails the job."""
    run: Callable = provider.embed_documents

    @F.pandas_udf("array<float>")
    def vectors(text: pd.Series) -> pd.Series:
        return pd.Series(run(text.tolist()))

    made = chunks.select(F.col("id").alias("chunk_id"), F.lit(provider.model_id).alias("model_id"), F.lit(provider.dimensions).alias("dimensions"), vectors("text").alias("vector"))
    bad = F.raise_error(F.concat(F.lit("invalid embedding of chunk "), F.col("chunk_id"))).cast("array<float>")
    return made.withColumn("vector", F.when(is_valid(F.col("vector"), provider.dimensions), F.col("vector")).otherwise(bad))


def refreshed(chunks: DataFrame, embeddings: DataFrame, provider: Provider) -> DataFrame:
    """The embedding table after a refresh: other models' rows go, rows of gone chunks go, missing ones are made."""
    own = embeddings.where(F.col("model_id") == provider.model_id)
    kept = own.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "model_id", "dimensions", "vector")
    return kept.unionByName(embed(missing(chunks, own, provider.model_id), provider))


def upserted(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """``embeddings`` with the rows of ``new`` in place of those of equal (chunk_id, model_id)."""
    return embeddings.join(new, ["chunk_id", "model_id"], "left_anti").unionByName(new)


def stats(embeddings: DataFrame) -> DataFrame:
    """(model_id, embeddings, dimensions, storage_bytes), the model with most vectors first."""
    return (
        embeddings.groupBy("model_id").agg(F.count(F.lit(1)).alias("embeddings"), F.max("dimensions").alias("dimensions"), F.sum(F.size("vector") * 4).cast("bigint").alias("storage_bytes"))
        .orderBy(F.desc("embeddings"), "model_id")
    )


#: Components of the queries that are sent to every task (8 bytes each), and of a block beyond that; rows of a data block.
SENT_COMPONENTS = 1 << 23
BLOCK_ROWS = 1 << 15


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of floats to rows of unit length; 0 where the norm is 0.  Shorter rows are filled up with zeros."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    norm = np.sqrt((out * out).sum(axis=1))[:, None]
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _add_nearest(best: Best, asked: np.ndarray, batch: pa.RecordBatch | pa.Table) -> None:
    keys, held = batch.select(KEYS).to_pandas(), _matrix(batch.column("vector"))
    width, limit, step = min(held.shape[1], asked.shape[1]), best.limit, max(1, (1 << 22) // max(1, batch.num_rows))
    for at in range(0, len(asked), step):
        scores = np.round(asked[at : at + step, :width] @ held[:, :width].T, DIGITS) + 0.0
        cut = np.partition(scores, len(keys) - limit, axis=1)[:, len(keys) - limit] if len(keys) > limit else np.full(len(scores), -np.inf)
        query, row = np.nonzero(scores >= cut[:, None])
        best.add(keys, row, query + at, scores[query, row])


def score_vectors(embeddings: DataFrame, query_vectors: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, source_path, byte_start, score, rank): the ``limit`` nearest of the slim rows (id, source_path, byte_start, vector).

    Cosines are blocked matrix products, and only each block's nearest leave its task.  Queries are a
    stated set: up to SENT_COMPONENTS they are sent to the vectors, which stay where they are; a
    larger set is cut into blocks that meet blocks of vectors.
    """
    slim, asked_of = embeddings.select(*KEYS, "vector"), query_vectors.select("query_id", "query_vector")
    made, schema = result_type(slim, asked_of)
    n, components = asked_of.agg(F.count(F.lit(1)), F.sum(F.size("query_vector"))).first()
    if (components or 0) <= SENT_COMPONENTS:
        sent = asked_of.toArrow()
        ids, asked = sent.column("query_id").to_pandas().to_numpy(), _matrix(sent.column("query_vector"))

        def run(batches):
            best = Best(ids, limit, schema)
            for batch in batches:
                if batch.num_rows and len(ids):
                    _add_nearest(best, asked, batch)
            yield from best.table().to_batches()

        scored = slim.mapInArrow(run, made)
    else:
        query_blocks, data_blocks = -(-components // SENT_COMPONENTS), -(-slim.count() // BLOCK_ROWS)
        block = lambda c, k, name: F.pmod(F.xxhash64(c), F.lit(k)).cast("int").alias(name)
        every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(int(k) - 1))).alias(name)
        left = asked_of.select("*", block("query_id", query_blocks, "q")).select("*", every(data_blocks, "d"))
        right = slim.select("*", block("id", data_blocks, "e")).select("*", every(query_blocks, "p"))

        def solve(_, own: pa.Table, data: pa.Table) -> pa.Table:
            best = Best(own.column("query_id").to_pandas().to_numpy(), limit, schema)
            if own.num_rows and data.num_rows:
                _add_nearest(best, _matrix(own.column("query_vector")), data)
            return best.table()

        scored = left.groupBy("q", "d").cogroup(right.groupBy("p", "e")).applyInArrow(solve, made)
    return ranked(scored, F.desc("score"), limit=limit)


def find_vector(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, provider: Provider, limit: int = 10) -> DataFrame:
    """Nearest chunks of each query: all vectors are scored slim, and only winners get their text."""
    own = embeddings.where((F.col("model_id") == provider.model_id) & (F.col("dimensions") == provider.dimensions))
    if own.isEmpty():
        raise MissingEmbeddings(provider.model_id)
    rows = [(r["query_id"], provider.embed_query(r["query"])) for r in queries.select("query_id", "query").toLocalIterator()]
    if any(len(v) != provider.dimensions for _, v in rows):
        raise EmbeddingDimensions(provider.model_id)
    asked = chunks.sparkSession.createDataFrame(rows, f"query_id {dict(queries.dtypes)['query_id']}, query_vector array<double>")
    slim = own.join(chunks.select(F.col("id").alias("chunk_id"), "source_path", "byte_start"), "chunk_id").select(F.col("chunk_id").alias("id"), "source_path", "byte_start", "vector")
    best = score_vectors(slim, asked, limit).select("query_id", "id", "score", "rank")
    return best.join(chunks, "id")
