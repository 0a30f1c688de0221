"""Table schemas and errors of the retrieval engine."""

from __future__ import annotations

SOURCES = "path string, content_hash string, extractor string"
CHUNKS = (
    "id string, source_path string, source_hash string, byte_start bigint, byte_end bigint, line_start bigint, line_end bigint, "
    "text string, extractor string, symbol string"
)
EDGES = (
    "src_chunk_id string, edge_type string, dst_symbol string, confidence string, byte_start bigint, byte_end bigint, line_start bigint, line_end bigint"
)
EMBEDDINGS = "chunk_id string, model_id string, dimensions int, vector array<float>"
#: The inverted index: one row for each term of a chunk, and the terms of every chunk.
POSTINGS = "term string, id string, dl int, positions array<int>"
LENGTHS = "id string, dl int"
#: Version of the stored layout; an older one is upgraded on open, a newer one refused.
VERSION = 6
#: The order that breaks every tie between hits.
TOTAL_ORDER = ("source_path", "byte_start", "id")


class EngineError(Exception):
    """Base of the errors that are raised before any plan is built."""


class EmptyQuery(EngineError):
    pass


class InvalidLimit(EngineError):
    pass


class NoSearchTerms(EngineError):
    pass


class MissingEmbeddings(EngineError):
    pass


class EmbeddingDimensions(EngineError):
    pass


class NonFiniteEmbedding(EngineError):
    pass


class EvaluationCaseWithoutExpected(EngineError):
    pass


class CorpusMismatch(EngineError):
    pass


class StoreConflict(EngineError):
    """Two writers began from one state."""


class InvalidRoot(EngineError):
    pass


class UnsupportedSchemaVersion(EngineError):
    pass


class MissingCorpusRoot(EngineError):
    pass


class PathOutsideRoot(EngineError):
    pass


class InvalidName(EngineError):
    pass
