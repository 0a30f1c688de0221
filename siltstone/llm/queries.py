"""The thin registered queries of this subpackage: ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_wrapper, langid, mixing, ngram_join, packing, quality_fm, quality_rules, sharding, token_files, topk_voronoi
from ._common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = langid.fit_langid(documents.where(~held_out))
    return langid.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_voronoi.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nearly equal weights, which no corpus has by nature; where sources differ much the repetition limit decides.
    mixed = mixing.mix(table(spark, sf_dir, "documents"), target_entropy_share=0.9999, carry=["doc_id"])
    return mixed.select("doc.doc_id", "source", "tokens", "epoch", "block", "place")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = quality_fm.fit_quality_fm(documents, labels.where(~held_out))
    return quality_fm.score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = quality_rules.fit_quality_trees(documents, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(documents, trees)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read_back(spark, path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op4_topk": op4_topk,
    "op5_source_mixing": op5_source_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
            FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)])) END AS sh FROM w
        ), g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, CASE WHEN len(sh) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY sh) END::BIGINT AS n_copies
        FROM s JOIN c USING (doc_id)
    """,
}
