"""Retrieval operators on hand-written fixtures."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import text as T
from siltstone.operators import chunking, evaluate, graph, headers, hybrid, index, lexical, nearest, observe, retrieve, vector

CHUNK = schema.CHUNKS


def chunks_of(spark, *texts, extractor="plain-text-v1", symbols=None):
    rows = [(f"id{i}", f"p{i}.txt", "h", 0, len(t.encode()), 1, t.count("\n") + 1, t, extractor, symbols[i] if symbols else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


def queries_of(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def plain(spark, text):
    rows = chunking.chunk_plain(spark.createDataFrame([("a.txt", "h", text)], "path string, content_hash string, text string")).orderBy("byte_start").collect()
    return [(r["text"], r["byte_start"], r["byte_end"], r["line_start"], r["line_end"]) for r in rows]


def test_paragraphs_and_spans(spark):
    assert plain(spark, "alpha\n\nbeta") == [("alpha\n", 0, 6, 1, 1), ("beta", 7, 11, 3, 3)]
    assert plain(spark, "\n \n\t\n") == []
    assert plain(spark, "a\nb\n\n\nç\nd\n") == [("a\nb\n", 0, 4, 1, 2), ("ç\nd\n", 6, 11, 5, 6)]


def test_oversize_paragraphs_are_cut_at_space_and_character(spark):
    assert [len(t.encode()) for t, *_ in plain(spark, "a" * 1900 + " " + "b" * 300)] == [1901, 300]
    parts = plain(spark, "é" * 1200)
    assert [len(t) for t, *_ in parts] == [1024, 176] and [p[1] for p in parts] == [0, 2048]


def brute_spans(text, limit=2048):
    """Chunks by their definition, byte by byte."""
    out, lines, at = [], re.findall(r"[^\n]*\n|[^\n]+\Z", text), 0
    runs, open_ = [], False
    for line in lines:
        blank = not re.search(r"[^ \t\n\x0b\f\r]", line)
        if not blank and not open_:
            runs.append([at, ""])
        if not blank:
            runs[-1][1] += line
        open_ = not blank
        at += len(line.encode())
    for start, run in runs:
        pieces = re.findall(r"(?a:\S*\s|\S+)", run) if len(run.encode()) > limit else [run]
        parts = []
        for piece in pieces:
            small = [piece]
            while len(small[-1].encode()) > limit:
                k = max(k for k in range(len(small[-1])) if len(small[-1][:k].encode()) <= limit)
                small[-1:] = [small[-1][:k], small[-1][k:]]
            for own in small:
                if parts and len((parts[-1] + own).encode()) <= limit:
                    parts[-1] += own
                else:
                    parts.append(own)
        for part in parts:
            end = start + len(part.encode())
            first = text.encode()[:start].count(b"\n") + 1
            out.append((part, start, end, first, first + part.count("\n") - part.endswith("\n")))
            start = end
    return out


def test_chunks_equal_their_definition(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "中", "😀", " ", "\t", "\n", "\n\n", "\r\n", "\x0b", "\x85", "\u2028", "word "]
    texts = ["".join(rng.choices(alphabet, weights=[6, 2, 2, 1, 3, 1, 2, w, 1, 1, 1, 1, 5], k=rng.randrange(0, n))) for n in (40, 400, 6000) for w in (0, 1) for _ in range(8)]
    texts += ["x" * 10_000, "é" * 5000 + "\n", "\n", "a\n\n" * 3000]
    rows = spark.createDataFrame([(f"{i}.txt", "h", t) for i, t in enumerate(texts)] + [("none", "h", None)], "path string, content_hash string, text string")
    got = {}
    for r in chunking.chunk_plain(rows).orderBy("source_path", "byte_start").collect():
        got.setdefault(r["source_path"], []).append((r["text"], r["byte_start"], r["byte_end"], r["line_start"], r["line_end"]))
        assert r["id"] == chunking.id_of(r["source_path"], "h", r["byte_start"], r["byte_end"])
    assert got == {f"{i}.txt": own for i, t in enumerate(texts) if (own := brute_spans(t))}


def test_chunking_is_linear(spark):
    text = ("word " * 30 + "\n") * 100_000 + "\n" + "y" * 3_000_000  # one paragraph of 15 MB and one piece of 3 MB
    began = time.time()
    parts = list(chunking.spans(text))
    assert time.time() - began < 30 and sum(b - a for a, b, *_ in parts) == len(text) - 1


def test_large_query_sets_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    chunks = chunks_of(spark, *(" ".join(rng.choice(["alpha", "beta", "snake_case", "Gamma", "é", "x1"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)))
    queries = queries_of(spark, "alpha beta", "snake_case gamma", "e x1 x1", "beta snake_case alpha", "nothing", "a")
    vectors = chunks.select("id", "source_path", "byte_start", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda x: F.sin(x * F.crc32(F.col("text").cast("binary")))).cast("array<float>").alias("vector"))
    asked = vectors.where("id like '%0'").select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("query_vector"))

    def results():
        yield from (f(chunks, queries, 7) for f in (lexical.find_bm25, lexical.find_reranked, lexical.find_substring))
        yield vector.score_vectors(vectors, asked, 7)
        built = lexical.Index(lexical.postings(chunks), lexical.lengths(chunks))
        yield from (f(chunks, queries, 7, built) for f in (lexical.find_bm25, lexical.find_reranked))

    plain = lambda df: sorted(map(str, df.select("query_id", "rank", "id", "score").collect()))
    sent = [plain(r) for r in results()]
    monkeypatch.setattr(lexical, "SENT_TOKENS", 0)
    monkeypatch.setattr(lexical, "SENT_BYTES", 0)
    monkeypatch.setattr(vector, "SENT_COMPONENTS", 7)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 11)
    joined = [plain(r) for r in results()]
    assert sent == joined and sent[:2] == sent[4:] and all(sent)


def test_best_rows_are_kept_over_many_batches(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(nearest, "HELD", 50)
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": [f"i{k % 400}" for k in range(500)], "source_path": [f"p{k % 7}" for k in range(500)], "byte_start": range(500)})
    table = spark.createDataFrame(frame, "id string, source_path string, byte_start bigint")
    _, schema_ = nearest.result_type(table, spark.createDataFrame([], "query_id int"))
    best, scores = nearest.Best(np.array([5, 6, 9]), 8, schema_), rng.integers(0, 12, (500, 3)).astype(float)
    for at in range(0, 500, 40):
        row, query = np.nonzero(scores[at : at + 40] >= 0)
        best.add(frame.iloc[at : at + 40], row, query, scores[at : at + 40][row, query])
    got = best.table().to_pandas()
    for k, q in enumerate((5, 6, 9)):
        want = frame.assign(score=scores[:, k]).sort_values(["score", *schema.TOTAL_ORDER], ascending=[False, True, True, True]).head(8)
        own = got[got["query_id"] == q]
        assert own["byte_start"].tolist() == want["byte_start"].tolist() and own["score"].tolist() == want["score"].tolist()


def test_first_line(spark):
    texts = ["", " \n\t\n", "a", "\n  a b \t\r\n c", "\r\n\x0bx\r y\n", "é\n"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.first_line(F.col("t"))).collect()]
    assert got == ["", "", "a", "a b", "x\r y", "é"]


def test_chunk_ids_depend_on_path_hash_and_range(spark):
    one = F.lit(1)
    row = spark.range(1).select(*[chunking.chunk_id(F.lit(p), F.lit(h), F.lit(a), one).alias(f"c{i}") for i, (p, h, a) in enumerate([("a", "h", 0), ("b", "h", 0), ("a", "i", 0), ("a", "h", 1), ("a", "h", 0)])]).first()
    assert len(set(row)) == 4 and row[0] == row[4]


def test_substring_counts_without_overlap(spark):
    hits = lexical.find_substring(chunks_of(spark, "aaaa", "Aa b", "c"), queries_of(spark, "aa")).orderBy("rank").collect()
    assert [(r["source_path"], r["score"]) for r in hits] == [("p0.txt", 2.0), ("p1.txt", 1.0)]


def test_bm25_formula_floor_and_accents(spark):
    import math

    chunks = chunks_of(spark, "ecole alpha", "beta beta gamma", "beta")
    hits = {(r["query_id"], r["source_path"]): r["score"] for r in lexical.find_bm25(chunks, queries_of(spark, "école", "beta")).collect()}
    assert set(hits) == {(0, "p0.txt"), (1, "p1.txt"), (1, "p2.txt")}
    assert hits[0, "p0.txt"] == pytest.approx(round(math.log(2.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2)), 6))
    assert 0 < hits[1, "p1.txt"] < 1e-5  # in half of the chunks or more: the floor


def test_underscore_token_is_a_phrase(spark):
    chunks = chunks_of(spark, "chunk record from row here", "chunk from record row", "x chunk_record_from_row y chunk record from row")
    hits = lexical.bm25(chunks, queries_of(spark, "chunk_record_from_row")).join(chunks, "id").orderBy("source_path").collect()
    assert [r["source_path"] for r in hits] == ["p0.txt", "p2.txt"]


def test_rerank_puts_phrase_then_coverage_first_and_drops_equal_texts(spark):
    chunks = chunks_of(spark, "beta alpha", "alpha beta", "alpha alpha alpha alpha", "alpha beta", "zeta")
    hits = lexical.find_reranked(chunks, queries_of(spark, "alpha beta"), 10).orderBy("rank").collect()
    assert [r["source_path"] for r in hits] == ["p1.txt", "p0.txt", "p2.txt"]


def test_signature_lifts_definitions(spark):
    chunks = chunks_of(spark, "uses things\nRunStore here", "class RunStore\nthings here")
    hits = lexical.find_reranked(chunks, queries_of(spark, "RunStore things"), 2).orderBy("rank").collect()
    assert hits[0]["source_path"] == "p1.txt"


def test_query_checks():
    with pytest.raises(schema.EmptyQuery):
        lexical.check_query("  ", 0)
    with pytest.raises(schema.InvalidLimit):
        lexical.check_query("a", 0)
    with pytest.raises(schema.NoSearchTerms):
        lexical.check_terms("!! --")
    assert lexical.rerank_candidates(1) == 500 and lexical.rerank_candidates(1000) == 5000 and hybrid.candidate_limit(1) == 100


@pytest.mark.parametrize(
    "query, expected",
    [("chunk_record_from_row", "symbol"), ("function that reads a row", "natural"), ("RunStore", "symbol"), ("2024", "symbol"), ("how BM25", "symbol"),
     ("one two three four five the", "natural"), ("one two the", "symbol"), ("the of", "natural")],
)
def test_query_class(spark, query, expected):
    assert spark.range(1).select(T.query_class(F.lit(query))).first()[0] == expected


def test_identifier_shapes(spark):
    words = {"a_b": True, "Foo::bar": True, "camelCase": True, "Pascal": False, "FTS5": True, "A": False, "12": True, "word": False, "PascalCase": True}
    row = spark.range(1).select(*[T.is_identifier(F.lit(w)).alias(w.replace(":", "")) for w in words]).first()
    assert list(row) == list(words.values())


def test_vectors(spark):
    chunks, provider = chunks_of(spark, "alpha first", "beta", "nothing"), vector.KeywordProvider()
    made = vector.embed(chunks, provider)
    hits = vector.find_vector(chunks, made, queries_of(spark, "alpha"), provider, 3).orderBy("rank").collect()
    assert [(r["source_path"], r["score"]) for r in hits] == [("p0.txt", 1.0), ("p1.txt", 0.0), ("p2.txt", 0.0)]
    assert vector.missing(chunks, made.where("chunk_id <> 'id1'"), "keyword-v1").select("id").first()[0] == "id1"
    other = made.withColumn("model_id", F.lit("old"))
    again = vector.refreshed(chunks, made.where("chunk_id = 'id0'").unionByName(other), provider)
    assert again.count() == 3 and again.select("model_id").distinct().count() == 1
    with pytest.raises(schema.MissingEmbeddings):
        vector.find_vector(chunks, other, queries_of(spark, "alpha"), provider)

    class Broken(vector.KeywordProvider):
        def embed_documents(self, texts):
            return [[float("nan"), 0.0] for _ in texts]

    with pytest.raises(Exception, match="invalid embedding"):
        vector.embed(chunks, Broken()).collect()


def test_hybrid_pins_blends_and_short_cuts(spark):
    chunks = chunks_of(spark, *"abcdef")
    lex = spark.createDataFrame([(0, f"id{i}", s, i + 1) for i, s in enumerate((1.9, 1.5, 1.4, 1.2))], "query_id int, id string, score double, rank int")
    vec = spark.createDataFrame([(0, "id5", 0.9, 1), (0, "id3", 0.2, 2), (0, "id0", 0.1, 3)], "query_id int, id string, score double, rank int")

    def run(profile, limit=6):
        told = spark.createDataFrame([(0, profile.protected, profile.vector_weight, profile.shortcut)], "query_id int, protected int, vector_weight double, shortcut double")
        return [(r["id"], r["score"]) for r in hybrid.blend(lex, vec, chunks, told, limit).orderBy("rank").collect()]

    got = run(hybrid.BALANCED)
    assert [i for i, _ in got] == ["id0", "id1", "id2", "id5", "id3"]
    assert got[0][1] == 11.0 and got[3][1] == pytest.approx(1.9) and got[4][1] == pytest.approx(0.25 + 2 * 0.6)
    assert [i for i, _ in run(hybrid.LEXICAL, 3)] == ["id0", "id1", "id2"]  # strong lexical list: taken as it is
    assert [i for i, _ in run(hybrid.SEMANTIC)][:2] == ["id0", "id5"]


def test_graph(spark):
    chunks = chunks_of(spark, "helper", "caller", "other", "helper2", symbols=["helper", "caller", None, "twice"]).unionByName(chunks_of(spark, "z").withColumns({"id": F.lit("z"), "symbol": F.lit("twice")}))
    edges = spark.createDataFrame([("id1", "calls", "helper", "extracted", 1, 2, 1, 1), ("id2", "calls", "helper", "extracted", 3, 4, 1, 1), ("id1", "calls", "twice", "extracted", 5, 6, 1, 1), ("id1", "calls", "gone", "extracted", 7, 8, 1, 1)], schema.EDGES)
    ask = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    assert [(r["caller"], r["resolved"]) for r in graph.callers(chunks, edges, ask("helper")).orderBy("rank").collect()] == [("caller", True), ("", True)]
    assert graph.callers(chunks, edges, ask("gone")).count() == 0
    got = graph.callees(chunks, edges, ask("caller")).orderBy("rank").collect()
    assert [(r["callee"], r["resolved"]) for r in got] == [("helper", True), ("twice", False), ("twice", False)]


def test_headers(spark):
    text = "/// Reads a row.\n#[inline]\npub fn read(\n    row: &Row,\n) -> u32 {\n    1\n}"
    row = headers.with_headers(chunks_of(spark, text, extractor="tree-sitter-rust-v1")).first()
    assert row["signature"] == "pub fn read( row: &Row, ) -> u32" and row["synopsis"] == "Reads a row."
    ts = headers.with_headers(chunks_of(spark, "/**\n * Runs it.\n */\nexport function run(): void {}", extractor="tree-sitter-typescript-v1")).first()
    assert (ts["signature"], ts["synopsis"]) == ("export function run(): void", "Runs it.")
    py = headers.with_headers(chunks_of(spark, 'def f(x):\n    """\n    Adds.\n    """\n', extractor="tree-sitter-python-v1")).first()
    assert (py["signature"], py["synopsis"]) == ("def f(x):", "Adds.")
    prose = headers.with_headers(chunks_of(spark, "\n  " + "x" * 300)).first()
    assert prose["signature"] is None and prose["synopsis"] == "x" * 240 + "..."


def test_byte_budget_keeps_the_first_and_a_prefix(spark):
    hits = chunks_of(spark, *["x" * 100] * 5).withColumns({"query_id": F.lit(0), "rank": (F.substring("id", 3, 1).cast("int") + 1)})
    assert headers.budgeted(hits, 1).count() == 1
    size = headers.budgeted(hits).first()["header_bytes"]
    assert headers.budgeted(hits, 3 * size).count() == 3
    with pytest.raises(schema.InvalidLimit):
        headers.capped_limit(0)
    assert headers.capped_limit(99) == 50


def test_delta_and_report(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x"), ("g", "1", "old")], schema.SOURCES)
    new = spark.createDataFrame([("a", "1", "x", True), ("b", "2", "x", True), ("c", "2", "x", False), ("e", "1", "x", False), ("f", "1", "x", True), ("g", "1", "x", True)], schema.SOURCES + ", valid boolean")
    got = {r["path"]: r["action"] for r in index.delta(old, new).collect()}
    assert got == {"a": "unchanged", "b": "indexed", "c": "evicted", "d": "removed", "e": "rejected", "f": "indexed", "g": "indexed"}
    assert index.report(index.delta(old, new)).first().asDict() == {"discovered": 6, "indexed": 3, "unchanged": 1, "removed": 1, "rejected": 2}
    assert {r["action"] for r in index.delta(old, new, force=True).where("path = 'a'").collect()} == {"indexed"}


def test_drift_keeps_the_first_position(spark):
    listed = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "nowhere")], "position int, path string")
    stored = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x")], schema.SOURCES)
    live = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    assert [(r["path"], r["position"]) for r in index.drifted(listed, stored, live).orderBy("position").collect()] == [("b", 0), ("nowhere", 3)]


def test_retrieve_states(spark):
    chunks = chunks_of(spark, "one", "two", "three", "four")
    live = spark.createDataFrame([("p0.txt", "h", "one", None), ("p1.txt", "i", "new\ntext\n", None), ("p3.txt", "j", None, "source is not UTF-8")], "path string, content_hash string, text string, problem string")
    got = {r["id"]: (r["status"], r["text"], r["line_end"], r["message"]) for r in retrieve.retrieve(chunks, chunks.select("id"), live).collect()}
    assert got["id0"] == ("ok", "one", 1, None) and got["id1"] == ("file", "new\ntext\n", 2, None)
    assert got["id2"] == ("unavailable", None, None, "source is gone") and got["id3"][3] == "source is not UTF-8"


def test_evaluation(spark):
    cases = spark.createDataFrame([("c1", "q", [("p1.txt", None)]), ("c2", "q", [("p0.txt", "absent"), ("p2.txt", "thr")]), ("c3", "q", [("x", None)])], "name string, query string, expected array<struct<source_path:string,contains:string>>")
    base = chunks_of(spark, "one", "two", "three").withColumn("rank", F.substring("id", 3, 1).cast("int") + 1)
    hits = base.crossJoin(spark.createDataFrame([("c1",), ("c2",), ("c3",)], "query_id string"))
    ranks = evaluate.first_ranks(cases, hits)
    assert {r["name"]: r["first_rank"] for r in ranks.collect()} == {"c1": 2, "c2": 3, "c3": None}
    row = evaluate.report(ranks).first()
    assert (row["cases"], row["hits"]) == (3, 2) and row["mean_reciprocal_rank"] == pytest.approx((0.5 + 1 / 3) / 3, abs=1e-6)
    empty = evaluate.report(ranks.where("false")).first()
    assert empty["hit_rate"] == 0.0 and empty["mean_reciprocal_rank"] == 0.0
    with pytest.raises(schema.EvaluationCaseWithoutExpected):
        evaluate.check_cases(cases.withColumn("expected", F.array().cast(cases.schema["expected"].dataType)))


def test_activity_log(spark):
    lines = [
        "2024-01-02 03:04:05  serve start  model=M  embeddings=routed", '2024-01-02 03:04:06  find         q="a"  results=2  actual_tok=10  cold_tok=40  ~4.0x saved',
        '2024-01-02 03:04:07  find         q="b"  status=error  msg="x"', "2024-01-02 03:04:08  list_corpora count=3", "not a line",
    ]
    log = observe.parsed(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    assert observe.stats(log).first().asDict() == {"finds": 1, "actual_tokens": 10, "cold_tokens": 40, "ratio": 4.0}
    assert [r["line_no"] for r in observe.recent(log, 2).collect()] == [2, 3]
    assert observe.last_serve(log).first()[0] == "2024-01-02 03:04:05"
    assert spark.range(1).select(observe.utc(F.lit(86399))).first()[0] == "1970-01-01 23:59:59"
