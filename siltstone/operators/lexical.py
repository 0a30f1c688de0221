"""Lexical retrieval over a table of queries: substring, BM25, reranked.

``queries`` has (query_id, query); a single search is its one-row case.  ``chunks`` has the
chunk columns.  Results carry (query_id, rank, ...) and follow one total order.

BM25 reads an ``Index`` (postings and lengths that the store keeps) or, without one, the chunks.
A set of queries of up to ``SENT_TOKENS`` tokens is sent to the chunks: one pass counts the
tokens' chunks, a second scores each batch against all queries as a sparse product and keeps
the best in the task, so nothing of the corpus is shuffled.  A larger set is joined with the
postings of its terms.  Substrings work alike.  Texts are shuffled for the winners only; equal
texts are told by a digest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import TOTAL_ORDER, EmptyQuery, InvalidLimit, NoSearchTerms
from .nearest import KEYS, Best, result_type

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
DIGITS = 6
#: Tokens of all queries, or bytes of all substrings, that are sent to every task; a larger set is joined.
SENT_TOKENS = 1 << 20
SENT_BYTES = 1 << 24


def check_query(query: str, limit: int) -> str:
    query = query.strip()
    if not query:
        raise EmptyQuery("the query is empty")
    if limit < 1:
        raise InvalidLimit(f"limit {limit}")
    return query


def check_terms(query: str) -> None:
    if not any(c.isalnum() or c == "_" for c in query):
        raise NoSearchTerms(query)


def ranked(hits: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """Adds ``rank`` per query by ``order`` and the total order; keeps the first ``limit``."""
    window = Window.partitionBy("query_id").orderBy(*order, *TOTAL_ORDER)
    out = hits.withColumn("rank", F.row_number().over(window))
    return out.where(F.col("rank") <= limit) if limit else out


def deduplicated(hits: DataFrame, limit: int) -> DataFrame:
    """Keeps the best-ranked hit of each ``digest`` of a query, then the first ``limit``, ranked anew."""
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "digest").orderBy("rank"))).where("nth = 1")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return first.withColumn("rank", again).where(F.col("rank") <= limit).drop("nth", "digest")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def find_substring(chunks: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Chunks that hold the lower-cased query; the score counts its non-overlapping occurrences.

    A token inside a query, between two others, is a whole token wherever the query occurs: chunks
    and queries meet on the longest such one.  Shorter queries are tried on every chunk.
    """
    needle = queries.select("query_id", F.lower(F.trim("query")).alias("needle")).where("needle <> ''").withColumn("own", T.tokens(F.col("needle")))
    inner = F.slice("own", 2, F.greatest(F.size("own") - 2, F.lit(0)))
    needle = needle.withColumn("anchor", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("token"))))["token"]).drop("own")
    n, size = needle.agg(F.count(F.lit(1)), F.sum(F.octet_length("needle"))).first()
    scored = _substrings_sent(chunks, needle, limit) if n and size <= SENT_BYTES else _substrings_joined(chunks, needle)
    best = ranked(scored, F.desc("score"), limit=limit)
    return best.drop("source_path", "byte_start").join(chunks, "id")


def _substrings_joined(chunks: DataFrame, needle: DataFrame) -> DataFrame:
    slim = chunks.select("id", F.lower("text").alias("lowered"))
    holds = F.col("lowered").contains(F.col("needle"))
    short = slim.join(needle.where("anchor is null").select("query_id", "needle"), holds)
    anchors = needle.where("anchor is not null")
    met = slim.select("id", F.explode(F.array_distinct(T.tokens(F.col("lowered")))).alias("anchor")).join(anchors.select("query_id", "anchor"), "anchor").select("id", "query_id")
    long = met.join(slim, "id").join(anchors.select("query_id", "needle"), "query_id").where(holds)
    hits = short.select("query_id", "id", "lowered", "needle").unionByName(long.select("query_id", "id", "lowered", "needle"))
    scored = hits.select("query_id", "id", T.occurrences(F.col("lowered"), F.col("needle")).cast("double").alias("score"))
    return scored.join(chunks.select(*KEYS), "id")


def _substrings_sent(chunks: DataFrame, needle: DataFrame, limit: int) -> DataFrame:
    asked = needle.toArrow()
    ids, needles, anchors = asked.column("query_id").to_pandas().to_numpy(), asked.column("needle").to_pylist(), asked.column("anchor").to_pylist()
    by_anchor: dict[str, list[int]] = {}
    for k, anchor in enumerate(anchors):
        if anchor is not None:
            by_anchor.setdefault(anchor, []).append(k)
    values, short = pa.array(list(by_anchor), pa.string()), [k for k, anchor in enumerate(anchors) if anchor is None]
    groups = list(by_anchor.values())
    rows = chunks.select(*KEYS, F.lower("text").alias("lowered"))
    rows = rows.withColumn("tokens", F.array_distinct(T.tokens(F.col("lowered")))) if groups else rows.withColumn("tokens", F.array().cast("array<string>"))
    made, schema = result_type(rows, needle)

    def run(batches):
        best = Best(ids, limit, schema)
        for batch in batches:
            tokens = batch.column("tokens")
            code = pc.index_in(tokens.flatten(), value_set=values)
            at = np.flatnonzero(np.asarray(code.is_valid()))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))[at]
            pairs = [(i, k) for i, c in zip(owner.tolist(), code.take(pa.array(at)).to_pylist(), strict=True) for k in groups[c]]
            pairs += [(i, k) for i in range(batch.num_rows) for k in short]
            met = sorted({i for i, _ in pairs})
            texts = {i: t for i, t in zip(met, batch.column("lowered").take(pa.array(met, pa.int64())).to_pylist(), strict=True) if t is not None}
            found = [(i, k, float(n)) for i, k in pairs if i in texts and (n := texts[i].count(needles[k]))]
            if found:
                row, query, score = (np.array(c) for c in zip(*found, strict=True))
                best.add(batch.select(KEYS).to_pandas(), row, query, score)
        yield from best.table().to_batches()

    return rows.mapInArrow(run, made)


@dataclass
class Index:
    """``postings``: (term, id, dl, positions), one row for each term of a chunk; ``lengths``: (id, dl) of every chunk."""

    postings: DataFrame
    lengths: DataFrame


def _terms(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select("id", *more, T.index_terms(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, dl, positions): the inverted index, for the store to keep."""
    placed = _terms(chunks).select("id", "dl", F.posexplode("terms").alias("pos", "term"))
    return placed.groupBy("term", "id", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(chunks: DataFrame) -> DataFrame:
    return _terms(chunks).select("id", "dl")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, parts): distinct query tokens in first-seen order, each with its index terms (a phrase if several)."""
    own = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    return own.withColumn("parts", T.index_terms(F.col("token"))).where(F.size("parts") > 0)


def bm25(chunks: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """(query_id, id, score) of every chunk that matches any token; higher is better."""
    return _scored(chunks, queries, index).select("query_id", "id", "score")


def _scored(chunks: DataFrame, queries: DataFrame, index: Index | None, limit: int | None = None) -> DataFrame:
    """As bm25, with source_path and byte_start; with a ``limit`` only what can be among the best of a query."""
    wanted = query_terms(queries)
    if index is None and limit:
        n = wanted.count()
        if 0 < n <= SENT_TOKENS:
            return _scored_sent(chunks, wanted, limit)
    phrases = wanted.where(F.size("parts") > 1).select("token", "parts").distinct()
    with_phrases = not phrases.isEmpty()
    vocabulary = wanted.select(F.explode("parts").alias("term")).distinct()
    if index is None:
        key = ["id", "source_path", "byte_start"]
        placed = _terms(chunks, *key[1:]).select(*key, "dl", F.posexplode("terms").alias("pos", "term")).join(vocabulary, "term", "left_semi")
        matched = placed.groupBy("term", *key, "dl").agg(F.count(F.lit(1)).alias("f"), *([F.collect_list("pos").alias("positions")] if with_phrases else []))
        told = _terms(chunks)
    else:
        key = ["id"]
        matched = index.postings.join(vocabulary, "term", "left_semi").withColumn("f", F.size("positions").cast("bigint"))
        told = index.lengths
    # A chunk without index terms still counts in N and the mean length.
    stats = told.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))
    single = wanted.where(F.size("parts") == 1).select("token", F.col("parts")[0].alias("term")).distinct()
    hits = matched.join(single, "term").select("token", *key, "dl", "f")
    if with_phrases:
        parts = phrases.select("token", F.size("parts").alias("length"), F.posexplode("parts").alias("j", "term"))
        places = matched.select("term", *key, "dl", F.explode("positions").alias("pos")).join(parts, "term")
        starts = places.groupBy("token", "length", *key, "dl", (F.col("pos") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("met")).where("met = length")
        hits = hits.unionByName(starts.groupBy("token", *key, "dl").agg(F.count(F.lit(1)).alias("f")))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    idf = F.greatest(F.log((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # The statistics are one row.
    weighed = hits.join(df, "token").crossJoin(F.broadcast(stats)).select("token", *key, part.alias("part"))
    scores = weighed.join(wanted.select("token", "query_id"), "token").groupBy("query_id", *key).agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return scores if index is None else scores.join(chunks.select("id", "source_path", "byte_start"), "id").select("query_id", "id", "source_path", "byte_start", "score")


class _Sent:
    """The queries' tokens as codes: what each task needs to match and score a batch."""

    def __init__(self, wanted: pa.Table) -> None:
        tokens: dict[str, int] = {}
        codes: dict[str, int] = {}
        ids: dict = {}
        pairs = []
        for query_id, token, parts in zip(*(wanted.column(c).to_pylist() for c in ("query_id", "token", "parts")), strict=True):
            for p in parts:
                codes.setdefault(p, len(codes))
            pairs.append((tokens.setdefault(token, len(tokens)), ids.setdefault(query_id, len(ids))))
        parts = {t: [codes[p] for p in own] for t, own in zip(wanted.column("token").to_pylist(), wanted.column("parts").to_pylist(), strict=True)}
        self.terms, self.n_tokens = pa.array(list(codes), pa.string()), len(tokens)
        self.query_ids = np.array(list(ids), dtype=object)
        # A term is a token of its own at most once for each spelling; the rest of the tokens are phrases.
        self.single = sorted((own[0], tokens[t]) for t, own in parts.items() if len(own) == 1)
        self.phrases = [(tokens[t], own) for t, own in parts.items() if len(own) > 1]
        token, query = (np.array(c, dtype=np.int64) for c in zip(*sorted(pairs), strict=True))
        self.query_of, self.starts = query, np.searchsorted(token, np.arange(len(tokens) + 1))

    def matches(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, token, times, dl by row) of the tokens that occur in each row."""
        sizes = np.diff(terms.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.terms), -1).to_numpy().astype(np.int64)
        n = max(1, len(self.terms))
        key, times = np.unique((row * n + code)[code >= 0], return_counts=True)
        of_row, of_code = key // n, key % n
        first, own = (np.array(c, dtype=np.int64) for c in zip(*self.single, strict=True)) if self.single else (np.zeros(0, dtype=np.int64),) * 2
        a, b = np.searchsorted(first, of_code), np.searchsorted(first, of_code, side="right")
        at = np.repeat(np.arange(len(key)), b - a)
        token = own[np.arange(len(at)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)] if len(at) else np.zeros(0, dtype=np.int64)
        found = [(of_row[at], token, times[at])]
        for phrase, parts in self.phrases:
            m = len(code) - len(parts) + 1
            if m > 0:
                met = row[:m] == row[len(parts) - 1 :]
                for j, c in enumerate(parts):
                    met &= code[j : j + m] == c
                own_row, n_met = np.unique(row[:m][met], return_counts=True)
                found.append((own_row, np.full(len(own_row), phrase), n_met))
        return *(np.concatenate(c) for c in zip(*found, strict=True)), sizes


def _scored_sent(chunks: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, source_path, byte_start, score): the ``limit`` best of each task, in two passes over the chunks."""
    sent = _Sent(wanted.toArrow())
    rows = chunks.select(*KEYS, T.index_terms(F.col("text")).alias("terms"))
    made, schema = result_type(rows, wanted)

    def count(batches):
        df, n, size = np.zeros(sent.n_tokens, dtype=np.int64), 0, 0
        for batch in batches:
            _, token, _, sizes = sent.matches(batch.column("terms"))
            df += np.bincount(token, minlength=sent.n_tokens)
            n, size = n + len(sizes), size + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([*np.flatnonzero(df).tolist(), -1, -2]), pa.array([*df[df > 0].tolist(), n, size])], ["token", "n"])

    counts = {r["token"]: r["n"] for r in rows.select("terms").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n_chunks = counts.pop(-1, 0)
    mean = counts.pop(-2, 0) / max(1, n_chunks)
    df = np.zeros(sent.n_tokens)
    df[list(counts)] = list(counts.values())
    idf = np.maximum(np.log((n_chunks - df + 0.5) / (df + 0.5)), IDF_FLOOR)

    def run(batches):
        best, n_queries = Best(sent.query_ids, limit, schema), len(sent.query_ids)
        step = max(1, (1 << 22) // n_queries)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, token, times, sizes = sent.matches(batch.column("terms"))
                weight = idf[token] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[row] / mean))
                n_own = sent.starts[token + 1] - sent.starts[token]
                each = np.repeat(np.arange(len(token)), n_own)
                query = sent.query_of[np.arange(len(each)) - np.repeat(np.cumsum(n_own) - n_own, n_own) + np.repeat(sent.starts[token], n_own)]
                pair = row[each] * n_queries + query
                score = np.round(np.bincount(pair, weight[each], batch.num_rows * n_queries), DIGITS)
                met = np.flatnonzero(np.bincount(pair, minlength=batch.num_rows * n_queries))
                best.add(batch.select(KEYS).to_pandas(), met // n_queries, met % n_queries, score[met])
        yield from best.table().to_batches()

    return rows.mapInArrow(run, made)


def find_bm25(chunks: DataFrame, queries: DataFrame, limit: int = 10, index: Index | None = None) -> DataFrame:
    """The ``limit`` best chunks of each query by BM25, texts not deduplicated."""
    best = ranked(_scored(chunks, queries, index, limit), F.desc("score"), limit=limit)
    return best.drop("source_path", "byte_start").join(chunks, "id")


def rerank_candidates(limit: int) -> int:
    return min(max(limit * 20, 500), 5000)


def find_reranked(chunks: DataFrame, queries: DataFrame, limit: int = 10, index: Index | None = None) -> DataFrame:
    """BM25 candidates ordered by phrase, coverage and a blended score; one hit for each text."""
    many = rerank_candidates(limit)
    candidates = ranked(_scored(chunks, queries, index, many), F.desc("score"), limit=many).drop("rank").withColumnRenamed("score", "s")
    asked = queries.select(
        "query_id", T.tokens(F.col("query")).alias("all_tokens"),
        F.array_distinct(F.transform(F.filter(T.raw_tokens(F.col("query")), T.is_identifier), F.lower)).alias("symbols"),
    ).withColumn("unique", F.array_distinct("all_tokens"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    asked = asked.select("query_id", spaced("all_tokens").alias("wanted"), "unique", "symbols")
    # What the order needs of a text is made once for each text, not for each pair.
    own = chunks.select("id", digest(F.col("text")).alias("digest"), T.tokens(F.col("text")).alias("tokens"), T.tokens(T.first_line(F.col("text"))).alias("head"))
    own = own.select("id", "digest", spaced("tokens").alias("held"), F.array_distinct("tokens").alias("tokens"), "head")
    size = F.size("unique")
    hits = candidates.join(own, "id").join(asked, "query_id").select(
        "query_id", "id", "source_path", "byte_start", "digest", "s", size.alias("size"), F.contains("held", "wanted").cast("int").alias("phrase"),
        F.size(F.array_intersect("unique", "tokens")).alias("coverage"), F.size(F.array_intersect("symbols", "head")).alias("signature"),
    )
    score = 2 * F.col("phrase") + F.col("coverage") / F.col("size") + F.col("signature") / F.col("size") + F.col("s") / (1 + F.abs("s"))
    hits = hits.withColumn("score", F.round(score, DIGITS)).drop("signature", "s", "size")
    best = deduplicated(ranked(hits, F.desc("phrase"), F.desc("coverage"), F.desc("score")), limit)
    return best.drop("source_path", "byte_start").join(chunks, "id")
