"""Top-k search, n-gram join, components, sharding, mixing."""

import random

import numpy as np
import pytest

from siltstone.llm import mixing, ngram_join, sharding, topk_voronoi
from siltstone.llm.components import components
from pyspark.sql import functions as F


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def fixture(seed):
    """Groups of near copies of all sizes, shared passages, exact copies, and odd rows."""
    rng = random.Random(seed)
    passage, out = words(rng, 60), []
    for _ in range(25):
        base = words(rng, rng.randrange(1, 120))
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            text = " ".join(own)
            out.append(text.upper() if rng.random() < 0.2 else text)
    out += [out[0], out[0], "", None, " \n\t", "a b", "A\tb", "a b c d e", "É a b c d", "é a b c d", "x " * 3000]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # small blocks and chunks, so every path is taken
        for name, value in (("ROWS", 4), ("CHUNK", 400), ("LOCAL_COUNT", 2), ("COMMON_LEAST", 4), ("BLOCK_ENTRIES", 500), ("BITMAP", 64), ("HOT_COLUMN", 5), ("SUB_ROWS", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = fixture(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_shingles", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_ngram_join_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, None), (None, "q r s t u v")]
    got = sorted(map(str, (tuple(r)[:3] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, schema)).collect())))
    want = [(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (7, 0, 7), (None, 2, None)]
    assert got == sorted(map(str, want))
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, schema)).collect()
    # The copy without an id goes, as row 5 stands for it.
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == ["(5, 'a b c d e f')", "(7, None)", "(None, 'q r s t u v')", "(None, None)"]


def test_pairs_of_hot_columns_meet(monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(ngram_join, "SUB_ROWS", 4)
    for base_rows, other_rows in ((30, 9), (3, 2), (10, 40)):
        rows = [(k, 1000) for k in range(base_rows)] + [(500 + k, 2000 + rng.randrange(4)) for k in range(other_rows)]
        parts = lambda n: max(1, -(-n // ngram_join.SUB_ROWS))
        columns = ngram_join._HotColumns(np.array([7, 9], dtype=np.uint64), {7: (1000, parts(base_rows), parts(other_rows))})
        held = {}
        for node, label in rows:
            block, at = columns.blocks(np.array([7, 9, 12], dtype=np.uint64), node, label, 16)
            assert sorted(set(at.tolist())) == [0, 2] and block[at == 2].tolist() == [12]  # a column of one label is left out
            for b in block[at == 0].tolist():
                held.setdefault(b, set()).add((node, label))
        met = {frozenset((x, y)) for own in held.values() for x in own for y in own if x != y}
        assert all(frozenset((x, y)) in met for x in rows for y in rows if x[1] != y[1])
        if len(rows) > 30:
            assert max(map(len, held.values())) < len(rows) - 4


def test_a_text_of_hot_columns_alone(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_COLUMN", 20)
    line, rng = "a b c d e f g h", random.Random(17)
    rows = [(i, line) for i in range(40)] + [(100 + i, f"{line} {' '.join(words(rng, 30))}") for i in range(5)] + [(200, "q r s t u"), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_one_of_each_with_repeated_ids(spark):
    one, two, three = ("a b c d e f g h", "q r s t u v w x", "k l m n o p y z")
    rows = [(5, one, 3), (5, two, 1), (5, one, 2), (6, one, 0), (8, two, 0), (9, three, 7), (9, None, 4), (9, "", 5)]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, k int").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"], r["k"]) for r in kept if r["text"]) == [(5, one, 2), (5, two, 1), (9, three, 7)]
    assert sum(not r["text"] for r in kept) == 1


def test_one_of_each_without_ids_and_with_clashing_columns(spark):
    one, near = " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(39)) + " x"
    rows = [(None, one, 2), (None, near, 1), (None, one, 1), (None, "", 1), (None, "", 1), (None, "other words", 9), (4, None, 0), (4, None, 0)]
    names = ["doc_id", "text", "stay_id"]
    for clash in ("stay_id", "component", "k1", "own_k1", "doc", "node", "missing", "odd name.x"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, stay_id int").withColumnRenamed("stay_id", clash).repartition(2)
        kept = ngram_join.keep_one_of_each(docs)
        assert kept.columns == [*names[:2], clash]
        got = [tuple(r) for r in kept.collect()]
        assert sorted(str(r) for r in got if r[1] not in (one, near)) == sorted(str(r) for r in [*rows[3:6], rows[6]])
        assert [r for r in got if r[1] in (one, near)] in ([(None, one, 1)], [(None, near, 1)])
    empty = docs.where("false")
    assert ngram_join.keep_one_of_each(empty).count() == 0


def test_blocks_of_very_long_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 3000)
    rng = random.Random(11)
    base = words(rng, 1500)
    rows = []
    for i in range(40):  # near copies of one long text
        own = list(base)
        for _ in range(3):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(ngram_join, "CHUNK_BITS", 2048)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    sets = [ngram_join.shingle_set(t, ngram_join._WordHashes()) for _, t in rows]
    bits = [np.frombuffer(ngram_join.bitmap_of(s), dtype=np.uint8) for s in sets]
    assert ngram_join.hopeful_rows(bits, np.array([len(s) for s in sets])).all()
    assert len(set(ngram_join.block_links(sets))) == 1


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    from siltstone.llm._common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (3, None, 5, 100, 1, 1, 1, 1, 0)])], ["text"])
    assert [p.num_rows for p in slices(batch, 3, most_bytes=10)] == [3, 1, 3, 2]
    assert [p.num_rows for p in slices(batch, 100)] == [9] and list(slices(batch.slice(0, 0), 3)) == []


def test_bitmap_bound_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(400):
        base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        other = base.copy()
        k = rng.integers(0, max(1, len(base) // 4) + 1)
        other[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate([other, rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]))
        bits = [np.frombuffer(ngram_join.bitmap_of(s), dtype=np.uint8) for s in (a, b)]
        if ngram_join.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            assert ngram_join.may_link(bits[0], len(a), bits[1], len(b))
            assert ngram_join.hopeful_rows(bits, np.array([len(a), len(b)])).all()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path + star + [(7, 7), (3, 2)], "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_topk(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for at, (q, own) in enumerate(good):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for j, (i, v) in enumerate(good) if j != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (7, 3)])
def test_topk_equals_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk_voronoi, "DATA_BLOCK", blocks[0])
    monkeypatch.setattr(topk_voronoi, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(2)]) for i in range(0, 1500, 5)]
    rows += [(10001 + i, [0.5] * 6) for i in range(40)] + [(10100, [0.5] * 6), (10200, None), (10300, [float("nan")] * 6), (10400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (10500, [float("inf")] * 6), (None, [1.0] * 6), (10600, [3.0, 1.0]), (10700, []), (0, rows[0][1])]
    rows += [(200, [0.25] * 6), (7, rows[1][1]), (7, rows[1][1]), (10800, [0.0] * 6), (10900, [900.0, 0.0, -3.0, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk_voronoi.exact_topk(table, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 10)


def clustered(seed, clusters=40, each=30, width=16, spread=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * rng.choice([0.5, 1, 4], (clusters, 1))
    return [(c * each + i, [float(x) for x in centres[c] + rng.normal(scale=spread, size=width)]) for c in range(clusters) for i in range(each)]


def test_bounds_prune_clustered_vectors(spark):
    rows = clustered(1)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    result, routed, n_cells = topk_voronoi._join(table, F.col("vec_id") % 20 == 0, 10, 1024, "vec_id", "embedding", 60)
    n_queries, met = sum(i % 20 == 0 for i, _ in rows), routed.collect()  # of all pairs, not a third
    assert len(met) == len(set(met)) and len(met) < 0.35 * n_queries * n_cells
    good = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    want = []
    for q, own in good:
        if q % 20 == 0:
            scores = sorted((-int(np.dot(own, v)), i) for i, v in good if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])]
    assert sorted(map(tuple, result.collect())) == sorted(want)


def test_no_row_scores_above_its_cell():
    rng = np.random.default_rng(9)
    for _ in range(40):
        x, pivots = rng.integers(-900, 900, (60, 5)).astype(float), rng.integers(-900, 900, (4, 5)).astype(float)
        own = ((x[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
        summary = []
        for c in np.unique(own):
            v, u = x[own == c], pivots[c] / max(np.linalg.norm(pivots[c]), 1e-300)
            along = v @ u
            summary.append({"cell": c * topk_voronoi.RINGS, "n": len(v), "nq": 0, "far": np.linalg.norm(v - pivots[c], axis=1).max(), "norm": np.linalg.norm(v, axis=1).max(), "low": along.min(), "high": along.max(), "across": np.linalg.norm(v - along[:, None] * u, axis=1).max()})
        cells = topk_voronoi.Cells(pivots, summary)
        q = rng.normal(scale=500, size=(8, 5))
        most = cells.bound(q, cells.middle(q))
        for k, r in enumerate(summary):
            assert ((q @ x[own == r["cell"] // topk_voronoi.RINGS].T).max(axis=1) <= most[:, k]).all()


def test_topk_small_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert topk_voronoi.exact_topk(table([]), F.col("vec_id") % 100 == 0).count() == 0
    assert topk_voronoi.exact_topk(table([(100, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    got = topk_voronoi.exact_topk(table([(100, [1e6]), (3, [2.0]), (2, [2.0])]), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1024000000 * 2048), (3, 1024000000 * 2048)]


def shard(spark, rows, shards=4):
    return sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string, size string"), shards).collect()


def test_sharding_law_slots_and_groups(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 80))), "clash") for i in range(2000)]
    # One group within a shard's capacity, one above it.
    rows += [(30_000 + i, "warm text of some words", "clash") for i in range(1500)] + [(40_000 + i, "hot text of some words", "clash") for i in range(6000)] + [(20_000 + i, rows[0][1], "clash") for i in range(3)] + [(None, None, None), (5, None, "x"), (5, None, "x")]
    got = shard(spark, rows)
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    import zlib

    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert max(sizes) / min(sizes) < 1.02
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(rows[0][1].encode())}) == 1
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"warm text of some words")}) == 1
    hot = [r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot text of some words")]
    assert len(set(hot)) == 2 and min(hot.count(s) for s in set(hot)) > 2700
    assert shard(spark, []) == []
    assert [(r["size"], r["slot"]) for r in shard(spark, [(1, "", "")])] == [(16, 0)]


def brute_place(items, shards):
    """The placement by its definition: largest share first, to the highest dot product where the bytes fit."""
    total = [sum(x[j] for x in items) for j in range(3)]
    capacity = [max(t / shards, 1e-9) for t in total]
    share = [[x[j] / capacity[j] for j in range(3)] for x in items]
    left, out = [[1.0] * 3 for _ in range(shards)], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(share[i]), i)):
        fits = [k for k in range(shards) if left[k][0] >= share[i][0]]
        value = (lambda k: sum(a * b for a, b in zip(share[i], left[k], strict=True))) if fits else (lambda k: left[k][0])
        out[i] = max(fits or range(shards), key=lambda k: (round(value(k), 12), -k))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], share[i], strict=True)]
    return out


def test_placement_equals_its_definition():
    rng = np.random.default_rng(8)
    for n, shards in ((0, 3), (1, 3), (40, 3), (300, 7)):
        items = rng.integers(0, 900, (n, 3)).astype(float) + rng.random((n, 3))
        assert sharding.place(items, shards).tolist() == brute_place(items.tolist(), shards)
    assert sharding.place(np.zeros((5, 3)), 4).tolist() == [0] * 5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_that_fit_a_shard_stay_whole(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sharding.shard_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    capacity, size, where = sum(r["size"] for r in got) / 40, {}, {}
    for r in got:
        key = r["text"] or ""
        size[key] = size.get(key, 0) + r["size"]
        where.setdefault(key, set()).add(r["shard"])
    assert all(len(where[k]) <= max(1, -(-size[k] // capacity)) for k in size)
    assert all(len(where[k]) == 1 for k in size if size[k] <= capacity)
    if sf == "sf0.01":
        shards = [sum(r["size"] for r in got if r["shard"] == s) for s in range(40)]
        assert max(shards) / capacity < 1.05 and min(shards) / capacity > 0.95


def test_rows_without_an_id_are_spread(spark):
    got = shard(spark, [(None, "one text of all rows", "x")] * 4000, 4)
    assert all(800 < sum(r["shard"] == s for r in got) < 1200 for s in range(4))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(4))


def mixed(docs, **more):
    return mixing.mix(docs, **more).select("doc.doc_id", "source", "tokens", "epoch", "block", "place").collect()


def test_mixing_weights_repetition_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, "w " * (5 + i % 7), f"s{0 if i % 3 else i % 5}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    got = mixed(docs, block_tokens=1000, max_repetition=2.0, target_entropy_share=0.99)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and max(r["epoch"] for r in got) == 1
    total = {}
    for r in got:
        total[r["source"]] = total.get(r["source"], 0) + r["tokens"]
    natural = {}
    for _, t, s in rows:
        natural[s] = natural.get(s, 0) + len(t.split())
    # The exponent by plain bisection over the same shares.
    p = {s: n / sum(natural.values()) for s, n in natural.items()}
    low = max(a for a in np.linspace(0, 1, 20001) if -sum(w * np.log(w) for w in [v**a / sum(u**a for u in p.values()) for v in p.values()]) >= 0.99 * np.log(len(p)))
    high = min(a for a in np.linspace(0, 1, 20001) if max(v ** (a - 1) for v in p.values()) / min(v ** (a - 1) for v in p.values()) <= 2.0)
    a = max(low, high)
    owed = {s: natural[s] * (p[s] ** (a - 1)) / min(v ** (a - 1) for v in p.values()) for s in p}
    assert all(abs(total[s] - owed[s]) <= 12 + owed[s] * 2e-3 for s in p)
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r)
    share = [sum(r["tokens"] for r in b if r["source"] == "s0") / sum(r["tokens"] for r in b) for b in blocks.values()]
    assert len(blocks) > 5 and np.std(share) < 0.05


def brute_mix(spark, docs, a, block_tokens, budget=None, seed=5):
    """The stream by its definition, source by source in plain loops; only the hashes are Spark's."""
    hashed = docs.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("draw")).collect()
    sources, rows = {}, {}
    for r in hashed:
        sources[r["source"]] = sources.get(r["source"], 0) + r["tokens"]
        rows.setdefault(r["source"], []).append(r)
    total = sum(sources.values())
    term = {s: (n / total) ** a for s, n in sources.items() if n}
    z, whole = sum(term.values()), budget is None
    budget = z / min(term[s] / sources[s] for s in term) if whole else budget
    block_tokens = block_tokens or max(1, min(mixing.BLOCK_TOKENS, budget / mixing.LEAST_BLOCKS))
    blocks, out = max(1, round(budget / block_tokens)), []
    for source, own in rows.items():
        owed = round(term.get(source, 0) / z * budget)
        owed = max(owed, sources[source]) if whole else owed
        for epoch in range(max(1, -(-owed // max(1, sources[source])))):
            draws = spark.createDataFrame([(r["doc_id"], r["tokens"], r["draw"]) for r in own], "doc_id bigint, tokens bigint, draw bigint")
            order = sorted(draws.select("*", F.xxhash64(F.lit(seed + 1), F.lit(epoch), "draw").alias("o"), F.xxhash64(F.lit(seed + 2), "draw", F.lit(epoch)).alias("place")).collect(), key=lambda r: (r["o"], r["draw"]))
            at = epoch * sources[source]
            for r in order:
                if at < owed or epoch == 0 and at <= owed and not r["tokens"]:
                    out.append((r["doc_id"], source, r["tokens"], epoch, min(blocks - 1, int(at / max(owed, 1) * blocks)), r["place"]))
                at += r["tokens"]
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [None, 9000])
def test_mixed_stream_equals_its_definition(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 30), f"s{rng.choice([0, 0, 0, 0, 1, 1, 2])}" if i % 17 else None) for i in range(900)] + [(2000, None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for block_tokens in (None, 700):
        got = mixing.mix(docs, target_entropy_share=0.995, max_repetition=3.0, budget=budget, block_tokens=block_tokens)
        totals = {}
        for _, text, source in rows:
            totals[source] = totals.get(source, 0) + len((text or "").split())
        sources = spark.createDataFrame([(n,) for n in totals.values() if n], "tokens bigint")
        a = mixing.exponent(sources, 0.995, 3.0, None if budget is None else float(budget), float(sum(totals.values())), sources.count())
        assert 0 < a < 1
        want = brute_mix(spark, docs, a, block_tokens, budget)
        got = sorted((tuple(r) for r in got.select("doc.doc_id", "source", "tokens", "epoch", "block", "place").collect()), key=str)
        assert got == want and len({r[4] for r in got}) >= 10 and max(r[3] for r in got) >= 1


def test_the_registered_mix_changes_the_test_tables(spark):
    from siltstone.llm import queries

    got = queries.QUERIES["op5_source_mixing"](spark, "/root/testdata/sf0.01").select("source", "tokens", "epoch", "block").collect()
    by, natural = {}, {}
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["tokens"]
        natural[r["source"]] = natural.get(r["source"], 0) + r["tokens"] * (r["epoch"] == 0)
    spread = lambda x: max(x.values()) / min(x.values())
    assert max(r["epoch"] for r in got) >= 1 and len({r["block"] for r in got}) == mixing.LEAST_BLOCKS and spread(by) < 0.8 * spread(natural)


def test_mixing_budget_and_odd_tables(spark):
    schema = "doc_id bigint, text string, source string"
    docs = spark.createDataFrame([(i, "w w w w", "a" if i % 4 else "b") for i in range(400)], schema)
    got = mixed(docs, budget=800, max_repetition=0, target_entropy_share=1.0)
    by = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in "ab"}
    assert by == {"a": 400, "b": 400}
    odd = [(1, None, None), (None, "a b", None), (2, "", "s"), (2, "c d", "s"), (2, "c d", "s")]
    got = mixed(spark.createDataFrame(odd, schema), max_repetition=1.0)
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in got) == [("1", 0), ("2", 0), ("2", 2), ("2", 2), ("None", 2)]
    assert mixed(spark.createDataFrame([], schema)) == []
    assert len(mixed(spark.createDataFrame([(1, None, "s"), (2, "", "s")], schema))) == 2
