"""Every stage of the pipeline, and the whole of it, against plain loops over the rows of a small odd table."""

import importlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_joins import brute_mix
from tokenizers import Tokenizer

from siltstone.llm import langid, mixing, quality_rules
from siltstone.llm import text_stats as ts
from siltstone.llm.tokenize import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASHES = [
    "draw", "epoch", "block", "place", "tokens", "doc", "owed", "bucket", "bin", "fill", "offset", "piece", "k0", "k1", "k2", "own_k1", "missing",
    "component", "component_id", "least", "node", "n", "sig", "bits", "hot", "label", "stay_id", "y", "share", "windows", "score", "kept", "lang_pred",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of documents and labels: the smallest test table and odd rows, with clashing columns."""
    at = tmp_path_factory.mktemp("odd")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    own = [tuple(r) for r in documents.collect()]
    rng = random.Random(3)
    whole = sorted((r for r in own if len(WORD.findall(r[1] or "")) > 200), key=lambda r: r[0])[:6]
    vary = lambda text, k: " ".join(f"edit{k}" if i == 7 * k else w for i, w in enumerate(WORD.findall(text)))
    odd = [
        (1000, "", "en", "src0", 0), (1001, None, "en", "src0", None), (None, None, None, None, None), (1002, " \n\t", None, "src1", 3), (1003, "12 34 ½ %", None, None, None),
        (None, whole[0][1], "en", "src0", 1),  # a copy without an id
        *((2000 + k, vary(whole[1][1], k), whole[1][2], None, k) for k in range(5)),  # near copies of no source
        (None, vary(whole[2][1], 3), None, "src2", 1), (whole[3][0], whole[4][1] + " and more of it", None, "src2", 1),  # an id with another text
        *[(3000, vary(whole[5][1], 9), whole[5][2], "src1", 5)] * 3,  # repeated rows
        (4000, " ".join(rng.choice(whole)[1] if k % 3 else f"word{k} and word{k + 1}" for k in range(120)), None, "src3", 1),  # a long text
    ]
    table = spark.createDataFrame(own + odd, documents.schema)
    table = table.select("*", *(F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, F.col("doc_id")).alias(c) for c in CLASHES))
    table.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


def good(row, trees):
    words = WORD.findall(row["text"] or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, again = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            again |= set(range(i, i + 5))
    if len(words) < 10 or 100 * len(again) > 20 * len(words):
        return False
    x, total = ts.features(ts.base_stats(row["text"])), trees.bias
    for feature, threshold, value in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist(), strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + 2 if x[feature[at]] > threshold[at] else 2 * at + 1
        total += value[at - len(feature)]
    return 1 / (1 + np.exp(-total)) >= 0.5


def plain_language(text, model):
    """(language, score) by the convolution's definition; None without letters."""
    if not any(c.isalpha() for c in text or ""):
        return None
    data, weighted = text.lower().encode(), 0
    for at in range(0, len(data), langid.WINDOW):
        own = data[at : at + langid.WINDOW]
        e, pooled = model.embed[np.frombuffer(own.ljust(langid.WINDOW, b"\0"), dtype=np.uint8)], []
        for w, f, b in zip(langid.WIDTHS, model.filters, model.bias, strict=True):
            pooled.append((sum(e[j : langid.WINDOW - w + 1 + j] @ f[j] for j in range(w)) + b).max(axis=0))
        z = np.maximum(np.concatenate(pooled), 0) @ model.out + model.out_bias
        p = np.exp(z - z.max())
        weighted = weighted + len(own) * p / p.sum()
    k = int(weighted.argmax())
    return model.languages[k], weighted[k] / len(data)


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(rows):
    """Lists of rows that links reach from each other; rows without words are groups of equal ids, or alone without one."""
    sets, top = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) or not sets[i] and not sets[j] and rows[i]["doc_id"] is not None and rows[i]["doc_id"] == rows[j]["doc_id"]:
                top[max(find(i), find(j))] = min(find(i), find(j))
    made = {}
    for i, r in enumerate(rows):
        made.setdefault(find(i), []).append(r)
    return list(made.values())


def pieces(rows):
    tokenizer, out = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            out[(r["doc_id"], k, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))] += 1
    return out


def check(spark, name, docs, out, folder):
    """The rows of ``out`` are those that stage ``name`` has to make of ``docs``."""
    rows, got = docs.collect(), out.collect()
    if name != "best_fit_packing":
        assert out.columns == docs.columns
    if name == "quality_rules":
        trees = quality_rules.fit_quality_trees(docs, spark.read.parquet(f"{folder}/labels.parquet"))
        assert Counter(got) == Counter(r for r in rows if good(r, trees))
    elif name == "language_id":
        model, want = langid.fit_langid(docs), Counter()
        for r in rows:
            found = plain_language(r["text"], model)
            if found and found[1] >= 0.5:
                want[(*r[:2], r["lang"] or found[0], *r[3:])] += 1
        assert Counter(map(tuple, got)) == want
    elif name == "ngram_jaccard_join":
        groups, left = groups_of(rows), Counter(got)
        for group in groups:
            ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
            stays = [r for r in set(group) if r["doc_id"] == (min(ids) if ids else None) and left[r]]
            assert stays, group[0]["doc_id"]
            left[stays[0]] -= 1
        assert not any(left.values())
    elif name == "source_mixing":
        totals = {}
        for r in rows:
            totals[r["source"]] = totals.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
        sources = spark.createDataFrame([(n,) for n in totals.values() if n], "tokens bigint")
        a = mixing.exponent(sources, mixing.TARGET_ENTROPY_SHARE, importlib.import_module("corpus_pipeline").MAX_REPETITION, None, float(sum(totals.values())), sources.count())
        want = Counter((r[0], r[1], r[2]) for r in brute_mix(spark, docs, a, None))
        key = lambda r: (r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")))
        # A pass takes all rows of equal id, source and text as soon as it takes the first.
        copies = Counter(map(key, rows))
        assert Counter(map(key, got)) == {k: -(-n // copies[k]) * copies[k] for k, n in want.items()}
        assert set(got) == set(rows)
    else:
        assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == pieces(rows)
        held = {}
        for r in got:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in held.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(own[-1]) <= 2048
        assert len(held) <= -(-sum(r["length"] for r in got) // 2048) + 2


def test_stages_and_run_equal_plain_loops(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [at.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, folder).cache()
        check(spark, name, at, out, folder)
        at = out
        sizes.append(at.count())
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[4] >= sizes[3]
    got = Counter(tuple(r) for r in pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert got == pieces(at.collect())


@pytest.mark.parametrize("number", range(5))
def test_stage_on_the_odd_table(spark, folder, number):
    """A stage by itself, on rows that the stages before it would have taken out."""
    name, stage = importlib.import_module("corpus_pipeline").STAGES[number]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(spark, name, docs, stage(spark, docs, folder).cache(), folder)
    assert stage(spark, docs.where("false"), folder).count() == 0
