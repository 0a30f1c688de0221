"""Language ID, quality rules and quality classifier on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import langid, quality_fm, quality_rules
from siltstone.llm import text_stats as ts
from siltstone.llm._common import bounded_sample

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
SF = "/root/testdata/sf0.001"
#: Nulls in any column, blanks, ties, repeated rows, a very long text; a column that clashes with an output.
ODD = [
    (1, None, "en", "s", None, "x"), (2, "", None, None, 0, "x"), (None, "some words here", "en", "s", 1, None), (3, " \t\n ", "en", "s", 1, "x"),
    (4, "12 34 !!", "en", "s", 1, "x"), (5, "the same text of words", "en", "s", 1, "x"), (6, "the same text of words", "fr", "s", 1, "x"),
    (6, "the same text of words", "fr", "s", 1, "x"), (7, "lorem ipsum dolor sit " * 20000, "en", "s", 1, "x"),
]


def reference_stats(text):
    """The statistics by their definitions, plainly."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b\x85c d", "x#y |z <é>", "l\nl\n\n\nl \nl", "a b c d e a b c d e f", "a b c d a b c d", "w " * 50, "é ü\x1cñ 😀"])
def test_base_statistics(text):
    got = ts.base_stats(text)
    assert (len(got[0]), *got[1:5]) == reference_stats(text)


def test_base_statistics_on_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n\t#|é"), rng.integers(0, 60)))
        got = ts.base_stats(text)
        assert (len(got[0]), *got[1:5]) == reference_stats(text)


def test_trees_obey_monotonic_constraints_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.05)).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([-1, 1, 0]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    for j, sign in ((0, -1), (1, 1)):
        grid = np.repeat(rng.random((50, 3))[:, None, :], 40, axis=1)
        grid[:, :, j] = np.linspace(0, 1, 40)
        scores = trees.score(grid.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(scores, axis=1) >= -1e-12).all()
    assert len(quality_rules.fit_trees(x, np.ones(600), np.zeros(3)).score(x)) == 600


def test_tree_scores_equal_a_plain_walk():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(500, 4)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(scale=0.3, size=500) > 0.8).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([1, 0, 0, -1]), rounds=15)
    assert len(trees.feature) == 15

    def walk(row):
        total = trees.bias
        for feature, threshold, value in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist(), strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 2 if row[feature[at]] > threshold[at] else 2 * at + 1
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    fresh = np.concatenate([x, np.round(rng.normal(scale=3, size=(200, 4)), 1), np.array([[np.inf, -np.inf, 0, 0]])])
    assert np.allclose(trees.score(fresh), [walk(r) for r in fresh.tolist()])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85


def test_quality_rules_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    trees = quality_rules.fit_quality_trees(docs, labels)
    rows = quality_rules.apply_rules(docs, trees).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[7]["n_words"] == 80000 and by[7]["n_repeat_words"] == 80000 and by[7]["base_failed"]
    kept = quality_rules.apply_rules(docs, trees, passthrough=True)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    empty = docs.where("false")
    none = quality_rules.fit_quality_trees(empty, labels.where("false"))
    assert quality_rules.apply_rules(empty, none).count() == 0


def test_quality_rules_agree_with_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.apply_rules(docs, quality_rules.fit_quality_trees(docs, labels)).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in got]) > 0.9


def test_bounded_sample_is_bounded_and_balanced(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    got = {r["y"]: r["count"] for r in bounded_sample(keys, "y", 150, 2, 1).groupBy("y").count().collect()}
    assert 100 < got[0] < 200 and 100 < got[1] < 201
    with pytest.raises(ValueError):
        bounded_sample(keys.withColumn("y", F.col("doc_id") % 3), "y", 10, 2, 1)


def test_language_tables_equal_the_convolution():
    rng = np.random.default_rng(2)
    model = langid.train(["abc def " * 40, "xyz uvw " * 40], ["a", "b"], epochs=1)
    windows = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    e, pooled = model.embed[windows], []
    for w, f, b in zip(langid.WIDTHS, model.filters, model.bias, strict=True):
        z = sum(e[:, j : langid.WINDOW - w + 1 + j] @ f[j] for j in range(w)) + b
        pooled.append(z.max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ model.out + model.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(model.probabilities(windows, model.tables()), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit_langid(docs.where(~held))
    got = langid.identify(docs.where(held), model).join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)


def test_language_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    model = langid.fit_langid(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by[5]["score"] == by[6]["score"] and by[7]["lang_pred"] in ("en", "fr")
    assert langid.keep_identified(docs, model, 0.0).count() == 5
    assert langid.fit_langid(docs.where("false")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_numerals_are_no_letters_and_many_languages_are_learned(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} " * 30, f"l{i:03d}") for i in range(80)], "doc_id bigint, text string, lang string")
    model = langid.fit_langid(docs)
    assert len(model.languages) == 80
    odd = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167 12 __ !"), (2, "\u00bd \u00aa"), (3, "5 \u4e2d")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in langid.identify(odd, model).collect()} == {1: True, 2: False, 3: False}
    # Without a column lang the other columns are left as they are.
    assert sorted(r["doc_id"] for r in langid.keep_identified(odd.withColumn("last", F.lit(None).cast("string")), model, 0.0).where("last is null").collect()) == [2, 3]


def test_registered_queries_give_a_boolean_for_a_null_id(spark, tmp_path):
    from siltstone.llm import queries

    docs = spark.createDataFrame([*ODD, *((100 + i, f"some plain words of text {i}", "en", "s", 1, "x") for i in range(20))], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op1_language_id", "op6_quality_classifier"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == docs.count() and all(isinstance(r["held_out"], bool) for r in rows)


def test_machine_scores_equal_the_pairwise_sum():
    rng = np.random.default_rng(3)
    size = quality_fm.WORD_BUCKETS + quality_fm.BINS * len(ts.FEATURES) + quality_fm.LENGTH_CLASSES
    fm = quality_fm.FactorisationMachine([np.zeros(0)] * len(ts.FEATURES), 0.3, rng.normal(size=size), rng.normal(size=(size, 4)))
    raw = [quality_fm.raw_inputs(t, quality_fm.Hasher()) for t in ("a few words", None, "x")]
    indices, values, starts = fm.rows(raw)
    ends = np.append(starts[1:], len(indices))
    for k, got in enumerate(fm.raw_score(indices, values, starts)):
        own, x = indices[starts[k] : ends[k]], values[starts[k] : ends[k]]
        want = 0.3 + (fm.w[own] * x).sum()
        want += sum((fm.v[own[i]] @ fm.v[own[j]]) * x[i] * x[j] for i in range(len(own)) for j in range(i + 1, len(own)))
        assert got == pytest.approx(want)


def test_machine_held_out_and_odd_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality_fm.fit_quality_fm(docs, labels.where(~held))
    got = quality_fm.score_quality(docs.where(held), model).join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    odd = quality_fm.score_quality(spark.createDataFrame(ODD, DOCS), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in odd)
    none = quality_fm.fit_quality_fm(docs.where("false"), labels)
    assert {r["score"] for r in quality_fm.score_quality(docs.limit(3), none).collect()} == {0.5}
