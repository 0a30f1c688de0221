"""Every registered query of the retrieval engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def rows_of(frame, columns):
    plain = lambda v: None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame[columns].itertuples(index=False))


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, views, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), views.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_callees_of_both_kinds(spark, views):
    """Every site has a row for each definition of its supplier and of its part, found by brute force."""
    names = views.execute("SELECT p_partkey, p_name FROM part").fetchall()
    named, count = dict(names), {}
    for _, name in names:
        count[name] = count.get(name, 0) + 1
    calls = views.execute("SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey").fetchall()
    got = registry.QUERIES["graph_callees_all"](spark, SF).toPandas()
    assert len(got) == len(calls) + sum(count[named[k]] for (k,) in calls)
    assert (got["resolved"] == (got["definition_count"] == 1)).all() and set(got["resolved"]) == {True, False}


@pytest.mark.parametrize(("n_parts", "n_sites"), [(60, 400), (400, 60)])
def test_callees_of_one_name_are_dealt(spark, tmp_path, monkeypatch, n_parts, n_sites):
    """Rows of a name that all parts share are those of plain loops, and not all made by one task, whichever side is longer."""
    monkeypatch.setattr("siltstone.operators.graph.PAIRS", 500, raising=False)
    parts, sites = [(i, "nut" if i else "bolt") for i in range(n_parts)], [(i % 50, i % n_parts, 1, i) for i in range(n_sites)]
    tables = {
        "part": (parts, "p_partkey long, p_name string"), "supplier": ([(1, "Acme")], "s_suppkey long, s_name string"), "orders": ([(i,) for i in range(50)], "o_orderkey long"),
        "lineitem": ([*sites, sites[0]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        got = registry.QUERIES["graph_callees_all"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for order, part, _, line in [*sites, sites[0]]:
        want.append((f"order_{order}", "Acme", "supplier/1", line, 1, True))
        named = [f"part/{i}" for i, name in parts if name == parts[part][1]]
        want += [(f"order_{order}", parts[part][1], i, line, len(named), len(named) == 1) for i in named]
    columns = ["symbol", "callee", "definition_id", "site", "definition_count", "resolved"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want)
    assert got.groupby("task").size().max() < len(got) / 2


def join_rows(node):
    """Rows out of each join of a plan that ran."""
    kind = node.nodeName()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in kind else [node.children().apply(i) for i in range(node.children().size())]
    return [*([node.metrics().get("numOutputRows").get().value()] if "Join" in kind else []), *(n for x in below for n in join_rows(x))]


@pytest.mark.parametrize(("n_parts", "n_sites"), [(100, 300), (300, 100)])
def test_callees_are_paired_behind_the_joins(spark, monkeypatch, n_parts, n_sites):
    """Dealt callees, a definition without an id among them, equal the plain join's in every column, and no join makes a row for each pair."""
    monkeypatch.setattr("siltstone.operators.graph.PAIRS", 5000)
    monkeypatch.setattr("siltstone.operators.graph.BLOCK", 16, raising=False)
    named = [(None if i == 7 else f"part/{i}", f"path{i % 5}", i, "nut" if i else "bolt") for i in range(n_parts)]
    chunks = spark.createDataFrame([*named, *((f"order/{i}", "order", i, f"order_{i}") for i in range(20))], "id string, source_path string, byte_start long, symbol string")
    sites = [(f"order/{i % 20}", i, i + 1, 0, 0, ("nut", "nut", "bolt", "undefined")[i % 4]) for i in range(n_sites)]
    edges = spark.createDataFrame(sites, "src_chunk_id string, byte_start long, byte_end long, line_start long, line_end long, dst_symbol string")
    want = graph.callees(chunks, edges, chunks.select("symbol")).collect()
    dealt = graph.callees(chunks, edges, chunks.select("symbol"), dealt=True)
    got = dealt.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(got) == n_sites // 2 * (n_parts - 1) + n_sites // 4
    assert max(join_rows(dealt._jdf.queryExecution().executedPlan())) < len(got) / 3
