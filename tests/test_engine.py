"""The engine end to end on a directory, code extraction, sources and streaming."""

import json
import os

import pytest

from siltstone import schema
from siltstone.operators import code
from siltstone.operators.vector import KeywordProvider
from siltstone.plans.engine import Engine
from siltstone.sources import corpus, manifests

RUST = '''/// Adds.
/// Two.
pub fn add(a: i32) -> i32 {
    helper(a); // not_a_call()
    let s = "fake_call()"; self.method(); mod_a::path_call::<u8>(s); println!("x {}", other(1))
}

// plain comment
impl<T> Show for Foo<T> {
    fn show(&self) { draw() }
}
struct Foo;
use x::y;
macro_rules! m { () => {} }
'''


def names(rows):
    return [(r["text"].strip().splitlines()[0], r["symbol"]) for r in rows]


def test_rust_items_symbols_and_calls():
    rows = code.scan("lib.rs", "h", RUST, "tree-sitter-rust-v1")
    assert names(rows) == [("/// Adds.", "add"), ("impl<T> Show for Foo<T> {", "Foo"), ("struct Foo;", "Foo"), ("macro_rules! m { () => {} }", "m")]
    assert [e["dst_symbol"] for e in rows[0]["edges"]] == ["helper", "path_call", "println", "other"]
    assert [e["dst_symbol"] for e in rows[1]["edges"]] == ["draw"]
    e = rows[0]["edges"][0]
    assert RUST.encode()[e["byte_start"] : e["byte_end"]] == b"helper" and e["line_start"] == 4


def test_typescript_items():
    text = "import a from 'b';\nfunction greet(n: string): string {\n  return `Hi ${n} {`;\n}\n\n/**\n * Doc.\n */\nexport class A {\n  m() {}\n}\n\n/** far */\n\nexport type S = \"a\" | \"b\";\nasync function f() { return fetch('}'); }\n"
    rows = code.scan("a.ts", "h", text, "tree-sitter-typescript-v1")
    assert [n for n, _ in names(rows)] == ["function greet(n: string): string {", "/**", 'export type S = "a" | "b";', "async function f() { return fetch('}'); }"]


def test_python_and_ruby_items():
    text = "import os\n@deco(1)\nasync def é(a):\n    return a\n\nclass B:\n    def m(self): pass\n"
    rows = code.scan("a.py", "h", text, "tree-sitter-python-v1")
    assert [r["text"] for r in rows] == ["@deco(1)\nasync def é(a):\n    return a", "class B:\n    def m(self): pass"]
    assert text.encode()[rows[1]["byte_start"] : rows[1]["byte_end"]].decode() == rows[1]["text"]
    ruby = "# Doc.\ndef greet(n)\n  if n then puts 'end' end\n  [1].each do |x|\n    y if x\n  end\nend\n\n# far\n\nmodule Pay\n  def self.go; end\nend\n"
    assert [n for n, _ in names(code.scan("a.rb", "h", ruby, "tree-sitter-ruby-v1"))] == ["# Doc.", "module Pay"]
    assert code.scan("b.py", "h", "def broken(", "tree-sitter-python-v1") == []


def texts(path, text, extractor):
    return [r["text"] for r in code.scan(path, "h", text, extractor)]


def test_headers_of_code_are_made_by_one_scan(spark, tmp_path):
    from siltstone.plans import registry_code

    for t in registry_code.TEMPLATES:
        spark.range(1, 4).withColumnRenamed("id", t.key).write.parquet(f"{tmp_path}/{t.table}.parquet")
    made = registry_code.code_headers(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert made.count() == 3 * (5 + 4 + 2 + 2) and made.where("signature is not null and slim_synopsis is not null").count() == 0


def test_an_error_costs_its_own_item_only():
    first, second = "@deco\ndef one(a):\n    return '''\ndef inside(): pass\n'''", "class Two:\n    x = (1,\n  2)\n\n    def m(self): pass"
    text = f"import os\n{first}\n\n{second}\nx = = 1\ndef broken(:\n    pass\nasync def three(): return 3  # end\n"
    assert texts("a.py", text, "tree-sitter-python-v1") == [first, second, "async def three(): return 3"]
    whole = text.replace("x = = 1\ndef broken(:\n    pass\n", "")
    assert texts("a.py", whole, "tree-sitter-python-v1") == texts("a.py", text, "tree-sitter-python-v1")


def test_typescript_regular_expressions_and_jsx_text():
    items = ["function f() { return /[/}\"]{2}\\/'/g.test(x) ? a / b : c / d; }", "export function View() {\n  return <p>it's {n} o'clock</p>;\n}", "class Z { m() { if (/}/.test(s)) {} } }"]
    assert texts("a.tsx", "import a from 'b';\n" + "\n".join(items) + "\n", "tree-sitter-tsx-v1") == items


def test_ruby_here_documents_words_and_regular_expressions():
    items = [
        "def a\n  x = <<~SQL + b(<<-TXT)\n    select end from def\n  SQL\n    if while\n  TXT\n  y\nend",
        "def b\n  %w[end def if].each { |w| p w =~ /end if/ }\n  q = n % 3\nend", "class C\n  class << self\n    def d; end\n  end\nend",
    ]
    assert texts("a.rb", "\n\n".join(items) + "\n", "tree-sitter-ruby-v1") == items


def test_rust_raw_identifiers_and_deep_generics():
    text = "fn r#match(a: u8) { r#type(a); build::<Vec<Vec<Option<u8>>>>(a); pair::<(u8, u8)>(a); let s = r#\"call()\"#; }\n"
    row = code.scan("a.rs", "h", text, "tree-sitter-rust-v1")[0]
    assert row["symbol"] == "r#match" and [e["dst_symbol"] for e in row["edges"]] == ["r#type", "build", "pair"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("alpha first\n\nbeta second\n")
    (root / "b.rs").write_text("fn helper() {}\nfn caller() { helper() }\n")
    (root / "sub/c d+e.txt").write_text("gamma é\n")
    (root / "bad.txt").write_bytes(b"\x66\x6f\x80\x6f")
    (root / ".gitignore").write_text("*.log\n/skip/\n!keep.log\n")
    (root / "x.log").write_text("no")
    (root / "keep.log").write_text("kept\n")
    (root / "skip").mkdir()
    (root / "skip/z.txt").write_text("no")
    (root / ".git").mkdir()
    (root / ".git/config").write_text("no")
    (root / "fixtures/eval").mkdir(parents=True)
    (root / "fixtures/eval/answers.json").write_text("{}")
    os.symlink(root / "a.txt", root / "link.txt")
    return root


def test_discover(tree):
    assert corpus.discover(str(tree)).files == [".gitignore", "a.txt", "b.rs", "bad.txt", "keep.log", "sub/c d+e.txt"]
    with pytest.raises(schema.InvalidRoot):
        corpus.discover(str(tree / "none"))
    with pytest.raises(schema.PathOutsideRoot):
        corpus.confined(str(tree), "../x")
    assert corpus.safe_relative("a/b") and not corpus.safe_relative("../b") and not corpus.safe_relative("/b")


def test_index_find_retrieve_and_refresh(spark, tree, tmp_path):
    engine, root = Engine(spark, str(tmp_path / "db"), KeywordProvider()), str(tree)
    report = engine.index(root)
    assert (report["discovered"], report["indexed"], report["rejected"], report["removed"]) == (6, 5, 1, 0)
    again = engine.index(root)
    assert (again["indexed"], again["unchanged"], again["chunks_written"]) == (0, 5, 0)
    hits = engine.find("alpha").collect()
    assert [r["source_path"] for r in hits] == ["a.txt"] and hits[0]["line_start"] == 1
    assert [r["source_path"] for r in engine.find_headers("gamma").collect()] == ["sub/c d+e.txt"]
    assert [r["caller"] for r in engine.related("helper").collect()] == ["caller"]
    with pytest.raises(schema.MissingEmbeddings):
        engine.find("alpha", strategy="vector")
    assert engine.find("alpha", strategy="routed").count() == 1
    assert engine.refresh_embeddings()["embedded"] == engine.store.read("chunks").count()
    assert engine.refresh_embeddings()["embedded"] == 0
    assert engine.find("first", 1, "vector").first()["text"] == "alpha first\n"
    assert engine.find("alpha", 2, "hybrid").first()["source_path"] == "a.txt"
    old = hits[0]["id"]
    (tree / "a.txt").write_text("delta\n")
    (tree / "keep.log").unlink()
    assert engine.drifted(root, ["b.rs", "a.txt", "keep.log", "a.txt"]) == ["a.txt", "keep.log"]
    row = engine.retrieve(root, [old]).first()
    assert (row["status"], row["text"]) == ("file", "delta\n")
    assert engine.refresh_source(root, "a.txt") == "reindexed" and engine.refresh_source(root, "a.txt") == "unchanged"
    assert engine.refresh_source(root, "keep.log") == "pruned"
    assert engine.index(root)["removed"] == 0
    assert engine.find("alpha").count() == 0 and engine.find("delta").count() == 1
    status = engine.status().first()
    assert status["sources"] == 4 and status["edges"] == 1 and status["embedding_model"] == "keyword-v1"
    with pytest.raises(schema.CorpusMismatch):
        engine.index(str(tree / "sub"))


def test_manifest_profiles_and_log(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"limit": 5, "cases": [{"name": "n", "query": "q", "expected": [{"source_path": "a", "contains": None}]}]}, indent=1))
    row = manifests.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row["limit"], row["name"], row["expected"][0]["source_path"]) == (5, "n", "a")
    folder = str(tmp_path / "reg")
    (tmp_path / "r/deep").mkdir(parents=True)
    manifests.set_profile(folder, "one", str(tmp_path / "r"))
    assert manifests.resolve_corpus(folder)["name"] == "one"
    manifests.set_profile(folder, "two", str(tmp_path / "r/deep"))
    assert manifests.infer_profile(folder, str(tmp_path / "r/deep"))["name"] == "two"
    assert manifests.resolve_corpus(folder) is None and manifests.resolve_corpus(folder, fallback="one")["name"] == "one"
    assert manifests.remove_profile(folder, "two") and not manifests.remove_profile(folder, "two")
    with pytest.raises(schema.InvalidName):
        manifests.set_profile(folder, "-bad", "/")
    (tmp_path / "log.txt").write_text("a\nb\n")
    assert [r["value"] for r in manifests.read_log(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()] == ["a", "b"]


def test_streaming_merge(spark, tmp_path):
    from siltstone.streaming.ingest import ingest

    engine = Engine(spark, str(tmp_path / "db"))
    rows = [("a.txt", b"alpha one\n"), ("b.txt", b"beta\n")]
    spark.createDataFrame(rows, "path string, content binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content binary").parquet(str(tmp_path / "in"))
    ingest(engine, stream, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a.txt", b"gamma\n")], "path string, content binary").write.mode("append").parquet(str(tmp_path / "in"))
    ingest(engine, spark.readStream.schema("path string, content binary").parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["text"] for r in engine.store.read("chunks").collect()) == ["beta\n", "gamma\n"]


def test_activity_lines_are_read_back(spark, tmp_path, monkeypatch):
    from siltstone.operators import observe
    from siltstone.sources import activity

    path = str(tmp_path / "logs/activity.log")
    activity.found(path, "a b", 3, 10, 40)
    activity.retrieved(path, "id", "a.txt")
    activity.related(path, "s", "callers", 1)
    activity.failed(path, "find", 'q="x"', "no terms")
    log = observe.parsed(manifests.read_log(spark, path))
    assert observe.stats(log).first().asDict() == {"finds": 1, "actual_tokens": 10, "cold_tokens": 40, "ratio": 4.0}
    assert [r["kind"] for r in observe.recent(log, 9).collect()] == ["find", "retrieve", "find_related", "find"]
    monkeypatch.setattr(activity, "MAX_BYTES", 1)
    activity.append(path, "list_corpora", "count=1")
    assert len(open(path).readlines()) == 1 and os.path.exists(path + ".1")


def test_command_line(spark, tree, tmp_path, capsys):
    from siltstone.__main__ import main

    base = ["--db", str(tmp_path / "db"), "--log", str(tmp_path / "log"), "--registry", str(tmp_path / "reg")]
    assert main([*base, "index", str(tree)]) == 0
    assert main([*base, "find", "alpha", "--strategy", "reranked"]) == 0
    assert main([*base, "setup", "one", str(tree)]) == 0 and main([*base, "list"]) == 0 and main([*base, "delete", "one"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0]["indexed"] == 5 and out[1]["source_path"] == "a.txt" and "text" not in out[1] and out[2]["name"] == "one"


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content binary")


def test_a_change_writes_its_own_rows_and_keeps_postings(spark, tmp_path):
    from siltstone.operators import lexical

    engine = Engine(spark, str(tmp_path / "db"), KeywordProvider())
    engine.index_sources(sources(spark, *((f"{i}.txt", f"alpha word{i}\n\nsecond {i}\n".encode()) for i in range(30))), "/r")
    engine.refresh_embeddings()
    report = engine.index_sources(sources(spark, ("3.txt", b"changed words\n"), ("new.txt", b"alpha new\n")), only=spark.createDataFrame([("3.txt",), ("new.txt",), ("4.txt",)], "path string"))
    assert (report["indexed"], report["removed"], report["chunks_written"]) == (2, 1, 2)
    part = engine.store.state()["parts"][-1]
    assert spark.read.parquet(f"{tmp_path}/db/{part['name']}/chunks").count() == 2
    chunks = engine.store.read("chunks")
    plain = lambda df: sorted(map(str, df.collect()))
    order = ["term", "id", "dl", "positions"]
    assert chunks.count() == 28 * 2 + 2 and plain(engine.store.read("postings").select(*order)) == plain(lexical.postings(chunks).select(*order))
    assert plain(engine.store.read("lengths").select("id", "dl")) == plain(lexical.lengths(chunks))
    assert engine.store.read("embeddings").count() == 28 * 2 and engine.refresh_embeddings()["embedded"] == 2
    before = {t: plain(engine.store.read(t)) for t in ("sources", "chunks", "edges", "embeddings", "postings", "lengths")}
    assert engine.find("changed").count() == 1 and engine.find("word4").count() == 0
    engine.store.compact()
    assert {t: plain(engine.store.read(t)) for t in before} == before and len(engine.store.state()["parts"]) == 1
    assert engine.store.vacuum() and len(engine.store.versions()) == 1 and plain(engine.store.read("chunks")) == before["chunks"]
    same = engine.index_sources(sources(spark, ("new.txt", b"alpha new\n")), only=spark.createDataFrame([("new.txt",)], "path string"))
    assert (same["unchanged"], same["chunks_written"]) == (1, 0) and len(engine.store.versions()) == 1  # nothing is written


def test_two_writers_and_a_crash(spark, tmp_path, monkeypatch):
    from siltstone.operators.store import Store

    engine = Engine(spark, str(tmp_path / "db"))
    engine.index_sources(sources(spark, ("a.txt", b"one\n")), "/r")
    one, two = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    state, rows = one.state(), spark.createDataFrame([("b.txt", "h", "x")], schema.SOURCES)
    assert one.change(None, base=state, sources=rows) == state["version"] + 1
    with pytest.raises(schema.StoreConflict):
        two.change(None, base=state, sources=rows.withColumn("path", rows["content_hash"]))
    assert sorted(r["path"] for r in two.read("sources").collect()) == ["a.txt", "b.txt"]
    # A writer that dies before it publishes leaves the state in force, and no one trips over its files.
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        one.change(None, sources=rows)
    monkeypatch.undo()
    assert one.state()["version"] == 2 and one.read("sources").count() == 2
    assert one.change(None, dropped=spark.createDataFrame([("b.txt",)], "path string")) == 3 and one.read("sources").count() == 1
    assert [n for n in one.vacuum() if n.startswith("part-")] and one.read("sources").count() == 1
    with pytest.raises(schema.CorpusMismatch):
        one.change("/other", sources=rows)


def test_older_layouts_are_filled_and_newer_ones_refused(spark, tmp_path):
    from siltstone.operators.store import Store

    store = Store(spark, str(tmp_path / "db"))
    spark.createDataFrame([("a.txt", "h")], "path string, content_hash string").write.parquet(str(tmp_path / "db/old/sources"))
    state = {"version": 1, "root": "/r", "layout": 3, "parts": [{"name": "old", "tables": ["sources"], "drops": False}]}
    (tmp_path / "db/state-1.json").write_text(json.dumps(state))
    assert [tuple(r) for r in store.read("sources").collect()] == [("a.txt", "h", None)] and store.read("postings").count() == 0
    (tmp_path / "db/state-2.json").write_text(json.dumps(state | {"version": 2, "layout": schema.VERSION + 1}))
    with pytest.raises(schema.UnsupportedSchemaVersion):
        store.state()


def test_the_latest_content_of_a_batch_wins(spark, tmp_path):
    from siltstone.streaming.ingest import ingest

    kind = "path string, content binary, at bigint"
    spark.createDataFrame([("a.txt", b"zzz old\n", 1), ("a.txt", b"aaa new\n", 2), ("b.txt", b"b\n", 1)], kind).write.parquet(str(tmp_path / "in"))
    engine = Engine(spark, str(tmp_path / "db"))
    ingest(engine, spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), order="at").awaitTermination()
    assert sorted(r["text"] for r in engine.store.read("chunks").collect()) == ["aaa new\n", "b\n"]


def test_log_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * 50}" for i in range(3000)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "20000")
        log = manifests.read_log(spark, str(tmp_path / "log.txt"))
        assert spark.read.text(str(tmp_path / "log.txt")).rdd.getNumPartitions() > 3
        assert [(r["line_no"], r["value"]) for r in log.orderBy("line_no").collect()] == list(enumerate(lines, 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_serve_answers_lines(spark, tree, tmp_path):
    import argparse
    import io

    from siltstone.__main__ import serve
    from siltstone.operators import observe

    engine, a = Engine(spark, str(tmp_path / "db")), argparse.Namespace(log=str(tmp_path / "log"), registry=str(tmp_path / "reg"), root=str(tree))
    engine.index(str(tree))
    asked = [{"id": 1, "method": "find", "params": {"query": "alpha"}}, {"id": 2, "method": "find_related", "params": {"symbol": "helper"}}, {"id": 3, "method": "list_corpora"}, {"id": 4, "method": "find", "params": {"query": " "}}]
    answers = io.StringIO()
    serve(engine, a, [json.dumps(x) for x in asked] + ["no json"], answers)
    got = [json.loads(x) for x in answers.getvalue().splitlines()]
    assert got[0]["result"][0]["source_path"] == "a.txt" and got[1]["result"][0]["caller"] == "caller" and got[2]["result"] == []
    assert got[3]["error"].startswith("EmptyQuery") and "error" in got[4]
    log = observe.parsed(manifests.read_log(spark, str(tmp_path / "log")))
    assert [r["kind"] for r in log.orderBy("line_no").collect()][:4] == ["serve start", "find", "find_related", "list_corpora"]
    assert observe.last_serve(log).first()[0]
