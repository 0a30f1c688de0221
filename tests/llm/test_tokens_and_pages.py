"""Tokenizer, coding, token files, packing, extraction, registration, pipeline."""

import importlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import html_wrapper, packing, pfor, queries, token_files
from siltstone.llm.tokenize import WordTokenizer, tokenizer_path

ODD = [(5, "b b a"), (None, None), (1, ""), (3, "Hello, WORLD's 12 ünïcode ß..."), (3, "Hello, WORLD's 12 ünïcode ß..."), (2, "word " * 5000), (4, None)]


def test_word_cache_equals_whole_texts():
    t = WordTokenizer(tokenizer_path())
    assert t.by_part and t.by_word
    rng = random.Random(1)
    letters = "ab'sS tΣéÉ́  \n\t 1２३!*|ﬁßİıǅ中😀‍\x1c\x85<ÀÝ×ªµ~^"
    for k in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + ("<|endoftext|>x" if k % 7 == 0 else "")
        assert t.encode(text).tolist() == t.whole(text)
    t.words.size = t.parts.size = 2  # a cache that turns at every text
    assert all(t.encode(x).tolist() == t.whole(x) for x in ("a b c", "a b d", "á 中 b", "c d e f"))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50000, n), rng.integers(7, 9, n), np.full(n, 2**32 - 1), rng.integers(0, 4, n) + (rng.random(n) < 0.05) * 2**31):
        ids = ids.astype("<u4")
        image = pfor.encode(ids)
        assert (pfor.decode(image) == ids).all()
        for block in range(-(-n // pfor.BLOCK)):
            assert (pfor.decode_block(image, block) == ids[block * pfor.BLOCK : (block + 1) * pfor.BLOCK]).all()
    with pytest.raises(ValueError):
        pfor.decode(b"x" * 32)


@pytest.mark.parametrize("segment", [token_files.SEGMENT_IDS, 5])
def test_token_files(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id bigint, text string, start string")
    token_files.write(docs, str(tmp_path / "f"))
    got = sorted(map(tuple, token_files.read_back(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    t, at, want = WordTokenizer(tokenizer_path()), 0, []
    for i, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.whole(text or ""), 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    token_files.write(docs.where("false"), str(tmp_path / "e"))
    assert token_files.read_back(spark, str(tmp_path / "e")).count() == 0


def check_packed(rows, docs, capacity):
    t, left = WordTokenizer(tokenizer_path()), []
    for i, text in docs:
        ids = np.array([*t.whole(text or ""), 0], dtype="<u4")
        left += [(str(i), k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(left)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, monkeypatch):
    rng = random.Random(2)
    docs = ODD + [(100 + i, " ".join(rng.choice(["alpha", "of", "xylophone", "é"]) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    table = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, length int").repartition(6)
    n = check_packed(packing.pack(table, 64).collect(), docs, 64)
    total = sum(len(WordTokenizer(tokenizer_path()).whole(t or "")) + 1 for _, t in docs)
    assert n <= 1.03 * total / 64 + 2
    monkeypatch.setattr(packing, "GROUP_ITEMS", 4)  # several rounds of the tree
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 20)
    assert check_packed(packing.pack(table, 64).collect(), docs, 64) <= 1.1 * total / 64 + 2
    assert packing.pack(table.where("false")).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8] and fills.tolist() == [10, 10]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_its_definition(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 120))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 400))
    bins, offsets, fills = packing.best_fit(lengths, capacity)
    free = []
    for size in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, f in enumerate(free) if f >= size]
        k = min(fits, key=lambda k: free[k]) if fits else len(free)
        if not fits:
            free.append(capacity)
        free[k] -= size
    assert sorted(fills.tolist()) == sorted(capacity - f for f in free)
    for k in range(len(fills)):
        own = sorted(zip(offsets[bins == k].tolist(), lengths[bins == k].tolist(), strict=True))
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) == fills[k]
    assert all(a + b > capacity for i, a in enumerate(fills) for b in fills[:i])


def test_no_round_gathers_what_cannot_pair(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 5000)
    rounds, merge = [], packing._merge
    monkeypatch.setattr(packing, "_merge", lambda items, groups, capacity: rounds.append((items.count(), groups)) or merge(items, groups, capacity))
    # Sequences that cannot pair, and one small one for each 50,000 that can.
    items = spark.range(200_000).select(F.col("id").alias("bin"), F.when(F.col("id") % 50_000 == 7, 100).otherwise(1100).cast("bigint").alias("fill"))
    moves = packing.tree(items, 2048)
    assert len(rounds) > 1 and rounds[-1][1] == 1 and all(count <= 1.01 * packing.GROUP_ITEMS * groups for count, groups in rounds)
    assert moves.count() == 200_000 and moves.select("new_bin").distinct().count() == 200_000 - 4
    assert packing.tree(items.where("false"), 2048) is None


def test_rounds_leave_about_one_half_full_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 200)
    rng = np.random.default_rng(3)
    fills = rng.integers(1, 1500, 6000)
    items = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fills)], "bin bigint, fill bigint").repartition(5)
    moves, total, spans = packing.tree(items, 2048).collect(), {}, {}
    for r in moves:
        total[r["new_bin"]] = total.get(r["new_bin"], 0) + int(fills[r["bin"]])
        spans.setdefault(r["new_bin"], []).append((r["shift"], int(fills[r["bin"]])))
    assert len(moves) == 6000 and max(total.values()) <= 2048
    for own in spans.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
    assert sum(2 * t <= 2048 for t in total.values()) <= 1
    assert len(total) <= 1.02 * len(packing.best_fit(fills, 2048)[2])


def test_tree_matching_and_blocks():
    page = html_wrapper.fold(html_wrapper.parse("<body><nav>m</nav><div class=a>x<p>y</div><article><h1>T &amp; &eacute;</h1><p>a  b<br>c<p><b>d</b>e<ul><li>f<li>g</ul></article><footer>z"))
    assert html_wrapper.split_text(page) == ("T & é\na b\nc\nde\nf\ng", True)
    other = html_wrapper.fold(html_wrapper.parse("<body><div class=a>q</div><article>w</article>"))
    assert html_wrapper.tree_match(page, page)[0] > html_wrapper.tree_match(page, other)[0] == 4
    bad = html_wrapper.fold(html_wrapper.parse('</p></div><a href="x><b>t</i> 1 < 2 <![CDATA[x]]><!-- open'))
    assert "t 1 < 2" in html_wrapper.text_by_template(bad, set(), frozenset())
    deep = html_wrapper.fold(html_wrapper.parse("<div>" * 3000 + "x" + "</div>" * 3000))
    assert html_wrapper.text_by_template(deep, set(), frozenset()) == "x"


def test_extraction_by_template(spark):
    frame = '<html><body><div class=a><p>Menu one two</div><div class=b><h1>T{0}</h1><p>Body text {0} here</div><div class="box comments">no</div><div class=c>Bottom {1}</div></body></html>'
    rows = [(i, f"http://h.example/{i}", frame.format(i, "A" if i % 9 else "B"), "x") for i in range(40)]
    rows += [(100, "http://solo.example/", frame.format("Solo", "A"), "x"), (101, None, None, None), (None, "x", "", None), (7, "http://h.example/7", rows[7][2], "x")]
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r["page_id"] in (101, None) else "TSolo\nBody text Solo here" if r["page_id"] == 100 else f"T{r['page_id']}\nBody text {r['page_id']} here"
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html_wrapper.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_extraction_of_the_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_wrapper.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_registration_and_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, sf).cache()
        assert out.columns == columns
        assert out.count() > 0.5 * at.count(), name
        at = out
    packed = pipeline.STAGES[-1][1](spark, at, sf)
    assert packed.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
    empty = docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def extracted(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def words(i, n=12):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_template_decides_inside_main_elements(spark):
    page = "<body><article><h1>T{0}</h1><p>{1}</p>{2}<p>Share this page</p><div class=terms>All rights</div></article></body>"
    pages = [("http://a/", page.format(i, words(i), "".join(f"<p>more {i} {k}</p>" for k in range(i % 3)))) for i in range(12)]
    # Near copies at a host are one page, so what they share is text.
    near = [("http://b/", f"<main><h2>N</h2><p>{words(99)}</p><p>a shared line</p><p>edit {i}</p></main>") for i in range(6)]
    got = extracted(spark, pages + near)
    assert got[:12] == ["\n".join([f"T{i}", words(i), *(f"more {i} {k}" for k in range(i % 3))]) for i in range(12)]
    assert got[12:] == [f"N\n{words(99)}\na shared line\nedit {i}" for i in range(6)]


def test_templates_beyond_the_sent_size_are_joined(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    both = []
    for most in (html_wrapper.SENT_VALUES, 0):
        monkeypatch.setattr(html_wrapper, "SENT_VALUES", most)
        both.append(sorted((r["page_id"], r["text"]) for r in html_wrapper.extract(pages).collect()))
    assert both[0] == both[1] and len(both[0]) == 250


def test_copies_count_once(spark):
    page = "<html><body>{0}<div class=x>{1}</div></body></html>"
    same, others = page.format("loose", "copied text"), [page.format(f"own {i}", f"text {i}") for i in range(2)]
    got = extracted(spark, [("http://c/", h) for h in [same] * 3 + others])
    assert got == ["loose\ncopied text"] * 3 + [f"own {i}\ntext {i}" for i in range(2)]
    # Copies on many hosts, and no page of the pool is a template of another.
    mirrors = [(f"http://m{i}/", page.format("", f"news {i % 5}")) for i in range(40)]
    assert extracted(spark, mirrors) == [f"news {i % 5}" for i in range(40)]


def test_marks_of_wrappers_are_no_furniture(spark):
    inner = "<article><p>{0}</p></article>"
    marks = ["<div class='with-sidebar'>{0}</div>", "<div class='has-header'>{0}</div>", "<section class='no-comments'>{0}</section>", "<div id='share-page'>{0}</div>", "<form>{0}</form>"]
    pages = [(f"http://d{k}/", f"<body>{m.format(i.format(words(k)))}<div class=related>see x</div></body>") for k, m in enumerate(marks) for i in (inner, "<p>{0}</p>")]
    assert extracted(spark, pages) == [words(k) for k in range(len(marks)) for _ in range(2)]


def test_siblings_are_slots_of_their_own(spark):
    page = "<body><div>Menu</div><div>{0}</div><div>Footer</div></body>"
    assert extracted(spark, [("http://e/", "")] + [("http://e/", page.format(words(i))) for i in range(5)]) == ["", *(words(i) for i in range(5))]
    # Beyond the former caps: many children before the text, and a template that the first page lacks.
    row = "".join(f"<div>Link {k}</div>" for k in range(90))
    deep = [("http://f/", f"<body>{row if i else ''}<div class=q>{words(i)}</div><div class=z>Last</div></body>") for i in range(6)]
    assert extracted(spark, deep) == [words(i) for i in range(6)]
    long = "".join(f"<ul><li>Item {k}</li></ul>" for k in range(450))
    assert extracted(spark, [("http://g/", f"<body>{long}<p>{words(i)}</p></body>") for i in range(4)]) == [words(i) for i in range(4)]


def text_of(html):
    return html_wrapper.text_by_template(html_wrapper.fold(html_wrapper.parse(html)), set(), frozenset())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div role="navigation">menu</div><div>Main content here</div>', "Main content here"),
        ("<div>Main</div><div hidden>secret</div>", "Main"),
        ('<section><article class="comment">first!</article></section><p>x</p>', "x"),
        ('<article>real<article class="comment reply-2">first!</article></article>', "real"),
        ('<article><p>The text</p><p class="legal">Body</p><div class="share-of-market">Part</div><div class="share-box">tweet</div></article>', "The text\nBody\nPart"),
        ("<article><header><h1>Title</h1></header><p>x</p><footer>f</footer></article><header><h1>Site</h1></header>", "Title\nx"),
        ('<main><header class="site">links</header><p>x</p></main>', "x"),
        ("<div class='no-comments'>all of the text</div><div class='ad-unit'>ad</div>", "all of the text"),
    ],
)
def test_marks_and_roles_of_single_pages(page, want):
    assert text_of(page) == want


def test_pages_without_main_elements_and_names(spark):
    """The test pages with article as div and without classes: the template alone finds the adverts, which come from a pool."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)article>", "<$1div>"), ' class="ad"', "")
    want = {r["page_id"]: r["text"] for r in html_wrapper.extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(pages.withColumn("html", bare)).collect()}
    assert len(got) == 2500 and all(re.search("[^ ]", t) for t in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def brute_match(a, b):
    """The greatest common top-down order-preserving subtree, by all choices."""
    if a.name != b.name:
        return 0

    def forest(x, y):
        if not x or not y:
            return 0
        own = brute_match(x[0], y[0])
        return max(forest(x[1:], y), forest(x, y[1:]), own + forest(x[1:], y[1:]) if own else 0)

    return 1 + forest(a.children, b.children)


def test_tree_matching_equals_brute_force():
    rng = random.Random(12)

    def tree(depth):
        own = html_wrapper.Slot(rng.choice("abc"), False, False)
        own.digests = [rng.randrange(3)] if rng.random() < 0.5 else []
        own.children = [tree(depth - 1) for _ in range(rng.randrange(0, 5))] if depth else []
        return own

    met = 0
    for _ in range(400):
        a, b = tree(2), tree(2)
        b.name = a.name
        size, pairs = html_wrapper.tree_match(a, b)
        assert size == brute_match(a, b)
        work, held = [(a, b, pairs)], 0
        while work:  # the pairs are a matching of that size, in order
            x, y, inner = work.pop()
            held += 1
            places = [([c is p for c in x.children].index(True), [c is q for c in y.children].index(True)) for p, q, _ in inner]
            assert x.name == y.name and all(s < t and u < v for (s, u), (t, v) in zip(places, places[1:], strict=False))
            work += inner
        assert held == size
        met += size
    assert met > 2 * 400  # more than the roots alone
