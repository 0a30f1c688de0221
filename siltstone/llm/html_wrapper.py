"""Main-text extraction by wrapper induction over the pages of a host.

Pages are parsed to DOM trees: a node is a block element with its class and id, and every
sibling is a node of its own.  The commonest trees of a host are merged into its reference.
Every page of the host is aligned to it by simple tree matching (the greatest common top-down,
order-preserving subtree; equal blocks at both ends of a child list first, then by dynamic
programming), so its nodes get slots of the reference.  For each slot the digests of its
blocks are counted, in Spark, over distinct page contents: copies count once, and inside an
``article`` or ``main`` so do pages that share their longest other passage, since these are near
copies.  A block is template if most pages of its slot have it, or if it is repeated in a slot
that holds repeated blocks only (a notice of most pages, or adverts from a pool on at least
``POOL_PAGES``); inside an ``article`` or ``main``, where a passage that some pages quote is
text, most pages of the host must have it.  The same rule goes over the paths of a host, whatever the
place among siblings and for nodes that no slot matches, and over the paths of all hosts, which
gives hosts of one page a template.  All this runs on descriptions (names and digests, no text).

The induced template decides the blocks of every page.  After it come two checks on what is left:
a page with an ``article`` or ``main`` keeps only blocks of such elements, and elements that HTML
marks as furniture (menu, header, footer, hidden, script, style; not the header with a heading
that an article has) are left out, and so are reader comments (a class ``comment`` and the like,
also of an ``article``).  One that only its class or id (sidebar, notice, advert) or ``form`` marks
is left out unless it holds more than half of what is left; inside an ``article`` or ``main`` names
of other words (``share-of-market``) and of words that text has as well (``legal``) mark nothing.

Edge cases: null and empty html give an empty text and take no part in the induction.  Broken
markup (unclosed, stray or crossing tags) is read as it stands.  Null urls share the host ''.
Nesting beyond ``MAX_DEPTH`` is read as text of the last level.  Each input row gives one output
row; an empty table gives none.  Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from array import array
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

MAX_DEPTH = 200
#: Child lists whose product of lengths is larger are not aligned; their nodes are counted by path.
MAX_CELLS = 250_000
#: Values of all references or templates that are sent to every task; more are joined with the pages by host.
SENT_VALUES = 1 << 21
#: Trees of a host that are merged into its reference.
REFERENCE_TREES = 8
#: A block is constant if it is on at least this share of the pages with its slot, and on this many.
CONSTANT_SHARE = 0.6
CONSTANT_PAGES = 3
#: In a slot with this share of repeated blocks, and a constant one or this many pages, all repeated blocks are template.
REPEATED_SHARE = 0.9
POOL_PAGES = 10

# Comments, declarations, whole tags, and at last tags with an unbalanced quote, which are skipped.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Attributes without one of these words neither name nor mark an element.
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^a-z0-9]+")
# Fixed values of HTML: void, raw, block and implied-end elements.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "head"}
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements that never hold the main text, roles alike, and words that mark furniture in a class or id.
FURNITURE_TAGS = set(
    "nav header footer aside script style noscript iframe template head title menu button select option input textarea svg canvas object dialog label fieldset legend".split()
)
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer comment comments disqus reply replies cookie cookies consent notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended widget toolbar pagination pager skip copyright legal".split()
)
#: Words beside them that leave the mark as it is, and marking words that inside the main text mark nothing.
NEUTRAL_WORDS = set(
    "bar block box button buttons container content entry fixed footnote global group icon icons inline inner item items large left link links list main module outer page panel post row "
    "section site small slot sticky top bottom right text title unit wrap wrapper area media".split()
)
TEXT_WORDS = set("copyright header legal masthead skip".split())
COMMENT_NAMES = set("comment comments reply replies".split())
MAIN_TAGS = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Node:
    name: str
    tag: str
    children: list = field(default_factory=list)  # Node or str
    furniture: bool = False
    marked: bool = False  # only by its class or id, or a form
    outside: bool = False  # marked so only outside the main text


def _node(tag: str, attributes: str) -> Node:
    if not _TELLING.search(attributes):
        return Node(f"{tag}.", tag, furniture=tag in FURNITURE_TAGS, marked=tag == "form")
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes.strip(" /") else {}
    label = " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x).lower()
    names = [_WORDS.split(x) for x in label.split()]
    words = {w for name in names for w in name}
    style = found.get("style", "").replace(" ", "").lower()
    off = (
        tag in FURNITURE_TAGS or found.get("role", "").lower() in FURNITURE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        or "display:none" in style or (tag not in ("html", "body", "main") and not COMMENT_NAMES.isdisjoint(label.split()))
    )
    marked = tag == "form" or (tag not in ("html", "body", *MAIN_TAGS) and bool(words & FURNITURE_WORDS))
    inside = tag == "form" or any(
        not (FURNITURE_WORDS - TEXT_WORDS).isdisjoint(name) and all(not w or w.isdigit() or w in FURNITURE_WORDS or w in NEUTRAL_WORDS for w in name) for name in names
    )
    return Node(f"{tag}.{'.'.join(sorted(w for w in words if w and not w.isdigit()))}", tag, furniture=off, marked=marked, outside=marked and not inside)


def parse(text: str | None) -> Node:
    """The DOM tree of a whole page; broken markup is read as it stands."""
    root = Node("#", "#")
    stack = [root]
    text, at = text or "", 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCKS and stack[k].tag in _BLOCKS:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, _ENDS_P - {"p"} | {"td", "th", "body"})
        if tag in _SELF_CLOSING:
            _close(stack, _SELF_CLOSING[tag], _SCOPES[tag])
        node = _node(tag, m[3])
        stack[-1].children.append(node)
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in _VOID and not m[3].endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


@dataclass(slots=True)
class Slot:
    """A block element: its name, child blocks, and the texts directly in it."""

    name: str
    main: bool
    furniture: bool
    marked: bool = False
    children: list = field(default_factory=list)
    texts: list = field(default_factory=list)  # (order, text)
    digests: list = field(default_factory=list)  # of the texts


def digest_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_PATHS: dict[tuple[int, str], int] = {}


def path_of(up: int, name: str) -> int:
    """The digest of a path of names."""
    got = _PATHS.get((up, name))
    if got is None:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        got = _PATHS[up, name] = digest_of(f"{up}/{name}")
    return got


def _has_heading(node: Node) -> bool:
    work = [node]
    while work:
        own = work.pop()
        if own.tag in _HEADINGS:
            return True
        work += [c for c in own.children if not isinstance(c, str)]
    return False


def fold(root: Node) -> Slot:
    """The tree of block elements.  Inline elements dissolve; text goes to the nearest block."""
    top = Slot("#", False, False)
    order = 0

    def flush(slot: Slot, buffer: list[str]) -> None:
        nonlocal order
        text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            slot.texts.append((order, text))
            order += 1

    # Each entry: the node's children still to visit, its slot, its buffer of inline text.
    work = [(iter(root.children), top, [])]
    while work:
        children, slot, buffer = work[-1]
        for child in children:
            if isinstance(child, str):
                buffer.append(child)
            elif child.tag in _VOID:
                if child.tag in ("br", "hr"):
                    flush(slot, buffer)
            elif child.tag in _BLOCKS or child.furniture or child.marked:
                flush(slot, buffer)
                off = child.furniture and not (child.tag == "header" and slot.main and _has_heading(child))
                own = Slot(child.name, slot.main or child.tag in MAIN_TAGS, slot.furniture or off, child.marked and not (child.outside and slot.main))
                slot.children.append(own)
                work.append((iter(child.children), own, []))
                break
            else:  # inline: its children are read in place, with this block's buffer
                work.append((iter(child.children), slot, buffer))
                break
        else:
            work.pop()
            if not work or work[-1][2] is not buffer:
                flush(slot, buffer)
    return top


def tree_match(a: Slot, b: Slot) -> tuple[int, list]:
    """Simple tree matching of two slots of one name: (matched nodes, pairs of matched children with their own pairs)."""
    if a.name != b.name:
        return 0, []
    left, right = a.children, b.children
    if not left or not right:
        return 1, []
    # Equal leaves at both ends, then leaves of one name at the start: an optimum contains them.
    head, most = 0, min(len(left), len(right))
    while head < most and _same(left[head], right[head]):
        head += 1
    tail = 0
    while tail < most - head and _same(left[-1 - tail], right[-1 - tail]):
        tail += 1
    while head < most - tail and (x := left[head]).name == (y := right[head]).name and not x.children and not y.children:
        head += 1
    ends = [(left[k], right[k], []) for k in range(head)] + [(left[-k], right[-k], []) for k in range(tail, 0, -1)]
    left, right = left[head : len(left) - tail], right[head : len(right) - tail]
    if not left or not right or len(left) * len(right) > MAX_CELLS:
        return 1 + len(ends), ends
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    got = {}
    for i, x in enumerate(left):
        row, up = best[i + 1], best[i]
        for j, y in enumerate(right):
            most = max(up[j + 1], row[j])
            if x.name == y.name:
                own = got[i, j] = tree_match(x, y)
                most = max(most, up[j] + own[0])
            row[j + 1] = most
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j], got[i, j][1]))
    return 1 + len(ends) + best[-1][-1], ends[:head] + pairs[::-1] + ends[head:]


def _same(x: Slot, y: Slot) -> bool:
    return x.name == y.name and not x.children and not y.children and x.digests == y.digests


def aligned(page: Slot, reference: Slot, numbers: dict[int, int]):
    """(page slot, reference number) of every matched slot."""
    work = [(page, reference, tree_match(page, reference)[1])]
    while work:
        own, other, pairs = work.pop()
        if id(other) in numbers:
            yield own, numbers[id(other)]
        work += pairs


def merge(reference: Slot, page: Slot) -> None:
    """Add what ``page`` has beyond ``reference`` to it, each node behind the sibling before it."""
    work = [(reference, page, tree_match(page, reference)[1])]
    while work:
        into, own, pairs = work.pop()
        match = {id(x): (y, inner) for x, y, inner in pairs}
        place = 0
        for child in own.children:
            if id(child) in match:
                y, inner = match[id(child)]
                place = next(k for k, c in enumerate(into.children) if c is y) + 1
                work.append((y, child, inner))
            else:
                into.children.insert(place, child)
                place += 1


def _digest_all(page: Slot) -> None:
    """Digests of all texts outside furniture; furniture is a leaf from now on."""
    work = [page]
    while work:
        slot = work.pop()
        if slot.furniture:
            slot.children, slot.texts = [], []
        slot.digests = [digest_of(t) for _, t in slot.texts]
        work += slot.children


def _kept(page: Slot, template: set, furniture_paths: frozenset, numbers: dict[int, int]) -> tuple[str, bool]:
    """(text, whether the page has blocks in main elements)."""
    blocks, work, any_main = [], [(page, 0, ())], False
    while work:
        slot, up, marks = work.pop()
        if slot.furniture:
            continue
        here = path_of(up, slot.name)
        if slot.marked:
            marks = (*marks, id(slot))
        number = numbers.get(id(slot), -1)
        any_main = any_main or bool(slot.main and slot.texts)
        for (order, text), digest in zip(slot.texts, slot.digests or [0] * len(slot.texts), strict=True):
            if (number, digest) not in template and (here, digest) not in furniture_paths:
                blocks.append((order, text, slot.main, marks))
        work += [(c, here, marks) for c in slot.children]
    if any_main:
        blocks = [b for b in blocks if b[2]]
    total, held = sum(len(b[1]) for b in blocks), defaultdict(int)
    for b in blocks:
        for mark in b[3]:
            held[mark] += len(b[1])
    return "\n".join(b[1] for b in sorted(blocks, key=lambda b: b[0]) if all(2 * held[m] > total for m in b[3])), any_main


def split_text(page: Slot) -> tuple[str, bool]:
    """(text of the blocks in main elements, whether there are any), furniture left out."""
    text, any_main = _kept(page, set(), frozenset(), {})
    return text if any_main else "", any_main


def text_by_template(page: Slot, template: set, furniture_paths: frozenset, numbers: dict[int, int] | None = None) -> str:
    """The text of a page without the blocks in ``template`` (slot, digest) and ``furniture_paths`` (path, digest)."""
    return _kept(page, template, furniture_paths, numbers or {})[0]


def host_of(url):
    """The host of a url column, lower-cased; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    # One description a distinct content, with the hosts that have it; the first of them stands for it among all hosts.
    contents = materialise(
        rows.select("host", "html").mapInArrow(_describe, _DESCRIBED)
        .groupBy("content").agg(F.sort_array(F.collect_set("host")).alias("hosts"), F.first(F.struct("names", "parents", "at", "digests", "cores")).alias("d"))
        .select("content", F.posexplode("hosts").alias("place", "host"), "d.*").withColumn("tree", F.xxhash64("names", "parents")),
        "wrapper-contents",
    )
    tree = Window.partitionBy("host").orderBy(F.desc("n"), "tree")
    references = materialise(
        contents.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("names", "parents", "at", "digests"), "content").alias("d"))
        .withColumn("k", F.row_number().over(tree)).where(F.col("k") <= REFERENCE_TREES)
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "d"))).alias("trees")).mapInArrow(_merged, _REFERENCE),
        "wrapper-references",
    )
    keys = ["host", "slot", "path", "main", "digest"]
    # Pages of (slot, path, digest), of (-1, path, digest), and of both without a digest.
    wanted = contents.select("host", "place", "names", "parents", "at", "digests", "cores")
    sent = _sent(references, _REF)
    seen = (wanted if sent else wanted.join(references, "host")).mapInArrow(lambda batches: _slot_counts(batches, sent), _COUNTS)
    once = lambda c: F.sum(F.when(F.col("core").isNull(), F.col(c)).otherwise((F.col(c) > 0).cast("bigint"))).alias(c)
    counts = materialise(
        seen.groupBy(*keys, "core").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts")).groupBy(*keys).agg(once("n"), once("firsts")), "wrapper-counts"
    )
    by_path = counts.where("slot = -1")
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    pooled = _constant(by_path.groupBy("path", "main", "digest").agg(F.sum("firsts").alias("n")), ["path"], contents.where("place = 0").agg(F.count(F.lit(1)).alias("n_pages")))
    constant = (
        _constant(counts.drop("firsts"), ["host", "slot", "path"], sizes).unionByName(by_path.join(pooled, ["path", "digest"], "left_semi").select("host", "slot", "path", "digest")).distinct()
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "path", "digest"))).alias("constant"))
    )

    templates = materialise(references.join(constant, "host"), "wrapper-templates")
    told = _sent(templates, [*_REF, "constant"])

    def by_template(batches):
        trees = _References([*_REF, "constant"], told)
        for part in _slices(batches):
            texts = []
            for i, (host, html) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                page, template = fold(parse(html)), trees.of(host, part, i)
                if template is None:
                    texts.append(text_by_template(page, set(), frozenset()))
                    continue
                _digest_all(page)
                root, numbers, slots, paths = template
                own = {id(s): k for s, k in aligned(page, root, numbers)} if slots else {}
                texts.append(text_by_template(page, slots, paths, own))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = rows.select("page_id", "url", "html", "host")
    return (rows if told else rows.join(templates, "host", "left")).mapInArrow(by_template, "page_id bigint, url string, text string, n_chars bigint")


def _sent(templates: DataFrame, columns: list[str]):
    """What is known of each host as a broadcast, if it has at most SENT_VALUES values; None where it has more, which is joined."""
    size = templates.agg(F.sum(sum((F.size(c) for c in columns[1:]), F.size(columns[0])))).first()[0] or 0
    if size > SENT_VALUES:
        return None
    table = templates.select("host", *columns).toArrow()
    return templates.sparkSession.sparkContext.broadcast({row["host"]: tuple(row[c] for c in columns) for row in table.to_pylist()})


def _constant(counts: DataFrame, by: list[str], sizes: DataFrame) -> DataFrame:
    """The template blocks among ``counts`` (``by``, main, digest, n); ``sizes`` has n_pages, by host or of all; the row without a digest counts the pages."""
    n, block, often = F.col("n"), F.col("digest").isNotNull(), F.col("n") >= CONSTANT_PAGES
    slots = counts.groupBy(*by).agg(
        F.max(F.when(~block, n)).alias("pages"), F.max(F.when(block, n)).alias("most"), F.sum(F.when(block, n)).alias("all"), F.sum(F.when(block & often, n)).alias("repeated")
    ).where(
        (F.col("most") >= CONSTANT_PAGES) & (F.col("most") >= CONSTANT_SHARE * F.col("pages"))
        | (F.col("pages") >= POOL_PAGES) & (F.col("repeated") >= REPEATED_SHARE * F.col("all"))
    )
    found = counts.where(block & often).join(slots, by)
    return (
        (found.join(sizes, "host") if "host" in by else found.crossJoin(sizes)).where(F.when(F.col("main"), n >= CONSTANT_SHARE * F.col("n_pages")).otherwise((n >= CONSTANT_SHARE * F.col("pages")) | (F.col("repeated") >= REPEATED_SHARE * F.col("all"))))
        .select(*by, "digest")
    )


def _slices(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _flat(page: Slot) -> tuple[list[str], list[int], list[int], list[int]]:
    """Names and parent numbers of a tree in preorder; node number and digest of each block."""
    names, parents, at, digests, work = [], [], [], [], [(page, -1)]
    while work:
        own, parent = work.pop()
        k = len(names)
        names.append(own.name)
        parents.append(parent)
        digests += own.digests
        at += [k] * len(own.digests)
        work += [(c, k) for c in reversed(own.children)]
    return names, parents, at, digests


def _grown(names: list[str], parents: list[int], at: list[int], digests: list[int]) -> list[Slot]:
    """The slots of a described tree in preorder, the root first."""
    slots = []
    for name, p in zip(names, parents, strict=True):
        up = slots[p] if p >= 0 else None
        slots.append(Slot(name, name.partition(".")[0] in MAIN_TAGS or (up is not None and up.main), False))
        if up is not None:
            up.children.append(slots[-1])
    for k, d in zip(at, digests, strict=True):
        slots[k].digests.append(d)
    return slots


class _References:
    """Trees of the references met, with what is template of each; bounded where they come with the rows."""

    def __init__(self, columns: list[str], sent) -> None:
        self.columns, self.sent, self.known = columns, sent, {}

    def of(self, host: str, part: pa.RecordBatch, row: int):
        """(root, numbers of its slots, template slots, template paths) for a row of ``part``; None where the host has none."""
        if host not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            values = self.sent.value.get(host) if self.sent else [part.column(c)[row].as_py() for c in self.columns]
            self.known[host] = self._made(*values) if values is not None and values[-1] is not None else None
        return self.known[host]

    @staticmethod
    def _made(names, parents, at, digests, constant=()):
        slots = _grown(names, parents, at, digests)
        off = [(c["slot"], c["path"], c["digest"]) for c in constant]
        return slots[0], {id(s): k for k, s in enumerate(slots)}, {(k, d) for k, _, d in off if k >= 0}, frozenset((p, d) for k, p, d in off if k < 0)


_REF = ["ref_names", "ref_parents", "ref_at", "ref_digests"]
_TREE = "names array<string>, {0}parents array<int>, {0}at array<int>, {0}digests array<bigint>"
_REFERENCE = "host string, ref_" + _TREE.format("ref_")
_DESCRIBED = "host string, content binary, " + _TREE.format("") + ", cores array<bigint>"
_COUNTS = "host string, slot int, path bigint, main boolean, digest bigint, core bigint, n bigint, firsts bigint"
_TYPES = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _describe(batches):
    """Descriptions of pages with text; cores are the two longest blocks in main elements."""
    for part in _slices(batches):
        rows = []
        for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            page = fold(parse(html))
            _digest_all(page)
            names, parents, at, digests = flat = _flat(page)
            if digests:
                content = hashlib.blake2b(repr((names, parents, at)).encode("utf-8", "surrogatepass") + array("q", digests).tobytes(), digest_size=16).digest()
                rows.append((host, content, *flat, _cores(page)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.string(), pa.binary(), *_TYPES, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "content", "names", "parents", "at", "digests", "cores"])


def _cores(page: Slot) -> list[int]:
    found, work = {}, [page]
    while work:
        slot = work.pop()
        if slot.main:
            found |= {d: len(t) for (_, t), d in zip(slot.texts, slot.digests, strict=True)}
        work += slot.children
    return sorted(found, key=lambda d: (-found[d], d))[:2]


def _merged(batches):
    for batch in batches:
        out = []
        for host, trees in zip(batch.column("host").to_pylist(), batch.column("trees").to_pylist(), strict=True):
            first, *rest = (_grown(**t["d"])[0] for t in trees)
            for other in rest:
                merge(first, other)
            out.append((host, *_flat(first)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *_TYPES], strict=True)], ["host", *_REF])


def _slot_counts(batches, sent):
    """Distinct page contents of each key in a batch, and those that stand for their content; core is null outside main elements."""
    trees = _References(_REF, sent)
    for part in _slices(batches, 1024):
        counts: dict[tuple, list[int]] = {}
        own_columns = (part.column(c).to_pylist() for c in ("host", "place", "names", "parents", "at", "digests", "cores"))
        for i, (host, place, names, parents, at, digests, cores) in enumerate(zip(*own_columns, strict=True)):
            slots = _grown(names, parents, at, digests)
            root, numbers = trees.of(host, part, i)[:2]
            matched = {id(own): k for own, k in aligned(slots[0], root, numbers)}
            paths, keys = [], set()
            for slot, parent in zip(slots, parents, strict=True):
                path = path_of(paths[parent] if parent >= 0 else 0, slot.name)
                paths.append(path)
                if slot.digests:
                    number = matched.get(id(slot), -1)
                    keys |= {(host, number, path, slot.main, None, None), (host, -1, path, slot.main, None, None)}
                    for d in slot.digests:
                        core = next((c for c in cores if c != d), 0) if slot.main else None
                        keys |= {(host, number, path, slot.main, d, core), (host, -1, path, slot.main, d, core)}
            for key in keys:
                own = counts.setdefault(key, [0, 0])
                own[0] += 1
                own[1] += place == 0
        if counts:
            columns = [*zip(*counts, strict=True), *zip(*counts.values(), strict=True)]
            types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "slot", "path", "main", "digest", "core", "n", "firsts"])
