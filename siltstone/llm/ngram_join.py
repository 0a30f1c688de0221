"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's set holds its distinct five-word shingles (64-bit hashes); two documents link
at a Jaccard similarity of ``NUM / DEN`` or more.  Documents with equal sets are one class
(by a 128-bit hash of the set), and only classes are joined.  Steps:

1. Sets are hashed and classes formed; shingles that are frequent inside a chunk of the
   corpus are counted.  A shingle that is frequent overall is frequent in some chunk.
   Each class keeps a bitmap of its set, of about two bits a shingle: the bits of one set
   that another lacks bound their overlap from above.
2. Row blocks: classes that share one of their least ``SIGNATURES`` shingles meet in blocks
   of about ``ROWS`` classes and ``BLOCK_SHINGLES`` shingles at most (with the group's first
   class in each), so long texts meet in smaller blocks.  Rows whose bitmap
   rules out every other row of the block leave.  The overlaps of the others
   are one product of the block's incidence matrix with its transpose, accumulated over
   column chunks; only a spanning forest of the links leaves the task.
3. Column blocks: the product restricted to where it can still matter.  Under one order of
   all shingles (rare first), two sets that link share one among their first
   ``n - ceil(n NUM / DEN) + 1``.  Those prefixes are dealt by shingle to column blocks (a
   column of more than ``HOT_COLUMN`` documents only if it joins several components, and then
   by pairs of sub-blocks, so no task has the whole of it);
   inside a column, pairs that step 2 has connected already, pairs outside the size bound
   and pairs whose remaining shingles cannot reach the needed overlap are discarded, then
   pairs that their bitmaps rule out.  What is left has its overlap counted in full.
4. Components of all links.

No link is lost: a pair either lies in one component already or survives step 3.  Hash
collisions of 64-bit shingles are the only inexactness.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are
their own component.  Fewer words than five make one shingle.  Rows with a null id take part
through their text; a component's id is the least non-null id in it (null if there is
none).  Repeated ids and rows give a row each.  An empty table gives no rows.  Only ``doc_id``
and ``text`` are read by the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, materialise, slices
from .components import components

NUM, DEN = 3, 4
SHINGLE = 5
SIGNATURES = 2
ROWS = 512
BLOCK_SHINGLES = 1 << 23
#: Shingles of a chunk whose frequent ones are counted, and their least count inside it.
CHUNK = 1 << 21
LOCAL_COUNT = 3
#: Shingles counted this often in such chunks are ordered last, by their count.  The least
#: count doubles until at most MAX_COMMON shingles are left, which bounds what is broadcast.
COMMON_LEAST = 16
MAX_COMMON = 1 << 19
#: Prefix entries of a column block, and the least number of blocks.
BLOCK_ENTRIES = 1 << 21
LEAST_BLOCKS = 16
#: A shingle counted more often is a hot column; rows of a sub-block of one.
HOT_COLUMN = 1 << 15
SUB_ROWS = 1 << 13
#: Least and most buckets of the bitmaps that pre-filter rows, eight for each wanted row between; a collision only costs time.
BITMAP = 1 << 23
MAX_BITMAP = 1 << 27
#: Bits (a float32 each) of a chunk of the bitmaps' product.
CHUNK_BITS = 1 << 22
_WORDS = 150_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _WORDS:
            self[word] = value
        return value


def shingle_set(text: str | None, words_seen: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words_seen.__getitem__, words), dtype=np.uint64, count=n)
    span = min(n, SHINGLE)
    h = np.full(n - span + 1, span, dtype=np.uint64)
    for j in range(span):
        h = h * _P + w[j : n - span + 1 + j]
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return np.unique(h)


def set_key(s: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_digest(s.tobytes())
    return tuple(np.frombuffer(key, dtype="<i8").tolist())


def linked(overlap, n_a, n_b):
    """overlap / union >= NUM / DEN in whole numbers."""
    return DEN * overlap >= NUM * (n_a + n_b - overlap)


def bitmap_of(s: np.ndarray) -> bytes:
    """A bitmap of a set: a power of two of bits, at least two for each shingle, 64 or more."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(m, dtype=np.uint8)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A packed bitmap folded to ``size`` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(bits_a: np.ndarray, n_a: int, bits_b: np.ndarray, n_b: int) -> bool:
    """False only if the bits of one set that the other lacks rule a link out."""
    size = min(len(bits_a), len(bits_b))
    a, b = _folded(bits_a, size), _folded(bits_b, size)
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return bool(linked(most, n_a, n_b))


def hopeful_rows(bitmaps: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which rows of a block may link with another row of it; the bits are multiplied in chunks."""
    out = np.zeros(len(bitmaps), dtype=bool)
    lengths = np.array([len(b) for b in bitmaps])
    for size in np.unique(lengths):
        own = np.flatnonzero((lengths == size) | (lengths == 2 * size))  # sets that link differ by a third at most
        if len(own) < 2:
            continue
        folded = [_folded(bitmaps[i], size) for i in own]
        both, held = np.zeros((len(own), len(own)), dtype=np.float32), np.zeros(len(own))
        step = max(1, CHUNK_BITS // (8 * len(own)))
        for at in range(0, size, step):
            m = np.unpackbits(np.stack([b[at : at + step] for b in folded]), axis=1).astype(np.float32)
            both += m @ m.T
            held += m.sum(axis=1)
        n = sizes[own]
        most = np.minimum(n[:, None] - (held[:, None] - both), n[None, :] - (held[None, :] - both))
        may = linked(most, n[:, None], n[None, :])
        np.fill_diagonal(may, False)
        out[own] |= may.any(axis=1)
    return out


def _hash_pass(documents: DataFrame) -> DataFrame:
    """One row per document (kind 0), and rows of frequent shingles of each chunk (kind 1); bigints beyond doc_id and text are kept."""
    more = [c for c in documents.columns if c not in ("doc_id", "text")]

    def run(batches):
        seen = _WordHashes()
        held, size = [], 0

        def frequent():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays(
                [*(pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))), pa.array([keys[keep].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([counts[keep].tolist()], pa.list_(pa.int64())), *(pa.nulls(1, pa.int64()) for _ in more)],
                names,
            )

        names = ["doc_id", "n", "k1", "k2", "bits", "sig", "hot", "hot_n", *more]
        for batch in batches:
            for part in slices(batch, 512):
                sets = [shingle_set(t, seen) for t in part.column("text").to_pylist()]
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([bitmap_of(s) for s in sets], pa.binary()), pa.array([s[:SIGNATURES].view(np.int64).tolist() for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.list_(pa.int64())), pa.nulls(len(sets), pa.list_(pa.int64())),
                        *(part.column(c) for c in more),
                    ],
                    names,
                )
                held += sets
                size += sum(map(len, sets))
                if size >= CHUNK:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return documents.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bits binary, sig array<bigint>, hot array<bigint>, hot_n array<bigint>" + "".join(f", {c} bigint" for c in more))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``key`` values, of a power of two of buckets between BITMAP and MAX_BITMAP: at most a 64th of them as words reach the driver."""
    size = max(BITMAP, min(MAX_BITMAP, 1 << (8 * keys.count()).bit_length()))
    words = (
        keys.select(F.pmod(F.col("key"), F.lit(size)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    )
    out = np.zeros(size // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets_of(documents: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """(k1, k2, shingles) of the classes in ``wanted`` (k1, k2, rep).

    Texts are not stored with their sets and not shuffled: they are hashed again, only
    where a bitmap of the representatives' ids lets them pass.
    """
    wanted_bits = _bitmap(wanted.select(F.xxhash64("rep").alias("key")))
    shared = documents.sparkSession.sparkContext.broadcast(wanted_bits)

    def run(batches):
        seen, bits, done = _WordHashes(), shared.value, set()
        for batch in batches:
            bit = np.asarray(batch.column("bit"))
            keep = ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
            for part in slices(batch.filter(pa.array(keep)), 2048):
                sets = [shingle_set(t, seen) for t in part.column("text").to_pylist()]
                rows = [(k, s) for k, s in ((set_key(s), s) for s in sets) if k not in done and not done.add(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["k1", "k2", "shingles"]
                )

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(wanted_bits))).alias("bit")
    made = documents.select("text", bit).mapInArrow(run, "k1 bigint, k2 bigint, shingles binary")
    return materialise(made.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), label)


def block_links(sets: list[np.ndarray]) -> np.ndarray:
    """Component (index of its first row) of each row of a block, by the product of its incidence matrix with its transpose."""
    g = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    columns, entry = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(g), sizes)
    used = np.bincount(entry, minlength=len(columns)) > 1
    new = np.cumsum(used) - 1
    keep = used[entry]
    row, entry, n_columns = row[keep], new[entry[keep]], int(used.sum())
    overlap = np.zeros((g, g), dtype=np.float32)
    step = max(1, (1 << 22) // g)
    order = np.argsort(entry, kind="stable")
    row, entry = row[order], entry[order]
    edges = np.searchsorted(entry, np.arange(0, n_columns + step, step))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        if b > a:
            m = np.zeros((g, min(step, n_columns - k * step)), dtype=np.float32)
            m[row[a:b], entry[a:b] - k * step] = 1
            overlap += m @ m.T
    link = linked(overlap, sizes[:, None], sizes[None, :])
    label = np.full(g, -1)
    for i in range(g):
        if label[i] < 0:
            reach = np.zeros(g, dtype=bool)
            reach[i] = True
            front = reach
            while front.any():
                grown = link[front].any(axis=0) & ~reach
                reach |= grown
                front = grown
            label[reach] = i
    return label


def _hopeful(batches):
    """The rows of each (s, block) that may link inside it; the input is sorted by it."""
    rest = None
    names = ["s", "block", "leads", "node", "k1", "k2", "rep"]

    def of(table):
        s, block = table.column("s").to_numpy(), table.column("block").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (block[1:] != block[:-1]), [True]]))
        bits, n = [np.frombuffer(b, dtype=np.uint8) for b in table.column("bits").to_pylist()], table.column("n").to_numpy()
        keep = np.concatenate([hopeful_rows(bits[a:b], n[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
        return table.select(names).filter(pa.array(keep))

    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        s, block = table.column("s").to_numpy(), table.column("block").to_numpy()
        last = int(np.flatnonzero((s == s[-1]) & (block == block[-1]))[0]) if len(s) else 0  # its group may go on
        if last:
            yield from of(table.slice(0, last)).combine_chunks().to_batches()
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield from of(rest).combine_chunks().to_batches()


def _row_blocks(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) of nodes found among classes that share a signature."""
    sigs = classes.select("node", "k1", "k2", "rep", "n", "bits", F.explode("sig").alias("s"))
    # Groups of a signature: their size and first class, summed with map-side combining.  They are a
    # table of their own, so a hot signature of the join can be split (or they are broadcast by size).
    groups = materialise(
        sigs.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.sum("n").alias("held")).where("size > 1")
        .select("s", "first", F.ceil(F.greatest(F.col("size") / F.lit(ROWS), F.col("held") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")),
        "ngram-groups",
    )
    placed = materialise(
        sigs.join(groups, "s").withColumn("leads", F.col("node") == F.col("first"))
        .withColumn("block", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.col("k2"), F.col("blocks")).cast("int")))))
        .repartition("s", "block").sortWithinPartitions("s", "block").select("s", "block", "leads", "node", "k1", "k2", "rep", "n", "bits")
        .mapInArrow(_hopeful, "s bigint, block int, leads boolean, node bigint, k1 bigint, k2 bigint, rep bigint"),
        "ngram-row-blocks",
    )
    sets = _sets_of(documents, placed, "ngram-row-sets")

    def run(batches):
        group, key = [], None

        def solved():
            group.sort(key=lambda r: (not r[0], r[1]))
            label = block_links([np.frombuffer(r[2], dtype=np.uint64) for r in group])
            return [(group[k][1], group[i][1]) for i, k in enumerate(label) if i != k]

        def batch_of(links):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

        for batch in batches:
            links = []
            for s, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, block) != key:
                    if len(group) > 1:
                        links += solved()
                    group, key = [], (s, block)
                group.append(row)
            if links:
                yield batch_of(links)
        if len(group) > 1 and (links := solved()):
            yield batch_of(links)

    return materialise(
        placed.join(sets, ["k1", "k2"]).select("s", "block", "leads", "node", "shingles")
        .repartition("s", "block").sortWithinPartitions("s", "block").mapInArrow(run, "a bigint, b bigint"),
        "ngram-row-links",
    )


def prefix(s: np.ndarray, common: np.ndarray, common_n: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare first: those without a count by value, then by count and value."""
    n = len(s)
    length = n - -(-NUM * n // DEN) + 1 if n else 0
    if not len(common):
        return s[:length]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    hot = common[at] == s
    rare = s[~hot][:length]
    if len(rare) == length:
        return rare
    last = s[hot]
    return np.concatenate([rare, last[np.lexsort((last, common_n[at[hot]]))][: length - len(rare)]])


def column_pairs(h: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Pairs of rows that can still link: same column, other label, and enough shingles left.

    ``h``, ``row``, ``pos``: shingle, row and place of each prefix entry; ``n``, ``label`` by row.
    """
    order = np.argsort(h, kind="stable")
    h, row, pos = h[order], row[order], pos[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(h)))
    lab = label[row]
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    mixed = (np.minimum.reduceat(lab, starts) != np.maximum.reduceat(lab, starts)) & (sizes > 1)
    found = []

    def keep(x, y):
        a, b = row[x], row[y]
        na, nb = n[a], n[b]
        needed = -(-NUM * (na + nb) // (NUM + DEN))
        ok = (label[a] != label[b]) & (np.minimum(na - pos[x], nb - pos[y]) >= needed)
        a, b = a[ok], b[ok]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        if len(found) > 64:
            found[:] = [np.unique(np.concatenate(found), axis=0)]

    small = mixed & (sizes <= 256)
    in_small = np.repeat(small, sizes)
    at, run = np.flatnonzero(in_small), np.repeat(np.arange(len(starts)), sizes)[in_small]
    step = 1
    while len(at) > step:
        same = run[step:] == run[:-step]
        if not same.any():
            break
        keep(at[:-step][same], at[step:][same])
        step += 1
    for k in np.flatnonzero(mixed & (sizes > 256)):
        own = np.arange(starts[k], starts[k] + sizes[k])
        values, inverse, counts = np.unique(lab[own], return_inverse=True, return_counts=True)
        largest = inverse == counts.argmax()
        base, rest = own[largest], own[~largest]
        for i, x in enumerate(rest):
            keep(np.full(len(base) + len(rest) - i - 1, x), np.concatenate([base, rest[i + 1 :]]))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def _mixed(*values: int) -> int:
    """A hash of whole numbers, not negative, above the numbers of plain blocks."""
    return (xxhash.xxh3_64_intdigest(np.array(values, dtype=np.uint64).tobytes()) >> 2) | (1 << 61)


class _HotColumns:
    """Where the entries of hot columns go; ``found`` has the columns that join several labels."""

    def __init__(self, values: np.ndarray, found: dict[int, tuple[int, int, int]] | None = None) -> None:
        self.values, self.found = values, found or {}

    def blocks(self, h: np.ndarray, node: int, label: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, place) of each copy of the entries ``h`` of a row.

        A hot column of one label has no pair to find.  In another, the rows of its commonest label
        meet only the rest, in a grid of sub-blocks, and the rest meets itself by pairs of sub-blocks.
        """
        block, at = (h % np.uint64(blocks)).astype(np.int64), np.arange(len(h))
        if not len(self.values):
            return block, at
        hot = self.values[np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)] == h
        if not hot.any():
            return block, at
        more = []
        for place in np.flatnonzero(hot).tolist():
            value = int(h[place])
            if value not in self.found:
                continue
            base, of_base, of_rest = self.found[value]
            own = _mixed(node, value)
            if label == base:
                more += [(_mixed(value, 0, own % of_base, j), place) for j in range(of_rest)]
            else:
                j = own % of_rest
                more += [(_mixed(value, 0, i, j), place) for i in range(of_base)]
                more += [(_mixed(value, 1, min(j, q), max(j, q)), place) for q in range(of_rest)]
        extra, where = (np.array(c, dtype=np.int64) for c in zip(*more, strict=True)) if more else (np.zeros(0, dtype=np.int64),) * 2
        return np.concatenate([block[~hot], extra]), np.concatenate([at[~hot], where])


def _hot_columns(prefixed: DataFrame, values: np.ndarray) -> _HotColumns:
    """The labels of each hot column are counted where its entries lie; one row for each column that has several is collected."""
    shared = prefixed.sparkSession.sparkContext.broadcast(values)

    def count(batches):
        known = shared.value
        for batch in batches:
            h, sizes = _bytes_of(batch.column("shingles"))
            h = h.view(np.uint64)
            label = np.repeat(batch.column("label").to_numpy(), sizes // 8)
            hot = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            keys, counts = np.unique(np.stack([h[hot].view(np.int64), label[hot]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(counts)], ["h", "label", "n"])

    labels = prefixed.select("label", "shingles").mapInArrow(count, "h bigint, label bigint, n bigint").groupBy("h", "label").agg(F.sum("n").alias("n"))
    found = labels.groupBy("h").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).where("labels > 1").collect()
    parts = lambda n: max(1, -(-n // SUB_ROWS))
    return _HotColumns(values, {r["h"] % 2**64: (r["most"]["label"], parts(r["most"]["n"]), parts(r["n"] - r["most"]["n"])) for r in found})


def _column_blocks(classes: DataFrame, documents: DataFrame, hot: DataFrame, n_entries: int) -> DataFrame:
    """Links (a, b) of labels among classes that the row blocks have not connected; ``classes`` has their labels."""
    spark = documents.sparkSession
    counts = materialise(hot.groupBy("h").agg(F.sum("hn").alias("hn")).where(F.col("hn") >= COMMON_LEAST), "ngram-common")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(F.floor(F.log2("hn")).cast("int").alias("level")).count().collect()}
    level = COMMON_LEAST.bit_length() - 1
    while sum(n for k, n in sizes.items() if k >= level) > MAX_COMMON:
        level += 1
    rows = counts.where(F.col("hn") >= (1 << level)).toPandas()
    values = rows["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    shared = spark.sparkContext.broadcast((values[order], rows["hn"].to_numpy(dtype=np.int64)[order]))

    def prefixes(batches):
        seen, done = _WordHashes(), set()
        common, common_n = shared.value
        for batch in batches:
            for part in slices(batch, 512):
                sets = [shingle_set(t, seen) for t in part.column("text").to_pylist()]
                rows = [(k, s) for k, s in ((set_key(s), s) for s in sets if len(s)) if k not in done and not done.add(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([prefix(s, common, common_n).tobytes() for _, s in rows], pa.binary())],
                    ["k1", "k2", "n", "shingles"],
                )

    blocks = max(LEAST_BLOCKS, -(-n_entries // BLOCK_ENTRIES))
    rows = documents.select("text").mapInArrow(prefixes, "k1 bigint, k2 bigint, n bigint, shingles binary").dropDuplicates(["k1", "k2"])
    prefixed = rows.join(classes.select("k1", "k2", "node", "label"), ["k1", "k2"]).select("node", "label", "n", "shingles")
    hot_values = np.sort(shared.value[0][shared.value[1] > HOT_COLUMN])
    columns = _HotColumns(hot_values)
    if len(hot_values):
        prefixed = materialise(prefixed, "ngram-prefixes")
        columns = _hot_columns(prefixed, hot_values)
    hot_shared = spark.sparkContext.broadcast(columns)

    def deal(batches):
        hot_columns = hot_shared.value
        for batch in batches:
            out = []
            for node, label, n, shingles in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "n", "shingles")), strict=True):
                h = np.frombuffer(shingles, dtype=np.uint64)
                block, at = hot_columns.blocks(h, node, label, blocks)
                if not len(block):  # only hot columns, each of one label: no pair to find
                    continue
                order = np.argsort(block, kind="stable")
                block, pos, h = block[order], at[order].astype("<u4"), h[at[order]]
                edges = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(h)).tolist()
                out += [(int(block[a]), node, label, n, h[a:b].tobytes(), pos[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                if len(out) >= 20_000:
                    yield _dealt(out)
                    out = []
            if out:
                yield _dealt(out)

    def pairs(batches):
        held, current = [], None

        def solved():
            node, label, n, counts, h, pos = (np.concatenate(part) for part in zip(*held, strict=True))
            got = column_pairs(h.view(np.uint64), np.repeat(np.arange(len(node)), counts), pos.view("<u4").astype(np.int64), n, label)
            a, b = got[:, 0], got[:, 1]
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], label[a], label[b])], ["a", "b", "la", "lb"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
            for x, y in zip(edges, edges[1:], strict=False):
                if block[x] != current:
                    if held:
                        yield solved()
                    held, current = [], block[x]
                part = batch.slice(x, y - x)
                h, sizes = _bytes_of(part.column("shingles"))
                held.append((*(part.column(c).to_numpy().copy() for c in ("node", "label", "n")), sizes // 8, h, _bytes_of(part.column("pos"))[0]))
        if held:
            yield solved()

    pair = "a bigint, b bigint, la bigint, lb bigint"
    candidates = materialise(
        prefixed.mapInArrow(deal, "block bigint, node bigint, label bigint, n bigint, shingles binary, pos binary")
        .repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(pairs, pair).distinct(),
        "ngram-candidates",
    )
    def ruled(batches):
        for batch in batches:
            bits = [[np.frombuffer(x, dtype=np.uint8) for x in batch.column(c).to_pylist()] for c in ("xa", "xb")]
            sizes = [batch.column(c).to_pylist() for c in ("na", "nb")]
            keep = [may_link(x, n, y, m) for x, n, y, m in zip(bits[0], sizes[0], bits[1], sizes[1], strict=True)]
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(keep, pa.bool_()))

    mark = lambda x: classes.select(F.col("node").alias(x), F.col("bits").alias(f"x{x}"), F.col("n").alias(f"n{x}"))
    candidates = materialise(
        candidates.join(mark("b"), "b").join(mark("a"), "a").select("a", "b", "la", "lb", "xa", "na", "xb", "nb").mapInArrow(ruled, pair), "ngram-likely"
    )
    ends = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = materialise(ends.join(classes.select("node", "k1", "k2", "rep"), "node"), "ngram-ends")
    sets = ends.join(_sets_of(documents, ends, "ngram-pair-sets"), ["k1", "k2"]).select("node", "shingles")

    def verify(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb"))
            keep = [bool(linked(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y))) for x, y in zip(a, b, strict=True)]
            yield batch.select(["la", "lb"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    return candidates.join(side("b"), "b").join(side("a"), "a").select("la", "lb", "sa", "sb").mapInArrow(verify, "la bigint, lb bigint").distinct()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary column without nulls, and the size of each value."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].copy(), np.diff(offsets)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "node", "label", "n", "shingles", "pos"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) for every row of ``documents``."""
    return _placed(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "n_shingles", "component_id", "n_copies")


def _placed(documents: DataFrame) -> DataFrame:
    """As near_duplicates, with the further columns of ``documents`` and the component itself (null without shingles), whatever its ids."""
    more = [c for c in documents.columns if c not in ("doc_id", "text")]
    hashed = materialise(_hash_pass(documents), "ngram-hashed")
    rows = hashed.where(F.col("n").isNotNull()).select("doc_id", "n", "k1", "k2", "sig", "bits", *more)
    hot = hashed.where(F.col("n").isNull()).select(F.explode(F.arrays_zip("hot", "hot_n")).alias("e")).select(F.col("e.hot").alias("h"), F.col("e.hot_n").alias("hn"))
    classes = materialise(
        rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id()),
        "ngram-classes",
    )
    n_docs, n_shingles = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    labels = components(_row_blocks(classes, documents)).withColumnRenamed("component", "found")
    labelled = materialise(classes.join(labels, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found", "sig"), "ngram-labelled")
    joined = components(_column_blocks(labelled, documents, hot, (n_shingles or 0) // DEN + n_docs), "la", "lb")
    placed = labelled.join(joined.withColumnRenamed("node", "label"), "label", "left").withColumn("component", F.coalesce("component", "label"))
    placed = materialise(placed.select("k1", "k2", "component", "rep", "n_copies"), "ngram-placed")
    # A table of its own, so the join of a large component can be split (or it is broadcast by size).
    least = materialise(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "ngram-least")
    named = materialise(placed.join(least, "component").select("k1", "k2", "component", "component_id", "n_copies"), "ngram-named")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(None).cast("bigint").alias("component"), *more)
    return rows.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies", "component", *more).unionByName(alone)


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` without those that another row of their component stands for.

    Of each component one row stays: the least by id (rows without an id come last), then by
    two hashes of its text, then by all columns in their order, which so have to be of types
    that can be ordered.  Rows that share an id but not a component are no copies of each
    other.  Rows without shingles are copies only under one id; those without an id all stay.
    """
    key = ["k0", "k1", "k2"]
    missing, doc_id = F.col("doc_id").isNull(), F.col("doc_id").cast("bigint")
    # The row is one struct, so none of its columns can clash.
    keyed = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), doc_id.alias("doc_id"), "text",
        F.xxhash64(missing, F.coalesce(doc_id, F.lit(0))).alias("k0"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"),
    )
    found = _placed(keyed.select("doc_id", "text", *(F.col(c).alias(f"own_{c}") for c in key))).withColumn("missing", missing)
    order = F.struct("missing", "doc_id", *(f"own_{c}" for c in ("k1", "k2", "k0")))
    least = found.where("component is not null or not missing").groupBy("component", F.when(F.col("component").isNull(), F.col("doc_id")).alias("alone")).agg(F.min(order).alias("least"))
    stays = least.select(*(F.col(f"least.own_{c}").alias(c) for c in key))
    kept = keyed.drop("text", "doc_id").join(stays, key, "left_semi").groupBy(*key).agg(F.min("doc").alias("doc")).select("doc.*")
    return kept.unionByName(documents.where(missing & ~F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))))
