"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are assigned to the nearest pivot and, inside it, to a ring of about equal norm; both
together are a cell.  Only a summary of each cell reaches the driver: its rows, its queries, its
radius (greatest distance from the pivot), its greatest norm, and the range of its vectors along
the pivot with their greatest part across it.  Two rounds follow:

1. Each query is solved on its nearest cells, as many as hold k others.  The k-th score found
   is a true lower bound of its k-th best, ``theta``.
2. For a query ``q`` and a cell with pivot ``p`` no score exceeds the least of ``q.p + |q| r``,
   ``|q| max|x|`` and ``max(q.u a) + |q across u| h`` (``u`` the pivot's direction, ``a`` the
   cell's range along it, ``h`` its part across).  Only cells where this reaches ``theta`` are asked.

Queries are grouped by pivots, neighbouring pivots together up to ``QUERY_BLOCK``; data rows are
replicated only to the query groups that need their cell, and cells heavier than a block
are salted into blocks, so no task sees a whole hot cell.  A block has up to ``DATA_BLOCK``
rows, so the copies of the queries of a group are few beside the data that they meet.  Each
(query group, block) is solved by one matrix product, and the partial lists are merged.

How much the bounds save rests on the vectors: in clusters most cells are ruled out, but of
directions drawn evenly in many dimensions no such bound rules out much, and the join
then compares all queries with all rows, in blocks.

Scores are integers and exact: products run in float64 only where they stay below 2^53, and
else in int64.

Edge cases: vectors that are null or hold null or non-finite components, and rows with a
null id, take no part.  Rows that repeat an id are rows of their own: each is a candidate of all
others, and each query row gets its own ranks.  Shorter vectors are filled up with zeros.
Ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives
no rows.  Only the id and the vector column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: The pivots are a hash sample of the rows: the square root of their number, at most MAX_PIVOTS.
MAX_PIVOTS = 4096
#: Rows and components of a data block, and query rows of a group.
DATA_BLOCK = 1 << 16
BLOCK_COMPONENTS = 1 << 22
QUERY_BLOCK = 2048
_SLACK = 1e-6


def floor_scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def valid(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return embedding.isNotNull() & ~F.exists(embedding, lambda x: F.coalesce(bad(x), F.lit(True)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of bigint to a matrix, short rows filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def local_topk(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """(query index, data index, score) of each query's k best, ties to the smaller id, own row excluded."""
    order = np.lexsort((rows, ids))
    data, rows = data[order], rows[order]
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1]) < 2**53
    left, right = (queries.astype(np.float64), data.astype(np.float64).T) if exact else (queries, data.T)
    out, step = [], max(1, (1 << 22) // max(1, len(data)))
    for at in range(0, len(queries), step):
        scores = left[at : at + step] @ right
        for i, row in enumerate(scores):
            keep = np.flatnonzero(rows != query_rows[at + i])
            if len(keep) > k:
                cut = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                keep = keep[row[keep] >= cut]
            best = keep[np.argsort(-row[keep], kind="stable")[:k]]
            out.append((np.full(len(best), at + i), order[best], row[best].astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3


def _query_groups(pivots: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, blocks) of each pivot's queries: a chain of nearest pivots, cut at QUERY_BLOCK queries."""
    square, left, chain = (pivots * pivots).sum(axis=1), np.ones(len(pivots), dtype=bool), [0]
    left[0] = False
    for _ in range(len(pivots) - 1):
        near = np.where(left, square - 2 * pivots @ pivots[chain[-1]], np.inf)
        chain.append(int(np.argmin(near)))
        left[chain[-1]] = False
    group, blocks = np.zeros(len(pivots), dtype=np.int64), np.ones(len(pivots), dtype=np.int64)
    number, held = 0, 0
    for c in chain:
        if held and held + queries[c] > QUERY_BLOCK:
            number, held = number + 1, 0
        group[c] = number
        held += int(queries[c])
        blocks[c] = max(1, -(-int(queries[c]) // QUERY_BLOCK))
    return group, blocks


class Cells:
    """The summaries of all cells, and the bounds that follow from them."""

    def __init__(self, pivots: np.ndarray, found: list) -> None:
        found = sorted(found, key=lambda r: r["cell"])
        self.cell = np.array([r["cell"] for r in found], dtype=np.int64)
        self.count, self.queries, self.far, self.norm, self.low, self.high, self.across = (
            np.array([r[c] for r in found], dtype=np.float64) for c in ("n", "nq", "far", "norm", "low", "high", "across")
        )
        self.pivot = pivots[self.cell // RINGS]

    def middle(self, q: np.ndarray) -> np.ndarray:
        return q @ self.pivot.T

    def first(self, middle: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells of each query that hold k others."""
        order = np.argsort(-middle, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(middle.shape, dtype=bool)
        np.put_along_axis(out, order, before < k + 1, axis=1)  # one more, as the query may be among them
        return out

    def bound(self, q: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """No row of the cell scores more."""
        size, length = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((self.pivot * self.pivot).sum(axis=1))[None, :]
        along = middle / np.maximum(length, 1e-300)
        turned = np.maximum(along * self.low, along * self.high) + np.sqrt(np.maximum(size * size - along * along, 0)) * self.across
        most = np.minimum(np.minimum(middle + size * self.far, size * self.norm), np.where(length > 0, turned, np.inf))
        return most + _SLACK * (np.abs(middle) + size * self.norm + 1)


#: Rings of a pivot: half powers of two of the norm.
RINGS = 256


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows."""
    return _join(vectors, is_query, k, scale, id_column, vector_column, max_pivots)[0]


def _join(vectors: DataFrame, is_query: Column, k: int, scale: int, id_column: str, vector_column: str, max_pivots: int):
    """The result, the routed (query row, cell) pairs and the number of cells."""
    spark = vectors.sparkSession
    rows = materialise(
        vectors.where(valid(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
            floor_scaled(F.col(vector_column), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"),
        ),
        "topk-rows",
    )
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n < 2:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint"), None, 0
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(4)), "vec_id", "v").limit(int(min(max_pivots, max(1, round(n**0.5))))).collect()
    pivots = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        pivots[i, : len(r["v"])] = r["v"]

    def assign(batches):
        square, length = (pivots * pivots).sum(axis=1), np.sqrt((pivots * pivots).sum(axis=1))
        step = max(1, (1 << 22) // len(pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column("v"), width).astype(np.float64)
                own = (square[None, :] - 2 * x @ pivots.T).argmin(axis=1)
                p, norm = pivots[own], np.sqrt((x * x).sum(axis=1))
                along = (x * p).sum(axis=1) / np.maximum(length[own], 1e-300)
                across = np.sqrt(((x - along[:, None] * p / np.maximum(length[own], 1e-300)[:, None]) ** 2).sum(axis=1))
                ring = np.clip(np.floor(2 * np.log2(np.maximum(norm, 1)) + 0.5), 0, RINGS - 1)
                made = [own * RINGS + ring.astype(np.int64), np.sqrt(((x - p) ** 2).sum(axis=1)), norm, along, across]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "row", "v", "q")), *map(pa.array, made)], ["vec_id", "row", "v", "q", "cell", "far", "norm", "along", "across"])

    cells = materialise(rows.mapInArrow(assign, "vec_id bigint, row bigint, v array<bigint>, q boolean, cell bigint, far double, norm double, along double, across double"), "topk-cells")
    most = [F.max(c).alias(c) for c in ("far", "norm", "across")]
    known = Cells(pivots, cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("nq"), *most, F.min("along").alias("low"), F.max("along").alias("high")
    ).collect())
    asking = np.bincount(known.cell // RINGS, known.queries, minlength=len(pivots)).astype(np.int64)
    group, query_blocks = _query_groups(pivots, asking)
    data_blocks = np.maximum(1, np.ceil(known.count / max(1, min(DATA_BLOCK, BLOCK_COMPONENTS // max(1, width))))).astype(np.int64)
    # At most pivots x rings rows, whatever the input.
    layout = F.broadcast(spark.createDataFrame([(int(c), int(b), int(group[c // RINGS]), int(query_blocks[c // RINGS])) for c, b in zip(known.cell, data_blocks, strict=True)], "cell bigint, blocks int, grp int, subs int"))

    def route(again: bool):
        def run(batches):
            step = max(1, (1 << 20) // len(known.cell))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    q = _matrix(part.column("v"), width).astype(np.float64)
                    middle = known.middle(q)
                    wanted = known.first(middle, k)
                    if again:
                        theta = np.array([-np.inf if t is None else t for t in part.column("theta").to_pylist()])
                        wanted = (known.bound(q, middle) >= theta[:, None]) & ~wanted
                    at, cell = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in ("row", "vec_id", "grp", "sub")), pa.array(known.cell[cell])], ["row", "query_id", "grp", "sub", "cell"])

        return run

    asked = cells.where("q").join(layout, "cell").select("row", "vec_id", "v", "grp", F.pmod(F.xxhash64("row", F.lit(1)), F.col("subs")).cast("int").alias("sub"))
    data = cells.join(layout, "cell").select("vec_id", "row", "v", "cell", F.pmod(F.xxhash64("row", F.lit(2)), F.col("blocks")).cast("int").alias("block"))
    key = ["grp", "sub", "cell", "block"]

    def solve(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        query_rows, query_ids, ids, own = (t.column(c).to_numpy() for t, c in ((left, "row"), (left, "query_id"), (right, "vec_id"), (right, "d_row")))
        i, j, score = local_topk(_matrix(left.column("v"), width), query_rows, _matrix(right.column("d_v"), width), ids, own, k)
        return pa.table([pa.array(c) for c in (query_rows[i], query_ids[i], own[j], ids[j], score)], names=names)

    def best(scores: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
        return scores.withColumn("rank", rank).where(F.col("rank") <= k)

    def solved(routed: DataFrame) -> DataFrame:
        """The partial lists of routed queries: one row for each query and block that it meets."""
        met = routed.join(layout.select("cell", "blocks"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = met.join(asked.select("row", "v"), "row").select("row", "query_id", "v", *key)
        # Names of its own, as both sides come from one table.
        right = data.join(routed.select("grp", "sub", "cell").distinct(), "cell").select("vec_id", *(F.col(c).alias(f"d_{c}") for c in ("row", "v", *key)))
        return left.groupBy(*key).cogroup(right.groupBy(*(f"d_{c}" for c in key))).applyInArrow(solve, "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")

    routes = "row bigint, query_id bigint, grp int, sub int, cell bigint"
    near = materialise(asked.mapInArrow(route(False), routes), "topk-near")
    found = materialise(best(solved(near)).drop("rank"), "topk-found")
    theta = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("theta")).where(F.col("held") == k).select(F.col("query_row").alias("row"), "theta")
    rest = materialise(asked.join(theta, "row", "left").mapInArrow(route(True), routes), "topk-rest")
    result = best(found.unionByName(solved(rest))).select("query_id", "rank", "vec_id", "score")
    return result, near.unionByName(rest).select("row", "cell"), len(known.cell)
