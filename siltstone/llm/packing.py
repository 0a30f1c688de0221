"""Best-fit packing of documents into training sequences, hierarchically.

Each map task tokenizes its documents, cuts only those longer than a sequence, and packs
its pieces best-fit in falling length.  Sequences that are nearly full are done.  Underfull
ones are items of the next round: they are dealt to groups of about ``GROUP_ITEMS``, packed
best-fit again, and so on up the tree until one group is left.  No two sequences that best-fit
leaves in a group fit together, so at most one of them is half full or less, and only such a
one can still join another: a group sends up its half-full one and its emptiest
``1 / NARROWING`` as receivers, and the rest is done.  So every round has an eighth of the
groups of the one before, and no task more than a group's items, whether or not anything
merged.  The moves of all rounds are composed and joined to the pieces once.

Edge cases: a null or empty text has the end id alone.  Null and repeated ids and repeated
rows are packed like any row.  Text of any length is cut into full pieces, so no piece is
lost or truncated.  An empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, slices
from .tokenize import WordTokenizer, tokenizer_path

#: A sequence with at most this many free places is done.
NEARLY_FULL = 8
#: Underfull sequences of a group in the tree.
GROUP_ITEMS = 50_000
#: A group sends at most 1 / NARROWING of GROUP_ITEMS up the tree, and one more.
NARROWING = 8
#: Pieces that a map task holds before it packs them.
LOCAL_ITEMS = 100_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item and the fill of each bin.

    Bins are kept by free places, and one integer has a bit for each number of free places
    that some open bin has, so the tightest bin that fits is one shift and lowest bit away.
    """
    bins, offsets, fills = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            k = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            k, free = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = k, capacity - free
        free -= size
        fills[k] = capacity - free
        if free:
            open_bins[free].append(k)
            mask |= 1 << free
    return bins, offsets, np.array(fills, dtype=np.int64)


def _local(documents: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    def run(batches):
        words = WordTokenizer(tokenizer)
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def packed():
            nonlocal first, rows
            bins, offsets, fills = best_fit(np.array([r[3] for r in rows], dtype=np.int64), capacity)
            columns = [*zip(*rows, strict=True)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(bins + first), pa.array(offsets), pa.array(fills[bins])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"],
            )
            first, rows = first + len(fills), []
            return out

        for batch in batches:
            for part in slices(batch, 256):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(words.encode(text), np.uint32(end_id))
                    data = memoryview(ids.tobytes())
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = data[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, k, start, len(own) // 4, zlib.crc32(own)))
                if len(rows) >= LOCAL_ITEMS:
                    yield packed()
        if rows:
            yield packed()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def _merge(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """One round: (bin, fill) to (bin, new_bin, shift, new_fill, up), best-fit inside each of ``groups``; ``up``: a sequence for the next round."""
    most = max(1, GROUP_ITEMS // NARROWING)

    def run(batches):
        bins, fills = [], []
        for batch in batches:
            bins.append(batch.column("bin").to_numpy(zero_copy_only=False))
            fills.append(batch.column("fill").to_numpy(zero_copy_only=False))
        if not bins:
            return
        bin_, fill = np.concatenate(bins), np.concatenate(fills)
        order = np.lexsort((bin_, -fill))
        bin_, fill = bin_[order], fill[order]
        to, shift, total = best_fit(fill, capacity)
        name = np.zeros(len(total), dtype=np.int64)
        name[to[::-1]] = bin_[::-1]  # a merged sequence takes its first member's number
        if len(bin_):
            goes = np.zeros(len(total), dtype=bool)
            goes[np.argsort(total, kind="stable")[: most + 1]] = True  # the half-full one, if any, comes first
            goes &= total < capacity - NEARLY_FULL
            yield pa.RecordBatch.from_arrays(
                [pa.array(bin_), pa.array(name[to]), pa.array(shift), pa.array(total[to]), pa.array(goes[to] & (name[to] == bin_))], ["bin", "new_bin", "shift", "new_fill", "up"]
            )

    return items.repartition(groups, "bin").mapInArrow(run, "bin bigint, new_bin bigint, shift bigint, new_fill bigint, up boolean")


def tree(items: DataFrame, capacity: int) -> DataFrame | None:
    """(bin, new_bin, shift) of the sequences ``items`` (bin, fill) after all rounds; None without items."""
    moves, groups = None, 0
    while groups != 1:
        count = items.count()
        if not count:
            break
        groups = -(-count // GROUP_ITEMS) if not groups else min(-(-count // GROUP_ITEMS), groups - 1)
        made = materialise(_merge(items, groups, capacity), "pack-moves")
        if moves is None:
            moves = made.select("bin", "new_bin", "shift")
        else:
            later = made.select(F.col("bin").alias("new_bin"), F.col("new_bin").alias("to"), F.col("shift").alias("more"))
            moves = materialise(
                moves.join(later, "new_bin", "left").select(
                    "bin", F.coalesce("to", "new_bin").alias("new_bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
                ),
                "pack-composed",
            )
        items = made.where("up").select("bin", F.col("new_fill").alias("fill"))
    return moves


def pack(documents: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    pieces = materialise(_local(documents, capacity, end_id, tokenizer or tokenizer_path()), "pack-pieces")
    underfull = F.col("fill") < capacity - NEARLY_FULL
    items = pieces.where(underfull & (F.col("offset") == 0)).select("bin", "fill")
    moves = tree(items, capacity)
    if moves is None:
        placed = pieces.withColumns({"new_bin": F.lit(None).cast("bigint"), "shift": F.lit(None).cast("bigint")})
    else:
        placed = pieces.join(moves, "bin", "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("new_bin", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
