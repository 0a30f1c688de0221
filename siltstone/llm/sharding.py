"""Sharding: vector bin packing of groups of equal texts, balancing bytes, tokens and rows jointly.

Law ``bytes``: shard sizes near equal, where a row's size is the UTF-8 bytes of its text
plus 16.  Rows with equal text form a group and go to one shard together.  Only a group that
is heavier than a whole shard, which no balance can hold, is dealt in as few equal chunks as
fit a shard each, by a hash of its rows' ids.  Heavy groups (chunks included) are single items;
the many light groups are first dealt by their text's hash to a fixed number of bundles, each an
item.  The number of items so has a bound that does not grow with the input, and only
their three sums reach the driver.  Items go in falling order of size, each to the shard, of
those whose residual bytes hold it, where the dot product of its vector (bytes, tokens, rows,
as shares of a shard's capacity) with the shard's residual capacity is highest.

Within a shard, slots count from 0 without a gap.  They follow (bucket, hash, doc_id): rows
are numbered inside small buckets and shifted by the sizes of the buckets before, so no
task sorts a whole shard.

Edge cases: a null text counts as empty (size 16, crc32 0).  Null ids, repeated ids and
repeated rows are kept, one output row each; rows without an id are spread by their place in
the table.  An empty table gives no rows.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

ROW_OVERHEAD = 16
#: Bundles of light groups for each shard; items of heavy groups number at most twice as many.
BUNDLES_PER_SHARD = 128
#: Rows of a bucket in which slots are numbered.
BUCKET_ROWS = 4000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (n x 3 non-negative sums), by dot product with the residual capacity.

    Items go in falling order of their largest share.  As the law is on bytes, an item goes to
    a shard whose residual bytes hold it; where none does, to the one with most of them.  Ties
    go to the lower shard.
    """
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-9)
    share = items / capacity
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        dot = np.where(residual[:, 0] >= share[i, 0], residual @ share[i], -np.inf)
        best = int(np.argmax(dot))
        if dot[best] == -np.inf:
            best = int(np.argmax(residual[:, 0]))
        out[i] = best
        residual[best] -= share[i]
    return out


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("bigint").alias("size"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.hash(text, F.lit(9)).alias("h2"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id()).alias("spread"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total[1]:
        return _result(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}))
    capacity = total[0] / shards
    heavy_from = capacity / BUNDLES_PER_SHARD

    key = ["h1", "h2", "text_crc32"]
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    # At most shards * BUNDLES_PER_SHARD groups can weigh this much, whatever the input.
    heavy = {(r["h1"], r["h2"], r["text_crc32"]): r for r in groups.where(F.col("size") >= heavy_from).collect()}
    n_bundles = shards * BUNDLES_PER_SHARD
    heavy_df = spark.createDataFrame(
        [(*k, max(1, math.ceil(r["size"] / capacity))) for k, r in heavy.items()], "h1 bigint, h2 int, text_crc32 bigint, chunks int"
    )
    salted = rows.join(F.broadcast(heavy_df), key, "left")
    part = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("h1", "h2"), F.lit(n_bundles))).otherwise(
        F.pmod(F.xxhash64("spread", F.lit(5)), F.col("chunks"))
    )
    # An item: (bundle number) or (heavy group, chunk number).
    item = F.struct(
        F.when(F.col("chunks").isNotNull(), F.col("h1")).alias("a"), F.when(F.col("chunks").isNotNull(), F.col("h2")).alias("b"),
        F.when(F.col("chunks").isNotNull(), F.col("text_crc32")).alias("d"), part.cast("int").alias("c"),
    )
    found = salted.withColumn("n", F.lit(1)).groupBy(item.alias("item")).agg(*sums).collect()
    found.sort(key=lambda r: (r["item"]["a"] is not None, r["item"]["a"] or 0, r["item"]["b"] or 0, r["item"]["d"] or 0, r["item"]["c"]))
    where = place(np.array([[r["size"], r["tokens"], r["n"]] for r in found], dtype=np.float64), shards)
    placed = spark.createDataFrame(
        [(r["item"]["a"], r["item"]["b"], r["item"]["d"], r["item"]["c"], int(s)) for r, s in zip(found, where, strict=True)],
        "a bigint, b int, d bigint, c int, shard int",
    )
    dealt = salted.withColumn("item", item).alias("l").join(
        F.broadcast(placed), F.expr("l.item.a <=> a AND l.item.b <=> b AND l.item.d <=> d AND l.item.c = c")
    ).select("doc_id", "size", "text_crc32", "spread", "shard")

    buckets = max(1, math.ceil(total[1] / shards / BUCKET_ROWS))
    dealt = materialise(
        dealt.withColumn("draw", F.xxhash64("spread", "text_crc32", F.lit(7))).withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int")), "shard-dealt"
    )
    before = F.sum("rows_here").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows_here")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("draw", "doc_id", "text_crc32", "size"))
    return _result(dealt.withColumn("number", number).join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("number") - 1))


def _result(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
