"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source token shares ``p`` are raised to an exponent ``a`` in [0, 1] and normalised:
``w = p^a / sum p^a``.  The exponent is the largest at which the mix has the target entropy
(a share of the greatest, log of the number of sources), raised where a source would
otherwise be repeated more than ``max_repetition`` times within the token budget.  By
default the budget is the least at which every document is taken once, so mixing repeats
light sources and drops nothing; a smaller budget samples the heavy ones.  Both conditions
are monotonic in ``a``, so it is bisected; one job evaluates ``2^STEPS - 1``
exponents at once, which is ``STEPS`` bisections, and the sources never leave Spark.

The weights are realised as budgeted block permutations.  Source ``s`` owes
``round(w_s * budget)`` tokens.  Its documents are permuted by a hash anew in each pass
(epoch), taken pass after pass while the tokens before a document are below what is owed, and
the place of a document in its source's quota gives its block.  So each block holds
each source in its target weight, and inside a block documents follow another hash.
Running sums go over hash buckets of bounded size, shifted by the sums of the buckets
before, so a source with a third of all rows is spread like any other.

Edge cases: a null source is a source of its own.  A null text has no tokens; a document
without tokens is taken in the first pass if its place is within the quota.  Rows of a null
or a repeated id are each mixed as rows, but those of equal id, source and text share a
hash: a pass takes all of them or none, into one block, so the last pass of a source may
exceed its quota by such a group, and none is ranked in one task.  An empty table, or one
without any token, is returned as it is (one pass, one block).  One source keeps weight 1.
Columns of ``documents`` are carried under one struct, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: Share of the greatest possible entropy that the mix has at least, unless repetition forbids it.
TARGET_ENTROPY_SHARE = 0.97
MAX_REPETITION = 2.0
#: Tokens of a block at most, and blocks of a stream at least (where it has as many tokens).
BLOCK_TOKENS = 1 << 22
LEAST_BLOCKS = 16
#: Rows of a hash bucket in which running sums are taken.
BUCKET_ROWS = 4000
STEPS, ROUNDS = 5, 6
#: Terms are rounded to this decimal type before they are added, so sums do not depend on order.
_TERM = "decimal(38,18)"


def n_tokens(text: Column) -> Column:
    """Words of a text, the token measure of the mix."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def exponent(sources: DataFrame, target_entropy_share: float, max_repetition: float, budget: float | None, total: float, n: int) -> float:
    """The exponent of the mix; ``sources`` has a positive ``tokens`` for each source."""
    target = target_entropy_share * math.log(max(n, 1))
    k = 1 << STEPS

    def search(holds: Column, low: float, high: float, largest: bool) -> float:
        for _ in range(ROUNDS):
            tries = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.lit(low) + i * F.lit((high - low) / k))
            p = F.col("tokens") / F.lit(total)
            term = F.exp(F.col("a") * F.log(p))
            found = (
                sources.select("tokens", F.explode(tries).alias("a"))
                .groupBy("a").agg(
                    F.sum(term.cast(_TERM)).cast("double").alias("z"),
                    F.sum((term * F.col("a") * F.log(p)).cast(_TERM)).cast("double").alias("zl"),
                    F.max(term / F.col("tokens")).alias("most"),
                    F.min(term / F.col("tokens")).alias("least"),
                ).select("a", holds.alias("ok")).collect()
            )
            good = [r["a"] for r in found if r["ok"]]
            step = (high - low) / k
            if largest:
                low, high = (max(good), max(good) + step) if good else (low, low + step)
            else:
                low, high = (min(good) - step, min(good)) if good else (high - step, high)
        return round(low if largest else high, 9)

    entropy = F.log("z") - F.col("zl") / F.col("z")
    a = search(entropy >= F.lit(target), 0.0, 1.0, largest=True)
    repetition = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * F.lit(budget)
    return max(a, search(repetition <= F.lit(max_repetition), 0.0, 1.0, largest=False)) if max_repetition else a


def mix(
    documents: DataFrame, target_entropy_share: float = TARGET_ENTROPY_SHARE, max_repetition: float = MAX_REPETITION,
    budget: int | None = None, block_tokens: int | None = None, seed: int = 5, carry: list[str] | None = None,
) -> DataFrame:
    """The mixed stream: columns ``doc`` (a struct of the row), ``source``, ``tokens``, ``epoch``, ``block``, ``place``.

    ``budget``: tokens of the stream, by default the least that holds every document.
    ``block_tokens``: of a block, by default from the budget: BLOCK_TOKENS, or less where that gives fewer than LEAST_BLOCKS blocks.
    ``carry``: the columns of ``documents`` in ``doc``, by default all; others are not shuffled.
    """
    # The draw rests on the row's text as well, so equal ids do not pile up in one bucket.
    keyed = documents.select(
        F.struct(*(carry or documents.columns)).alias("doc"), "source", n_tokens(F.col("text")).alias("tokens"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("draw")
    )
    slim = materialise(keyed.select("source", "tokens", "draw"), "mix-rows")
    sources = materialise(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-sources")
    total, most_rows, n = sources.agg(F.sum("tokens"), F.max("n_rows"), F.count(F.when(F.col("tokens") > 0, 1))).first()
    if not total:
        return keyed.select("doc", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("place"))
    whole = budget is None
    a = exponent(sources.where("tokens > 0"), target_entropy_share, max_repetition, None if whole else float(budget), float(total), n)
    term = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(total)))))
    z, least = sources.agg(F.sum(term.cast(_TERM)).cast("double"), F.min(term / F.col("tokens"))).first()
    if whole:
        budget = z / least
    owed = F.coalesce(F.round(term / F.lit(z) * F.lit(float(budget))), F.lit(0)).cast("bigint")
    quota = sources.select("source", F.col("tokens").alias("source_tokens"), (F.greatest(owed, F.col("tokens")) if whole else owed).alias("owed"))

    blocks = max(1, round(budget / (block_tokens or max(1, min(BLOCK_TOKENS, budget / LEAST_BLOCKS)))))
    buckets = max(1, math.ceil(most_rows / BUCKET_ROWS))
    same = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    # Passes of a source: owed over its tokens, at most max_repetition rounded up.
    passes = F.greatest(F.lit(1), F.ceil(F.col("owed") / F.greatest(F.col("source_tokens"), F.lit(1)))).cast("int")
    # Repeated rows share a draw; one row stands for each and carries their number.
    rows = slim.groupBy("source", "draw").agg(F.sum("tokens").alias("weight"), F.max("tokens").alias("tokens"))
    runs = rows.alias("r").join(quota.alias("q"), same("r", "q")).select(
        "r.source", "draw", "weight", "tokens", "owed", "source_tokens", F.explode(F.sequence(F.lit(0), passes - 1)).alias("epoch")
    )
    runs = runs.withColumn("order", F.xxhash64(F.lit(seed + 1), "epoch", "draw"))
    runs = materialise(runs.withColumn("bucket", (F.shiftright(F.col("order"), 33) + F.lit(1 << 30)) * F.lit(buckets) / F.lit(1 << 31)).withColumn("bucket", F.col("bucket").cast("int")), "mix-runs")
    in_order = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.groupBy("source", "epoch", "bucket").agg(F.sum("weight").alias("sum_here")).withColumn("shift", F.coalesce(F.sum("sum_here").over(in_order), F.lit(0))).drop("sum_here")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("order", "draw").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    taken = (
        runs.alias("r").join(shift.alias("s"), same("r", "s") & (F.col("r.epoch") == F.col("s.epoch")) & (F.col("r.bucket") == F.col("s.bucket")))
        .select("r.source", "draw", "r.epoch", "owed", "tokens", (F.col("r.epoch") * F.col("source_tokens") + F.col("shift") + F.col("before")).alias("at"))
        .where((F.col("at") < F.col("owed")) | ((F.col("epoch") == 0) & (F.col("at") <= F.col("owed")) & (F.col("tokens") == 0)))
        .select("source", "draw", "epoch", F.least(F.lit(blocks - 1), F.floor(F.col("at") / F.greatest(F.col("owed"), F.lit(1)) * F.lit(blocks))).cast("bigint").alias("block"))
    )
    place = F.xxhash64(F.lit(seed + 2), "k.draw", "epoch")
    return keyed.alias("k").join(taken.alias("t"), same("k", "t") & (F.col("k.draw") == F.col("t.draw"))).select("k.doc", "k.source", "k.tokens", "t.epoch", "t.block", place.alias("place"))
