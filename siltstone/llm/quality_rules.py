"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are grown here in numpy on histogram bins with monotonic constraints on the
features whose sign in ``text_stats.FEATURES`` is not 0, and flattened into node arrays
that score a whole batch with one gather per level.

Edge cases: null and empty texts have no words, so they fail the base rules and are not
kept.  Equal texts get equal rows.  Every input row gives exactly one output row; an empty
table gives none.  Without labelled rows of both classes the trees are empty and the
verdict rests on the base rules alone.  Only ``doc_id`` and ``text`` are read, so further
columns do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_stats as ts
from ._common import bounded_sample, slices

#: Rows of each class that the trees are fitted on, at most about; the documented bound.
TRAIN_PER_LABEL = 2500
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SLICE = 256


@dataclass
class Trees:
    """Nodes of all trees, level order, padded to one depth: a node without a split sends all rows left."""

    depth: int
    bias: float
    feature: np.ndarray = field(repr=False)  # trees x (2**depth - 1)
    threshold: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 48, l2: float = 1.0, min_child: float = 1.0,
) -> Trees:
    """Boosted trees for log loss.  ``signs``: per feature -1, 0 or 1.

    A split on a constrained feature must order its children's values by the sign, and the
    children inherit the midpoint as a bound, so no deeper node can break the order.
    """
    n_inner, n_leaf = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Trees(depth, float(np.log(p / (1 - p))) if len(y) else 0.0, np.zeros((0, n_inner), int), np.zeros((0, n_inner)), np.zeros((0, n_leaf)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias, raw = 0.0, np.zeros(len(y))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(n_inner, int), np.full(n_inner, np.inf)
        low, high = np.full(n_inner + n_leaf, -np.inf), np.full(n_inner + n_leaf, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(n_inner):
            inside = np.flatnonzero(node == k)
            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
            if len(inside) >= 2:
                best = _best_split(binned[inside], g[inside], h[inside], cuts, signs, low[k], high[k], l2, min_child)
                if best:
                    j, cut, left, right = best
                    feature[k], threshold[k] = j, cuts[j][cut]
                    if signs[j]:
                        mid = (left + right) / 2
                        if signs[j] > 0:
                            high[2 * k + 1], low[2 * k + 2] = mid, mid
                        else:
                            low[2 * k + 1], high[2 * k + 2] = mid, mid
            node[inside] = 2 * k + 1 + (x[inside, feature[k]] > threshold[k])
        value = np.zeros(n_leaf)
        for leaf in range(n_leaf):
            inside = node == n_inner + leaf
            value[leaf] = rate * np.clip(-g[inside].sum() / (h[inside].sum() + l2), low[n_inner + leaf], high[n_inner + leaf])
        value = np.nan_to_num(value)
        raw += value[node - n_inner]
        trees.append((feature, threshold, value))
    return Trees(depth, bias, *(np.stack(part) for part in zip(*trees, strict=True)))


def _best_split(binned, g, h, cuts, signs, low, high, l2, min_child):
    best, gain_of_best = None, 1e-6
    total_g, total_h = g.sum(), h.sum()
    clip = lambda v: np.clip(v, low, high)
    loss = lambda v, gg, hh: -(gg * v + 0.5 * (hh + l2) * v * v)
    whole = loss(clip(-total_g / (total_h + l2)), total_g, total_h)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        gl = np.cumsum(np.bincount(binned[:, j], g, len(cut) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], h, len(cut) + 1))[:-1]
        left, right = clip(-gl / (hl + l2)), clip(-(total_g - gl) / (total_h - hl + l2))
        gain = loss(left, gl, hl) + loss(right, total_g - gl, total_h - hl) - whole
        gain[(hl < min_child) | (total_h - hl < min_child)] = -1
        if signs[j]:
            gain[signs[j] * (right - left) < 0] = -1
        k = int(np.argmax(gain))
        if gain[k] > gain_of_best:
            best, gain_of_best = (j, k, left[k], right[k]), gain[k]
    return best


def _stats_batches(batches):
    """Arrow batches with a column text to lists of statistics and features, in bounded slices."""
    for batch in batches:
        for part in slices(batch, _SLICE):
            texts = part.column("text").to_pylist()
            stats = [ts.base_stats(t) for t in texts]
            x = np.array([ts.features(s) for s in stats], dtype=np.float64).reshape(len(texts), len(ts.FEATURES))
            yield part, stats, x


def fit_quality_trees(documents: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, seed: int = 3) -> Trees:
    """Fit on a bounded sample of labelled rows: at most about ``per_label`` of label 0 and of label 1; others take no part.

    Statistics are computed where the text lies; only the sample's feature vectors (a few
    hundred KB) reach the driver.
    """
    chosen = bounded_sample(labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)"), "y", per_label, 2, seed)

    def run(batches):
        for part, _, x in _stats_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    rows = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("text", "y").mapInArrow(run, "y int, x array<double>").collect()
    )
    rows.sort(key=lambda r: (r["y"], r["x"]))  # the fit does not depend on task order
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(ts.FEATURES))
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    return fit_trees(x, y, np.array([s for _, s in ts.FEATURES]))


RULES_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, quality_score double"
)


def apply_rules(documents: DataFrame, trees: Trees, threshold: float = 0.5, passthrough: bool = False) -> DataFrame:
    """Statistics and verdict of every row; with ``passthrough`` the kept rows of ``documents`` instead."""

    def verdicts(stats, x):
        n = np.array([len(s[0]) for s in stats], dtype=np.int64)
        rest = np.array([s[1:5] for s in stats], dtype=np.int64).reshape(len(stats), 4)
        failed = (n < MIN_WORDS) | (100 * rest[:, 3] > MAX_REPEAT_PERCENT * n)
        score = trees.score(x)
        return n, rest, failed, ~failed & (score >= threshold), score

    def run(batches):
        for part, stats, x in _stats_batches(batches):
            n, rest, failed, kept, score = verdicts(stats, x)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c) for c in (n, rest[:, 0], rest[:, 1], rest[:, 2], rest[:, 3], failed, kept, score))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"],
            )

    def keep(batches):
        for part, stats, x in _stats_batches(batches):
            yield part.filter(pa.array(verdicts(stats, x)[3]))

    if passthrough:
        return documents.mapInArrow(keep, documents.schema)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RULES_SCHEMA)
