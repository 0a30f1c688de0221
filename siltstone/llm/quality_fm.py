"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Inputs of a document: each distinct word hashed into ``WORD_BUCKETS`` (weight 1 over the
root of their number), each statistic of ``text_stats`` as a one-hot quantile bin, and as
metadata the length class of the text in characters.  Pairwise interactions have rank
``RANK`` and are scored in linear time by the sum-of-squares identity:
``sum_i<j <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2``.  Training is
Adagrad on the log loss, in numpy.

Edge cases: null and empty texts have no words but statistics, so they get a score like
any text.  Equal texts get equal scores; every input row gives one output row; an empty
table gives none.  Without labels of both classes the score is the share of label 1 (0.5
without labels).  Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_stats as ts
from ._common import bounded_sample, slices

WORD_BUCKETS = 1 << 15
RANK = 8
BINS = 12
LENGTH_CLASSES = 24
#: Documented bound of the training sample: documents of each label.
TRAIN_PER_LABEL = 1500
_SLICE = 256
_CACHE = 200_000


class Hasher:
    """Words to buckets, with a bounded cache."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def buckets(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        distinct = set(words)
        for w in distinct:
            if w not in known:
                known[w] = zlib.crc32(w.lower()) % WORD_BUCKETS
        return np.unique(np.fromiter((known[w] for w in distinct), dtype=np.int64, count=len(distinct)))


def raw_inputs(text: str | None, hasher: Hasher) -> tuple[np.ndarray, list[float], int]:
    """(word buckets, statistics, length class)."""
    stats = ts.base_stats(text)
    return hasher.buckets(stats[0]), ts.features(stats), min(LENGTH_CLASSES - 1, len(text or "").bit_length())


@dataclass
class FactorisationMachine:
    cuts: list[np.ndarray]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, raw: list[tuple[np.ndarray, list[float], int]]):
        """CSR form (indices, values, row starts): words, then one bin per statistic, then the length class."""
        n_stats = len(self.cuts)
        x = np.array([r[1] for r in raw], dtype=np.float64).reshape(len(raw), n_stats)
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1) if n_stats else np.zeros((len(raw), 0), int)
        bins += WORD_BUCKETS + BINS * np.arange(n_stats)
        indices, values, starts, at = [], [], [], 0
        for k, (words, _, length) in enumerate(raw):
            starts.append(at)
            indices += [words, bins[k], [WORD_BUCKETS + BINS * n_stats + length]]
            values += [np.full(len(words), 1.0 / np.sqrt(max(1, len(words)))), np.full(n_stats + 1, 1.0)]
            at += len(words) + n_stats + 1
        return np.concatenate(indices).astype(np.int64), np.concatenate(values), np.array(starts, dtype=np.int64)

    def raw_score(self, indices, values, starts) -> np.ndarray:
        vx = self.v[indices] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[indices] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, raw) -> np.ndarray:
        if not raw:
            return np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw_score(*self.rows(raw)), -30, 30)))


def train(raw, y: np.ndarray, seed: int = 6, epochs: int = 12, batch: int = 128, rate: float = 0.08, l2: float = 1e-4) -> FactorisationMachine:
    n_stats = len(ts.FEATURES)
    size = WORD_BUCKETS + BINS * n_stats + LENGTH_CLASSES
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return FactorisationMachine([np.zeros(0)] * n_stats, float(np.log(p / (1 - p))), np.zeros(size), np.zeros((size, RANK)))
    x = np.array([r[1] for r in raw])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_stats)]
    fm = FactorisationMachine(cuts, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            indices, values, starts = fm.rows([raw[i] for i in own])
            counts = np.diff(np.append(starts, len(indices)))
            vx = fm.v[indices] * values[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            p = 1 / (1 + np.exp(-np.clip(fm.raw_score(indices, values, starts), -30, 30)))
            d = weight[own] * (p - y[own]) / len(own)
            each = np.repeat(d, counts) * values
            keys, inverse = np.unique(indices, return_inverse=True)
            dw = np.bincount(inverse, each, len(keys)) + l2 * fm.w[keys]
            grad = each[:, None] * (np.repeat(sums, counts, axis=0) - vx)
            dv = np.stack([np.bincount(inverse, grad[:, k], len(keys)) for k in range(RANK)], axis=1) + l2 * fm.v[keys]
            gw[keys] += dw * dw
            gv[keys] += dv * dv
            gb += d.sum() ** 2
            fm.w[keys] -= rate * dw / np.sqrt(gw[keys])
            fm.v[keys] -= rate * dv / np.sqrt(gv[keys])
            fm.bias -= rate * d.sum() / np.sqrt(gb)
    return fm


def fit_quality_fm(documents: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, seed: int = 6) -> FactorisationMachine:
    """Fit on about ``per_label`` labelled documents of label 0 and of label 1 (others take no part); word buckets and statistics are made on the executors."""
    chosen = bounded_sample(labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)"), "y", per_label, 2, seed)

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, _SLICE):
                raw = [raw_inputs(t, hasher) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), pa.array([r[0].astype("<i4").tobytes() for r in raw], pa.binary()), pa.array([r[1] for r in raw], pa.list_(pa.float64())), pa.array([r[2] for r in raw], pa.int32())],
                    ["y", "words", "x", "length"],
                )

    rows = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("text", "y").mapInArrow(run, "y int, words binary, x array<double>, length int").collect()
    )
    rows.sort(key=lambda r: (r["y"], r["x"], bytes(r["words"])))
    raw = [(np.frombuffer(bytes(r["words"]), dtype="<i4").astype(np.int64), r["x"], r["length"]) for r in rows]
    return train(raw, np.array([r["y"] for r in rows], dtype=np.float64), seed)


def score_quality(documents: DataFrame, model: FactorisationMachine, cut: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, _SLICE):
                score = model.score([raw_inputs(t, hasher) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
