"""Language identification: a byte convolutional network over batched fixed-length windows.

Bytes are embedded, convolved by filters of several widths, max-pooled over the window,
rectified and classified by a softmax; all of it is trained here in numpy on labelled
text.  A whole text is cut into windows of ``WINDOW`` bytes (lower-cased UTF-8, the last
one padded), and the document's distribution is the mean of its windows', weighted by
their bytes.

Scoring folds the embedding into the filters: the response of a filter at a place is a
sum of table rows looked up by byte pairs, so a batch needs a few gathers per byte and no
matrix product.

Edge cases: null and empty texts and texts without any letter give ``und`` with score 0.
Equal texts give equal rows; every input row gives one output row; an empty table gives
none.  Without labelled text everything is ``und``.  With one language in the labels the
score of every text with letters is 1.  A letter is a character of Unicode's categories L, so
numerals such as one half or the Roman ones are none.  Only ``doc_id``, ``text`` and (for training)
``lang`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, slices

#: Documented bounds of the training sample: documents of each language, windows of a document
#: (spread evenly over it), windows of all languages and at least of each.
TRAIN_PER_LANGUAGE = 300
WINDOWS_PER_DOCUMENT = 32
TRAIN_WINDOWS = 8000
LEAST_WINDOWS = 100
#: More languages than are known to exist are an error, as the column then holds something else.
MAX_LANGUAGES = 10_000
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_BATCH_WINDOWS = 256


def window_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a whole text (n x WINDOW, zero-padded) and the bytes in each."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW, dtype=np.uint8)
    padded[: len(data)] = data
    sizes = np.full(n, WINDOW, dtype=np.int64)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), sizes


@dataclass
class ByteCNN:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width x EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # len(WIDTHS) * FILTERS x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the tables that its places look up: 65,536 rows by pair, 256 by byte."""
        made = []
        for w, b in zip(self.filters, self.bias, strict=True):
            by_byte = [(self.embed @ w[j]).astype(np.float32) for j in range(len(w))]
            by_byte[0] = by_byte[0] + b.astype(np.float32)
            made.append([(by_byte[j][:, None, :] + by_byte[j + 1][None, :, :]).reshape(65536, -1) if j + 1 < len(w) else by_byte[j] for j in range(0, len(w), 2)])
        return made

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Softmax over the languages for each window."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            places = WINDOW - width + 1
            total = None
            for k, part in enumerate(parts):
                index = pairs[:, 2 * k : 2 * k + places] if len(part) == 65536 else windows[:, 2 * k : 2 * k + places]
                got = part.take(index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(total.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out.astype(np.float32) + self.out_bias.astype(np.float32)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 1, **more) -> ByteCNN:
    """Train on all windows of the given texts."""
    return train_windows([(lang, window_bytes(t)[0]) for t, lang in zip(texts, langs, strict=True)], seed, **more)


def train_windows(found: list[tuple[str, np.ndarray]], seed: int = 1, epochs: int = 6, batch: int = 64, rate: float = 0.004) -> ByteCNN:
    """Train on (language, windows) of documents: whole windows and shorter crops, balanced by language."""
    rng = np.random.default_rng(seed)
    pools: dict[str, list] = {}
    for lang, windows in found:
        pools.setdefault(lang, []).append(windows)
    languages = sorted(pools)
    per = max(LEAST_WINDOWS, TRAIN_WINDOWS // max(1, len(languages)))
    xs, ys = [], []
    for k, lang in enumerate(languages):
        pool = np.concatenate(pools[lang])
        got = pool[rng.permutation(len(pool))[:per]]
        got = got[np.resize(np.arange(len(got)), per)].copy()
        short = rng.random(per) < 0.3  # crops teach short texts and last windows
        for i in np.flatnonzero(short):
            got[i, int(rng.integers(8, WINDOW)) :] = 0
        xs.append(got)
        ys.append(np.full(per, k))
    x, y = np.concatenate(xs), np.concatenate(ys)
    n_out = len(languages)
    p = {"e": rng.normal(0, 0.3, (256, EMBED)), "o": rng.normal(0, 0.15, (len(WIDTHS) * FILTERS, n_out)), "ob": np.zeros(n_out)}
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)), np.zeros(FILTERS)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            step += 1
            grads = _gradients(p, x[order[at : at + batch]], y[order[at : at + batch]])
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ByteCNN(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], p["ob"])


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
    n, rows = len(x), np.arange(len(x))
    e = p["e"][x]  # n x WINDOW x EMBED
    pooled, places, unrolled = [], [], []
    for w in WIDTHS:
        span = WINDOW - w + 1
        u = np.concatenate([e[:, j : j + span] for j in range(w)], axis=2)
        z = u @ p[f"w{w}"].reshape(w * EMBED, FILTERS) + p[f"b{w}"]
        at = z.argmax(axis=1)
        places.append(at)
        unrolled.append(u)
        pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :])
    pool = np.concatenate(pooled, axis=1)
    active = np.maximum(pool, 0)
    z = active @ p["o"] + p["ob"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[rows, y] -= 1
    z /= n
    g = {"o": active.T @ z + 1e-4 * p["o"], "ob": z.sum(axis=0), "e": np.zeros_like(p["e"])}
    back = (z @ p["o"].T) * (pool > 0)
    for k, w in enumerate(WIDTHS):
        d = back[:, k * FILTERS : (k + 1) * FILTERS]
        at = places[k]
        u = unrolled[k][rows[:, None], at]  # n x FILTERS x (w * EMBED)
        g[f"w{w}"] = np.einsum("nfu,nf->uf", u, d).reshape(w, EMBED, FILTERS)
        g[f"b{w}"] = d.sum(axis=0)
        for j in range(w):
            de = d[:, :, None] * p[f"w{w}"][j].T[None, :, :]
            np.add.at(g["e"], x[rows[:, None], at + j].ravel(), de.reshape(-1, EMBED))
    return g


def fit_langid(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, seed: int = 1) -> ByteCNN | None:
    """Train on at most about ``per_language`` documents of each language; their windows are cut on the executors."""
    chosen = bounded_sample(documents.select("doc_id", "lang"), "lang", per_language, MAX_LANGUAGES, seed)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                made = [window_bytes(t)[0] for t in part.column("text").to_pylist()]
                made = [w[np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_DOCUMENT).astype(np.int64))].tobytes() for w in made]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(made, pa.binary())], ["lang", "windows"])

    rows = (
        documents.select("doc_id", "text", "lang").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
        .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text").mapInArrow(run, "lang string, windows binary").collect()
    )
    found = sorted((r["lang"], bytes(r["windows"])) for r in rows)
    return train_windows([(lang, np.frombuffer(w, dtype=np.uint8).reshape(-1, WINDOW)) for lang, w in found], seed) if found else None


def predict_batch(model: ByteCNN | None, tables, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model is None:
        return lang, score
    have = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if not have:
        return lang, score
    made = [window_bytes(texts[i]) for i in have]
    owner = np.repeat(np.arange(len(have)), [len(w) for w, _ in made])
    windows, sizes = np.concatenate([w for w, _ in made]), np.concatenate([s for _, s in made]).astype(np.float64)
    probs = np.concatenate([model.probabilities(windows[at : at + _BATCH_WINDOWS], tables) for at in range(0, len(windows), _BATCH_WINDOWS)])
    total = np.stack([np.bincount(owner, probs[:, k] * sizes, len(have)) for k in range(probs.shape[1])], axis=1)
    total /= total.sum(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    for i, k in zip(have, best, strict=True):
        lang[i] = model.languages[k]
    score[have] = np.clip(total[np.arange(len(have)), best], 0.0, 1.0)
    return lang, score


def _scored(batches, model):
    tables = model.tables() if model is not None else None
    for batch in batches:
        for part in slices(batch, 128):
            yield part, *predict_batch(model, tables, part.column("text").to_pylist())


def identify(documents: DataFrame, model: ByteCNN | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; the text is read whole."""

    def run(batches):
        for part, lang, score in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: ByteCNN | None, min_score: float = 0.5) -> DataFrame:
    """The rows of ``documents`` with a language of at least ``min_score``; a null ``lang``, where there is one, is filled in."""

    def run(batches):
        for part, lang, score in _scored(batches, model):
            keep = pa.array([k != UNDETERMINED and s >= min_score for k, s in zip(lang, score, strict=True)], pa.bool_())
            at = part.schema.get_field_index("lang")
            columns = list(part.columns)
            if at >= 0:
                columns[at] = pa.array([own if own is not None else k for own, k in zip(part.column(at).to_pylist(), lang, strict=True)], part.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(keep)

    return documents.mapInArrow(run, documents.schema)
