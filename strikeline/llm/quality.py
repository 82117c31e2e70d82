"""Quality classification by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled web text is any text. The model is logistic in measures of a whole text
and their squares, and minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

so its output is a probability that the text is good. The prior is estimated first, from positives and unlabelled texts alone:
labels of 0 are never used. Training sees the measures, of fixed width, of at most about TRAIN_DOCS positives and as many
unlabelled texts; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import Words, byte_table, map_arrow, slices, text_bytes, with_text_columns

#: The bound of the sample that training sees: positives, and as many unlabelled texts.
TRAIN_DOCS = 6000
CUT = 0.7
#: Of the bounds on a ratio of two measured shares: its confidence.
DELTA = 0.1
SPACED = byte_table({b for b in range(256) if b > 0x20})
LETTERED = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def _distinct(codes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and the share of its commonest."""
    pairs, n = np.unique(row.astype(np.int64) << 32 | codes, return_counts=True)
    most = np.zeros(rows)
    np.maximum.at(most, pairs >> 32, n)
    return np.bincount(pairs >> 32, minlength=rows).astype(float), most


def measures(column: pa.Array) -> np.ndarray:
    """One line per text: amounts, shares of kinds of characters, and how often words, word pairs and lines repeat."""
    data, offsets = text_bytes(column)
    rows = len(column)
    size = np.diff(offsets).astype(float)
    per = np.maximum(size, 1)
    spaced, lettered = Words(column, SPACED), Words(column, LETTERED)
    words = spaced.counts.astype(float)
    out = [np.log1p(size), np.log1p(words), lettered.counts / np.maximum(words, 1), size / np.maximum(words, 1)]
    seen = np.bincount(np.repeat(np.arange(rows) << 8, np.diff(offsets)) | data, minlength=rows << 8).reshape(rows, 256)
    digit, upper, lower = (seen[:, a:b].sum(axis=1) for a, b in ((48, 58), (65, 91), (97, 123)))
    out += [upper / np.maximum(upper + lower, 1), digit / per, (upper + lower) / per]
    out += [np.log1p(1000 * seen[:, b] / per) for b in (*_SIGNS, 0x0A)]
    out.append((seen[:, :0x20].sum(axis=1) - seen[:, 0x0A]) / per)
    owner = np.repeat(np.arange(rows), lettered.counts)
    if len(owner):
        codes = lettered.tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds, most = _distinct(codes, owner, rows)
        inside = owner[1:] == owner[:-1]
        pairs = np.unique((codes[:-1] * (codes.max() + 1) + codes[1:])[inside], return_inverse=True)[1]
        two, most_two = _distinct(pairs, owner[1:][inside], rows) if len(pairs) else (np.zeros(rows), np.zeros(rows))
    else:
        kinds = most = two = most_two = np.zeros(rows)
    n = np.maximum(lettered.counts, 1)
    out += [kinds / n, most / n, two / n, most_two / n, (kinds + 1) / np.sqrt(n)]
    lines = Words(column, _LINES)
    owner = np.repeat(np.arange(rows), lines.counts)
    if len(owner):
        kinds, most = _distinct(lines.tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), owner, rows)
    else:
        kinds = most = np.zeros(rows)
    n = np.maximum(lines.counts, 1)
    out += [kinds / n, most / n, np.log1p(lines.counts), np.log1p(size / n)]
    return np.column_stack(out)


_LINES = byte_table({b for b in range(256) if b != 0x0A} - {0})


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z / 6])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(_wide(measures(column), self.mean, self.scale) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, epochs: int, seed: int, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on mini-batches of the non-negative risk with logistic loss. Where the part for negatives falls below zero, its
    slope is followed upwards instead, as the method has it."""
    rng = np.random.default_rng(seed)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w = np.zeros(p.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batch = 256
    for epoch in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(max(1, len(u) // batch)):
            a = p[np.take(pi, range(k * batch, (k + 1) * batch), mode="wrap")]
            b = u[np.take(ui, range(k * batch, (k + 1) * batch), mode="wrap")]
            fa, fb = a @ w, b @ w
            positive = -((1 - _sigmoid(fa)) @ a) / len(a)
            negative = (_sigmoid(fb) @ b) / len(b) - prior * (_sigmoid(fa) @ a) / len(a)
            risk = np.logaddexp(0, fb).mean() - prior * np.logaddexp(0, fa).mean()
            g = prior * positive + negative if risk >= 0 else -negative
            g[:-1] += l2 * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.02 * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of good texts among the unlabelled, from the scores of both that no fit saw: the ratio of the parts at or
    above a score, at the score where that ratio and the uncertainty of both parts are least together."""
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    above_p, above_u = (1 - np.searchsorted(np.sort(x), at) / len(x) for x in (p, u))
    doubt = (np.sqrt(np.log(4 / DELTA) / 2 / len(u)) + np.sqrt(np.log(4 / DELTA) / 2 / len(p))) / above_p
    best = int(np.argmin(above_u / above_p + doubt))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _crossed(p: np.ndarray, u: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each half by a fit on the other."""
    out = []
    for half in (0, 1):
        w, b = _minimise(p[half::2], u[half::2], 0.5, 15, seed)
        out.append([_sigmoid(x[1 - half :: 2] @ w + b) for x in (p, u)])
    return np.concatenate([out[0][0], out[1][0]]), np.concatenate([out[0][1], out[1][1]])


def train(p: np.ndarray, u: np.ndarray, seed: int = 11, epochs: int = 60) -> Model | None:
    """From the measures of positives and of unlabelled texts, a line each."""
    if len(p) < 2 or len(u) < 2:
        return None
    both = np.vstack([p, u])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = _wide(p, mean, scale), _wide(u, mean, scale)
    prior = estimate_prior(*_crossed(p, u, seed))
    w, b = _minimise(p, u, prior, epochs, seed)
    return Model(mean, scale, w, b, prior)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lines = measures(batch.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(list(lines), pa.list_(pa.float32()))], names=["place", "line"])


def _sample(df: DataFrame, total: int) -> np.ndarray:
    """Measures of about TRAIN_DOCS of the rows, or of all if there are fewer, in an order of their own."""
    whole, place = 1 << 30, F.xxhash64("doc_id", "text")
    if total > TRAIN_DOCS:
        df = df.filter(F.pmod(place, F.lit(whole)) < F.lit(int(whole * TRAIN_DOCS / total)))
    rows = map_arrow(df.select(place.alias("place"), "text"), _measured, "place long, line array<float>").toLocalIterator()
    found = sorted(((r.place, r.line) for r in rows), key=lambda r: r[0])
    return np.array([line for _, line in found], float)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """Train on rows of docs where `learn` holds; labels(doc_id, quality) marks positives, all else counts as unlabelled."""
    open_docs = docs.select("doc_id", "text").filter(learn)
    positives = labels.filter(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    total = positives.count()
    whole = 1 << 30
    if total > TRAIN_DOCS:
        positives = positives.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < F.lit(int(whole * TRAIN_DOCS / total)))
    trusted = open_docs.join(F.broadcast(positives), "doc_id", "left_semi")  # about TRAIN_DOCS ids
    return train(_sample(trusted, trusted.count()), _sample(open_docs, open_docs.count()))


def _score(model):
    def run(texts: pa.Array) -> list[pa.Array]:
        m = model.value
        return [pa.array(np.full(len(texts), 0.5) if m is None else m.score(texts))]

    return run


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, texts included, plus quality_score (0 to 1) and quality_good (score of at least CUT), from the text alone.

    Null texts are scored as empty ones; without a model, for want of two positives, every score is 0.5. Columns of docs named
    like the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = with_text_columns(docs.drop("quality_good"), _score(shared), [T.StructField("quality_score", T.DoubleType())])
    return out.withColumn("quality_good", F.col("quality_score") >= CUT)
