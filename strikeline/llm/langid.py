"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A word is its byte n-grams of 2 to 4, hashed into buckets that each have an embedding; a text is the mean over the n-grams
of all its words. Only training sees a sample, of at most about TRAIN_DOCS labelled texts. As the softmax is linear in the
mean, workers get the product of embeddings and weights, whose size depends on buckets and languages alone, and score whole
texts by adding up its rows.

Confidence is calibrated on texts kept out of the training: a temperature, then how often a confidence is right, which only
grows with it (isotonic regression). A text is rejected where it would rather be wrong than right, that is below the least
confidence that is right ACCEPT_FROM of the time, and where it has no letter. The model states the share of wrong names among
the stretches that it accepted and the share that it rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import Words, byte_table, map_arrow, slices, with_text_columns

#: Letters of ASCII in lower case, and all bytes of other characters.
LETTERS = byte_table({*range(0x61, 0x7B), *range(0x80, 0x100)})
BUCKET_BITS = 15
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: The bound of the labelled sample that training sees: texts, snippets of them, and the words and bytes of a snippet.
TRAIN_DOCS = 3000
TRAIN_SNIPPETS = 9000
SNIPPET_WORDS, SNIPPET_BYTES = 200, 4000
#: Confidences are accepted from where they are right at least so often.
ACCEPT_FROM = 0.5
UNKNOWN = "und"
SEED = 7


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word (with marks where it begins and ends) end to end, and where each word's begin."""
    count = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + count + 1].astype(np.int64)
    lengths = np.diff(offsets) + 2
    ends = np.cumsum(lengths)
    flat = np.full(ends[-1] if count else 0, 1, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[ends - lengths] = inner[ends - 1] = False
    flat[inner] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if count else []
    left = np.repeat(ends, lengths) - np.arange(len(flat))  # bytes to the end of the word, this one included
    keys, owner, word = [], [], np.repeat(np.arange(count), lengths)
    rolled = flat.copy()
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(257) + flat[n - 1 :]
        if n in GRAMS:
            good = left[: len(rolled)] >= n
            mixed = (rolled[good] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            keys.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owner.append(word[: len(rolled)][good])
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    keys = np.concatenate(keys)[order] if len(owner) else np.zeros(0, np.int64)
    return keys, np.searchsorted(owner[order], np.arange(count))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    accepted_error: float = 0.0
    rejected_part: float = 0.0

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each text, and its number of n-grams."""
        words = Words(column, LETTERS)
        sums, counts = np.zeros((len(column), len(self.langs))), np.zeros(len(column))
        if len(words.tokens):
            coded = words.tokens.dictionary_encode()
            keys, begin = grams(coded.dictionary)
            of_word = np.add.reduceat(self.table[keys], begin, axis=0)
            n = np.diff(begin, append=len(keys))
            codes = coded.indices.to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(words.counts)
            sums[rows] = np.add.reduceat(of_word[codes], words.first[rows], axis=0, dtype=np.float64)
            counts[rows] = np.add.reduceat(n[codes], words.first[rows])
        return softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature), counts


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _snippets(text: str, each: int) -> list[str]:
    """Stretches of 3 to SNIPPET_WORDS words from all over a text, the same ones whenever they are taken."""
    rng, words, out = np.random.default_rng([SEED, zlib.crc32(text.encode())]), text.split(), []
    for _ in range(each):
        n = int(np.exp(rng.uniform(np.log(3), np.log(SNIPPET_WORDS))))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        part = " ".join(words[at : at + n]).encode()[:SNIPPET_BYTES].decode(errors="ignore")
        if any(map(str.isalpha, part)):
            out.append(part)
    return out


def train(texts: list[list[str]], labels: list[str], epochs: int = 3, rate: float = 0.5) -> Model:
    """From the snippets and the language of each text: fit on most texts, calibrate on a fifth of them. Deterministic for the
    same texts in order."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    held = (rng.random(len(texts)) < 0.2 if len(texts) >= 50 else np.zeros(len(texts), bool))[of]
    snippets = [s for x in texts for s in x]
    target = np.array([langs.index(x) for x in labels])[of]
    words = Words(pa.array(snippets, pa.string()), LETTERS)
    examples = []
    for k in range(len(snippets)):
        keys, _ = grams(words.tokens.slice(words.first[k], words.counts[k]))
        if len(keys) and not held[k]:
            where, n = np.unique(keys, return_counts=True)
            examples.append((target[k], where, (n / n.sum()).astype(np.float32)))
    shares = np.bincount([e[0] for e in examples], minlength=len(langs)) / max(1, len(examples))
    pull = 1 / np.maximum(shares * len(langs), 1e-9)
    embed = rng.normal(0, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            y, where, part = examples[k]
            lr, step = rate * (1 - step / steps), step + 1
            mean = part @ embed[where]
            slope = softmax(mean @ weights + bias)
            slope[y] -= 1
            slope *= lr * min(pull[y], 4)
            back = weights @ slope
            weights -= np.outer(mean, slope)
            bias -= 0.1 * slope
            embed[where] -= 20 * part[:, None] * back  # n-grams are many: their share alone would hardly move them
    model = Model(langs, (embed @ weights).astype(np.float32), bias.astype(np.float64))
    kept = np.flatnonzero(held)
    return calibrate(model, [snippets[k] for k in kept], target[kept])


def isotonic(right: np.ndarray) -> np.ndarray:
    """The growing sequence nearest to how right the stretches are, in order of confidence: neighbours that fall are pooled."""
    means: list[float] = []
    sizes: list[int] = []
    for x in right.astype(float):
        means.append(x)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            n = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / n]
            sizes[-2:] = [n]
    return np.repeat(means, sizes)


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> Model:
    if not texts:
        return model
    raw = np.log(np.maximum(model.scores(pa.array(texts, pa.string()))[0], 1e-300))
    model.temperature = min(np.geomspace(0.1, 8, 121), key=lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean())
    p = softmax(raw / model.temperature)
    confidence, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.lexsort((right, confidence))
    good = np.flatnonzero(isotonic(right[order]) >= ACCEPT_FROM)
    # Nothing below the least confidence was seen: where that is right often enough, none is too low.
    model.threshold = 0.0 if len(good) and good[0] == 0 else float(confidence[order][good[0]]) if len(good) else 1.0
    accepted = confidence >= model.threshold
    model.rejected_part = float(1 - accepted.mean())
    model.accepted_error = float(1 - right[accepted].mean()) if accepted.any() else 0.0
    return model


def share(counts: list[int], total: int) -> float:
    """The most that each may have so that all together have `total`, those with less having all of theirs."""
    left = total
    for k, n in enumerate(ordered := sorted(counts)):
        if n * (len(ordered) - k) > left:
            return left / (len(ordered) - k)
        left -= n
    return float(max(counts, default=0))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter."""
    return docs.filter(F.udf(lambda text: any(map(str.isalpha, text or "")), "boolean")("text"))


def _cut_snippets(each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_snippets(t, each) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(found, pa.list_(pa.string()))], names=["place", "lang", "snippets"])

    return run


def fit(docs: DataFrame, learn: Column, lang: str = "lang") -> Model | None:
    """Train on at most about TRAIN_DOCS of the rows where `learn` holds and lang is not null, taken by a hash of doc_id and
    text: all of a language with few rows, an equal share of every other. The driver gets snippets of bounded length."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    bound, total = 1 << 30, sum(counts.values())
    place = F.xxhash64("doc_id", "text")
    if total > TRAIN_DOCS:
        most = share(list(counts.values()), TRAIN_DOCS)
        parts = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(bound * min(1.0, most / n)))])
        rows = rows.filter(F.pmod(place, F.lit(bound)) < parts[F.col(lang)])
    each = max(1, TRAIN_SNIPPETS // max(1, min(total, TRAIN_DOCS)))
    rows = rows.select(place.alias("place"), F.col(lang).alias("lang"), "text")
    sample = map_arrow(rows, _cut_snippets(each), "place long, lang string, snippets array<string>")
    sample = sorted((r for r in sample.toLocalIterator() if r.snippets), key=lambda r: (r.place, r.lang, r.snippets))
    if not sample:
        return None
    return train([r.snippets for r in sample], [r.lang for r in sample])


def _predict(model):
    def run(texts: pa.Array) -> list[pa.Array]:
        m, n = model.value, len(texts)
        known, best, pred, threshold = np.zeros(n, bool), np.zeros(n), [UNKNOWN] * n, 0.0
        if m is not None and n:
            p, counts = m.scores(texts)
            known, best, threshold = counts > 0, p.max(axis=1), m.threshold
            for i in np.flatnonzero(known):  # bytes beyond ASCII need not be letters
                known[i] = any(map(str.isalpha, texts[int(i)].as_py()))
            pred = [m.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), known, strict=True)]
        score = np.where(known, best, 0.0)
        return [pa.array(pred, pa.string()), pa.array(score), pa.array(~known | (score < threshold))]

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, texts included, plus lang_pred, lang_score (calibrated, 0 to 1) and lang_rejected, from the text alone.

    Null texts and texts without a letter are `und` with score 0 and rejected, and so is all without a model (no labelled
    row to learn from). Columns of docs named like the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    return with_text_columns(docs, _predict(shared), added)


def fold(modulus: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
