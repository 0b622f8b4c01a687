"""Quality by ordinal cumulative-link regression on graded ratings (operator 4).

P(grade > k) = sigmoid(w.x - t_k) with one weight vector w shared by all grades and increasing thresholds t (McCullagh,
"Regression models for ordinal data", 1980). x are hashed features of the whole text: the log-scaled frequencies of its
byte trigrams and of its words, scaled to unit length. The expected grade ranks documents; the tail probability of a
grade selects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._classify import fit_in_task, fold, labelled_sample
from trellica.llm._store import table
from trellica.llm._text import buffers, chunks, mix, prefix, span_hash, words


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: text, bucket and value of each feature."""
    data, off = buffers(texts)
    start, end, count = words(data, off)
    size = np.diff(off)
    tri = np.maximum(size - 2, 0)
    at = np.repeat(off[:-1] - (np.cumsum(tri) - tri), tri) + np.arange(tri.sum())
    code = data[at].astype(np.uint64) | data[at + 1].astype(np.uint64) << np.uint64(8) | data[at + 2].astype(np.uint64) << np.uint64(16)
    half = np.uint64(buckets // 2)
    bucket = np.concatenate((mix(code) % half, half + span_hash(prefix(data), start, end) % half)).astype(np.int64)
    text = np.concatenate((np.repeat(np.arange(len(size)), tri), np.repeat(np.arange(len(size)), count)))
    key, n = np.unique(text * buckets + bucket, return_counts=True)
    text, bucket = key // buckets, key % buckets
    value = np.log1p(n)
    norm = np.sqrt(np.bincount(text, value**2, minlength=len(size)))
    shape_text, shape_bucket = shape(off, start, end, count, span_hash(prefix(data), start, end), buckets)
    text, bucket, value = np.concatenate((text, shape_text)), np.concatenate((bucket, shape_bucket)), np.concatenate((value / norm[text], np.full(len(shape_text), SHAPE)))
    order = np.argsort(text, kind="stable")
    return text[order], bucket[order], value[order]


#: Weight of each shape feature beside the text's own features, which have unit length together.
SHAPE = 0.3


def shape(off: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed levels of a text's length in words, share of distinct words, share of words that repeat the one before, and
    mean word length; one feature of each kind for every text with words."""
    text = np.flatnonzero(count > 0)
    owner = np.repeat(np.arange(len(count)), count)
    n = count[text]
    _, first = np.unique(mix(word + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(owner[first], minlength=len(count))[text] / n
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, minlength=len(count))[text] / n
    length = np.bincount(owner, end - start, minlength=len(count))[text] / n
    levels = (np.log2(n), distinct * 20, np.ceil(repeats * 20), length * 2)
    kinds = [mix(np.minimum(v, 60).astype(np.uint64) + np.uint64(1000 * i)) % np.uint64(buckets) for i, v in enumerate(levels)]
    return np.tile(text, len(kinds)), np.concatenate(kinds).astype(np.int64)


def sample_features(texts: list[str] | pa.Array, buckets: int, piece: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many texts, a few at a time and in narrow types, which bounds the memory of the fitting task."""
    parts = []
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    for a in range(0, len(texts), piece):
        text, bucket, value = features(texts[a : a + piece], buckets)
        parts.append(((text + a).astype(np.int32), bucket.astype(np.int32), value.astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class CumulativeLink:
    """Shared weights and ordered thresholds between the grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None, :], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.asarray(self.grades, float))
        return self.grades[0] + tails @ steps if len(self.grades) else np.zeros(len(tails))


def slopes(linear: np.ndarray, y: np.ndarray, cuts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the mean weighted negative log-likelihood by each text's linear score and by each threshold."""
    row = np.arange(len(y))
    tails = 1 / (1 + np.exp(-np.clip(linear[:, None] - cuts[None, :], -60, 60)))
    full = np.concatenate((np.ones((len(y), 1)), tails, np.zeros((len(y), 1))), axis=1)
    upper, lower = full[row, y], full[row, y + 1]
    p = np.maximum(upper - lower, 1e-9)
    d_upper, d_lower = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
    to_cut = np.zeros((len(y), len(cuts) + 2))
    to_cut[row, y] += d_upper
    to_cut[row, y + 1] -= d_lower
    return (d_lower - d_upper) / len(y), to_cut[:, 1:-1].sum(0) / len(y)


def train(texts: list[str] | pa.Array, grades: list[int], shares: dict[int, float] | None = None, buckets: int = 1 << 18, epochs: int = 20, rate: float = 0.5, decay: float = 1e-6, seed: int = 5) -> CumulativeLink:
    """Maximum likelihood by Adagrad; thresholds are kept ordered by their gaps. One or no grade gives a constant model.

    `shares` says how common each grade really is, where the sample is drawn by grade.
    """
    names = sorted(set(grades))
    if len(names) < 2:
        return CumulativeLink(names or [0], np.zeros(buckets), np.zeros(0))
    y = np.searchsorted(names, grades)
    text, bucket, value = sample_features(texts, buckets)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    weight = np.ones(len(y))
    if shares:
        weight = np.array([shares[g] for g in names])[y] / np.bincount(y)[y]
        weight *= len(y) / weight.sum()
    above = ((y[:, None] > np.arange(len(names) - 1)[None, :]) * weight[:, None]).mean(0).clip(0.01, 0.99)
    base = np.log((1 - above) / above)
    low, gap = base[:1].copy(), np.log(np.maximum(np.diff(base), 1e-2))
    w = np.zeros(buckets)
    square = [np.full(buckets, 1e-8), np.full(1, 1e-8), np.full(len(gap), 1e-8)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 32)):
            n = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(np.arange(len(batch)), n)
            linear = np.bincount(row, value[at] * w[bucket[at]], minlength=len(batch))
            cuts = np.concatenate((low, low + np.cumsum(np.exp(gap))))
            to_linear, to_cut = slopes(linear, y[batch], cuts, weight[batch])
            used, pos = np.unique(bucket[at], return_inverse=True)
            grads = (np.bincount(pos, value[at] * to_linear[row], minlength=len(used)) + decay * w[used], to_cut.sum(keepdims=True), np.array([to_cut[i + 1 :].sum() * np.exp(gap[i]) for i in range(len(gap))]))
            for part, sq, g, where in zip((w, low, gap), square, grads, (used, slice(None), slice(None)), strict=True):
                sq[where] += g**2
                part[where] -= rate * g / np.sqrt(sq[where])
    return CumulativeLink([int(x) for x in names], w, np.concatenate((low, low + np.cumsum(np.exp(gap)))))


def grade(docs: DataFrame, model: CumulativeLink, text: str = "text", cut_grade: int | None = None) -> DataFrame:
    """docs with expected_grade and p_tail, the probability of `cut_grade` (default: the highest) or better."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = len(model.grades) - 1 if cut_grade is None else int(np.searchsorted(model.grades, cut_grade))

    @F.arrow_udf("struct<expected_grade double, p_tail double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        for column in texts:
            parts = []
            for piece in chunks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                row, bucket, value = features(piece.column(0), len(fitted.weights))
                tails = fitted.tails(np.bincount(row, value * fitted.weights[bucket], minlength=piece.num_rows))
                top = tails[:, place - 1] if 0 < place <= tails.shape[1] else np.full(piece.num_rows, float(place == 0))
                parts.append(pa.StructArray.from_arrays([pa.array(fitted.expected(tails)), pa.array(top)], ["expected_grade", "p_tail"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("expected_grade", pa.float64()), ("p_tail", pa.float64())]))

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("expected_grade", "p_tail")])
    return docs.withColumn("__grade", run(F.col(text))).select(*docs.columns, "__grade.expected_grade", "__grade.p_tail")


def quality(docs: DataFrame, ratings: DataFrame, rating: str = "quality", doc_id: str = "doc_id", text: str = "text", held_parts: int = 5, most_per_grade: int = 3000, most_bytes: int = 10_000, select: float = 0.5) -> DataFrame:
    """docs with held_out, expected_grade, p_tail (probability of the highest grade) and kept (p_tail >= select).

    Learns from a bounded sample of rated rows outside the held-out fold, the same number for each grade at most, weighted
    by how common each grade is; only texts are inputs, scored whole, however long they are. Null and empty texts have no features and get the thresholds' own probabilities; null ratings teach
    nothing; more than 1,000 grades raise ValueError; without two grades every document gets the one grade seen. Existing columns of these names are replaced; an
    empty table gives an empty result.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "kept")])
    sample = labelled_sample(docs, ratings, rating, doc_id, text, held_parts, {None: most_per_grade}, most_bytes)
    shares = {r[0]: r[1] for r in ratings.where(F.col(rating).isNotNull() & (fold(doc_id, held_parts) != 0)).groupBy(rating).count().collect()}
    model = fit_in_task(sample, lambda texts, y: train(texts, y, shares))
    out = grade(docs, model, text)
    return out.withColumn("held_out", fold(doc_id, held_parts) == 0).withColumn("kept", F.col("p_tail") >= select)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and verdict for every document; the table's ratings have the grades 0 and 1."""
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "expected_grade", "p_tail", "kept")
