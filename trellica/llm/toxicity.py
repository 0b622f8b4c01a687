"""Toxicity by subword-bag embeddings and a linear softmax (operator 1).

A word is the bag of its character n-grams, hashed into a bounded table of embeddings; a passage is the mean of
its words' vectors, and a linear softmax over two classes scores it. Embeddings and softmax are trained together in numpy
(Joulin et al., "Bag of tricks for efficient text classification", 2017; subwords after Bojanowski et al., 2017). As misspelled or inflected
words share n-grams with known ones, they share their vectors.

A document is toxic if any passage is: it is cut into overlapping passages of WINDOW words and scored by its worst one, so
a short insult in a long text is not averaged away. Training follows the same rule: each document's worst passage, as the
model of the moment sees it, carries the document's label. A passage's mean is taken over WINDOW words, of which missing
ones and those that repeat a word just before count as zero vectors, so that a single word does not make a strong passage.
The embeddings start from a direction that contrasts the buckets of the two classes; joint training does the rest.
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
from trellica.llm._text import PASS, buffers, chunks, prefix, span_hash, words

WINDOW, STEP, REPEAT = 16, 8, 3
#: Words whose n-grams are hashed at a time, which bounds the memory of long batches.
PIECE = 20_000
#: Tokens whose passages are scored at a time.
TOKENS = 1 << 18
GRAMS = (3, 4, 5)


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams (the word stands between marks), and how many each word has."""
    n = end - start
    at = np.cumsum(n + 2) - (n + 2)
    text = np.full(int((n + 2).sum()), 1, np.uint8)
    inner = np.repeat(at + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
    text[inner] = data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    text[at + n + 1] = 2
    run = prefix(text)
    short = np.flatnonzero(n + 2 < GRAMS[0])
    keys, owner = [span_hash(run, at[short], at[short] + n[short] + 2)], [short]
    for size in GRAMS:
        count = np.maximum(n + 2 - size + 1, 0)
        who = np.repeat(np.arange(len(n)), count)
        first = at[who] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        keys.append(span_hash(run, first, first + size))
        owner.append(who)
    owner_, keys_ = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner_, kind="stable")
    return (keys_[order] % np.uint64(buckets)).astype(np.int32), np.bincount(owner_, minlength=len(n))


@dataclass
class Vocabulary:
    """Distinct words of some texts with their subword buckets, and the texts as word numbers.

    `fresh` is 0 for a word that repeats one of the REPEAT words before it: a passage counts such runs once.
    """

    tokens: np.ndarray
    fresh: np.ndarray
    per_text: np.ndarray
    buckets: np.ndarray
    per_word: np.ndarray

    @staticmethod
    def of(texts: pa.Array, buckets: int, most: int = 4 << 20) -> Vocabulary:
        """Texts are taken about `most` bytes at a time, which bounds the memory of a large sample."""
        known, ids, per, hashes, counts = np.empty(0, np.uint64), [], [], [], []
        for piece in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", most):
            data, off = buffers(piece.column(0))
            start, end, count = words(data, off)
            word = span_hash(prefix(data), start, end)
            fresh, first = np.unique(word, return_index=True)
            if len(hashes):
                new = ~np.isin(fresh, known)
                fresh, first = fresh[new], first[new]
            for own in np.array_split(first, len(first) // PIECE + 1):
                bucket, n = subwords(data, start[own], end[own], buckets)
                ids.append(bucket)
                per.append(n)
            known = np.concatenate((known, fresh))
            hashes.append(word)
            counts.append(count)
        if not hashes:
            return Vocabulary(*[np.empty(0, np.int64) for _ in range(5)])
        subs, per_word = np.concatenate(ids), np.concatenate(per)
        del ids, per
        order = np.argsort(known).astype(np.int32)
        tokens = [order[np.searchsorted(known, hashes.pop(0), sorter=order)] for _ in range(len(hashes))] if len(known) else [np.empty(0, np.int32)]
        tokens, count = np.concatenate(tokens), np.concatenate(counts)
        fresh = np.ones(len(tokens), np.float32)
        place = np.arange(len(tokens), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
        for back in range(1, min(REPEAT, len(tokens) - 1) + 1):
            fresh[back:][(tokens[back:] == tokens[:-back]) & (place[back:] >= back)] = 0
        return Vocabulary(tokens, fresh, count, subs, per_word)

    def word_means(self, values: np.ndarray) -> np.ndarray:
        """Mean of a per-bucket value over each word's subwords, PIECE words at a time."""
        ends = np.cumsum(self.per_word)
        out = np.empty((len(ends), *values.shape[1:]))
        for a in range(0, len(ends), PIECE):
            n = self.per_word[a : a + PIECE]
            own = slice(int(ends[a] - n[0]), int(ends[a + len(n) - 1]))
            out[a : a + PIECE] = np.add.reduceat(values[self.buckets[own]], np.cumsum(n) - n, axis=0) / n.reshape(-1, *[1] * (values.ndim - 1))
        return out


def passages(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token start, token end and text of each passage; every text with words has at least one."""
    made = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(count)), made)
    place = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    base = (np.cumsum(count) - count)[text]
    start = base + place * STEP
    return start, np.minimum(start + WINDOW, base + count[text]), text


@dataclass
class SubwordSoftmax:
    """Embedding table, softmax weights and bias; `score` of a passage is softmax(mean embedding @ weights + bias)[1], the mean over WINDOW words, missing ones as zero."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def compact(self) -> tuple[np.ndarray, float]:
        """Log-odds contribution of each bucket and the bias: what scoring needs of a trained model."""
        lean = self.weights[:, 1] - self.weights[:, 0]
        return (self.embedding @ lean).astype(np.float64), float(self.bias[1] - self.bias[0])


def worst(vocabulary: Vocabulary, bucket_lean: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Highest passage log-odds of each text (bias alone without words), and that passage's token span.

    Texts are taken about TOKENS tokens at a time, a longer one alone.
    """
    word_lean = vocabulary.word_means(bucket_lean)
    ends = np.cumsum(vocabulary.per_text)
    out = np.full(len(ends), bias)
    a, b = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    at = 0
    while at < len(ends):
        base = int(ends[at] - vocabulary.per_text[at])
        to = max(at + 1, int(np.searchsorted(ends, base + TOKENS, "right")))
        own = slice(base, int(ends[to - 1]))
        total = np.concatenate(([0.0], np.cumsum(word_lean[vocabulary.tokens[own]] * vocabulary.fresh[own])))
        start, end, text = passages(vocabulary.per_text[at:to])
        if len(text):
            value = (total[end] - total[start]) / WINDOW + bias
            order = np.lexsort((value, text))
            pick = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
            out[at + text[pick]], a[at + text[pick]], b[at + text[pick]] = value[pick], base + start[pick], base + end[pick]
        at = to
    return out, a, b


def contrast(vocabulary: Vocabulary, y: np.ndarray, buckets: int) -> np.ndarray:
    """How much oftener toxic texts hold each bucket than clean ones: the log ratio of document shares over its error."""
    seen = np.zeros((2, buckets))
    word_first = np.cumsum(vocabulary.per_word) - vocabulary.per_word
    ends = np.cumsum(vocabulary.per_text)
    for own in np.array_split(np.arange(len(y)), int(ends[-1]) // 50_000 + 1):
        if not len(own):
            continue
        n = vocabulary.per_text[own]
        tokens = vocabulary.tokens[int(ends[own[0]] - n[0]) : int(ends[own[-1]])]
        part = np.unique(np.repeat(own, n) * len(vocabulary.per_word) + tokens)
        text, word = part // len(vocabulary.per_word), part % len(vocabulary.per_word)
        n = vocabulary.per_word[word]
        bucket = vocabulary.buckets[np.repeat(word_first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        np.add.at(seen, (y[np.repeat(text, n)], bucket), 1)
    share = np.log((seen + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1))
    return (share[1] - share[0]) / np.sqrt((1 / (seen + 0.5)).sum(0))


def slopes(model: SubwordSoftmax, vocabulary: Vocabulary, word_first: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives of the mean weighted cross-entropy of the passages [a, b) by embedding rows (numbers and values),
    softmax weights and bias."""
    n = b - a
    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    token, fresh, size = vocabulary.tokens[at], vocabulary.fresh[at][:, None], np.maximum(n, WINDOW)[:, None]
    used, word_at = np.unique(token, return_inverse=True)
    m = vocabulary.per_word[used]
    bucket = vocabulary.buckets[np.repeat(word_first[used] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    vector = np.add.reduceat(model.embedding[bucket], np.cumsum(m) - m, axis=0) / m[:, None]
    mean = np.add.reduceat(vector[word_at] * fresh, np.cumsum(n) - n, axis=0) / size
    logit = mean @ model.weights + model.bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight / len(y))[:, None]
    to_mean = (p @ model.weights.T) / size
    to_word = np.zeros((len(used), model.embedding.shape[1]))
    np.add.at(to_word, word_at, np.repeat(to_mean, n, axis=0) * fresh)
    to_bucket = np.repeat(to_word / m[:, None], m, axis=0)
    names, at = np.unique(bucket, return_inverse=True)
    grad = np.zeros((len(names), model.embedding.shape[1]))
    np.add.at(grad, at, to_bucket)
    return names, grad, mean.T @ p, p.sum(0)


def train(texts: list[str] | pa.Array, labels: list[int], buckets: int = 1 << 18, dim: int = 8, epochs: int = 12, least_steps: int = 400, rate: float = 0.5, seed: int = 11) -> SubwordSoftmax:
    """Joint Adagrad training of embeddings and softmax; small samples get more rounds, up to `least_steps` updates.

    Embeddings start from a random table plus one direction that contrasts the buckets of toxic and clean texts, so that
    the first worst passages are already meaningful. Without both classes the model gives the one class seen (0 without any) to every text.
    """
    rng = np.random.default_rng(seed)
    model = SubwordSoftmax(rng.uniform(-1 / dim, 1 / dim, (buckets, dim)), rng.normal(0, 0.1, (dim, 2)), np.array([0.0, 0.0]))
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return SubwordSoftmax(np.zeros((buckets, dim)), np.zeros((dim, 2)), np.array([0.0, -8.0 if not len(y) or y[0] == 0 else 8.0]))
    vocabulary = Vocabulary.of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), buckets, PASS)
    model.embedding[:, 0] += 0.5 * contrast(vocabulary, y, buckets)
    model.weights[0] += (-1.0, 1.0)
    word_first = np.cumsum(vocabulary.per_word) - vocabulary.per_word
    square = [np.full(x.shape, 1e-6) for x in (model.embedding, model.weights, model.bias)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    group = int(np.clip(len(y) // 24, 8, 256))
    more = max(0, least_steps // max(1, len(y) // group) - epochs)
    for _ in range(epochs + more):
        _, a, b = worst(vocabulary, *model.compact())
        order = rng.permutation(np.flatnonzero(b > a))
        for batch in np.array_split(order, max(1, len(order) // group)):
            names, grad, to_weights, to_bias = slopes(model, vocabulary, word_first, a[batch], b[batch], y[batch], weight[batch])
            square[0][names] += grad**2
            model.embedding[names] -= rate * grad / np.sqrt(square[0][names])
            for i, (part, g) in enumerate(((model.weights, to_weights), (model.bias, to_bias))):
                square[i + 1] += g**2
                part -= 0.2 * rate * g / np.sqrt(square[i + 1])
    return model


def scores(texts: pa.Array, model: tuple[np.ndarray, float], most: int = PASS) -> pa.Array:
    """Score of each whole text by a model's compact() form, about `most` bytes of text at a time."""
    lean, bias = model
    parts = []
    for piece in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", most):
        value, _, _ = worst(Vocabulary.of(piece.column(0), len(lean)), lean, bias)
        parts.append(pa.array(1 / (1 + np.exp(-np.clip(value, -60, 60))), pa.float64()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())


def score_texts(docs: DataFrame, text: str, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """docs with the score of each whole text by a model's compact() form, a bounded table that is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield scores(column, shared.value)

    return docs.withColumn(out, score(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", held_parts: int = 5, most_toxic: int = 2000, most_clean: int = 3000, most_bytes: int = 10_000) -> tuple[np.ndarray, float]:
    """compact() form of a model that one task learns from a bounded labelled sample; see labelled_sample()."""
    sample = labelled_sample(docs, labels, label, doc_id, text, held_parts, {1: most_toxic, None: most_clean}, most_bytes)
    return fit_in_task(sample, lambda texts, y: train(texts, y).compact())


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= 0.5).

    Only whole texts of labelled rows outside the held-out fold teach the model, and only texts are scored, whole, however
    long they are. Null and empty
    texts get the score of the bias alone; null ids belong to a fold like an empty id; repeated rows score alike; without
    labels of both classes every text gets the score of the class that was seen (0 without any). Existing columns of
    these names are replaced; an empty table gives an empty result.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")])
    scored = score_texts(docs, text, fit(docs, labels, doc_id=doc_id, text=text, **options))
    return scored.withColumn("held_out", fold(doc_id, options.get("held_parts", 5)) == 0).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for every document."""
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
