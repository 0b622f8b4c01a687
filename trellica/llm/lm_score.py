"""Language-model scores by deleted interpolation (operator 2).

The model mixes maximum-likelihood n-gram estimates of all orders with a smoothed unigram base (Jelinek and Mercer, 1980).
The mixture weights depend on how often the context was seen (buckets by powers of two) and are learnt by
expectation-maximisation on a deleted part of the training documents, with counts taken from the other part. Scores then
use the counts of all training documents.

Counts cover the whole corpus and never leave the executors. Documents are dealt into blocks of a few MB. A block sends
its distinct n-gram hashes, sorted, to the fragments of the hash range; a fragment adds up each n-gram over all blocks and
answers every block with the totals in the order it asked. The block scores its documents from them. Only the number of
tokens and types, and a histogram of bounded size for the mixture weights, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._classify import fold
from trellica.llm._store import cut, table
from trellica.llm._text import BASE, buffers, mix, prefix, span_hash, words

END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)
HASH_BITS = {True: 64, False: 56}  # of single tokens, of longer n-grams
HELD, DELETED, REST = 0, 1, 2
LEVELS = 16  # context-frequency buckets an order
ADD = 0.1  # added to every token count by the base


#: Texts and numbers travel as zstd frames, which are smaller than what the shuffle's own codec makes of them.
CODEC = "zstd"


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the leading ones are mostly zero."""
    return pa.Codec(CODEC, compression_level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), asbytes=True)


def from_planes(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = pa.Codec(CODEC).decompress(raw, n * size)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).ravel()


def packed(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        codec = pa.Codec(CODEC, compression_level=1)
        return pa.array([codec.compress(x, asbytes=True) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return run(text)


def unpacked(rows: pa.RecordBatch | pa.Table) -> pa.Array:
    codec = pa.Codec(CODEC)
    both = zip(rows["packed"].to_pylist(), rows["size"].to_pylist(), strict=True)
    return pa.array([codec.decompress(x, n, asbytes=True) for x, n in both], pa.binary()).cast(pa.large_string())


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram that ends at each token (words, then one end), and tokens per text.

    Hashes of single tokens are odd and have 64 bits, those of longer n-grams are even and have 56.
    """
    data, off = buffers(texts)
    start, end, count = words(data, off)
    tokens = count + 1
    stop = np.cumsum(tokens)
    first = stop - tokens
    token = np.empty(int(tokens.sum()), np.uint64)
    inner = np.ones(len(token), bool)
    inner[stop - 1] = False
    token[inner] = span_hash(prefix(data), start, end)
    token[stop - 1] = END
    out, run = [token | np.uint64(1)], token
    for k in range(2, order + 1):
        before = np.empty_like(run)
        before[1:] = run[:-1]
        before[first] = START + np.uint64(k)
        run = mix(before * BASE + token)
        out.append((run >> np.uint64(64 - HASH_BITS[False])) & ~np.uint64(1))
    return out, tokens


def fragments(found: np.ndarray, single: bool, bits: int) -> tuple[int, np.ndarray]:
    """First fragment of this kind of n-gram, and where each fragment begins among sorted hashes (and where the last ends)."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(HASH_BITS[single] - bits)
    return (1 << bits) * single, np.append(np.searchsorted(found, starts), len(found))


def ask(order: int, bits: int) -> Callable:
    """Group task: a block's documents to its distinct n-grams and their counts, one row per fragment."""
    names = ["part", "block", "size", "grams", "counts"]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {True: [], False: []}
        for batch in batches:
            single, *longer = grams(unpacked(batch), order)[0]
            kinds[True].append(single)
            kinds[False] += longer
        for single in (False, True):
            hashes = kinds.pop(single)
            if not hashes:
                continue
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            del hashes
            first, at = fragments(h, single, bits)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if b > a:
                    raw = [planes(np.diff(h[a:b], prepend=np.uint64(0))), planes(n[a:b].astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int32()), pa.array([key[0].as_py()], pa.int64()), pa.array([b - a], pa.int64()), *[pa.array([x], pa.binary()) for x in raw]], names)

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: all n-grams of a fragment; answers each block with totals, and deleted blocks also with what others hold."""
    rows = [r for b in batches for r in b.select(["part", "block", "size", "grams", "counts"]).to_pylist()]
    if not rows:
        return
    h = [np.cumsum(from_planes(r.pop("grams"), np.uint64, r["size"]), dtype=np.uint64) for r in rows]
    size = np.array([len(x) for x in h])
    kind = np.repeat(np.array([r["block"] % 3 for r in rows], np.int8), size)
    n = np.concatenate([from_planes(r.pop("counts"), np.uint32, r["size"]) for r in rows]).astype(np.int64)
    h = np.concatenate(h)
    order = np.argsort(h)
    run = h[order]
    del h
    lead = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    per = np.diff(np.append(lead, len(run)))
    single = (run[lead] & np.uint64(1)).astype(bool)
    place = np.empty(len(run), np.int32)
    place[order] = np.repeat(np.arange(len(lead), dtype=np.int32), per)
    all_, rest = (np.add.reduceat(np.where(part, n, 0)[order], lead) for part in (kind != HELD, kind == REST))
    del run, order, n, kind
    back = lambda total, own: planes(total[place[own]].astype(np.uint64))
    names = ["part", "block", "size", "totals", "others", "types", "tokens", "other_tokens"]
    long = lambda x: pa.array([x], pa.int64())
    end = np.cumsum(size)
    for i, r in enumerate(rows):
        own = slice(end[i] - size[i], end[i])
        others = back(rest, own) if r["block"] % 3 == DELETED else None
        stats = (int((all_[single] > 0).sum()), int(all_[single].sum()), int(rest[single].sum())) if i == 0 else (0, 0, 0)
        yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), long(r["block"]), long(r["size"]), pa.array([back(all_, own)]), pa.array([others], pa.binary()), *map(long, stats)], names)


def estimates(texts: pa.Array, order: int, replies: pa.Table, column: str, total: float, types: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the estimates (highest order first, then unigram, then base), bucket; tokens per text, unigram counts."""
    (single, *longer), tokens = grams(texts, order)
    replies = replies.sort_by("part")
    known = np.concatenate([from_planes(x, np.uint64, n) for x, n in zip(replies[column].to_pylist(), replies["size"].to_pylist(), strict=True)]).astype(np.float64)
    counts = np.empty((order, len(single)))
    ahead = 0
    if longer:
        found, back = np.unique(np.concatenate(longer), return_inverse=True)
        ahead = len(found)
        counts[1:] = known[back].reshape(order - 1, -1)
        del found, back
    found, back = np.unique(single, return_inverse=True)
    if ahead + len(found) != len(known):
        raise ValueError("a block's rows changed between two reads of the input")
    counts[0] = known[ahead + back]
    stop = np.cumsum(tokens)
    first = stop - tokens
    texts_seen = counts[0][stop[0] - 1]
    parts = np.empty((order + 1, counts.shape[1]))
    parts[order], parts[order - 1] = (counts[0] + ADD) / (total + ADD * (types + 1)), counts[0] / max(total, 1)
    bucket = np.zeros(counts.shape[1], np.int64)
    for k in range(2, order + 1):
        context = np.empty(counts.shape[1])
        context[1:] = counts[k - 2][:-1]
        context[first] = texts_seen
        parts[order - k] = np.where(context > 0, counts[k - 1] / np.maximum(context, 1), 0.0)
        level = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), LEVELS - 1)
        bucket = np.where(context > 0, 1 + (k - 2) * LEVELS + level, bucket)
    return parts, bucket, tokens, counts[0]


def available(order: int) -> np.ndarray:
    """Which estimates (highest order first) each bucket can use."""
    out = np.zeros((1 + (order - 1) * LEVELS, order + 1), bool)
    for b in range(len(out)):
        top = 1 if b == 0 else 2 + (b - 1) // LEVELS
        out[b, order - top :] = True
    return out


def histogram(order: int, total: float, types: float) -> Callable:
    """Cogroup task: a deleted block to cells (bucket, rounded estimates) with their token counts and mean estimates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["cell", "n", *[f"f{i}" for i in range(order + 1)]]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in ("cell", "n") else pa.float64()) for c in names})
        parts, bucket, _, _ = estimates(unpacked(left), order, right, "others", total, types)
        cell = bucket
        for f in parts[:-1]:
            cell = cell * 64 + np.where(f > 0, np.clip(60 + np.round(6 * np.log10(np.maximum(f, 1e-10))), 1, 63), 0).astype(np.int64)
        names_, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        return pa.table([pa.array(names_), pa.array(n.astype(np.int64)), *[pa.array(np.bincount(at, f, minlength=len(n))) for f in parts]], names=names)

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket: expectation-maximisation on the histogram, one token of prior for each estimate."""
    usable = available(order)
    weights = usable / usable.sum(1, keepdims=True)
    if not len(n):
        return weights
    bucket, f = cells >> (6 * order), sums / n[:, None]
    for _ in range(rounds):
        share = weights[bucket] * f
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        found = np.zeros(weights.shape)
        np.add.at(found, bucket, share)
        found = np.where(usable, found + 1, 0)
        weights = found / found.sum(1, keepdims=True)
    return weights


def scores(order: int, total: float, types: float, weights: np.ndarray) -> Callable:
    """Cogroup task: every document of a block with its counts and scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": left["id"][:0], "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        parts, bucket, tokens, single = estimates(unpacked(left), order, right, "totals", total, types)
        first = np.cumsum(tokens) - tokens
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({"id": left["id"], "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(add((single > 0).astype(np.int64))), "base_score": pa.array(add(np.log10(parts[-1]))), "score": pa.array(add(np.log10((weights[bucket].T * parts).sum(0))))})

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3, held_parts: int = 10, block_bytes: int = 4 << 20, fragment_bytes: int = 8 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows whose crc32(id as text) is not 0 modulo held_parts; those with remainder 1 are the deleted part
    that teaches the mixture weights. A text is its words (A-Z lower-cased, separated by [\\x20\\x09-\\x0D]) and one end;
    texts of any length are scored whole, null counts as empty, a null id as an empty id; repeated rows count each time. Without training rows the base alone
    scores. An empty table gives an empty result; other columns are not read. Tokens are compared as 64-bit hashes, longer
    n-grams as 56-bit ones. Rows go to blocks by a hash of id and text, so rows that share an id spread.
    """
    rest = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(held_parts))
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, int(size // block_bytes))
    bits = min(15, max(6, int(size * order // (2 * fragment_bytes)).bit_length()))
    kind = F.least(rest, F.lit(REST))
    deal = F.pmod(F.xxhash64(doc_id, text, F.lit(1)), F.when(kind == REST, blocks).otherwise(max(1, blocks // 8)))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), packed(whole).alias("packed"), F.octet_length(whole).alias("size"), (deal * 3 + kind).cast("bigint").alias("block"))
    asked = rows.groupBy("block").applyInArrow(ask(order, bits), "part int, block bigint, size bigint, grams binary, counts binary")
    replies = cut(asked.repartitionById(2 << bits, "part").mapInArrow(answer, "part int, block bigint, size bigint, totals binary, others binary, types bigint, tokens bigint, other_tokens bigint"), chain=True)
    types, total, other = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "other_tokens")]).first()
    fields = ", ".join(f"f{i} double" for i in range(order + 1))
    deleted = F.pmod("block", F.lit(3)) == DELETED
    cells = rows.where(deleted).groupBy("block").cogroup(replies.where(deleted).select("part", "block", "size", "others").groupBy("block")).applyInArrow(histogram(order, other, types), f"cell bigint, n bigint, {fields}")
    table_ = cells.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(order + 1)]).toArrow()
    column = lambda name, kind: np.asarray(table_[name], kind)
    weights = learn_weights(column("cell", np.int64), column("n", float), np.stack([column(f"f{i}", float) for i in range(order + 1)], axis=1), order)
    if not total:
        weights = np.eye(order + 1)[[order] * len(weights)]
    kind_of = docs.schema[doc_id].dataType.simpleString()
    scored = rows.groupBy("block").cogroup(replies.select("part", "block", "size", "totals").groupBy("block")).applyInArrow(scores(order, total, types, weights), f"id {kind_of}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("id", (fold("id", held_parts) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
