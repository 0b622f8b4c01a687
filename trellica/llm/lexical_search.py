"""Ranked lexical search over a tiered index (operator 12).

The index is cut by documents into shards, one row each. For every term that items use, a shard holds the postings in
tiers by impact, the highest first, each tier in columns of its own. The first posting of a lower tier bounds what a term
can still add to a document not seen with it: its residual.

The first pass reads the first tier alone. The partial scores in it give every item a threshold that its 20th best score
cannot fall below. The second pass asks each shard for the proof that a tier holds every document that can still enter: the
residuals of the item's terms together stay below the threshold. Items lacking the proof fall through to the next tier of
that shard. Of the documents seen, those whose partial score and residuals reach the threshold get their lower postings
added, so every score that leaves a shard is exact; 20 an item at most leave it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellica.llm._store import cut, ensure_checkpoint_dir, table
from trellica.llm._text import buffers, chunks, lists, prefix, span_hash

#: Postings of a term in the tiers of a shard, but for the last, which holds all others.
TIERS = (64, 1024)
#: Documents and postings in a shard, and bytes of text in a block of items (about).
SHARD_DOCS, SHARD_POSTINGS, BLOCK_BYTES = 1 << 14, 1 << 20, 1 << 20
#: Constants of the ranking, and the impact that no posting reaches.
SCALE, SATURATE, LENGTH, SHARE = 1_000_000_000, 1000, 12, 25
MOST_IMPACT = SCALE // SATURATE
#: Bytes that end a term: ASCII but for digits and letters.
GAP = np.zeros(256, bool)
GAP[[c for c in range(128) if not chr(c).isalnum()]] = True


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every term of lower-cased texts, and the text it stands in."""
    gap = GAP[data]
    before, after = np.concatenate(([True], gap))[: len(gap)], np.concatenate((gap[1:], [True]))[: len(gap)]
    inner = off[(off > 0) & (off < len(data))]
    before[inner], after[inner - 1] = True, True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def terms(text: str | None) -> list[bytes]:
    """Terms of one text, in order, A-Z lower-cased."""
    data, off = buffers(pa.array([text], pa.string()))
    start, end, _ = spans(data, off)
    return [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]


class Block:
    """A bounded block of items: its distinct terms as bytes and sorted hashes, and each item's terms with their repeats."""

    def __init__(self, items: list[tuple]):
        self.items = [i for i, _ in items]
        found = [terms(t) for _, t in items]
        self.words = sorted({w for ws in found for w in ws})
        number = {w: n for n, w in enumerate(self.words)}
        self.of = [np.unique(np.array([number[w] for w in ws], np.int64), return_counts=True) for ws in found]
        self.data = np.frombuffer(b"".join(self.words), np.uint8)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        hashes = span_hash(prefix(self.data), self.start, self.start + self.size)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]

    def same(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether each span holds the bytes of its term."""
        out = end - start == self.size[word]
        for at in np.array_split(np.flatnonzero(out), 1 + len(out) // 100_000):
            if len(at):
                size = self.size[word[at]]
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                equal = data[np.repeat(start[at], size) + step] == self.data[np.repeat(self.start[word[at]], size) + step]
                out[at] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return out

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the term that each span holds, -1 for none: its hash finds the term, its bytes decide."""
        out = np.full(len(start), -1, np.int64)
        hashes = span_hash(prefix(data), start, end)
        place = np.searchsorted(self.hashes, hashes)
        some = np.arange(len(start))
        while True:
            some = some[place[some] < len(self.hashes)]
            some = some[self.hashes[place[some]] == hashes[some]]
            if not len(some):
                return out
            word = self.by_hash[place[some]]
            good = self.same(data, start[some], end[some], word)
            out[some[good]] = word[good]
            some = some[~good]
            place[some] += 1  # another term of this hash


def postings(block, kind: str):
    """Task: documents (id, text) to shards: ids in ascending order, terms in each, and (term, document, times)."""
    shape = f"ids array<{kind}>, n array<bigint>, term array<int>, doc array<int>, tf array<bigint>"

    def shard(ids: list, n: list, term: list, doc: list, tf: list) -> pa.RecordBatch:
        ids, n = pa.chunked_array(ids).combine_chunks(), np.concatenate(n)
        order = np.asarray(pc.sort_indices(ids, null_placement="at_end")).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one = lambda x, t: lists(x, np.array([len(x)]), t)
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([held, one(n[order], pa.int64()), one(np.concatenate(term), pa.int32()), one(place[np.concatenate(doc)], pa.int32()), one(np.concatenate(tf), pa.int64())], ["ids", "n", "term", "doc", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, many = [[] for _ in range(5)], 0, 0
        for batch in chunks(batches, "text"):
            data, off = buffers(batch.column("text"))
            start, end, text = spans(data, off)
            number = block.value.numbers(data, start, end)
            hit = number >= 0
            pair, tf = np.unique(number[hit] * len(off) + text[hit], return_counts=True)
            for to, x in zip(held, (batch.column("id"), np.bincount(text, minlength=batch.num_rows), pair // len(off), docs + pair % len(off), tf), strict=True):
                to.append(x)
            docs, many = docs + batch.num_rows, many + len(pair)
            if docs >= SHARD_DOCS or many >= SHARD_POSTINGS:
                yield shard(*held)
                held, docs, many = [[] for _ in range(5)], 0, 0
        if docs:
            yield shard(*held)

    return run, shape


def impacts(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Impact of each posting from its times and the length of its document, in whole numbers."""
    share = np.array([SHARE * int(x) * total_docs // total_terms for x in n], np.int64) if len(n) and int(n.max()) * SHARE * total_docs >= 2**63 else SHARE * n * total_docs // total_terms
    return SCALE * tf // (SATURATE * tf + LENGTH * (100 - SHARE + share))


def tiered(total_docs: int, total_terms: int, kind: str):
    """Task: shards to index rows: for each tier the terms in it, where their postings begin, and the postings."""
    names = [f"{c}{j}" for j in range(len(TIERS) + 1) for c in ("term", "start", "doc", "impact")]
    shape = f"ids array<{kind}>, " + ", ".join(f"{n} array<int>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, term, doc, tf = (np.asarray(batch.column(c).slice(i, 1).flatten()).astype(np.int64) for c in ("n", "term", "doc", "tf"))
                impact = impacts(tf, n[doc], total_docs, total_terms)
                order = np.lexsort((doc, -impact, term))
                term, doc, impact = term[order], doc[order], impact[order]
                place = np.arange(len(term)) - np.searchsorted(term, term)
                tier = np.searchsorted(np.cumsum(TIERS), place, "right")
                columns = []
                for j in range(len(TIERS) + 1):
                    own = tier == j
                    some, start = np.unique(term[own], return_index=True)
                    columns += [some, np.append(start, own.sum()), doc[own], impact[own]]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1), *[lists(c, np.array([len(c)]), pa.int32()) for c in columns]], ["ids", *names])

    return run, shape


class Tier:
    """One tier of a shard."""

    def __init__(self, batch: pa.RecordBatch, i: int, j: int, words: int):
        terms_, start, self.doc, self.impact = (np.asarray(batch.column(f"{c}{j}").slice(i, 1).flatten()).astype(np.int64) for c in ("term", "start", "doc", "impact"))
        self.at, self.to = np.zeros(words, np.int64), np.zeros(words, np.int64)
        self.at[terms_], self.to[terms_] = start[:-1], start[1:]
        self.most = np.zeros(words, np.int64)  # of each term, as postings stand in order of impact
        self.most[terms_] = self.impact[start[:-1]]

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the postings of some terms, and which of the terms each belongs to."""
        size = self.to[words] - self.at[words]
        return np.repeat(self.at[words] - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(np.arange(len(words)), size)


def add_up(docs: np.ndarray, values: np.ndarray, many: int, most: int) -> np.ndarray:
    """Sum of the values of each document, exact: doubles where they can hold it."""
    if most < 2**53:
        return np.bincount(docs, values, many).astype(np.int64)
    out = np.zeros(many, np.int64)
    np.add.at(out, docs, values)
    return out


def highest(score: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller document."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((docs[some], -score[some]))[:k]]
    return np.lexsort((docs, -score))


def best_of_shard(tiers: list[Tier], words: np.ndarray, gain: np.ndarray, least: int, docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents with their exact scores, the k highest of at least `least` (and above 0), and the tier that held the proof.

    gain: what a term's impact counts in this item, weight times repeats.
    """
    left = [np.zeros(len(words), np.int64)]
    for lower in tiers[:0:-1]:
        left.insert(0, np.maximum(left[0], lower.most[words]))
    bound = int(gain.sum()) * MOST_IMPACT
    for depth in range(len(tiers)):
        if depth == len(tiers) - 1 or int((gain * left[depth]).sum()) < least:
            break
    found = [t.rows(words) for t in tiers]
    seen = [(tiers[j].doc[at], gain[of] * tiers[j].impact[at], gain[of] * left[depth][of]) for j, (at, of) in enumerate(found[: depth + 1])]
    doc, value, residual = (np.concatenate(x) for x in zip(*seen, strict=True))
    score = add_up(doc, value, docs, bound)
    open_ = int((gain * left[depth]).sum()) - add_up(doc, residual, docs, bound)
    some = (score > 0) & (score + open_ >= least)
    for j in range(depth + 1, len(tiers)):
        at, of = found[j]
        own = some[tiers[j].doc[at]]
        score += add_up(tiers[j].doc[at[own]], gain[of[own]] * tiers[j].impact[at[own]], docs, bound)
    some = np.flatnonzero(some & (score >= least))
    kept = some[highest(score[some], some, k)]
    return kept, score[kept], depth


def first_tier(block, weights: np.ndarray, k: int):
    """Task over index rows: the k highest partial scores of each item in the first tier of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                tier = Tier(batch, i, 0, len(held.words))
                many = int(tier.doc.max(initial=-1)) + 1
                out = []
                for words, times in held.of:
                    gain = weights[words] * times
                    at, of = tier.rows(words)
                    score = add_up(tier.doc[at], gain[of] * tier.impact[at], many, int(gain.sum()) * MOST_IMPACT)
                    score = score[score > 0]
                    out.append(score[highest(score, np.zeros(len(score)), k)])
                item = np.repeat(np.arange(len(out)), [len(x) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.concatenate(out), pa.int64())], ["item", "score"])

    return run, "item int, score bigint"


def all_tiers(block, weights: np.ndarray, least: np.ndarray, k: int, kind: str):
    """Task over index rows: for each item the documents of a shard that can be among the k highest, with exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                tiers = [Tier(batch, i, j, len(held.words)) for j in range(len(TIERS) + 1)]
                ids = batch.column("ids").slice(i, 1).flatten()
                out = [best_of_shard(tiers, words, weights[words] * times, int(least[n]), len(ids), k) for n, (words, times) in enumerate(held.of)]
                item = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
                doc, score = (np.concatenate([x[c] for x in out]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), ids.take(pa.array(doc))], ["item", "score", "doc_id"])

    return run, f"item int, score bigint, doc_id {kind}"


def search_block(spark: SparkSession, docs: DataFrame, items: list[tuple], k: int, kind: str) -> DataFrame | None:
    """(item, score, doc_id, rank) for one block of items, numbered in their order; None where nothing can be found."""
    own = Block(items)
    block = spark.sparkContext.broadcast(own)
    shards = cut(docs.mapInArrow(*postings(block, kind)))
    total = shards.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not total[0] or not own.words:
        return None
    frequency = np.zeros(len(own.words), np.int64)
    for r in shards.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        frequency[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * total[0] + 2) / (2.0 * frequency + 1))).astype(np.int64)
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    shards.mapInArrow(*tiered(int(total[0]), int(total[1]), kind)).write.parquet(at)
    index = spark.read.parquet(at)
    first = index.select(*[f"{c}0" for c in ("term", "start", "doc", "impact")]).mapInArrow(*first_tier(block, weights, k))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    least = np.ones(len(items), np.int64)
    for r in first.withColumn("rank", rank).where(F.col("rank") == k).collect():
        least[r["item"]] = r["score"]
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return index.mapInArrow(*all_tiers(block, weights, least, k, kind)).withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest score above 0, ties to the smaller id.

    Null, empty and wordless texts have no terms: such documents are found by nothing and do not count, such items find
    nothing. Texts of any length are read whole. Rows of docs are documents of their own, also where they share an id or
    repeat; a null id comes after all others of its score. Items that share id and text are one item, an id with several
    texts has a ranking for each. Empty tables give an empty result; other columns are not read. The index holds the
    postings of the terms that items use; items are taken in blocks of about block_bytes of text, each with a pass of its
    own over the documents, so what is broadcast does not grow with them.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    found = spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {kind}, score bigint")
    for b in range(blocks):
        own = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        part = search_block(spark, rows, own, k, kind) if own else None
        if part is not None:
            names = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(own)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}"))
            part = part.join(names, "item").select("item_id", "rank", "doc_id", "score")
            found = part if blocks == 1 else cut(found.unionByName(part))
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} FROM documents), i AS (SELECT item_id, {_TERMS} FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
p AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY t),
s AS (SELECT i.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN w USING (t) JOIN size USING (doc_id), a GROUP BY i.item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 20
"""
