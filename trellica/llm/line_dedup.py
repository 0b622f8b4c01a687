"""Line deduplication with two Bloom filters (operator 7).

One filter holds the hashes seen at least once, the other those seen at least twice. Partial filters of the tasks merge as
(a1|b1, a2|b2|(a1&b1)), which is associative and never loses a repeat. Only lines that the second filter suspects are
shuffled, as exact keys, to confirm them and to find the smallest document that holds each. Only documents that lose a line
then meet their lines by a shuffle: a third filter, of their ids, lets all others pass where they are.

The second filter is broadcast while 16 bits for every line stay within a bound. Beyond it the hashes are dealt by range:
every range has both filters of its own, so the bits a line gets do not fall as lines grow, and answers with the hashes that
it suspects. These meet the hashes of the lines by a join; texts and keys still move for suspected lines only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._skew import join_spread
from trellica.llm._store import cut, table
from trellica.llm._text import SPACE, buffers, chunks, mix, prefix, span_hash

PROBES = 3
CHUNK_BITS = 1 << 19
LINE_BITS = 16
#: Bits of one filter of a range of hashes.
RANGE_BITS = 1 << 23


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text: bytes, start and end of the stripped key, code points of the key, its hash, lines per text."""
    data, off = buffers(texts)
    breaks = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(breaks, off)) + 1
    first = np.cumsum(per) - per
    start = np.empty(per.sum(), np.int64)
    inner = np.ones(len(start), bool)
    inner[first] = False
    start[first] = off[:-1]
    start[inner] = breaks + 1
    end = np.empty_like(start)
    last = first + per - 1
    outer = np.ones(len(end), bool)
    outer[last] = False
    end[last] = off[1:]
    end[outer] = breaks
    solid = np.flatnonzero(~SPACE[data])
    solid_end = np.append(solid, len(data))
    a = solid_end[np.searchsorted(solid, start)]
    b = np.append(-1, solid)[np.searchsorted(solid, end)] + 1
    blank = a >= end
    a, b = np.where(blank, start, a), np.where(blank, start, b)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return data, a, b, points[b] - points[a], span_hash(prefix(data), a, b), per


def bit_positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = mix(hashes) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def in_filter(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in bit_positions(hashes, len(filter_) * 8):
        found &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def put(filter_: np.ndarray, hashes: np.ndarray) -> None:
    for at in bit_positions(hashes, len(filter_) * 8):
        np.bitwise_or.at(filter_, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def by_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for a hash and the place of its text in the batch."""
    return mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def held(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the keys of `least` code points or more, and how many of the texts hold each."""
    _, _, _, points, hashes, per = line_keys(texts)
    wide = points >= least
    hashes, doc = hashes[wide], np.repeat(np.arange(len(per)), per)[wide]
    _, at = np.unique(by_text(hashes, doc), return_index=True)
    return np.unique(hashes[at], return_counts=True)


def see(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> None:
    """Enter distinct hashes, each held by n texts, into both filters."""
    put(twice, hashes[(n > 1) | in_filter(once, hashes)])
    put(once, hashes)


def twice_seen(docs: DataFrame, text: str, least: int, bits: int) -> np.ndarray:
    """The merged filter of hashes that at least two documents (or one twice, by chance) hold; `bits` bounds its size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in chunks(batches, text):
            see(once, twice, *held(batch.column(0), least))
        size = min(CHUNK_BITS, bits) // 8
        for k in range(0, bits // 8, size):
            if once[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([once[k : k + size].tobytes()]), pa.array([twice[k : k + size].tobytes()])], ["chunk", "once", "twice"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
                once, twice = (x, y) if once is None else (once | x, twice | y | (once & x))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()])], ["chunk", "twice"])

    parts = docs.select(text).mapInArrow(partial, "chunk int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    size = min(CHUNK_BITS, bits) // 8
    for row in parts.groupBy("chunk").applyInArrow(merge, "chunk int, twice binary").toLocalIterator():
        out[row.chunk * size : row.chunk * size + size] = np.frombuffer(row.twice, np.uint8)
    return out


def picked(id_: pa.Array, texts: pa.Array, least: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """(id, hash, key) of the lines that `choose` takes, given the hashes of keys and the places of their texts."""
    data, a, b, points, hashes, per = line_keys(texts)
    doc = np.repeat(np.arange(len(per)), per)
    hit = np.flatnonzero(points >= least)
    hit = hit[choose(hashes[hit], doc[hit])]
    raw = data.tobytes()
    keys = pa.array([raw[x:y] for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([id_.take(pa.array(doc[hit])), pa.array(hashes[hit].view(np.int64)), keys], ["id", "hash", "key"])


def suspects(docs: DataFrame, least: int, filter_: np.ndarray) -> DataFrame:
    """Rows (id, hash, key) of the lines that the twice-seen filter holds; docs are (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield picked(batch.column(0), batch.column(1), least, lambda hashes, _: in_filter(shared.value, hashes))

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hash bigint, key string")


def range_suspects(docs: DataFrame, least: int, lines: int, bits: int) -> DataFrame:
    """(hash, n): hashes that the filters of their range suspect; n, about how many rows hold each. docs are (id, text).

    A task sends a hash once for some megabytes of text, so that a very common line makes few rows in its range.
    """
    width = max(1, (LINE_BITS * lines // bits).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            hashes, n = held(batch.column(0), least)
            home = (hashes >> np.uint64(64 - width)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["range", "hash", "n"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, at = np.unique(np.asarray(batch.column("hash")).view(np.uint64), return_inverse=True)
            n = np.zeros(len(hashes), np.int64)
            np.add.at(n, at, np.asarray(batch.column("n")))
            see(once, twice, hashes, n)
            hit = in_filter(twice, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[hit].view(np.int64)), pa.array(n[hit])], ["hash", "n"])

    sent = docs.select("text").mapInArrow(send, "range bigint, hash bigint, n bigint")
    return sent.groupBy("range").applyInArrow(meet, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def joined_suspects(docs: DataFrame, least: int, hashes: DataFrame) -> DataFrame:
    """Rows (id, hash, key) of the lines whose hash is in `hashes` (hash, n), found by joins; docs are (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            _, _, _, points, found, per = line_keys(batch.column(1))
            wide = points >= least
            found, doc = found[wide], np.repeat(np.arange(len(per)), per)[wide]
            _, at = np.unique(by_text(found, doc), return_index=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at])), pa.array(found[at].view(np.int64))], ["id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            listed = batch.column(2)
            places = np.repeat(np.arange(len(listed)), np.diff(np.asarray(listed.offsets)))
            wanted = by_text(np.asarray(listed.flatten()).view(np.uint64), places)
            yield picked(batch.column(0), batch.column(1), least, lambda hashes, doc, wanted=wanted: np.isin(by_text(hashes, doc), wanted))

    lines = cut(docs.mapInArrow(own, f"id {kind}, hash bigint"))
    listed = join_spread(lines, hashes, ["hash"], "n").groupBy("id").agg(F.collect_set("hash").alias("hashes"))
    return docs.join(listed, "id").select("id", "text", "hashes").mapInArrow(run, f"id {kind}, hash bigint, key string")


def later_holders(found: DataFrame) -> DataFrame:
    """(id, hash) of suspected lines that a document with a smaller id holds too.

    Keys are confirmed by an aggregate that combines before its shuffle; the confirmed ones meet their lines by hash and
    md5, so that the lines of a very common key need not gather in one task.
    """
    found = found.withColumn("md5", F.md5("key"))
    repeated = found.groupBy("key", "md5", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last")
    return join_spread(found.select("id", "hash", "md5"), repeated.select("hash", "md5", "first", "n"), ["hash", "md5"], "n").where("id > first").select("id", "hash")


def id_filter(drop: DataFrame, most_bits: int) -> np.ndarray:
    """A filter of the ids that lose lines, of 16 bits each and most_bits at most; beyond, it only lets more others through."""
    bits = min(most_bits, 1 << max(13, int(LINE_BITS * drop.count() - 1).bit_length()))
    size = min(CHUNK_BITS, bits) // 8

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(own, np.asarray(batch.column(0)).view(np.uint64))
        for k in range(0, bits // 8, size):
            if own[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([own[k : k + size].tobytes()])], ["chunk", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                own |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([own.tobytes()])], ["chunk", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    parts = drop.select("__mark").mapInArrow(partial, "chunk int, bits binary")
    for row in parts.groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").toLocalIterator():
        out[row.chunk * size : row.chunk * size + size] = np.frombuffer(row.bits, np.uint8)
    return out


def may_hold(filter_: np.ndarray, spark: SparkSession) -> Callable[[Column], Column]:
    """Column function: whether a filter may hold a hash."""
    shared = spark.sparkContext.broadcast(filter_)

    @F.arrow_udf("boolean")
    def run(marks: pa.Array) -> pa.Array:
        return pa.array(in_filter(shared.value, np.asarray(marks.fill_null(0)).view(np.uint64)))

    return run


def thin(least: int) -> Callable[[Column, Column], Column]:
    """Column function: text without the lines whose key hash is listed, with line counts."""

    @F.arrow_udf("struct<text string, n_lines bigint, n_dropped bigint>")
    def run(texts: pa.Array, drop: pa.Array) -> pa.Array:
        parts = []
        for batch in chunks(iter([pa.RecordBatch.from_arrays([texts, drop], ["text", "drop"])]), "text"):
            column, gone = batch.column(0), batch.column(1)
            _, _, _, points, hashes, per = line_keys(column)
            first = np.cumsum(per) - per
            out, dropped = column.to_pylist(), np.zeros(len(per), np.int64)
            for i in np.flatnonzero(np.asarray(gone.is_valid())):
                own = slice(first[i], first[i] + per[i])
                bad = (points[own] >= least) & np.isin(hashes[own].view(np.int64), np.asarray(gone[int(i)].values))
                dropped[i] = bad.sum()
                if dropped[i]:
                    out[i] = "\n".join(line for line, no in zip(out[i].split("\n"), bad.tolist(), strict=True) if not no)
            parts.append(pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(per.astype(np.int64)), pa.array(dropped)], ["text", "n_lines", "n_dropped"]))
        return pa.concat_arrays(parts)

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10, max_filter_bits: int = 1 << 30) -> DataFrame:
    """Remove every line whose key another document with a smaller id already holds; add n_lines and n_dropped.

    The key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased; keys under `least` code points stay. Filters
    have 16 bits a line, texts are read whole, however long they are; the broadcast one takes at most `max_filter_bits`, and more lines meet filters by range of hash,
    with the same results. A null text stays null and counts as one empty line; rows with a null id are neither thinned nor counted as a
    document; rows that share an id are one document. An empty table gives an empty result; other columns stay, existing
    n_lines and n_dropped are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")])
    lines = docs.select(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = 1 << max(13, int(LINE_BITS * lines - 1).bit_length())
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if bits <= max_filter_bits:
        found = cut(suspects(named, least, twice_seen(docs, text, least, bits)))
    else:
        found = cut(joined_suspects(named, least, cut(range_suspects(named, least, lines, min(RANGE_BITS, max_filter_bits)))))
    drop = cut(later_holders(found).groupBy("id").agg(F.collect_set("hash").alias("__drop")).withColumn("__mark", F.xxhash64("id")))
    touched = may_hold(id_filter(drop, max_filter_bits), docs.sparkSession)(F.xxhash64(doc_id))
    marked = docs.withColumn("__touched", F.coalesce(touched, F.lit(False)))
    hit = marked.where("__touched").join(drop.select(F.col("id").alias("__id"), "__drop"), F.col(doc_id) == F.col("__id"), "left").withColumn("__kept", thin(least)(F.col(text), F.col("__drop")))
    kept = [F.col("__kept.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    whole = marked.where("NOT __touched").select(*[f"`{c}`" for c in docs.columns], (F.coalesce(breaks, F.lit(0)) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return hit.select(*kept, F.col("__kept.n_lines").alias("n_lines"), F.col("__kept.n_dropped").alias("n_dropped")).unionByName(whole)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what stays, for every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.first < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.no) FILTER (r.first IS NULL OR r.first = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY k.doc_id
"""
