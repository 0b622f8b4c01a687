"""N-gram Jaccard self-join by vertical partitioning (operator 8).

Every document is the set of its distinct word n-grams. The global n-gram order (their 64-bit hashes) is cut into
fragments and each document sends a segment to every fragment. A fragment holds all postings of its n-grams, so it knows
their exact document frequency; n-grams of one document can add nothing to any overlap and end there. A document goes on
only if enough of its n-grams are shared for a link at all; it is then a candidate partner under its rarest shared n-grams
(prefix filtering). Overlaps of candidate pairs are counted per fragment and summed per pair.

Groups of copies: documents with equal sets are joined as one. Inside a large group of near copies most documents link to
one centre; pairs within a component need no further check, so only pairs between different components are compared, and
all of those. Links are therefore never lost, while the pairs stay linear in a group that one component fills. Of the
others the join lets out only pairs whose parity sketches leave room for a link, an exact bound (see within_sketch()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._skew import join_spread
from trellica.llm._store import cut, table
from trellica.llm._text import chunks, lists, mix, text_shingles
from trellica.llm.components import components

PACK = "part int, ids array<bigint>, sizes array<int>, counts array<int>, hashes array<bigint>, df array<int>"
#: Fragments in which the overlap of a candidate pair is counted, as a power of two.
COUNT_BITS = 3
#: Words of 64 bits in the parity sketch of a document.
SKETCH = 4


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any partner that it links with."""
    return (percent * n + 99) // 100


def segments(k: int, bits: int):
    """Task: whole texts to one packed row per fragment and chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids = np.asarray(batch.column(0)).astype(np.int64)
            flat, made = text_shingles(batch.column(1), k)
            cut_at = np.concatenate(([0], np.cumsum(made)))
            own = [np.unique(flat[a:b]) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]
            n = np.fromiter(map(len, own), np.int64, len(own))
            h = np.concatenate(own) if len(own) else np.empty(0, np.uint64)
            doc = np.repeat(np.arange(len(ids)), n)
            part = (h >> np.uint64(64 - bits)).astype(np.uint16)
            home = np.zeros(len(ids), np.int64)
            home[n > 0] = part[(np.cumsum(n) - n)[n > 0]]
            order = np.argsort(part, kind="stable")
            h, doc, part = h[order], doc[order], part[order].astype(np.int64)
            key = part * len(ids) + doc
            lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            count = np.diff(np.append(lead, len(key)))
            e_part, e_doc = part[lead], doc[lead]
            none = np.flatnonzero(n == 0)
            e_part, e_doc, count = np.concatenate((none * 0, e_part)), np.concatenate((none, e_doc)), np.concatenate((none * 0, count))
            size = np.where(home[e_doc] == e_part, n[e_doc], 0)
            yield pack(e_part, ids[e_doc], size, count, h, np.empty(0, np.int32))

    return run


def pack(part, ids, size, count, hashes, df) -> pa.RecordBatch:
    """Entries sorted by part to one row per part, with their postings in the same order."""
    parts, per = np.unique(part, return_counts=True)
    ends = np.cumsum(per)
    posts = np.diff(np.concatenate(([0], np.cumsum(count)[ends - 1] if len(ends) else [])))
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), lists(ids, per, pa.int64()), lists(size, per, pa.int32()), lists(count, per, pa.int32()), lists(hashes.view(np.int64), posts, pa.int64()), lists(df, posts if len(df) else posts * 0, pa.int32())],
        ["part", "ids", "sizes", "counts", "hashes", "df"],
    )


def gather(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All packed rows of a task as flat arrays: ids, sizes, counts, hashes, df."""
    found = [[], [], [], [], []]
    for batch in batches:
        for out, name in zip(found, ("ids", "sizes", "counts", "hashes", "df"), strict=True):
            out.append(np.asarray(batch.column(name).flatten()))
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32)
    return [np.concatenate(x).astype(t, copy=False) if x else np.empty(0, t) for x, t in zip(found, kinds, strict=True)]


def repeats(ids: np.ndarray, entry: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Postings of a fragment that repeat an n-gram of their document, which rows with equal ids can do."""
    names, at = np.unique(ids, return_inverse=True)
    if len(names) == len(ids):
        return np.empty(0, np.int64)
    some = np.flatnonzero((np.bincount(at) > 1)[at][entry])
    doc = at[entry[some]]
    order = np.lexsort((doc, h[some]))
    same = (h[some[order[1:]]] == h[some[order[:-1]]]) & (doc[order[1:]] == doc[order[:-1]])
    return some[order[1:][same]]


def frequencies(targets: int):
    """Task: all postings of a fragment; keeps those of n-grams in two documents or more, with their frequency.

    Rows that share an id are one document: what they hold twice is counted once and taken off the document's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, count, h, _ = gather(batches)
        entry = np.repeat(np.arange(len(ids), dtype=np.int32), count)
        empty = count == 0
        again = repeats(ids, entry, h)
        if len(again):
            np.subtract.at(size, entry[again], 1)
            keep = np.ones(len(h), bool)
            keep[again] = False
            entry, h = entry[keep], h[keep]
        order = np.argsort(h)
        run_ = h[order]
        lead = np.flatnonzero(np.concatenate(([True], run_[1:] != run_[:-1]))) if len(h) else np.empty(0, np.int64)
        per = np.diff(np.append(lead, len(h)))
        df = np.empty(len(h), np.int32)
        df[order] = np.repeat(per, per)
        del order, run_
        keep = df > 1
        count = np.bincount(entry[keep], minlength=len(ids))
        h, df = h[keep], df[keep]
        to = (mix(ids.view(np.uint64)) % np.uint64(targets)).astype(np.int64)
        live = np.flatnonzero((count > 0) | (size != 0) | empty)
        live = live[np.argsort(to[live], kind="stable")]
        first = np.cumsum(count) - count
        n = count[live]
        at = np.repeat(first[live] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield pack(to[live], ids[live], size[live], n, h[at], df[at])

    return run


def parity(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """A row of SKETCH words for each document; bit i is the parity of the number of its hashes that fall on i."""
    out = np.zeros((docs, SKETCH), np.uint64)
    h = h.view(np.uint64)
    np.bitwise_xor.at(out.reshape(-1), doc * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), np.uint64(1) << (h // np.uint64(SKETCH) % np.uint64(64)))
    return out.view(np.int64)


def sets(percent: int):
    """Task: all shared n-grams of its documents, rarest first; documents that cannot link keep only their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, count, h, df = gather(batches)
        names, at = np.unique(ids, return_inverse=True)
        n = np.zeros(len(names), np.int64)
        np.add.at(n, at, size)
        doc = np.repeat(at, count)
        order = np.lexsort((h, df, doc))
        doc, h, df = doc[order], h[order], df[order]
        shared = np.bincount(doc, minlength=len(names))
        least = need(n, percent)
        live = (n > 0) & (shared >= least)
        keep = live[doc]
        doc, h = doc[keep], h[keep]
        lead = np.where(live, shared - least + 1, 0)
        place = np.arange(len(h)) - (np.cumsum(np.where(live, shared, 0)) - np.where(live, shared, 0))[doc]
        marks = [np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64)]
        for i in (0, 1):
            np.add.at(marks[i], doc, mix(h.view(np.uint64) + np.uint64(i + 1)))
            whole = shared == n
            marks[i] = np.where(whole, marks[i], mix(names.view(np.uint64) + np.uint64(i)))
        sketch = parity(doc, h, len(names))
        part = (h.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
        inner = np.argsort(doc * (1 << COUNT_BITS) + part, kind="stable")
        seg = np.bincount(doc * (1 << COUNT_BITS) + part, minlength=len(names) << COUNT_BITS)
        front = place < lead[doc]
        for a in range(0, len(names), 2000):
            own = slice(a, min(a + 2000, len(names)))
            pick = slice(*np.searchsorted(doc, [own.start, own.stop]))
            f = front[pick]
            dead = pa.array(~live[own])
            inner_lists = lists(h[inner[pick]], seg[own.start << COUNT_BITS : own.stop << COUNT_BITS], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[own]), pa.array(n[own]), pa.array(shared[own], pa.int64()), pa.array(marks[0][own].view(np.int64)), pa.array(marks[1][own].view(np.int64)), lists(h[pick][f], lead[own], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(own.stop - own.start + 1, dtype=np.int32) << COUNT_BITS), inner_lists), lists(sketch[own][live[own]].ravel(), live[own] * SKETCH, pa.int64())],
                ["id", "n", "shared", "mark1", "mark2", "front", "parts", "sketch"],
            ).append_column("live", pc.invert(dead))

    return run


def overlaps(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link: partial overlaps are counted per fragment and summed per pair."""
    seg = docs.select("id", "n", F.posexplode("parts").alias("fragment", "segment"))
    left = seg.select(F.col("id").alias("a"), F.col("n").alias("na"), "fragment", F.col("segment").alias("sa"))
    right = seg.select(F.col("id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("segment").alias("sb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    total = part.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("common").alias("common"))
    return total.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def possible(percent: int):
    """Condition on two bucket rows x and y: the n-grams from this one on could still make a link."""
    least = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    return (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent) & (F.least("x.rest", "y.rest") >= least)


def within_sketch(percent: int):
    """Condition on two rows x and y: the sketches leave room for a link.

    A hash that both hold cancels in the exclusive or of the sketches, so each bit left is at least one hash that only one
    of the two holds: no link is ever excluded.
    """
    least = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    differ = sum(F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH))
    return F.col("x.shared") + F.col("y.shared") - differ >= least * 2


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, fragment_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_shingles, component_id) for every document; links need 100 * overlap >= percent * union.

    Sets hold distinct k-word n-grams of the whole text with A-Z lower-cased; a shorter text is one n-gram, a text that is
    null or without words is the empty set and links with nothing. Rows without an id are left out; rows that share an id
    are one document, whose set is the union of theirs. Ids may be of any type that can be ordered: integers are used as
    they are, others through a 64-bit hash. An empty table gives an empty result; other columns are not read. n-grams are
    compared as 64-bit hashes. Fragments hold about `fragment_bytes` of text each, 64 at least and 2**15 at most.
    """
    whole = docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col(doc_id).cast("long") if whole else F.xxhash64(F.col(doc_id))
    docs = docs.where(F.col(doc_id).isNotNull())
    found = groups(docs.select(key.alias("id"), F.col(text).alias("text")), k, percent, fragment_bytes)
    if whole:
        return found
    named = found.join(docs.select(key.alias("id"), F.col(doc_id).alias("name")).distinct(), "id")
    least = named.groupBy("component_id").agg(F.min("name").alias("least"))
    return named.join(least, "component_id").select(F.col("name").alias("id"), "n_shingles", F.col("least").alias("component_id"))


def groups(docs: DataFrame, k: int, percent: int, fragment_bytes: int) -> DataFrame:
    """near_duplicates() of (id, text) with bigint ids."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(15, max(6, int(size // fragment_bytes).bit_length()))
    packed = docs.mapInArrow(segments(k, bits), PACK).repartitionById(1 << bits, "part")
    shared = packed.mapInArrow(frequencies(1 << bits), PACK).repartitionById(1 << bits, "part")
    schema = "id bigint, n bigint, shared bigint, mark1 bigint, mark2 bigint, front array<bigint>, parts array<array<bigint>>, sketch array<bigint>, live boolean"
    every = cut(shared.mapInArrow(sets(percent), schema), chain=True)
    live = every.where("live")
    mark = ["mark1", "mark2", "n"]
    alike = live.groupBy(*mark).agg(F.min("id").alias("rep"), F.count("*").alias("many"))
    member = cut(join_spread(live.select("id", *mark), alike, mark, "many").select("id", "rep"))
    single = cut(live.join(member.where("id = rep").select("id"), "id", "left_semi"))
    bucket = single.select("id", "n", "shared", F.posexplode("front").alias("place", "gram")).select("gram", "id", "n", (F.col("shared") - F.col("place")).alias("rest"))
    centre = bucket.groupBy("gram").agg(F.min(F.struct("id", "n", "rest")).alias("c"), F.count("*").alias("many")).where("many > 1").select("gram", "c.*")
    star = bucket.alias("y").join(centre.alias("x"), "gram").where((F.col("x.id") != F.col("y.id")) & possible(percent))
    linked = cut(overlaps(star.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), single, percent))
    label = components(linked)
    named = bucket.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tally = named.groupBy("gram", "component").count().groupBy("gram").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    mixed = cut(named.join(tally, "gram").join(single.select("id", "shared", "sketch"), "id"))
    minor = mixed.where("component <> main").alias("x")
    rest = minor.join(mixed.alias("y"), "gram").where((F.col("x.component") != F.col("y.component")) & possible(percent) & within_sketch(percent))
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    late = cut(overlaps(rest, single, percent))
    return every.select("id", F.col("n").alias("n_shingles")).join(resolve(member, label, late), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def resolve(member: DataFrame, label: DataFrame, late: DataFrame) -> DataFrame:
    """(id, component) of all documents in groups, after the links found late have joined components."""
    own = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"{side}_of"))
    late = late.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).distinct()
    joined = components(late).withColumnsRenamed({"id": "old", "component": "new"})
    named = member.join(label.withColumnsRenamed({"id": "rep"}), "rep", "left").select("id", F.coalesce("component", "rep").alias("old"))
    return named.join(joined, "old", "left").select("id", F.coalesce("new", "old").alias("component"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: five words, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g AS x JOIN g AS y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
