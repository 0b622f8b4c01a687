"""Seeded alignment: minimizers by one pass over pieces of the sequences, hits, chain and window as joins, then an exact alignment of the window.

Hashes are FNV-1a over the k-mer's bytes, kept as a long with the sign bit flipped, so that signed order is unsigned order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellica.functions.scoring import Scoring
from trellica.operators.align import align

#: FNV-1a offset and prime (fixed values of the published hash).
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
DEFAULT_K, DEFAULT_WINDOW, DEFAULT_FLANK = 15, 10, 128


def fnv1a(text: Column) -> Column:
    """FNV-1a of the bytes of a text, as a sign-flipped long."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).to_pylist()
        size = np.array([len(x or b"") for x in raw], np.int64)
        grid = np.zeros((len(raw), int(size.max(initial=0))), np.uint64)
        for row, x in zip(grid, raw, strict=True):
            if x:
                row[: len(x)] = np.frombuffer(x, np.uint8)
        out = np.full(len(raw), FNV_OFFSET, np.uint64)
        for j in range(grid.shape[1]):
            out = np.where(size > j, (out ^ grid[:, j]) * FNV_PRIME, out)
        return pa.array((out ^ np.uint64(1 << 63)).view(np.int64), mask=np.asarray(texts.is_null()))

    return run(text)


def check_parameters(k: int, window: int) -> None:
    if k < 1 or window < 1:
        raise ValueError("k and window must be 1 or more")


def kmers(rows: DataFrame, id_: str, text: str, k: int) -> DataFrame:
    """(id, pos, kmer, n_kmers): every k-mer of every text of at least k symbols."""
    count = F.length(text) - k + 1
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(text), i + 1, F.lit(k)))
    at = rows.where(F.length(text) >= k).select(F.col(id_), count.alias("n_kmers"), each.alias("kmers"))
    return at.select(id_, "n_kmers", F.posexplode("kmers").alias("pos", "kmer")).select(id_, "pos", "kmer", "n_kmers")


#: Window starts that one piece of a sequence holds, however long the sequence is.
STARTS_PER_PIECE = 4096


def hashes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a of the byte spans [start, end), sign-flipped."""
    out, size = np.full(len(start), FNV_OFFSET, np.uint64), end - start
    for j in range(int(size.max(initial=0))):
        out = np.where(size > j, (out ^ data[np.minimum(start + j, len(data) - 1)]) * FNV_PRIME, out)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def least_places(values: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Place of the leftmost least value among the `window` values from each place on that are in its group.

    Spans double while they fit into the window, then two of them that overlap cover it.
    """
    n, place, span = len(values), np.arange(len(values)), 1
    last = np.searchsorted(group, group, "right") - 1
    lower = lambda a, b: np.where(values[b] < values[a], b, a)
    while 2 * span <= window:
        place = lower(place, place[np.minimum(np.arange(n) + span, last)])
        span *= 2
    return lower(place, place[np.minimum(np.arange(n) + window - span, last)]) if n else place


def minimizers(rows: DataFrame, id_: str, text: str, k: int = DEFAULT_K, window: int = DEFAULT_WINDOW, starts: int = STARTS_PER_PIECE) -> DataFrame:
    """(id, pos, hash, kmer): the least k-mer hash of each window, leftmost on ties; a window that picks the same position
    as the one before adds nothing. A text shorter than the window has one window.

    A text is cut into overlapping pieces of `starts` windows: a piece also holds the symbols that its last window reaches
    and the start before its first, so pieces are independent and a long sequence spreads over many tasks. One pass over a
    batch of pieces hashes and slides; k-mers become rows and strings only where a window picks them.
    """
    check_parameters(k, window)
    if starts < 1:
        raise ValueError("starts must be 1 or more")
    kind = rows.schema[id_].dataType
    windows = F.greatest(F.length(text) - k + 1 - window, F.lit(0)) + 1
    first = F.greatest(F.col("piece") * starts - 1, F.lit(0))
    pieces = rows.where(F.length(text) >= k).select(F.col(id_).alias("id"), F.col(text).alias("text"), F.explode(F.sequence(F.lit(0), F.floor((windows - 1) / starts))).alias("piece"))
    pieces = pieces.select("id", first.cast("long").alias("first"), (F.col("piece") > 0).alias("inner"), F.substring("text", (first + 1).cast("int"), F.lit(starts + window + k - 1)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            symbol = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes at which symbols begin
            lead = np.searchsorted(symbol, off)
            count = np.diff(lead) - k + 1  # k-mers of each piece
            piece = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)  # place in its piece
            start = np.repeat(lead[:-1], count) + at
            hashes = hashes_at(data, symbol[start], symbol[start + k])
            least = least_places(hashes, piece, window)
            inner = np.asarray(batch.column("inner")).astype(np.int64)[piece]
            full = np.maximum(count - window, 0)[piece]
            own = (at >= inner) & (at <= np.minimum(full, starts - 1 + inner))
            changed = own & ((at == 0) | (least != np.concatenate(([-1], least[:-1]))))
            to = least[changed]
            kmers_ = pa.array([data[a:b].tobytes() for a, b in zip(symbol[start[to]], symbol[start[to] + k], strict=True)], pa.binary()).cast(pa.string())
            ids = batch.column("id").take(pa.array(piece[to]))
            pos = np.asarray(batch.column("first"))[piece[to]] + at[to]
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(hashes[to]), kmers_], [id_, "pos", "hash", "kmer"])

    return pieces.mapInArrow(run, f"`{id_}` {kind.simpleString()}, pos int, hash bigint, kmer string")


def minimizer_hits(pairs: DataFrame, k: int = DEFAULT_K, window: int = DEFAULT_WINDOW) -> DataFrame:
    """(pair_index, query_pos, target_pos, length): equal minimizers of query and target, each position pair once."""
    query = minimizers(pairs, "pair_index", "query", k, window).select("pair_index", "hash", "kmer", F.col("pos").alias("query_pos"))
    target = minimizers(pairs, "pair_index", "target", k, window).select("pair_index", "hash", "kmer", F.col("pos").alias("target_pos"))
    hits = query.join(target, ["pair_index", "hash", "kmer"]).select("pair_index", "query_pos", "target_pos").distinct()
    return hits.withColumn("length", F.lit(k))


def best_chain(hits: list[tuple[int, int]]) -> list[int]:
    """Numbers of the hits of the longest chain that grows in both positions; earliest predecessor and end on ties.

    hits are sorted. A Fenwick tree over the ranks of target positions keeps the longest chain that ends before each, the
    earliest on ties; hits of one query position enter it together, after all of them have asked.
    """
    size = len(hits)
    ranks = (np.unique([t for _, t in hits], return_inverse=True)[1] + 1).tolist()
    tree = [0] * (max(ranks, default=0) + 1)  # (length, earlier hits larger) in one number
    length, before = [1] * size, [-1] * size
    at = 0
    while at < size:
        to = at
        while to < size and hits[to][0] == hits[at][0]:
            best, rank = 0, ranks[to] - 1
            while rank:
                best = max(best, tree[rank])
                rank &= rank - 1
            if best:
                more, late = divmod(best, size + 1)
                length[to], before[to] = more + 1, size - late
            to += 1
        for i in range(at, to):
            value, rank = length[i] * (size + 1) + size - i, ranks[i]
            while rank < len(tree):
                tree[rank] = max(tree[rank], value)
                rank += rank & -rank
        at = to
    at, chain = length.index(max(length)), []
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


def seed_chain(hits: DataFrame) -> DataFrame:
    """(pair_index, chain): the best chain of each pair that has hits, as array<struct<query_pos, target_pos, length>>."""
    kind = "array<struct<query_pos:int,target_pos:int,length:int>>"

    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            out.append([row[i] for i in best_chain([(h["query_pos"], h["target_pos"]) for h in row])])
        return pa.array(out, rows.type)

    ordered = F.array_sort(F.collect_list(F.struct("query_pos", "target_pos", "length"))).cast(kind)
    return hits.groupBy("pair_index").agg(ordered.alias("hits")).select("pair_index", run("hits").alias("chain"))


def seeded_windows(pairs: DataFrame, k: int = DEFAULT_K, window: int = DEFAULT_WINDOW, flank: int = DEFAULT_FLANK) -> DataFrame:
    """pairs with the chain's span widened by the flank and clipped to the sequences; null without a seed."""
    chain = seed_chain(minimizer_hits(pairs, k, window))
    first, last = F.element_at("chain", 1), F.element_at("chain", -1)
    out = pairs.join(chain, "pair_index", "left").withColumn("seeds", F.size("chain"))
    for side in ("query", "target"):
        out = out.withColumn(f"{side}_from", F.greatest(F.lit(0), first[f"{side}_pos"] - flank))
        out = out.withColumn(f"{side}_to", F.least(F.length(side), last[f"{side}_pos"] + last["length"] + flank))
    seen = F.col("chain").isNotNull()
    return out.withColumns({f"{s}_{e}": F.when(seen, F.col(f"{s}_{e}")) for s in ("query", "target") for e in ("from", "to")})


def align_seeded(pairs: DataFrame, scoring: Scoring | None = None, k: int = DEFAULT_K, window: int = DEFAULT_WINDOW, flank: int = DEFAULT_FLANK, **options) -> DataFrame:
    """Global alignment inside each pair's seeded window, in coordinates of the whole sequences; no seed is an error row.

    The verification limit still looks at the whole pair, so verify is only passed on for pairs within it.
    """
    windows = seeded_windows(pairs, k, window, flank)
    piece = {s: F.substring(F.col(s), F.col(f"{s}_from") + 1, F.col(f"{s}_to") - F.col(f"{s}_from")) for s in ("query", "target")}
    spans = {"query_from": "query_from", "target_from": "target_from", "whole_query": "query", "whole_target": "target", "chain": "chain"}
    kept = windows.select("pair_index", "query_id", "target_id", *[v.alias(s) for s, v in piece.items()], *[F.col(c).alias(n) for n, c in spans.items()])
    inner = align(kept, "global-linear", scoring, **options, keep=tuple(spans))
    moved = inner.withColumns({f"{s}_{e}": F.col(f"{s}_{e}") + F.col(f"{s}_from") for s in ("query", "target") for e in ("start", "end")})
    moved = moved.withColumns({"error": F.when(F.col("chain").isNull(), "no shared seed").otherwise(F.col("error")), "mode": F.lit("seeded-global-linear"), "backend": F.lit("minimizer-seeded")})
    moved = moved.withColumns({s: F.col(f"whole_{s}") for s in ("query", "target")} | {f"{s}_length": F.length(f"whole_{s}") for s in ("query", "target")})
    return moved.select(*[c for c in inner.columns if c not in spans])
