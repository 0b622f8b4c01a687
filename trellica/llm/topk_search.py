"""Exact top-k inner products by norm-bucketed retrieval (operator 11).

Vectors are grouped by length into at most MOST_BUCKETS buckets of neighbouring norms. A query first meets one block of the
bucket of the longest vectors; its k-th best score there is a threshold t that its final k-th score cannot fall below.
Then it meets the buckets that the threshold leaves: in a bucket whose longest vector has norm l, a vector can only reach t
if its cosine with the query reaches the local threshold t / (|q| l). Every bucket decides between two ways of pruning from
the local thresholds of the queries that meet it: by length (a prefix of its vectors, in order of norm, in one block
product) or by coordinate (a range of one sorted coordinate: the angles of two unit vectors with an axis differ by no more
than the angle between them). What is left is verified by the products themselves, in exact integers. Teflioudi, Gemulla
and Mykytiuk, "LEMP: fast retrieval of large entries in a matrix product" (2015).

A bucket and its queries are dealt into tiles of two bounded blocks, met by key. A tile sends on k rows a query at most, and
none below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellica.llm._store import cut, table

#: Buckets of norms at most; doubles in a block at most, and in a bucket while buckets are few.
MOST_BUCKETS, BLOCK_VALUES, BUCKET_VALUES = 4096, 1 << 20, 1 << 16
#: What rounding may take from a bound; cost of a vector found by coordinate, and of a query that asks, in products of a block.
SLACK, GATHER, ASK = 1e-9, 6.0, 300.0
#: Coordinates that a query looks at: those largest in it.
FOCUS = 3
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(scale: float):
    """Task: (id, vector) to integers floor(scale * x) held as doubles, with norm and a mark; other vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("vector")))
            column = batch.column("vector")
            size = np.asarray(pc.list_value_length(column)).astype(np.int64)
            off = np.concatenate(([0], np.cumsum(size)))
            x = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.where(np.isfinite(x), np.clip(np.floor(scale * x), -(2.0**62), 2.0**62), np.nan)
            squares = np.concatenate(([0.0], np.cumsum(~np.isfinite(x))))
            fine = squares[off[1:]] == squares[off[:-1]]
            norm = np.array([np.linalg.norm(x[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)])
            held = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), held, pa.array(norm, pa.float64())], ["id", "vector", "norm"]).filter(pa.array(fine))

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays of whole numbers, exact; beyond 64 bits the nearest 64-bit number."""
    most = np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape) for x in (a, b)]
    return np.clip((whole[0] @ whole[1].T).reshape(len(a), len(b)) if a.shape[1] else np.zeros((len(a), len(b)), np.int64), LEAST, MOST).astype(np.int64)


def best(score: np.ndarray, row: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each row, ties to the smaller place."""
    order = np.lexsort((place, -score.astype(np.float64), row)) if np.abs(score).max(initial=0) < 2**53 else np.array(sorted(range(len(row)), key=lambda i: (row[i], -int(score[i]), place[i])), np.int64)
    sorted_rows = row[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
    return order[rank < k]


def search_block(vectors: np.ndarray, ids: np.ndarray, norms: np.ndarray, queries: np.ndarray, own: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int, way: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) positions of the k best vectors of a block for each query, but for those below its threshold.

    `ids` and `own` number the ids of vectors and queries by rank, so that equal numbers are equal ids; `least` is LEAST
    where a query has no threshold. `way` forces length or coordinate pruning; else the local thresholds decide.
    """
    order = np.argsort(-norms, kind="stable")
    vectors, norms, places = vectors[order], norms[order], ids[order]
    goal = least.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        need = goal * (1 - SLACK) / lengths  # norm that a vector must have at least
        local = need / norms[0]  # its cosine, at least
    free = ~(goal > 0) | ~np.isfinite(local)
    prefix = np.where(free, len(norms), np.searchsorted(-norms, -np.where(free, 0.0, need), "right"))
    met = np.flatnonzero(prefix > 0)
    asks = np.flatnonzero((prefix > 0) & ~free & (lengths > 0))
    found = [np.zeros((3, 0), np.int64)]
    by_coordinate = np.zeros(0, np.int64)
    if len(asks) and vectors.shape[1] and way != "length":
        unit_v = vectors / np.where(norms > 0, norms, 1)[:, None]
        unit_q = queries[asks] / lengths[asks, None]
        focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
        angle = np.arccos(np.clip(local[asks], -1, 1))[:, None] + 1e-7
        centre = np.arccos(np.clip(np.take_along_axis(unit_q, focus, axis=1), -1, 1))
        low, high = np.cos(np.minimum(centre + angle, np.pi)) - SLACK, np.cos(np.maximum(centre - angle, 0)) + SLACK
        by_value = np.argsort(unit_v, axis=0)
        in_order = np.take_along_axis(unit_v, by_value, axis=0)
        first, last = (np.array([[np.searchsorted(in_order[:, f], x, side) for f, x in zip(fs, xs, strict=True)] for fs, xs in zip(focus, xss, strict=True)]).reshape(focus.shape) for xss, side in ((low, "left"), (high, "right")))
        narrow = np.argmin(last - first, axis=1)
        width = np.take_along_axis(last - first, narrow[:, None], axis=1)[:, 0]
        if way == "coordinate" or (GATHER * width + ASK).sum() < prefix[asks].sum():
            by_coordinate = asks
            for i, q in enumerate(asks):
                f = narrow[i]
                some = by_value[first[i, f] : last[i, f], focus[i, f]]
                for g in range(focus.shape[1]):
                    value = unit_v[some, focus[i, g]]
                    some = some[(value >= low[i, g]) & (value <= high[i, g])]
                some = some[(some < prefix[q]) & (places[some] != own[q])]
                score = products(queries[q : q + 1], vectors[some])[0]
                some, score = some[score >= least[q]], score[score >= least[q]]
                kept = best(score, np.zeros(len(score), np.int64), places[some], k)
                found.append(np.stack((np.full(len(kept), q), some[kept], score[kept])))
    rest = np.setdiff1d(met, by_coordinate)
    rest = rest[np.argsort(-prefix[rest], kind="stable")]
    for a in range(0, len(rest), 256):
        q = rest[a : a + 256]
        score = products(queries[q], vectors[: prefix[q[0]]])
        score[own[q][:, None] == places[None, : score.shape[1]]] = LEAST
        floor = least[q]
        if score.shape[1] > k:
            floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
        r, c = np.nonzero((score >= floor[:, None]) & (own[q][:, None] != places[None, : score.shape[1]]))
        kept = best(score[r, c], r, places[c], k)
        found.append(np.stack((q[r[kept]], c[kept], score[r, c][kept])))
    q, v, score = np.concatenate(found, axis=1)
    return q, order[v], score


def tile(k: int, kind: str):
    """Group task: the vectors (side 0) and queries (side 1) of a tile to (query, mark, id, score)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        rank = np.asarray(pc.rank(rows["id"], "ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
        side = np.asarray(rows["side"])
        x = np.asarray(rows["vector"].combine_chunks().flatten()).reshape(len(side), -1)
        norms, least = np.asarray(rows["norm"]), np.asarray(rows["least"])
        v, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        at, to, score = search_block(x[v], rank[v], norms[v], x[q], rank[q], norms[q], least[q], k) if len(v) and len(q) else np.zeros((3, 0), np.int64)
        ids = rows["id"]
        columns = [ids.take(pa.array(q[at])), rows["mark"].take(pa.array(q[at])), ids.take(pa.array(v[to])), pa.chunked_array([pa.array(score, pa.int64())])]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["query", "mark", "id", "score"])

    return run, f"query {kind}, mark bigint, id {kind}, score bigint"


def above(edges: np.ndarray):
    """Column function: how many of the ascending edges are not below a number."""

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series((len(edges) - np.searchsorted(edges, x.to_numpy(np.float64))).astype(np.int32))

    return place


def met(vectors: DataFrame, asked: DataFrame, buckets: DataFrame, k: int, kind: str, every: bool) -> DataFrame:
    """Best rows of the tiles in which queries meet their bucket: every block of it, or one."""
    counts = asked.groupBy("bucket").agg(F.sum("values").alias("asked"))
    plan = buckets.join(counts, "bucket").select("bucket", *[F.ceil(F.greatest(c, F.lit(1)) / BLOCK_VALUES).cast("int").alias(n) for c, n in (("held", "blocks"), ("asked", "groups"))])
    plan = F.broadcast(cut(plan))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", "mark", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["bucket", "dim", "block", "group", "side", "id", "mark", "norm", "least", "vector"]
    left = vectors.join(plan, "bucket").select("*", deal("blocks", 1).alias("block"), upto("groups").alias("group"), F.lit(0).alias("side"), F.lit(LEAST).alias("least"))
    right = asked.join(plan, "bucket").withColumn("group", deal("groups", 2)).withColumn("side", F.lit(1))
    right = right.withColumn("block", upto("blocks") if every else deal("blocks", 3))
    run, shape = tile(k, kind)
    return left.select(*fields).unionByName(right.select(*fields)).groupBy("bucket", "dim", "block", "group").applyInArrow(run, shape)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest integer inner product for each query.

    Both tables have an id (of one type that can be ordered) and a vector; a component x counts as the integer
    floor(scale * x). A vector with the query's id is its own and no candidate; vectors without an id are candidates, after
    all others of their score, but no queries. Equal scores go to the smaller id. Vectors that are null or hold null or
    non-finite components take no part; zero and empty vectors score 0. Vectors are compared with queries of their own
    length only, as a product across lengths is not defined; a query without a candidate has no rows. Rows that share an id
    are candidates of their own; queries that share id and vector are one query, an id with several query vectors has a
    ranking for each. Scores are exact while they fit 64 bits, beyond that the nearest 64-bit number; components are held
    within 2^62. Empty tables give an empty result; other columns are not read.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    as_rows = lambda df: df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).mapInArrow(whole_numbers(scale), f"id {kind}, vector array<double>, norm double").withColumn("mark", F.xxhash64("vector")).withColumn("dim", F.size("vector"))
    base, asked = cut(as_rows(vectors)), as_rows(queries.where(F.col(vec_id).isNotNull())).dropDuplicates(["id", "mark"])
    values = base.agg(F.sum(F.col("dim") + 1)).first()[0] or 0
    wanted = int(min(MOST_BUCKETS, max(-(-values // BLOCK_VALUES), min(64, -(-values // BUCKET_VALUES)))))
    edges = base.agg(F.percentile_approx("norm", [i / wanted for i in range(1, wanted)], 10 * MOST_BUCKETS).alias("at")).first()["at"] if wanted > 1 else None
    edges = np.unique(np.array(edges or [], np.float64))
    base = base.withColumn("bucket", above(edges)(F.col("norm")))
    buckets = cut(base.groupBy("bucket").agg(F.sum(F.col("dim") + 1).alias("held"), F.max("norm").alias("longest")))
    longest = {r["bucket"]: r["longest"] for r in buckets.select("bucket", "longest").collect()}
    if not longest:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("score")).where(F.lit(False))
    asked = cut(asked.withColumns({"least": F.lit(LEAST), "values": F.col("dim") + 1, "bucket": F.lit(min(longest))}))
    seeds = met(base, asked, buckets, k, kind, every=False)
    least = seeds.groupBy("query", "mark").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k).select(F.col("query").alias("id"), "mark", F.element_at("s", k).alias("least"))
    raised = asked.drop("least", "bucket").join(least, ["id", "mark"], "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))
    shortest = np.array([longest[b] for b in sorted(longest, reverse=True)]) * (1 + SLACK)
    reached = F.when(F.col("least") > 0, above(shortest)(F.col("least") / F.greatest("norm", F.lit(1.0)))).otherwise(len(shortest))
    some = raised.withColumn("bucket", F.explode(F.slice(F.lit(np.array(sorted(longest), np.int32)), F.lit(1), reached)))
    found = met(base, cut(some), buckets, k, kind, every=True)
    order = Window.partitionBy("query", "mark").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best products of every embedding whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_products(rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
