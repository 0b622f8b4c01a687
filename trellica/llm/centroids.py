"""Centroid clustering by kd-tree filtering in exact integers (operator 13).

Every partition packs its vectors into kd-trees of bounded size, once. A node holds its count, the integer sum of its
vectors and their box. A round walks all nodes of a level at once: a centroid that is strictly farther than another one
from every point of a node's box is pruned there; a node with one centroid left adds its count and sum as a whole, and
only leaves that several centroids still dispute look at their vectors. Tasks send on a count and a sum for each centroid,
so a round shuffles nothing that grows with the vectors. Kanungo et al., "An efficient k-means clustering algorithm:
analysis and implementation" (2002).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._store import cut, table
from trellica.llm._text import lists

#: Integers in the vectors of a tree, and vectors in a leaf (about).
TREE_VALUES, LEAF = 1 << 19, 32
FAR = np.iinfo(np.int64).max


def largest(dim: int) -> int:
    """Size of a component up to which no number of this module leaves 64 bits: 2^27 for 64 components."""
    return math.isqrt((1 << 60) // dim)


def whole_numbers(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of dim finite components, and the integers floor(scale * x) of those, held within largest(dim)."""
    fine = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    own = column.filter(fine)
    values = own.flatten().cast(pa.float64())
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    keep = np.asarray(fine).copy()
    keep[keep] = good
    with np.errstate(over="ignore"):
        return keep, np.clip(np.floor(scale * x[good]), -largest(dim), largest(dim)).astype(np.int64)


def borders(n: int) -> list[np.ndarray]:
    """Where the nodes of each level of a balanced tree over n rows begin, from the root to leaves of about LEAF rows."""
    levels = int(np.ceil(np.log2(max(1.0, n / LEAF))))
    return [np.arange((1 << j) + 1, dtype=np.int64) * n >> j for j in range(levels + 1)]


def kd_order(x: np.ndarray) -> np.ndarray:
    """Rows in tree order: each node is split at the median of its widest dimension."""
    order, levels = np.arange(len(x)), borders(len(x))
    for edges, halves in zip(levels, levels[1:], strict=False):
        for a, middle, b in zip(edges[:-1], halves[1::2], edges[1:], strict=True):
            own = x[order[a:b]]
            widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle - a)]
    return order


def node_facts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest components, and sums, of all nodes, level by level."""
    starts = [edges[:-1] for edges in borders(len(x))]
    return tuple(np.concatenate([f.reduceat(x, s, axis=0) for s in starts]) for f in (np.minimum, np.maximum, np.add))


def undominated(low: np.ndarray, high: np.ndarray, live: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """live (nodes x centroids) without those that another live one beats strictly at every point of the node's box.

    The other one is the live centroid nearest to the middle of the box. The difference of two squared distances is linear
    in the point, so its least value over a box stands at a corner.
    """
    size = (centres * centres).sum(axis=1)
    to_middle = size - (low + high) @ centres.T  # less the same number for all centroids
    best = np.argmin(np.where(live, to_middle, FAR), axis=1)
    way = centres[None, :, :] - centres[best][:, None, :]
    most = np.maximum(way * low[:, None, :], way * high[:, None, :]).sum(axis=2)
    return live & ~(size[None, :] - size[best][:, None] - 2 * most > 0)


def walk(x: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, centres: np.ndarray, label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Count and sum of each centroid's vectors in one tree; with `label` also the centroid of every vector."""
    k, n = len(centres), len(x)
    count, sums = np.zeros(k, np.int64), np.zeros_like(centres)
    own = np.full(n, -1, np.int32) if label else None
    levels, first = borders(n), 0
    node, live = np.zeros(1, np.int64), np.ones((1, k), bool)
    for depth, edges in enumerate(levels):
        live = undominated(low[first + node], high[first + node], live, centres)
        single = live.sum(axis=1) == 1
        winner = np.argmax(live, axis=1)
        done, to = node[single], winner[single]
        np.add.at(count, to, edges[done + 1] - edges[done])
        np.add.at(sums, to, total[first + done])
        if label:
            for v, c in zip(done, to, strict=True):
                own[edges[v] : edges[v + 1]] = c
        node, live, first = node[~single], live[~single], first + len(edges) - 1
        if depth < len(levels) - 1:
            node, live = np.stack((2 * node, 2 * node + 1), axis=1).ravel(), np.repeat(live, 2, axis=0)
    sizes = levels[-1][node + 1] - levels[-1][node]
    rows = np.repeat(levels[-1][node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    points, disputed = x[rows], np.repeat(live, sizes, axis=0)
    products = (points.astype(np.float64) @ centres.T.astype(np.float64)).astype(np.int64) if exact(points, centres) else points @ centres.T
    to = np.argmin(np.where(disputed, (centres * centres).sum(axis=1) - 2 * products, FAR), axis=1)
    np.add.at(count, to, 1)
    np.add.at(sums, to, points)
    if label:
        own[rows] = to
    return count, sums, own


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all products of rows of a and b, and their partial sums, exactly."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53


def plant(kind: str, dim: int, scale: float):
    """Task: rows (id, vector) to trees of bounded size; vectors that take no part are left out."""
    most = max(1, TREE_VALUES // dim)

    def tree(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        order = kd_order(x)
        x = x[order]
        flat = lambda a, t: lists(a.ravel(), np.array([a.size]), t)
        low, high, total = node_facts(x)
        held = pa.chunked_array(ids).combine_chunks().take(pa.array(order))
        held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        return pa.RecordBatch.from_arrays([held, flat(x, pa.int32()), flat(low, pa.int32()), flat(high, pa.int32()), flat(total, pa.int64())], ["ids", "vectors", "low", "high", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                keep, x = whole_numbers(part.column("vector"), dim, scale)
                own = part.column("id").filter(pa.array(keep))
                if held and held + len(x) > most:
                    yield tree(ids, parts)
                    ids, parts, held = [], [], 0
                if len(x):
                    ids, parts, held = [*ids, own], [*parts, x], held + len(x)
        if held:
            yield tree(ids, parts)

    return run, f"ids array<{kind}>, vectors array<int>, low array<int>, high array<int>, total array<bigint>"


def trees_of(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("ids").slice(i, 1).flatten(), *[np.asarray(batch.column(c).slice(i, 1).flatten(), np.int64).reshape(-1, dim) for c in ("vectors", "low", "high", "total")]


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of dim finite components.

    Other vectors (null, of another length, with null or non-finite components) are left out. A component x counts as the
    integer floor(scale * x), held within largest(dim) on both sides, so that every distance fits 64 bits; sums beyond 64 bits
    count as the largest number. The first centroids are the k vectors with the smallest sha256 of `seed:vec_id`, equal
    hashes by their components; fewer where there are fewer vectors. A null id has no hash and seeds only where ids run
    out. Rows that share an id, or repeat, are vectors of their own; equal distances go to the smaller number. An empty
    table gives an empty result; other columns are not read. k * dim integers reach the driver in a round.
    """
    kind = df.schema[vec_id].dataType.simpleString()
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    grow, shape = plant(kind, dim, scale)
    trees = cut(rows.mapInArrow(grow, shape))
    starts = seeds(rows, k, dim, scale, seed)
    if not len(starts):
        return trees.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centres = starts
    for _ in range(rounds):
        centres = moved(trees, centres, dim)
    assigned = cut(trees.select("ids", "vectors", "low", "high", "total").mapInArrow(labels_by(centres, dim), f"vec_id {kind}, cluster int, distance bigint"))
    within = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    capped = lambda n: min(n, int(FAR))
    facts = [(c, capped(within[c]), capped(sum(within.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c in sorted(within)]
    told = trees.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def seeds(rows: DataFrame, k: int, dim: int, scale: float, seed: int) -> np.ndarray:
    """The k first centroids (fewer rows, if there are fewer vectors)."""
    fine = (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where(fine).orderBy(mark.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    column = pa.array([r["vector"] for r in first], pa.list_(pa.float64()))
    return whole_numbers(column, dim, scale)[1]


def moved(trees: DataFrame, centres: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centres), np.int64), np.zeros_like(centres)
        for _, x, low, high, total in trees_of(batches, dim):
            more, add, _ = walk(x, low, high, total, centres, label=False)
            count, sums = count + more, sums + add
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(count), lists(sums.ravel(), np.full(len(centres), dim), pa.int64())], ["cluster", "many", "sums"])

    parts = trees.mapInArrow(run, "cluster int, many bigint, sums array<bigint>")
    large = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = parts.select("cluster", "many", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(large("many").alias("many"), large("part").alias("total")).collect()
    out = centres.copy()
    for r in found:
        if r["many"]:
            out[r["cluster"], r["at"]] = int(r["total"]) // int(r["many"])
    return out


def labels_by(centres: np.ndarray, dim: int):
    """Task: trees to (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, low, high, total in trees_of(batches, dim):
            own = walk(x, low, high, total, centres, label=True)[2]
            apart = ((x - centres[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(apart)], ["vec_id", "cluster", "distance"])

    return run


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance, inertia and final centroid of every embedding."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    near = lambda name: f"SELECT v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.v, z.c, sum((x.n - z.n) * (x.n - z.n)) AS d FROM x JOIN {name} AS z ON x.i = z.i GROUP BY x.v, z.c) GROUP BY v"
    steps = [f"""kept AS (SELECT vec_id, row_number() OVER () AS v, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
             "x AS MATERIALIZED (SELECT v, unnest(e) AS n, generate_subscripts(e, 1) AS i FROM kept)",
             f"z0 AS MATERIALIZED (SELECT c, unnest(e) AS n, generate_subscripts(e, 1) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM kept QUALIFY c < {k}))"]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near(f'z{r}')})")
        steps.append(f"m{r} AS (SELECT a.c, x.i, CAST((sum(x.n) - ((sum(x.n) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS n FROM a{r} AS a JOIN x ON x.v = a.v GROUP BY a.c, x.i)")
        steps.append(f"z{r + 1} AS MATERIALIZED (SELECT z.c, z.i, coalesce(m.n, z.n) AS n FROM z{r} AS z LEFT JOIN m{r} AS m ON m.c = z.c AND m.i = z.i)")
    steps.append(f"fin AS MATERIALIZED ({near(f'z{rounds}')})")
    steps.append(f"told AS (SELECT c, sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY i)) AS s FROM z{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + """
SELECT k.vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.d) OVER () AS BIGINT) AS inertia, t.s AS centroid_sha256 FROM fin AS f JOIN kept AS k ON k.v = f.v JOIN told AS t ON t.c = f.c
"""


ORACLE = _oracle()
