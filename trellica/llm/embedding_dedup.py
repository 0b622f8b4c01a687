"""Embedding near-duplicates by spherical k-means cells and blocked cosine products (operator 5).

Spherical k-means on a bounded sample gives cell centres; centres that would link with each other are merged, so a dense
group is one cell. Every vector lives in the cell of its nearest centre. A vector x of cell h has a link in cell c only if
x.h - x.c <= d |c - h|, where d is the distance of unit vectors whose cosine is the link's: the linked vector is at least as
near to c as to h. x visits the cells that this bound leaves, so no link is missed, whatever the centres are; they only
decide how many products are saved.

Cells are joined by key in blocks of bounded size on both sides. Equal vectors are joined as one with a weight before
anything is compared. The core of a cell, its vectors within half the link's angle of the centre, links throughout, so a
group of near copies costs no products inside its core. Tasks send on link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm._skew import join_spread
from trellica.llm._store import cut, table
from trellica.llm._text import lists
from trellica.llm.components import components

#: Doubles in a block at most, what rounding may add to a bound, and lengths of vectors that get centres of their own.
BLOCK_VALUES, SLACK, FITTED_LENGTHS = 1 << 19, 1e-9, 64


def cells_for(vectors: int, most: int = 8192) -> int:
    """Cells that balance the cost of assignment and of products: half the root of the number of vectors."""
    return int(min(most, max(1, np.ceil(np.sqrt(vectors) / 2))))


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors; an empty cell is given a random vector again."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        empty = size < 1e-12
        total[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        centres = total / np.linalg.norm(total, axis=1, keepdims=True)
    return centres


def merge_centres(centres: np.ndarray, least: float) -> np.ndarray:
    """Centres of which no two would link: each joins the first one left that it would link with."""
    left = np.ones(len(centres), bool)
    out = []
    for i in range(len(centres)):
        if left[i]:
            near = left & (centres @ centres[i] >= least)
            left[near] = False
            total = centres[near].sum(axis=0)
            out.append(total / np.linalg.norm(total))
    return np.stack(out)


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length one; they are scaled by their largest component first, so that no square overflows."""
    rows = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least label reachable inside a block for each of n nodes, from the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def visits(points: np.ndarray, home: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Which later cells each point may have a link in (points x centres); a pair of cells is compared in the later one."""
    dots = points @ centres.T
    homes, at = np.unique(home, return_inverse=True)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[homes] @ centres.T)) + SLACK * SLACK)
    reach = np.sqrt(max(0.0, 2 - 2 * least)) * apart + SLACK
    return (dots[np.arange(len(home)), home][:, None] - dots <= reach[at]) & (np.arange(len(centres)) > home[:, None])


def compare(least: float):
    """Group task: the two blocks of a tile to link counts by vector and a spanning forest of links by node."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        side, ids, nodes, weight = (np.asarray(rows[c]) for c in ("side", "id", "node", "weight"))
        vectors = np.asarray(rows["vector"].combine_chunks().flatten()).reshape(len(ids), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = key[1].as_py() == key[2].as_py()
        if same:
            right = left
        count = np.zeros(len(ids), np.int64)
        names, at = np.unique(nodes, return_inverse=True)
        label = np.arange(len(names))
        b = vectors[right]
        for j in range(0, len(left), 1024):
            x, y = np.nonzero(vectors[left[j : j + 1024]] @ b.T >= least)
            x, y = left[j + x], right[y]
            if same:
                x, y = x[x < y], y[x < y]
            np.add.at(count, x, weight[y])
            np.add.at(count, y, weight[x])
            label = forest(np.concatenate((at[x], np.arange(len(names)))), np.concatenate((at[y], label)), len(names))
        link, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(count)
        columns = (ids[some], names[label[link]]), (ids[some], names[link]), (count[some], link * 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["a", "b", "degree"])

    return run


def upto(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def tiles(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Each vector once for every tile (cell, i, j) it takes part in, on side 0 or 1.

    Residents of a cell are dealt into `cores` blocks of its core and `others` of the rest, visitors into `guests`. Blocks
    meet in pairs i <= j, but for two of the core; the visitors' blocks count from -1 downwards. `cells` has one row a cell.
    """
    blocks = F.col("cores") + F.col("others")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own = placed.drop("visits").join(F.broadcast(cells), "home")
    own = own.withColumn("own", F.when(F.col("core"), deal(F.col("cores"))).otherwise(F.col("cores") + deal(F.col("others"))))
    met = F.filter(upto(blocks), lambda j: ~F.col("core") | (j >= F.col("cores")))
    inner = F.transform(met, lambda j: pair(F.least("own", j), F.greatest("own", j), (F.col("own") > j)))
    outer = F.transform(upto(F.col("guests")), lambda v: pair(F.col("own"), -1 - v, F.lit(0)))
    residents = own.withColumn("tile", F.explode(F.concat(inner, outer)))
    guests = placed.withColumn("cell", F.explode("visits")).drop("visits", "home").join(F.broadcast(cells.withColumnRenamed("home", "cell")), "cell").withColumnRenamed("cell", "home")
    guests = guests.withColumn("own", deal(F.col("guests")))
    guests = guests.withColumn("tile", F.explode(F.transform(upto(blocks), lambda i: pair(i, -1 - F.col("own"), F.lit(1)))))
    fields = ["home", "tile.i", "tile.j", "tile.side", "id", "node", "weight", "vector"]
    return residents.select(*fields).unionByName(guests.select(*fields))


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95, per_block: int = 4096, sample_per_cell: int = 32, most_cells: int = 8192, sample_bytes: int = 64 << 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors are compared with
    all others of their length, as a cosine is not defined across lengths. Rows without an id link with nothing and are
    kept. Every row is a vector of its own: rows that share an id are not joined by it, each counts its own links and is in
    the component that its vector links into, which takes its name from the smallest id in it; kept compares that name with
    the row's id, so of rows that share an id all, some or none may be kept. Ids may be of any type that can be ordered. An
    empty table gives an empty result; other columns are not read. The centres are fitted on about sample_per_cell * cells
    vectors and sample_bytes at most, drawn by a hash of the vector; links do not depend on them.
    """
    found = linked(df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vector")), least, per_block, sample_per_cell, most_cells, sample_bytes)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def fit_centres(single: DataFrame, least: float, per_block: int, sample_per_cell: int, most_cells: int, sample_bytes: int) -> dict[int, tuple[int, np.ndarray]]:
    """For the most frequent vector lengths the number of the first cell and the centres of the cells."""
    found = single.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(FITTED_LENGTHS).collect()
    many = {r["dim"]: r["count"] for r in found}
    size = {d: min(cells_for(n, most_cells), -(-4 * n // per_block)) for d, n in many.items()}
    wanted = {d: min(sample_per_cell * k, max(1, sample_bytes // (8 * d * len(many)))) for d, k in size.items()}
    if not many:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in wanted.items() for x in (d, min(1.0, n / many[d]))])
    drawn = single.where(F.pmod(F.xxhash64("mark0", "mark1"), F.lit(1 << 20)) < share[F.size("vector")] * (1 << 20)).select("vector").toArrow()["vector"].combine_chunks()
    out, first = {}, 0
    for d in sorted(size):
        sample = drawn.filter(pc.equal(pc.list_value_length(drawn), d))
        if len(sample):
            out[d] = (first, merge_centres(spherical_kmeans(unit(sample, d), size[d]), least))
            first += len(out[d][1])
    return out


def linked(rows: DataFrame, least: float, per_block: int, sample_per_cell: int, most_cells: int, sample_bytes: int) -> DataFrame:
    """(id, n_links, component) for (id, vector array<double>). Distinct vectors are told apart by a number, never by an id."""
    values = F.col("vector")
    fine = F.col("id").isNotNull() & values.isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    mark = [F.when(F.col("fine"), F.xxhash64(F.lit(i), "vector")).alias(f"mark{i}") for i in (0, 1)]
    rows = rows.select("id", "fine", *mark, "vector")
    marks = ["mark0", "mark1"]
    single = cut(rows.where("fine").groupBy(*marks).agg(F.min("id").alias("least_id"), F.count("*").alias("weight"), F.first("vector").alias("vector")).withColumn("id", F.monotonically_increasing_id()))
    fitted = fit_centres(single, least, per_block, sample_per_cell, most_cells, sample_bytes)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    inside = np.sqrt((1 + least) / 2) + SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("vector"))
            for d in pc.unique(dims).to_pylist():
                own = batch.filter(pc.equal(dims, d))
                start, centres = shared.value.get(d, (-d, None))  # a length without centres is one cell, without a core
                for a in range(0, own.num_rows, 1024):
                    part = own.slice(a, 1024)
                    points = unit(part.column("vector"), d)
                    near = np.full((len(points), 1), -1.0) if centres is None else points @ centres.T
                    home = np.argmax(near, axis=1)
                    core = near[np.arange(len(home)), home] >= inside
                    seen = np.zeros(near.shape, bool) if centres is None else visits(points, home, centres, least)
                    columns = [part.column("id"), part.column("weight"), pa.array((start + home).astype(np.int32)), pa.array(core), lists((start + np.nonzero(seen)[1]).astype(np.int32), seen.sum(axis=1), pa.int32()), lists(points.ravel(), np.full(len(points), d), pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "weight", "home", "core", "visits", "vector"])

    placed = cut(single.select("id", "weight", "vector").mapInArrow(assign, "id bigint, weight bigint, home int, core boolean, visits array<int>, vector array<double>"))
    inner = placed.groupBy("home").agg(F.count_if("core").alias("in_core"), F.count_if(~F.col("core")).alias("in_rest"), F.max(F.size("vector")).alias("dim"), F.min(F.when(F.col("core"), F.col("id"))).alias("core_node"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("core_weight"))
    guests = placed.select(F.explode("visits").alias("home")).groupBy("home").agg(F.count("*").alias("seen"))
    room = F.greatest(F.lit(1), F.least(F.lit(per_block), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    many = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(0)) / room).cast("int")
    cells = cut(inner.join(guests, "home", "left").select("home", "core_node", "core_weight", many("in_core").alias("cores"), many("in_rest").alias("others"), many("seen").alias("guests")))
    placed = placed.join(F.broadcast(cells.select("home", "core_node", "core_weight")), "home")
    placed = placed.withColumn("node", F.when(F.col("core"), F.col("core_node")).otherwise(F.col("id"))).withColumn("implied", F.when(F.col("core"), F.col("core_weight") - F.col("weight")).otherwise(0))
    dealt = tiles(placed.drop("core_node", "core_weight", "implied"), cells.drop("core_node", "core_weight"))
    found = cut(dealt.groupBy("home", "i", "j").applyInArrow(compare(least), "a bigint, b bigint, degree bigint"))
    degree = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("degree"))
    label = components(found.where("a <> b").select("a", "b").distinct()).withColumnRenamed("id", "node")
    node = cut(placed.select(F.col("id").alias("rep"), "node", "implied"))
    of_node = node.groupBy("node").agg(F.count("*").alias("many")).join(label, "node", "left")
    links = F.col("weight") - 1 + F.col("implied") + F.coalesce("degree", F.lit(0))
    stats = single.select(*marks, F.col("id").alias("rep"), "least_id", "weight").join(join_spread(node, of_node, ["node"], "many"), "rep").join(degree, "rep", "left")
    stats = cut(stats.select(*marks, "least_id", "weight", links.alias("n_links"), F.coalesce("component", "node").alias("root")))
    name = stats.groupBy("root").agg(F.min("least_id").alias("component"), F.count("*").alias("vectors"))
    named = join_spread(stats, name, ["root"], "vectors").select(*marks, "weight", "n_links", "component")
    known = join_spread(cut(rows.where("fine").select("id", *marks)), named, marks, "weight")
    return known.select("id", "n_links", "component").unionByName(rows.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, count(l.b) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN l ON l.a = c.vec_id GROUP BY c.vec_id, c.component_id
"""
