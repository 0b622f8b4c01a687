"""Layered dynamic programs as Spark plans: joins layer by layer, ordered folds of small matrices, and array folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from trellica.functions.runtime import ensure_checkpoint_dir, scratch


def dag_problems(edges: DataFrame, widths: DataFrame) -> DataFrame:
    """Violations of a layered graph: (dag_id, problem). widths: dag_id, widths array<int>, start, end."""
    layers = F.size("widths")
    own = widths.select("dag_id", F.explode(F.array_compact(F.array(
        F.when(layers < 2, "needs two layers or more"),
        F.when(F.exists("widths", lambda w: w < 1), "a layer is empty"),
        F.when((layers >= 1) & ~F.col("start").between(0, F.element_at("widths", 1) - 1), "start outside the first layer"),
        F.when((layers >= 1) & ~F.col("end").between(0, F.element_at("widths", -1) - 1), "end outside the last layer"),
    ))).alias("problem"))
    at = edges.join(widths.select("dag_id", "widths"), "dag_id")
    bad = ~F.col("layer").between(0, F.size("widths") - 2) | ~F.col("from").between(0, F.get("widths", F.col("layer")) - 1) | ~F.col("to").between(0, F.get("widths", F.col("layer") + 1) - 1)
    return own.unionByName(at.where(bad).select("dag_id", F.lit("edge outside its layers").alias("problem")).distinct())


def longest_path_steps(edges: DataFrame, ends: DataFrame, layers: int) -> tuple[DataFrame, DataFrame]:
    """Best path from start to end of each graph: (dag_id, score), null where the end is out of reach, and one row
    (dag_id, layer, from, to) for each step of it.

    edges: dag_id, layer, edge_ord, from, to, score; ends: dag_id, start, end. Edges are written once, split by layer, so
    that each layer reads its own. All graphs advance together, one join and one maximum a layer, which keeps the score and
    the best predecessor of every node it reaches and nothing of the path; one pass backwards over these reads the paths.
    Ties take the smallest edge_ord.
    """
    spark, at = ends.sparkSession, scratch(ends.sparkSession, "edges")
    edges = edges.select("dag_id", F.col("layer").cast("int").alias("layer"), F.col("edge_ord").cast("long").alias("edge_ord"), F.col("from").cast("int").alias("at"), F.col("to").cast("int").alias("to"), F.col("score").cast("long").alias("gain"))
    edges.where(F.col("layer").between(0, layers - 1)).repartition("layer", "dag_id").write.partitionBy("layer").parquet(at)
    edges = spark.read.schema(edges.schema).parquet(at)
    front = ends.select("dag_id", F.col("start").cast("int").alias("at"), F.lit(0).cast("long").alias("score"))
    reached = []
    for layer in range(layers):
        total = F.col("score") + F.col("gain")
        best = F.max_by(F.struct(total.alias("score"), "at"), F.struct(total, -F.col("edge_ord"))).alias("b")
        step = front.join(edges.where(F.col("layer") == layer).drop("layer"), ["dag_id", "at"]).groupBy("dag_id", "to").agg(best)
        reached.append(step.select("dag_id", "to", "b.score", F.col("b.at").alias("from")).checkpoint())
        front = reached[-1].select("dag_id", F.col("to").alias("at"), "score")
    scores = ends.select("dag_id", F.col("end").cast("int").alias("at")).join(front, ["dag_id", "at"], "left").select("dag_id", "score")
    here, steps = ends.select("dag_id", F.col("end").cast("int").alias("to")), None
    for layer in reversed(range(layers)):
        step = here.join(reached[layer], ["dag_id", "to"]).select("dag_id", F.lit(layer).alias("layer"), "from", "to").checkpoint()
        here, steps = step.select("dag_id", F.col("from").alias("to")), step if steps is None else steps.unionByName(step)
    return scores, steps


def longest_paths(edges: DataFrame, ends: DataFrame, layers: int) -> DataFrame:
    """(dag_id, score, path): longest_path_steps() with the nodes of each path in one array; both null out of reach."""
    scores, steps = longest_path_steps(edges, ends, layers)
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("layer", "to"))), lambda s: s["to"])
    path = steps.groupBy("dag_id").agg(F.concat(F.array(F.min_by("from", "layer")), nodes).alias("path"))
    return scores.join(path, "dag_id", "left")


def path_score(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, path_score) of step rows: sum of the best parallel edge of each step; null if a step has no edge."""
    best = edges.groupBy("dag_id", "layer", "from", "to").agg(F.max("score").alias("gain"))
    joined = steps.join(best, ["dag_id", "layer", "from", "to"], "left")
    return joined.groupBy("dag_id").agg(F.when(F.count_if(F.col("gain").isNull()) == 0, F.sum("gain")).alias("path_score"))


def number_steps(rows: DataFrame, series: str, order: list[str], name: str = "step") -> DataFrame:
    """rows with a number from 0 without gaps in each series, by `order`; rows that tie are numbered in any order.

    Rows are sorted by ranges of (series, order), each range numbers its own runs in one pass, and what a series has in
    earlier ranges is carried into the next: one row a range reaches the driver. So a series may span many tasks, and no
    task holds more than a batch of one.
    """
    placed = rows.repartitionByRange(series, *order).sortWithinPartitions(series, *order)
    inner = StructType([*rows.schema.fields, StructField("__range", IntegerType()), StructField(name, LongType())])
    names = inner.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done = None, 0
        for batch in batches:
            if batch.num_rows:
                column = batch.column(series)
                own = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                lead = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                number = np.arange(len(own)) - np.repeat(lead, np.diff(np.append(lead, len(own))))
                if before is not None and column[0].as_py() == before[0]:
                    number[own == own[0]] += done
                before, done = (column[-1].as_py(),), int(number[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), TaskContext.get().partitionId()), pa.int32()), pa.array(number)], names=names)

    ensure_checkpoint_dir(rows.sparkSession)
    held = placed.mapInArrow(run, inner).checkpoint()
    key = F.struct(F.col(series).alias("k"), F.col(name).alias("n"))
    ranges = held.groupBy("__range").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("__range").collect()
    carried, last, rows_of_last = {}, None, 0
    for r in ranges:
        carried[r["__range"]] = rows_of_last if last is not None and last[0] == r["first"]["k"] else 0
        whole = r["first"]["k"] == r["last"]["k"]
        last, rows_of_last = (r["last"]["k"],), r["last"]["n"] + 1 + (carried[r["__range"]] if whole else 0)
    told = [(r["__range"], r["first"]["k"], carried[r["__range"]]) for r in ranges if carried[r["__range"]]]
    table = F.broadcast(rows.sparkSession.createDataFrame(told, StructType([StructField("__at", IntegerType()), StructField("__key", rows.schema[series].dataType), StructField("__more", LongType())])))
    joined = held.join(table, (F.col("__range") == F.col("__at")) & F.col(series).eqNullSafe(F.col("__key")), "left")
    return joined.select(*[c for c in rows.columns if c != name], (F.col(name) + F.coalesce("__more", F.lit(0))).alias(name))


def viterbi_problems(initial: Column, transitions: Column, emissions: Column) -> Column:
    """array<string>: what keeps a row from being decoded; empty for a sound one."""
    states = F.size(initial)
    return F.array_compact(F.array(
        F.when(F.coalesce(states, F.lit(0)) < 1, "no state"),
        F.when(F.coalesce(F.size(emissions), F.lit(0)) < 1, "no observation"),
        F.when((F.size(transitions) != states) | F.exists(transitions, lambda r: F.size(r) != states), "transitions are not square over the states"),
        F.when(F.exists(emissions, lambda r: F.size(r) != states), "an observation lacks a score for each state"),
    ))


def enter_states(scores: Column, emission: Column, grid: Column) -> Column:
    """array<struct<score, back>>: the best score of each state after one step and its first best predecessor."""
    states = F.sequence(F.lit(0), F.size(scores) - 1)
    best = F.transform(states, lambda to: F.array_max(F.transform(scores, lambda v, s: F.struct((v + F.get(F.get(grid, s), to)).alias("score"), (-s).alias("first")))))
    return F.transform(best, lambda b, to: F.struct((b["score"] + F.get(emission, to)).cast("long").alias("score"), (-b["first"]).cast("int").alias("back")))


def viterbi_blocks(steps: DataFrame, series: str, order: str, emission: str, initial: list[int], transitions: list[list[int]], block: int = 256, fanout: int = 256) -> DataFrame:
    """(series, block, score, start, end, states): the best path of each series in pieces, one row for each block of steps.

    A path begins in the best initial state (the last one on ties). A step adds the transition and the emission of the
    state it enters; the last best state wins at the end, the first best predecessor within.

    steps: one row per step with `order` gapless from 0 in each series. `states` holds the state in which the block is
    entered and then the state after each of its steps; score, start and end are those of the whole series. No task holds
    more of a series than one block of steps, or the matrices of `fanout` blocks: blocks are folded to matrices, these by
    `fanout` to matrices again until one is left, and on the way back the scores that enter each block follow; each block
    is then traced back from every state, and the states between blocks are chosen from the end in the same two ways.
    """
    states, grid = len(initial), F.array(*[F.array(*[F.lit(v).cast("long") for v in row]) for row in transitions])
    if not states or any(len(row) != states for row in (transitions, *transitions)):
        raise ValueError("transitions are not square over the states")
    if block < 1:
        raise ValueError("block must be 1 or more")
    start = max(range(states), key=lambda s: (initial[s], s))
    nothing = F.lit(None).cast("long")
    values = lambda row: F.transform(row, lambda x: x["score"])
    each = steps.select(F.col(series), F.floor(F.col(order) / block).alias("block"), F.struct(F.col(order).alias("at"), F.col(emission).alias("e")).alias("x"))
    held = each.groupBy(series, "block").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("steps"))
    ensure_checkpoint_dir(steps.sparkSession)
    held = held.checkpoint()

    unit = F.array(*[F.array(*[F.lit(0).cast("long") if s == t else nothing for t in range(states)]) for s in range(states)])
    matrix = F.aggregate("steps", unit, lambda rows, e: F.transform(rows, lambda row: values(enter_states(row, e, grid))))
    first = F.array(*[F.lit(initial[s]).cast("long") if s == start else nothing for s in range(states)])
    through = lambda at, m: F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda to: F.array_max(F.transform(at, lambda v, s: v + F.get(F.get(m, s), to))))
    matrices = held.select(series, "block", matrix.alias("m"))
    entered = carried(matrices, series, first, lambda a, b: F.transform(a, lambda row: through(row, b)), through, fanout).withColumnRenamed("value", "at")

    rows = F.aggregate("steps", F.array(F.transform("at", lambda v: F.struct(v.alias("score"), F.lit(-1).alias("back")))), lambda acc, e: F.concat(acc, F.array(enter_states(values(F.element_at(acc, -1)), e, grid))))
    ends = F.array(*[F.array(F.lit(s)) for s in range(states)])
    back = lambda paths, row: F.transform(paths, lambda p: F.concat(F.array(F.get(row, F.get(p, F.lit(0)))["back"]), p))
    traced = held.join(entered, [series, "block"]).select(series, "block", rows.alias("rows"))
    traced = traced.select(series, "block", values(F.element_at("rows", -1)).alias("scores"), F.aggregate(F.reverse(F.slice("rows", 2, F.size("rows") - 1)), ends, back).alias("paths")).checkpoint()

    final = traced.groupBy(series).agg(F.max("block").alias("top"), F.max_by("scores", "block").alias("scores"))
    last = F.array_max(F.transform("scores", lambda v, s: F.struct(v.alias("score"), s.alias("end"))))
    final = final.select(series, "top", last.alias("last")).checkpoint()
    firsts = traced.join(final, series).select(series, (F.col("top") - F.col("block")).alias("block"), F.transform("paths", lambda p: F.get(p, F.lit(0))).alias("m"))
    follow = lambda a, b: F.transform(a, lambda x: F.get(b, x))
    left = carried(firsts, series, F.sequence(F.lit(0), F.lit(states - 1)), follow, follow, fanout)
    chosen = left.join(final, series).select(series, (F.col("top") - F.col("block")).alias("block"), F.col("last.score").alias("score"), F.col("last.end").alias("end"), F.get("value", F.col("last.end")).alias("leave"))
    return traced.join(chosen, [series, "block"]).select(series, "block", "score", F.lit(start).alias("start"), "end", F.get("paths", F.col("leave")).alias("states"))


def carried(blocks: DataFrame, series: str, first: Column, join: Callable, enter: Callable, fanout: int) -> DataFrame:
    """(series, block, value): what enters each block of a series, `first` for block 0 and enter(value, m) behind a block.

    blocks: series, block from 0 without gaps, m. join(m, m) is associative. Runs of `fanout` blocks are joined to one, as
    often as runs are left, and values are handed down again, so no row holds more than `fanout` blocks.
    """
    ensure_checkpoint_dir(blocks.sparkSession)
    blocks = blocks.checkpoint()
    run = blocks.select(series, F.floor(F.col("block") / fanout).alias("run"), F.struct("block", "m").alias("b")).groupBy(series, "run").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["m"]).alias("ms"))
    if (blocks.agg(F.max("block")).first()[0] or 0) < fanout:
        above = run.withColumn("value", first)
    else:
        joined = F.aggregate(F.slice("ms", 2, fanout), F.element_at("ms", 1), join)
        upper = carried(run.select(series, F.col("run").alias("block"), joined.alias("m")), series, first, join, enter, fanout)
        above = run.join(upper.withColumnRenamed("block", "run"), [series, "run"])
    values = F.aggregate("ms", F.array("value"), lambda acc, m: F.concat(acc, F.array(enter(F.element_at(acc, -1), m))))
    each = above.select(series, "run", F.posexplode(F.slice(values, 1, F.size("ms"))).alias("no", "value"))
    return each.select(series, (F.col("run") * fanout + F.col("no")).alias("block"), "value")


def fold_matrices(steps: DataFrame, problem: str, order: str, matrix: str, states: int, block: int = 1000) -> DataFrame:
    """(problem, total): ordered min-plus product of states x states matrices, as a flat array by row.

    The product is associative but not commutative: each block of `block` consecutive steps is folded by itself (a partial
    aggregate that never holds more than a block), then the blocks of a problem are folded in order, again by blocks while
    many are left.
    """
    current = steps.select(F.col(problem), F.floor(F.col(order) / block).alias("__block"), F.col(order).alias("__at"), F.flatten(matrix).alias("__m"))
    most = current.agg(F.max("__block")).first()[0]
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("__at", "__m")))
        current = current.groupBy(problem, "__block").agg(F.aggregate(F.slice(ordered, 2, block), F.element_at(ordered, 1)["__m"], lambda acc, x: product(acc, x["__m"], states)).alias("__m"))
        if not most:
            return current.select(problem, F.col("__m").alias("total"))
        current = current.select(problem, F.floor(F.col("__block") / block).alias("__next"), F.col("__block").alias("__at"), "__m").withColumnRenamed("__next", "__block")
        most //= block


def product(left: Column, right: Column, states: int) -> Column:
    """Min-plus matrix product; null is infinity."""
    cell = lambda i, j: F.least(*[F.get(left, F.lit(i * states + k)) + F.get(right, F.lit(k * states + j)) for k in range(states)], F.lit(None).cast("long"))
    return F.array(*[cell(i, j) for i in range(states) for j in range(states)])
