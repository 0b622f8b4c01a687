"""Scores of pairs that no task can hold: tiles of the score table, antidiagonal by antidiagonal, passing border rows on.

Tile (i, j) covers a block of the query and a block of the target. It needs the last row of the tile above and the last
column of the tile to its left, so all tiles of one antidiagonal run at once, those of all pairs together. A row holds two
blocks of symbols and two borders, however long the pair is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellica.functions.runtime import ensure_checkpoint_dir
from trellica.functions.scoring import Scoring
from trellica.operators.align import mode_scoring, validated

#: Symbols of each side that a tile covers.
TILE = 4096


def fill(q: np.ndarray, t: np.ndarray, top: np.ndarray, left: np.ndarray, table: np.ndarray, gap: int, local: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Last row, last column and greatest score of a tile, from the row above it and the column to its left."""
    step = gap * np.arange(len(t) + 1)
    row, right, best = top, np.empty(len(q) + 1, np.int64), int(top.max())
    right[0] = top[-1]
    for i, c in enumerate(q, 1):
        enter = np.empty_like(row)
        enter[0] = left[i]
        enter[1:] = np.maximum(row[:-1] + table[c, t], row[1:] + gap)
        if local:
            enter = np.maximum(enter, 0)
        row = np.maximum.accumulate(enter - step) + step
        right[i] = row[-1]
        if local:
            best = max(best, int(row.max()))
    return row, right, best


def tile_column(scoring: Scoring, mode: str, tile: int) -> Column:
    """struct<bottom, right, best> of the tiles (i, j, query, target, top, left)."""
    free, local = mode == "semiglobal-linear", mode == "local-linear"

    @F.arrow_udf("struct<bottom array<bigint>, right array<bigint>, best bigint>")
    def run(i: pa.Array, j: pa.Array, query: pa.Array, target: pa.Array, top: pa.Array, left: pa.Array) -> pa.Array:
        table, out = scoring.table(), []
        for a, b, q, t, above, before in zip(i.to_pylist(), j.to_pylist(), query.cast(pa.binary()).to_pylist(), target.cast(pa.binary()).to_pylist(), top, left, strict=True):
            q, t = np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8)
            edge = lambda block, size, given, zero: np.asarray(given.values) if given.is_valid else (0 if zero else scoring.gap) * (block * tile + np.arange(size + 1, dtype=np.int64))
            bottom, right, best = fill(q, t, edge(b, len(t), above, free or local), edge(a, len(q), before, local), table, scoring.gap, local)
            out.append((bottom, right, best if local else int(bottom.max()) if free else int(bottom[-1])))
        bottoms, rights, bests = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(bottoms, pa.list_(pa.int64())), pa.array(rights, pa.list_(pa.int64())), pa.array(bests, pa.int64())], ["bottom", "right", "best"])

    return run(*[F.col(c) for c in ("i", "j", "query", "target", "top", "left")])


def tiled_scores(pairs: DataFrame, mode: str = "global-linear", scoring: Scoring | None = None, tile: int = TILE) -> DataFrame:
    """(pair_index, score) of a linear-gap mode for pairs of any length; null for a pair that cannot be aligned.

    Scores are in the kernel's sign (edit distance is negated). There are as many waves as the longest pair has blocks on
    both sides together; each is one job over the tiles of all pairs, cut in the checkpoint folder.
    """
    if mode == "global-affine":
        raise ValueError("tiles are for modes with linear gaps")
    if tile < 1:
        raise ValueError("tile must be 1 or more")
    scoring = mode_scoring(mode, scoring or Scoring())
    ensure_checkpoint_dir(pairs.sparkSession)
    sound = validated(pairs, scoring).select("pair_index", "query", "target")

    def blocks(side: str, number: str) -> DataFrame:
        last = F.greatest(F.ceil(F.length(side) / tile).cast("int") - 1, F.lit(0))
        at = sound.where("query IS NOT NULL AND target IS NOT NULL").select("pair_index", side, last.alias(f"last_{number}"), F.explode(F.sequence(F.lit(0), last)).alias(number))
        return at.select("pair_index", number, f"last_{number}", F.substring(side, F.col(number) * tile + 1, F.lit(tile)).alias(side)).checkpoint()

    query, target = blocks("query", "i"), blocks("target", "j")
    last = query.where("i = 0").join(target.where("j = 0"), "pair_index").agg(F.max(F.col("last_i") + F.col("last_j"))).first()[0]
    done, found = None, None
    for wave in range(-1 if last is None else last + 1):
        tiles = query.withColumn("j", F.lit(wave) - F.col("i")).join(target, ["pair_index", "j"])
        if done is None:
            none = F.lit(None).cast("array<bigint>")
            tiles = tiles.withColumns({"top": none, "left": none})
        else:
            tiles = tiles.join(done.select("pair_index", (F.col("i") + 1).alias("i"), "j", F.col("r.bottom").alias("top")), ["pair_index", "i", "j"], "left")
            tiles = tiles.join(done.select("pair_index", "i", (F.col("j") + 1).alias("j"), F.col("r.right").alias("left")), ["pair_index", "i", "j"], "left")
        done = tiles.select("pair_index", "i", "j", "last_i", "last_j", tile_column(scoring, mode, tile).alias("r")).checkpoint()
        ends = F.lit(True) if mode == "local-linear" else F.col("i") == F.col("last_i")
        if mode not in ("local-linear", "semiglobal-linear"):
            ends = ends & (F.col("j") == F.col("last_j"))
        told = done.where(ends).select("pair_index", F.col("r.best").alias("best"))
        found = told if found is None else found.unionByName(told)
    if found is None:
        return sound.select("pair_index", F.lit(None).cast("long").alias("score"))
    return sound.select("pair_index").join(found.groupBy("pair_index").agg(F.max("best").alias("score")), "pair_index", "left")
