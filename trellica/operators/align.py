"""Pairwise alignment as a DataFrame transform.

Input rows hold pair_index, query_id, query, target_id, target. Validation, engine routing, coordinates, statistics,
re-scoring and verification are Spark expressions; only cell recurrences run in Arrow kernels. Score and trace are columns
of their own, so a query that selects no path never computes one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellica.functions import cigar as C
from trellica.functions import kernels as K
from trellica.functions.scoring import EDIT, LCS, Scoring

MODES = ("edit-distance", "lcs", "global-linear", "global-affine", "local-linear", "semiglobal-linear")
SCHEMA_VERSION = "trellica-align.v1"
#: Band rule of the automatic edit-distance engine and the default affine band (fixed values).
AUTO_BAND_DIVISOR, AUTO_BAND_LEAST, AUTO_BAND_MOST, AFFINE_BAND = 32, 8, 512, 64
#: Longest sequence that is verified in full by default (fixed value).
VERIFY_LIMIT = 2048


def mode_scoring(mode: str, scoring: Scoring) -> Scoring:
    return {"edit-distance": EDIT, "lcs": LCS}.get(mode, scoring)


def on_pairs(kernel: Callable[[list, list], pa.Array], kind: str) -> Callable[..., Column]:
    """Arrow column function over rows whose first two columns are not null; other rows give null."""

    @F.arrow_udf(kind)
    def run(query: pa.Array, target: pa.Array, *rest: pa.Array) -> pa.Array:
        both = np.flatnonzero(np.asarray(query.is_valid()) & np.asarray(target.is_valid()))
        pick = pa.array(both)
        pairs = list(zip(query.take(pick).cast(pa.binary()).to_pylist(), target.take(pick).cast(pa.binary()).to_pylist(), strict=True))
        return placed(kernel(pairs, *[r.take(pick).to_pylist() for r in rest]), both, len(query))

    return run


def structs(**columns: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def score_column(mode: str, scoring: Scoring, query: Column, target: Column, band: int | None = None) -> Column:
    """struct<score, query_start, query_end, target_start, target_end>, in the kernel's sign (edit distance is negated)."""
    s = mode_scoring(mode, scoring)
    kind = "struct<score bigint, query_start bigint, query_end bigint, target_start bigint, target_end bigint>"

    def run(pairs: list) -> pa.Array:
        table = s.table()
        n, m = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
        if mode == "local-linear":
            x = K.local_scores(pairs, table, s.gap)
            return structs(score=x[:, 0], query_start=x[:, 1], query_end=x[:, 2], target_start=x[:, 3], target_end=x[:, 4])
        if mode == "global-affine":
            score, start, end = K.affine_scores(pairs, table, s.gap_open, s.gap_extend, band), m * 0, m
        else:
            score, start, end = K.global_scores(pairs, table, s.gap, free=mode == "semiglobal-linear").T
        return structs(score=score, query_start=n * 0, query_end=n, target_start=start, target_end=end)

    return on_pairs(run, kind)(query, target)


def trace_column(mode: str, scoring: Scoring, query: Column, target: Column, block: Column, band: Column | None = None) -> Column:
    """struct<score, query_start, query_end, target_start, target_end, cigar> with an exact optimal path."""
    s = mode_scoring(mode, scoring)
    kind = "struct<score bigint, query_start bigint, query_end bigint, target_start bigint, target_end bigint, cigar string>"

    def run(pairs: list, blocks: list, bands: list) -> pa.Array:
        table = s.table()
        sign = [(len(p[0]), len(p[1])) for p in pairs]
        ends = np.array([(0, 0, n, 0, m) for n, m in sign], np.int64).reshape(-1, 5)
        if mode == "local-linear":
            ends = K.local_scores(pairs, table, s.gap)
        elif mode == "semiglobal-linear":
            ends[:, [0, 3, 4]] = K.global_scores(pairs, table, s.gap, free=True)
        elif mode != "global-affine":
            wide = [k for k, block_ in enumerate(blocks) if mode != "edit-distance" or block_]
            ends[wide, 0] = K.global_scores([pairs[k] for k in wide], table, s.gap)[:, 0]
        ops: list[str | None] = [None] * len(pairs)
        split = []
        for k, ((q, t), block_, band_) in enumerate(zip(pairs, blocks, bands, strict=True)):
            if mode == "edit-distance" and not block_:
                found = K.trace_edits(q, t, automatic_band(len(q), len(t)) if band_ is None else band_)
                if found or band_ is not None:
                    ends[k, 0], path = (-found[0], found[1]) if found else (K.NEG, None)
                    ops[k] = None if path is None else K.runs(path)
                    continue
                ends[k, 0] = K.global_scores([(q, t)], table, s.gap)[0, 0]  # many edits: their rows would outgrow a block of one
            if mode == "global-affine":
                found = K.trace_affine(np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8), table, s.gap_open, s.gap_extend, band_)
                ends[k, 0], path = found or (K.NEG, None)
                ops[k] = None if path is None else K.runs(path)
            else:
                split.append(k)
        boxes = [(int(a), int(p), int(b), int(c)) for _, a, b, p, c in ends[split]]
        for k, path in zip(split, K.traces([pairs[k] for k in split], table, s.gap, [blocks[k] or int(mode == "edit-distance") for k in split], boxes), strict=True):
            ops[k] = path
        return structs(score=ends[:, 0], query_start=ends[:, 1], query_end=ends[:, 2], target_start=ends[:, 3], target_end=ends[:, 4], cigar=np.array(ops, object))

    return on_pairs(run, kind)(query, target, block, F.lit(None).cast("int") if band is None else band)


def auto_band(query: Column, target: Column) -> Column:
    """Band of the automatic edit-distance engine: the length difference or a share of the length, within limits."""
    longest = F.greatest(F.length(query), F.length(target))
    share = F.greatest(F.least(F.floor(longest / AUTO_BAND_DIVISOR).cast("int"), F.lit(AUTO_BAND_MOST)), F.lit(AUTO_BAND_LEAST))
    return F.least(F.greatest(F.abs(F.length(query) - F.length(target)), share), longest)


def automatic_band(n: int, m: int) -> int:
    """auto_band() of two lengths."""
    return min(max(abs(n - m), min(max(n, m) // AUTO_BAND_DIVISOR, AUTO_BAND_MOST), AUTO_BAND_LEAST), max(n, m))


def within_auto_band(query: Column, target: Column) -> Column:
    """Whether the edit distance is within auto_band(); unlike pairs of similar length are given up early."""
    close = F.levenshtein(query, target, AUTO_BAND_MOST)
    near = F.abs(F.length(query) - F.length(target)) <= AUTO_BAND_MOST
    band = auto_band(query, target)
    return F.when(near, (close >= 0) & (close <= band)).otherwise(F.levenshtein(query, target) <= band)


def final_band(query: Column, target: Column, distance: Column) -> Column:
    """Band at which doubling from the length difference (b to 2 b + 1) first reaches the distance, within the longer length."""
    longest, least = F.greatest(F.length(query), F.length(target)), F.abs(F.length(query) - F.length(target))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(31)), least.cast("long"), lambda b, _: F.when(b < distance, 2 * b + 1).otherwise(b))
    return F.least(grown, longest.cast("long"))


def lcs_bit_length(query: Column, target: Column) -> Column:
    """Length of a longest common subsequence for a target of at most 128 symbols, else null."""
    short = F.when(F.length(target) <= 128, target)
    return on_pairs(lambda pairs: pa.array([K.lcs_bits(q, t) for q, t in pairs], pa.int64()), "bigint")(query, short)


def second_score_column(mode: str, scoring: Scoring, query: Column, target: Column) -> Column:
    """Objective by a recurrence that shares nothing with the kernels of score and trace; edit distance by Spark itself."""
    if mode == "edit-distance":
        return -F.levenshtein(query, target).cast("long")

    def run(pairs: list) -> pa.Array:
        if mode == "global-affine":
            return pa.array(K.second_affine_scores(pairs, scoring.table(), scoring.gap_open, scoring.gap_extend))
        return pa.array(K.second_scores(pairs, scoring.table(), scoring.gap, mode == "semiglobal-linear", mode == "local-linear"))

    return on_pairs(run, "bigint")(query, target)


def block_rows(query: Column) -> Column:
    """Default block: the root of the number of rows, rounded up; 1 for up to one row."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.length(query))).cast("int"))


def banded_distance(query: Column, target: Column, band: int | Column) -> Column:
    """Edit distance if it is at most the band, else null. The band must be a number for the native threshold."""
    if isinstance(band, int):
        found = F.levenshtein(query, target, band)
        return F.when(found >= 0, found)
    found = F.levenshtein(query, target)
    return F.when(found <= band, found)


def bit_vector_distance(query: Column, target: Column) -> Column:
    """Edit distance for a query of at most 64 symbols (one machine word), else null."""
    return F.when(F.length(query) <= 64, F.levenshtein(query, target))


def spread(pairs: DataFrame, key: str = "pair_index") -> DataFrame:
    """pairs dealt evenly: a row's cost is the product of its lengths, which no size in bytes shows."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def validated(pairs: DataFrame, scoring: Scoring) -> DataFrame:
    """pairs with an `error` column; query and target are null where it is set, so that no kernel sees them."""
    bad = F.lit(None).cast("string")
    for side in ("target", "query"):
        text = F.col(side)
        if scoring.foreign():
            bad = F.when(text.rlike(scoring.foreign()), F.format_string(f"{side} %s: symbol outside matrix {scoring.matrix.name}", F.col(f"{side}_id"))).otherwise(bad)
        bad = F.when(text.rlike(r"[^\x00-\x7F]"), F.format_string(f"{side} %s: not ASCII", F.col(f"{side}_id"))).otherwise(bad)
        bad = F.when(text.isNull(), F.format_string(f"{side} %s: no sequence", F.col(f"{side}_id"))).otherwise(bad)
    out = pairs.withColumn("error", bad)
    return out.withColumns({f"{s}_length": F.length(s) for s in ("query", "target")} | {s: F.when(F.col("error").isNull(), F.col(s)) for s in ("query", "target")})


def check_options(mode: str, engine: str, block_size: int | None, score_only: bool, band: int | None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    engines = {"edit-distance": ("auto", "blocks", "linear-space", "adaptive-banded", "fixed-banded", "myers", "myers-u64"), "global-affine": ("blocks", "wavefront", "auto")}.get(mode, ("blocks", "linear-space"))
    if engine not in engines:
        raise ValueError(f"{mode} has the engines {', '.join(engines)}")
    if block_size is not None and (block_size < 1 or engine != "blocks"):
        raise ValueError("block_size needs the blocks engine and must be 1 or more")
    if score_only and mode not in ("edit-distance", "lcs"):
        raise ValueError("score_only is for edit-distance and lcs")
    if engine.startswith("myers") and not score_only:
        raise ValueError(f"{engine} needs score_only")
    if band is not None and engine not in ("fixed-banded", "wavefront", "auto"):
        raise ValueError("band needs a banded engine")
    if engine == "fixed-banded" and band is None:
        raise ValueError("fixed-banded needs a band")


def align(pairs: DataFrame, mode: str = "edit-distance", scoring: Scoring | None = None, engine: str | None = None, block_size: int | None = None, band: int | None = None, score_only: bool = False, verify: bool = False, verify_limit: int = VERIFY_LIMIT, fail_fast: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One result row per pair: objective, coordinates, operations as a run-length string, re-score and verification.

    A pair that cannot be aligned keeps its row, with `error` set and status `failed`; with fail_fast the query fails
    instead. `score` is the objective of the scoring modes, `distance` of edit-distance. `path_score` is computed from the
    operations and the symbols they pair; `band` is the band that a banded engine needed; status is `full` if it equals the objective of an independent score kernel too, `path_only` if
    only the path was checked, `score_only` without a path, `failed` if anything disagrees. Columns named in keep pass
    through. The transform has no state, so pairs may also be a stream.
    """
    scoring = mode_scoring(mode, scoring or Scoring())
    engine = engine or ("auto" if mode == "edit-distance" else "blocks")
    check_options(mode, engine, block_size, score_only, band)
    df = validated(spread(pairs), scoring)
    if fail_fast:
        df = df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(None).cast("string")))
    query, target = F.col("query"), F.col("target")
    longest = F.greatest(F.length(query), F.length(target))
    wanted = F.lit(verify) & ((F.lit(verify_limit) == 0) | (longest <= verify_limit)) if verify else F.lit(False)
    df, block, backend = routed(df, mode, engine, block_size, band)
    df = df.withColumns({"block_size": block.cast("long"), "backend": backend, "__verify": wanted})
    sign = -1 if mode == "edit-distance" else 1
    if score_only:
        value = F.levenshtein(query, target).cast("long") if mode == "edit-distance" else score_column(mode, scoring, query, target)["score"]
        if engine == "myers-u64":
            value = bit_vector_distance(query, target).cast("long")
        elif engine == "fixed-banded":
            value = banded_distance(query, target, band).cast("long")
        df = df.withColumns({"__objective": value, "query_start": F.lit(0), "query_end": F.length(query), "target_start": F.lit(0), "target_end": F.length(target), "cigar": F.lit(""), "path_score": F.lit(None).cast("long")})
    else:
        limit = F.when(F.col("backend") == "wavefront", band if band is not None else AFFINE_BAND)
        if engine == "fixed-banded":
            limit = F.lit(band)
        df = df.withColumn("__trace", trace_column(mode, scoring, query, target, F.coalesce(F.when(F.col("backend") == "linear-space", 1), F.col("block_size").cast("int"), F.lit(0)), limit))
        df = df.withColumns({"__objective": F.when(F.col("__trace.cigar").isNotNull(), F.col("__trace.score") * sign)} | {c: F.col(f"__trace.{c}") for c in ("query_start", "query_end", "target_start", "target_end", "cigar")})
        df = df.withColumn("aligned_query", C.aligned(F.col("cigar"), query, F.col("query_start").cast("int"), "I")).withColumn("aligned_target", C.aligned(F.col("cigar"), target, F.col("target_start").cast("int"), "D"))
        df = df.withColumn("path_score", C.rescore(F.col("cigar"), query, target, [F.col(c).cast("int") for c in ("query_start", "query_end", "target_start", "target_end")], scoring, mode == "global-affine") * sign)
    used = {"adaptive-banded": final_band(query, target, F.col("__objective")), "fixed-banded": F.lit(band), "wavefront": F.lit(band if band is not None else AFFINE_BAND)}
    named = F.lit(None).cast("long")
    for name, value in used.items():
        named = F.when(F.col("backend") == name, value.cast("long")).otherwise(named)
    df = df.withColumn("band", F.when(F.col("__objective").isNotNull(), named))
    df = df.withColumn("error", F.coalesce("error", F.when(F.col("__objective").isNull(), F.lit("no alignment inside the band"))))
    return verified(df, mode, scoring, score_only, sign, verify, keep)


def routed(df: DataFrame, mode: str, engine: str, block_size: int | None, band: int | None) -> tuple[DataFrame, Column, Column]:
    """Block size and backend of each pair, decided before any kernel runs."""
    query, target = F.col("query"), F.col("target")
    none = F.lit(None).cast("string")
    if mode == "edit-distance" and engine == "auto":
        inside = within_auto_band(query, target)
        return df, F.when(inside, 0).otherwise(1), F.when(inside, "adaptive-banded").otherwise("linear-space")
    if engine in ("adaptive-banded", "fixed-banded", "myers", "myers-u64", "wavefront"):
        return df, F.lit(0), F.lit(engine)
    if mode == "global-affine" and engine == "auto":
        reach = F.abs(F.length(query) - F.length(target)) <= (band if band is not None else AFFINE_BAND)
        return df, F.when(reach, 0).otherwise(1), F.when(reach, "wavefront").otherwise("linear-space")
    if engine == "linear-space":
        return df, F.lit(1), F.lit(engine)
    return df, F.lit(block_size) if block_size else block_rows(query), none


def verified(df: DataFrame, mode: str, scoring: Scoring, score_only: bool, sign: int, verify: bool, keep: tuple[str, ...]) -> DataFrame:
    """Adds score or distance, verification_status and verified, and puts the columns in order."""
    objective, path = F.col("__objective"), F.col("path_score")
    baseline = F.lit(None).cast("long")
    if verify:
        gated = [F.when(F.col("__verify"), F.col(c)) for c in ("query", "target")]
        baseline = second_score_column(mode, scoring, *gated) * sign
    df = df.withColumn("__baseline", baseline)
    sound = F.lit(True) if score_only else path.eqNullSafe(objective)
    agrees = F.col("__baseline").isNull() | (F.col("__baseline") == objective)
    status = F.when(F.col("error").isNotNull() | ~sound | ~agrees, "failed").when(F.col("__baseline").isNotNull(), "full").otherwise("score_only" if score_only else "path_only")
    df = df.withColumn("verification_status", status).withColumn("verified", F.when(F.col("verification_status") == "full", True).when(F.col("verification_status") == "failed", False))
    none = F.lit(None).cast("long")
    distance = mode == "edit-distance"
    names = [c for c in ("aligned_query", "aligned_target") if c in df.columns]
    return df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "pair_index", "query_id", "target_id", F.lit(mode).alias("mode"),
        (none if distance else objective).alias("score"), (objective if distance else none).alias("distance"), "path_score", "verification_status", "verified",
        *[F.col(c).cast("long").alias(c) for c in ("query_start", "query_end", "target_start", "target_end")], "cigar", "backend", "block_size", "band",
        (C.total(F.col("cigar"), "=XDI") + F.lit(0 if score_only else 1)).alias("path_length"), *names, "error", "query_length", "target_length", "query", "target", *keep,
    )


def with_operations(aligned: DataFrame, detail: str = "full") -> DataFrame:
    """aligned with operation_counts (detail summary or full) and operations (full)."""
    if detail not in ("none", "summary", "full"):
        raise ValueError("detail must be none, summary or full")
    cigar = F.col("cigar")
    if detail != "none":
        aligned = aligned.withColumn("operation_counts", C.operation_counts(cigar))
    if detail == "full":
        aligned = aligned.withColumn("operations", C.operations(cigar, F.col("query"), F.col("target"), F.col("query_start").cast("int"), F.col("target_start").cast("int")))
    return aligned


def warp(pairs: DataFrame, query: str = "query", target: str = "target") -> DataFrame:
    """Dynamic time warping of two integer series per row: adds cost, path and path_cost (null for an empty series).

    path_cost sums the differences along the path with Spark functions, independent of the kernel.
    """

    @F.arrow_udf("struct<cost bigint, path array<struct<row int, col int>>>")
    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        some, both = sound_series(q, t)
        paths, costs = K.warp_paths(both), K.warp_costs(both)
        cells = np.concatenate([np.zeros((0, 2), np.int64), *paths])
        made = pa.StructArray.from_arrays([pa.array(cells[:, c], pa.int32()) for c in (0, 1)], ["row", "col"])
        off = np.concatenate(([0], np.cumsum([len(p) for p in paths], dtype=np.int64))).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(costs), pa.ListArray.from_arrays(pa.array(off), made)], ["cost", "path"])
        return placed(found, some, len(q))

    df = pairs.withColumn("__warp", run(F.col(query), F.col(target)))
    steps = F.slice("__warp.path", 2, F.greatest(F.size("__warp.path") - 1, F.lit(0)))
    cost = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + F.abs(F.element_at(F.col(query), s["row"]) - F.element_at(F.col(target), s["col"])))
    return df.withColumns({"cost": F.col("__warp.cost"), "path": F.col("__warp.path"), "path_cost": cost}).drop("__warp")


def warp_cost(query: Column, target: Column) -> Column:
    """Cost alone."""

    @F.arrow_udf("bigint")
    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        some, both = sound_series(q, t)
        return placed(pa.array(K.warp_costs(both)), some, len(q))

    return run(query, target)


def sound_series(query: pa.Array, target: pa.Array) -> tuple[np.ndarray, list]:
    """Rows in which neither series is null or empty, and their series."""
    some = np.flatnonzero([bool(q.is_valid and t.is_valid and len(q) and len(t)) for q, t in zip(query, target, strict=True)])
    return some, [(np.asarray(query[i].values, np.int64), np.asarray(target[i].values, np.int64)) for i in some.tolist()]


def placed(found: pa.Array, some: np.ndarray, rows: int) -> pa.Array:
    """found at the rows `some`, null elsewhere."""
    place = np.full(rows, -1)
    place[some] = np.arange(len(some))
    return found.take(pa.array(place, mask=place < 0))
