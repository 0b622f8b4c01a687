"""Hash certificates: length-framed SHA-256 digests of inputs, traces and results, as Spark expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellica.functions.cigar import operations


def parameters(mode: str, scoring, matrix_sha256: str | None = None, seeding: tuple[int, int, int] | None = None) -> str:
    """Scoring parameters as compact JSON, tagged by kind; the text that parameters_sha256 digests."""
    if mode in ("edit-distance", "lcs"):
        return json.dumps({"kind": mode} | ({"substitution": 1, "insertion": 1, "deletion": 1} if mode == "edit-distance" else {}), separators=(",", ":"))
    pairs = {"type": "match-mismatch", "match_score": scoring.match, "mismatch_penalty": scoring.mismatch}
    if scoring.matrix is not None:
        pairs = {"type": "matrix", "name": scoring.matrix.name} | ({"source_sha256": matrix_sha256} if matrix_sha256 else {})
    if mode == "global-affine":
        return json.dumps({"kind": "affine", "substitution": pairs, "gap_open": scoring.gap_open, "gap_extend": scoring.gap_extend}, separators=(",", ":"))
    seeds = dict(zip(("seed_k", "seed_window", "seed_flank"), seeding, strict=True)) if seeding else {}
    return json.dumps({"kind": "seeded-linear" if seeding else "linear", "substitution": pairs, "gap": scoring.gap} | seeds, separators=(",", ":"))


def frame(value: Column) -> Column:
    """Byte length as eight little-endian bytes, then the bytes; a missing value is framed as <none>."""
    raw = F.encode(F.coalesce(value.cast("string"), F.lit("<none>")), "UTF-8")
    pairs = F.regexp_extract_all(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.concat(F.unhex(F.array_join(F.reverse(pairs), "")), raw)


def framed_sha256(*fields: Column) -> Column:
    """Hex digest of all fields in order; frames keep ('ab', 'c') and ('a', 'bc') apart."""
    return F.sha2(F.concat(*[frame(f) for f in fields]), 256)


def trace_sha256() -> Column:
    """Digest of the operations of a result row of align(), each with its place, positions and symbols; null without a path."""
    steps = operations(F.col("cigar"), F.col("query"), F.col("target"), F.col("query_start").cast("int"), F.col("target_start").cast("int"))
    told = lambda c: F.coalesce(c.cast("string"), F.lit("<none>"))
    line = lambda o, i: F.concat_ws("\t", told(i), *[told(o[f]) for f in ("op", "query_pos", "target_pos", "query_base", "target_base")])
    return F.when(F.col("path_score").isNotNull(), framed_sha256(F.size(steps), F.array_join(F.transform(steps, line), "\n")))


def certificate(settings_json: str) -> Column:
    """struct<query_sha256, target_sha256, parameters_sha256, trace_sha256, result_sha256, certificate_sha256> of a result
    row of align(). trace_sha256 is null where there is no path, as in score-only rows; the certificate then frames it as
    missing. Times are never hashed; the verification outcome is."""
    inputs = [F.sha2(F.coalesce(c, F.lit("")), 256) for c in ("query", "target")]
    settings, trace = F.sha2(F.lit(settings_json), 256), trace_sha256()
    spans = [F.col(c) for c in ("query_start", "query_end", "target_start", "target_end", "cigar", "path_length")]
    result = framed_sha256(F.col("mode"), F.coalesce("backend", F.lit("blocks")), F.col("score"), F.col("distance"), F.col("path_score"), F.col("verification_status"), F.col("verified"), F.col("block_size"), *spans, trace)
    names = ("query_sha256", "target_sha256", "parameters_sha256", "trace_sha256", "result_sha256")
    parts = [*inputs, settings, trace, result]
    return F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)], framed_sha256(*parts).alias("certificate_sha256"))
