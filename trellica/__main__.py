"""Command for batches of pairs: python -m trellica MODE --query-file Q --target-file T --format paf --output PATH.

A Spark job like any other: files are read in splits, pairs aligned by the operators of this package and reports written by
the sink. The exit status is 0 if every record is sound, 1 if one failed, 2 if the command could not run.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.functions.certificate import certificate, parameters
from trellica.functions.runtime import ensure_checkpoint_dir, session
from trellica.functions.scoring import Scoring, blosum62, read_matrix
from trellica.operators.align import AFFINE_BAND, MODES, VERIFY_LIMIT, align, with_operations
from trellica.operators.seeding import DEFAULT_FLANK, DEFAULT_K, DEFAULT_WINDOW, align_seeded
from trellica.sources import sink
from trellica.sources.sequences import read_records, read_sequences, zip_pairs

SEEDED = "seeded-global-linear"
FORMATS = {"text": "text", "json": "document", "jsonl": "json", "tsv": "tsv", "cigar": "cigar", "paf": "paf", "sam": "sam"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("trellica", description=__doc__.split("\n")[0])
    out.add_argument("mode", choices=[*MODES, SEEDED])
    for side in ("query", "target"):
        one = out.add_mutually_exclusive_group(required=True)
        one.add_argument(f"--{side}", help="one sequence")
        one.add_argument(f"--{side}-file", help="a file or folder of FASTA, FASTQ or raw sequences")
    out.add_argument("--format", choices=list(FORMATS), default="text")
    out.add_argument("--output", help="folder of text files; without it lines go to standard output")
    out.add_argument("--show-alignment", action="store_true", help="with the aligned strings")
    out.add_argument("--operation-detail", choices=("none", "summary", "full"), default="summary")
    out.add_argument("--certificate", action="store_true", help="with hash certificates in JSON")
    out.add_argument("--verify", action="store_true", help="compare with a second recurrence")
    out.add_argument("--verify-limit", type=int, default=VERIFY_LIMIT, help="longest sequence that is verified; 0 for all")
    out.add_argument("--continue-on-error", action="store_true", help="keep failed pairs as records")
    out.add_argument("--engine")
    out.add_argument("--block-size", type=int)
    out.add_argument("--band", type=int, help=f"band of a banded engine; {AFFINE_BAND} for wavefront and auto of global-affine")
    out.add_argument("--score-only", action="store_true")
    plain = Scoring()
    for name, value in (("match", plain.match), ("mismatch-penalty", plain.mismatch), ("gap", plain.gap), ("gap-open", plain.gap_open), ("gap-extend", plain.gap_extend)):
        out.add_argument(f"--{name}", type=int, default=value)
    one = out.add_mutually_exclusive_group()
    one.add_argument("--matrix", choices=("blosum62",))
    one.add_argument("--matrix-file")
    for name, value in (("k", DEFAULT_K), ("window", DEFAULT_WINDOW), ("flank", DEFAULT_FLANK)):
        out.add_argument(f"--seed-{name}", type=int, default=value)
    return out


def results(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Result rows of the command's pairs, with the columns that its report shows."""
    side = lambda name: read_sequences(spark, inline=text, label=name) if (text := getattr(given, name)) is not None else read_records(spark, getattr(given, f"{name}_file"))
    pairs = zip_pairs(side("query"), side("target"))
    matrix, digest = blosum62() if given.matrix else None, None
    if given.matrix_file:
        matrix, digest = read_matrix(spark, path=given.matrix_file)
    scoring = Scoring(given.match, given.mismatch_penalty, given.gap, given.gap_open, given.gap_extend, matrix)
    options = {"engine": given.engine, "block_size": given.block_size, "verify": given.verify, "verify_limit": given.verify_limit}
    seeds = (given.seed_k, given.seed_window, given.seed_flank) if given.mode == SEEDED else None
    if seeds:
        if given.band is not None or given.score_only:
            raise ValueError(f"{SEEDED} has no band and needs a path")
        out = align_seeded(pairs, scoring, *seeds, **options)
        if not given.continue_on_error:
            out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(None).cast("string")))
    else:
        out = align(pairs, given.mode, scoring, band=given.band, score_only=given.score_only, fail_fast=not given.continue_on_error, **options)
    if given.certificate:
        out = out.withColumn("certificate", certificate(parameters("global-linear" if seeds else given.mode, scoring, digest, seeds)))
    if given.format in ("json", "jsonl") and not given.score_only:
        out = with_operations(out, given.operation_detail)
    return out if given.show_alignment else out.drop("aligned_query", "aligned_target")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit status of the command."""
    given = parser().parse_args(argv)
    try:
        spark = spark or session()
        out, form = results(spark, given), FORMATS[given.format]
        if given.output:
            return sink.exit_status(sink.write_report(out, given.output, form))
        ensure_checkpoint_dir(spark)
        held, seen = sink.observed(out)
        held = held.checkpoint()
        for row in sink.lines(held, form).orderBy("place").toLocalIterator():
            print(row["value"])
        return sink.exit_status(seen.get)
    except Exception as e:
        message = str(e).strip().splitlines() or [type(e).__name__]
        print(f"trellica: {message[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
