"""Reports as files: guarded, ordered, header first, with the statuses of the batch from the job that computes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trellica.functions.runtime import ensure_checkpoint_dir
from trellica.sources import reports

STATUSES = ("full", "path_only", "score_only", "failed")
#: Formats whose records need a path and no error.
TRACED = ("paf", "sam")


def observed(aligned: DataFrame) -> tuple[DataFrame, Observation]:
    """aligned with the numbers of its statuses as metrics of whatever job reads it next."""
    seen = Observation()
    counts = [F.count_if(F.col("verification_status") == s).alias(s) for s in STATUSES]
    return aligned.observe(seen, *counts, F.count_if(F.col("path_score").isNull() & F.col("error").isNull()).alias("pathless")), seen


def exit_status(statuses: dict[str, int]) -> int:
    """0 if no record failed, else 1: what a batch command returns."""
    return int(statuses["failed"] > 0)


def lines(aligned: DataFrame, form: str) -> DataFrame:
    """(place, value): all lines of a report, header lines at places below 0."""
    made = {"tsv": reports.tsv, "cigar": reports.cigar_table, "text": reports.text, "json": reports.json_lines, "document": reports.json_document, "paf": reports.paf, "sam": reports.sam}
    if form not in made:
        raise ValueError(f"form must be one of {', '.join(made)}")
    if form == "document":
        return reports.json_document(aligned)
    body = made[form](aligned).select(F.col("pair_index").cast("long").alias("place"), "value")
    if form == "sam":
        head = reports.sam_header(aligned)
        first = F.when(F.col("place") < 0, F.lit(-(2**62))).otherwise(F.col("place") - 2**61)
        return head.select(first.cast("long").alias("place"), "value").unionByName(body)
    if form in ("tsv", "cigar"):
        fields = reports.TSV_FIELDS if form == "tsv" else reports.CIGAR_FIELDS
        return aligned.sparkSession.createDataFrame([(-1, reports.header(fields))], "place long, value string").unionByName(body)
    return body


def write_report(aligned: DataFrame, path: str, form: str = "tsv") -> dict[str, int]:
    """Write a report as text files in the order of pairs and return how many records have each status.

    The results are computed once, in the checkpoint folder; the statuses are metrics of that job. A form that needs paths
    refuses a batch with a failed or pathless record before any file exists, as it does a path that exists. Lines are
    sorted by ranges, so the files read in the order of their names are the report; Spark's committer publishes them
    together or not at all.
    """
    ensure_checkpoint_dir(aligned.sparkSession)
    if form != "document":
        lines(aligned, form)  # a wrong form fails before the work
    watched, seen = observed(aligned)
    held = watched.checkpoint()
    found = seen.get
    if form in TRACED and (found["failed"] or found["pathless"]):
        raise ValueError(f"{form} cannot hold {found['failed']} failed and {found['pathless']} pathless records")
    ordered = lines(held, form).repartitionByRange("place").sortWithinPartitions("place")
    ordered.select("value").write.mode("errorifexists").text(path)
    return {s: found[s] for s in STATUSES}
