"""Writers of alignment results: JSON lines, text, TSV, operation table, PAF and SAM lines as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellica.functions import cigar as C

#: Result fields that are left out when absent; all others are written as null.
OPTIONAL = ("backend", "band", "operation_counts", "operations", "certificate", "aligned_query", "aligned_target", "error")
#: Time columns of the tab-separated format; a Spark job has no time of its own for a record, so they are empty.
TIMES = ("summary_build_ms", "reconstruction_ms", "verification_ms", "elapsed_ms")
TSV_FIELDS = ("pair_index", "query_id", "target_id", "mode", "score", "distance", "path_score", "verification_status", "query_start", "query_end", "target_start", "target_end", "cigar", "block_size", "path_length", *TIMES)
CIGAR_FIELDS = ("pair_index", "query_id", "target_id", "mode", "score", "distance", "query_start", "query_end", "target_start", "target_end", "verification_status", "path_length", "cigar")


def plain(text: Column) -> Column:
    """Text with tabs and line ends as spaces; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\r", "   ")


def tabbed(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return df.select("pair_index", F.concat_ws("\t", *[plain(F.col(c) if c not in TIMES else F.lit(None)) for c in fields]).alias("value"))


def tsv(aligned: DataFrame) -> DataFrame:
    """(pair_index, value): one tab-separated line a pair; header() gives the first line."""
    return tabbed(aligned, TSV_FIELDS)


def cigar_table(aligned: DataFrame) -> DataFrame:
    return tabbed(aligned, CIGAR_FIELDS)


def header(fields: tuple[str, ...]) -> str:
    return "\t".join(fields)


def json_lines(aligned: DataFrame) -> DataFrame:
    """One JSON object a pair: required fields as null when absent, optional ones left out."""
    optional = [c for c in OPTIONAL if c in aligned.columns]
    required = [c for c in aligned.columns if c not in optional and c not in ("query", "target", "query_length", "target_length")]
    base = F.to_json(F.struct(*required), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(*optional)) if optional else F.lit("{}")
    joined = F.when(more == "{}", base).otherwise(F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))
    return aligned.select("pair_index", joined.alias("value"))


def json_document(aligned: DataFrame) -> DataFrame:
    """(place, value): the lines of one JSON document, an object for a single record and an array otherwise."""
    n, last = aligned.agg(F.count("*"), F.max("pair_index")).first()
    lines = json_lines(aligned).withColumnRenamed("pair_index", "place")
    if n == 1:
        return lines
    inner = lines.select("place", F.when(F.col("place") == last, F.col("value")).otherwise(F.concat("value", F.lit(","))).alias("value"))
    ends = aligned.sparkSession.createDataFrame([(-1, "["), ((-1 if last is None else last) + 1, "]")], "place long, value string")
    return inner.unionByName(ends)


def text(aligned: DataFrame) -> DataFrame:
    """Readable block of each pair, a field a line and an empty line after it; absent fields have no line."""
    said = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    checked = F.when(F.col("verified"), "true").when(~F.col("verified"), "false").otherwise("not_full")
    value = F.concat_ws(
        "\n",
        F.format_string("pair %d: %s vs %s", "pair_index", "query_id", "target_id"),
        *[said(c, c) for c in ("mode", "score", "distance", "backend", "path_score", "verification_status")],
        F.concat(F.lit("verified: "), checked),
        F.format_string("query: %s [%d..%d), target: %s [%d..%d)", "query_id", "query_start", "query_end", "target_id", "target_start", "target_end"),
        *[said(c, c) for c in ("cigar", "block_size", "path_length", "error", "aligned_query", "aligned_target") if c in aligned.columns],
        F.lit(""),
    )
    return aligned.select("pair_index", value.alias("value"))


def traced(aligned: DataFrame, name: str) -> DataFrame:
    """aligned, failing on records that a trace format cannot hold."""
    bad = F.when(F.col("error").isNotNull(), f"{name} cannot hold a failed record").when(F.col("path_score").isNull(), f"{name} needs a path; run without score_only")
    return aligned.withColumn("query_id", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("query_id")))


def tags(status: str) -> tuple[Column, Column, Column]:
    edits = F.coalesce("distance", C.stats(F.col("cigar"))["edit_ops"])
    return F.concat(F.lit("AS:i:"), F.col("score").cast("string")), F.concat(F.lit("NM:i:"), edits.cast("string")), F.concat(F.lit(status), "verification_status")


def paf(aligned: DataFrame) -> DataFrame:
    """(pair_index, value): PAF lines, with I for symbols of the query alone."""
    stats = C.stats(F.col("cigar"))
    score, edits, status = tags("vs:Z:")
    fields = [plain(F.col("query_id")), F.col("query_length"), F.col("query_start"), F.col("query_end"), F.lit("+"), plain(F.col("target_id")), F.col("target_length"), F.col("target_start"), F.col("target_end"), stats["matches"], stats["block_len"], F.lit("255")]
    more = [score, edits, F.concat(F.lit("cg:Z:"), C.swap_gaps(F.col("cigar"))), status, F.concat(F.lit("pi:i:"), F.col("pair_index").cast("string"))]
    return traced(aligned, "PAF").select("pair_index", F.concat_ws("\t", *[f.cast("string") for f in fields + more]).alias("value"))


def sam_header(aligned: DataFrame) -> DataFrame:
    """(place, value): version line and one reference line per target id, in order of first appearance.

    A target id with two lengths fails the query.
    """
    seen = aligned.groupBy("target_id").agg(F.min("pair_index").alias("place"), F.min("target_length").alias("low"), F.max("target_length").alias("high"))
    length = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.raise_error(F.lit("SAM needs one length for each target id")).cast("string"))
    lines = seen.select("place", F.concat(F.lit("@SQ\tSN:"), plain(F.col("target_id")), F.lit("\tLN:"), length).alias("value"))
    first = aligned.sparkSession.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit("@HD\tVN:1.6\tSO:unknown").alias("value"))
    return first.unionByName(lines)


def sam(aligned: DataFrame) -> DataFrame:
    """(pair_index, value): SAM body lines; write them after sam_header(), both ordered."""
    score, edits, status = tags("VS:Z:")
    ops = C.sam_cigar(F.col("cigar"), F.col("query_start"), F.col("query_end"), F.col("query_length"))
    sequence = F.coalesce(F.nullif(F.col("query"), F.lit("")), F.lit("*"))
    fields = [plain(F.col("query_id")), F.lit("0"), plain(F.col("target_id")), F.col("target_start") + 1, F.lit("255"), ops, F.lit("*"), F.lit("0"), F.lit("0"), sequence, F.lit("*")]
    more = [score, edits, status, F.concat(F.lit("PI:i:"), F.col("pair_index").cast("string"))]
    return traced(aligned, "SAM").select("pair_index", F.concat_ws("\t", *[f.cast("string") for f in fields + more]).alias("value"))


def write_lines(lines: DataFrame, path: str, order: str = "pair_index") -> None:
    """Text files whose lines follow the pair order across files."""
    lines.orderBy(order).select("value").write.text(path)


def all_sound(aligned: DataFrame) -> DataFrame:
    """(sound): true if no record failed, the exit status of a batch."""
    return aligned.agg(F.coalesce(F.bool_and(F.col("verification_status") != "failed"), F.lit(True)).alias("sound"))


def status_counts(results: DataFrame, status: str = "verification_status") -> DataFrame:
    """(status, n): how many results have each status."""
    return results.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
