"""Named queries whose results SQL can state exactly: pairs with one optimal path, formats, certificates, checks, inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellica.functions import cigar as C
from trellica.functions.certificate import certificate, parameters
from trellica.functions.runtime import scratch
from trellica.functions.scoring import Scoring
from trellica.operators import align as A
from trellica.operators import layered as L
from trellica.plans.align_queries import AFFINE, AFFINE_SQL, CLASSES, LAST, LINEAR, PARTS, linear_sql, simple
from trellica.plans.pairs import neighbours, part_pairs, table
from trellica.sources import reports, sequences, sink

NARROW, AFFINE_WIDTH = 32, 6


def edited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's description against itself, or against one with a ~ inserted, removed or put for a symbol, by key.

    Each of these pairs has exactly one optimal path, so whole output lines are determined.
    """
    base = F.upper(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    more = F.concat(F.substring("b", 1, 5), F.lit("~"), F.substring("b", 6, 2**31 - 1))
    other = F.concat(F.substring("b", 1, 5), F.lit("~"), F.substring("b", 7, 2**31 - 1))
    kind = F.col("pair_index") % 4
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pair_index"), base.alias("b"))
    return rows.select("pair_index", F.col("pair_index").cast("string").alias("query_id"), F.when(kind == 2, more).otherwise(F.col("b")).alias("query"), F.concat(F.lit("t"), "pair_index").alias("target_id"), F.when(kind == 1, more).when(kind == 3, other).otherwise(F.col("b")).alias("target"))


def edited(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return A.align(edited_pairs(spark, sf_dir), "edit-distance", **options)


def told(value: Column) -> Column:
    """A number, or -10**6 where there is none."""
    return F.coalesce(value, F.lit(-1000000)).cast("long")


def paf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.paf(edited(spark, sf_dir))


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sam(edited(spark, sf_dir))


def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tsv(edited(spark, sf_dir))


def cigar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cigar_table(edited(spark, sf_dir))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text(edited(spark, sf_dir))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_lines(A.with_operations(edited(spark, sf_dir), "summary"))


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's frame and, read back from its lines, the distances."""
    lines = reports.json_document(edited(spark, sf_dir))
    body = F.regexp_replace("value", ",$", "")
    return lines.select("place", F.substring("value", 1, 1).alias("opens"), F.col("value").endswith(",").alias("goes_on"), told(F.get_json_object(body, "$.distance").cast("long")).alias("distance"))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir).select("pair_index", certificate(parameters("edit-distance", LINEAR)).alias("c")).select("pair_index", "c.*")


def score_only_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.align(part_pairs(spark, sf_dir), "edit-distance", score_only=True, engine="myers")
    return out.select("pair_index", certificate(parameters("edit-distance", LINEAR)).alias("c")).select("pair_index", "c.*")


def lcs_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.align(edited_pairs(spark, sf_dir), "lcs")
    return out.select("pair_index", "score", C.common_subsequence(F.col("cigar"), F.col("query"), F.col("query_start").cast("int")).alias("common"))


def path_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every path with its symbols."""
    out = A.with_operations(edited(spark, sf_dir))
    return out.select("pair_index", F.posexplode("operations").alias("step", "o")).select("pair_index", "step", "o.op", told(F.col("o.query_pos")).alias("query_pos"), told(F.col("o.target_pos")).alias("target_pos"), F.coalesce("o.query_base", F.lit("")).alias("query_base"), F.coalesce("o.target_base", F.lit("")).alias("target_base"))


def adaptive_band_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.align(part_pairs(spark, sf_dir), "edit-distance", engine="adaptive-banded", verify=True)
    return out.select("pair_index", "distance", "path_score", "band", "backend", "verification_status")


def fixed_band_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.align(part_pairs(spark, sf_dir), "edit-distance", engine="fixed-banded", band=NARROW)
    return out.select("pair_index", told(F.col("path_score")).alias("path_score"), told(F.col("band")).alias("band"), "verification_status", F.coalesce("error", F.lit("")).alias("error"))


def affine_band_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.align(part_pairs(spark, sf_dir), "global-affine", AFFINE, engine="wavefront", band=AFFINE_WIDTH)
    return out.select("pair_index", told(F.col("score")).alias("score"), told(F.col("path_score")).alias("path_score"), "verification_status")


def affine_auto_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.align(part_pairs(spark, sf_dir), "global-affine", AFFINE, engine="auto", verify=True)
    return out.select("pair_index", "path_score", "backend", "verification_status")


def lcs_bit_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("query"), F.col("target")
    long = F.when(F.col("pair_index") % 5 == 0, F.repeat(t, 4)).otherwise(t)
    return part_pairs(spark, sf_dir).select("pair_index", told(A.lcs_bit_length(q, long)).alias("length"))


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of whole, unreduced document texts end in each status; symbols outside ASCII fail a pair."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat("text", F.when(F.col("item_id") % 3 == 0, "é").otherwise("")).alias("seq"))
    out = A.align(neighbours(rows), "edit-distance", score_only=True, verify=True)
    return reports.status_counts(out).withColumn("sound", F.bool_and(F.col("status") != "failed").over(Window.partitionBy()))


def input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of pairs that cannot be aligned: missing sequences, symbols outside ASCII or outside a matrix."""
    kind = F.col("pair_index") % 4
    pairs = part_pairs(spark, sf_dir)
    pairs = pairs.withColumn("query", F.when(kind == 0, F.lit(None)).when(kind == 1, "É").otherwise("AB")).withColumn("target", F.when(kind == 2, "A1").otherwise("AB"))
    out = A.align(pairs, "global-linear", Scoring(gap=-4, matrix=CLASSES))
    return out.select("pair_index", F.coalesce("error", F.lit("")).alias("error"), "verification_status", told(F.col("score")).alias("score"))


def viterbi_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no decoder can take, made from customers by their key."""
    kind = F.col("c_custkey") % 5
    ints = lambda *x: F.array(*[F.lit(v) for v in x])
    initial = F.when(kind == 1, F.array().cast("array<int>")).otherwise(ints(0, -1))
    transitions = F.when(kind == 2, F.array(ints(0, 1))).otherwise(F.array(ints(0, 1), ints(1, 0)))
    emissions = F.when(kind == 3, F.array().cast("array<array<int>>")).when(kind == 4, F.array(ints(1, 2), ints(1))).otherwise(F.array(ints(1, 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(L.viterbi_problems(initial, transitions, emissions), "; ").alias("problems"))


def raw_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name as a raw file, wrapped, parsed again."""
    files = table(spark, sf_dir, "part").select(F.format_string("in/part.%d.txt", "p_partkey").alias("source"), F.concat(F.lit("\n "), F.regexp_replace("p_name", " ", "\r\n"), F.lit("\t")).alias("text"))
    return sequences.parse(files).select("source", F.col("idx").cast("long").alias("idx"), "id", "seq")


def zip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand against parts by size, each side in several FASTA files, paired in the order of files and records."""

    def side(by: str) -> DataFrame:
        record = F.concat(F.lit(">"), F.col("p_partkey"), F.lit("\n"), "p_name")
        return sequences.read_fasta(spark, record_files(table(spark, sf_dir, "part"), by, "p_partkey", record))

    return sequences.zip_pairs(side("p_brand"), side("p_size")).select("pair_index", "query_id", "target_id", "query", "target")


def sam_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of a description inside a longer query, whose ends the SAM line clips."""
    pairs = edited_pairs(spark, sf_dir).where("query = target").withColumn("query", F.concat(F.repeat(F.lit("~"), F.pmod("pair_index", F.lit(3)).cast("int")), "query", F.lit("^^")))
    return reports.sam(A.align(pairs, "local-linear", Scoring()))


def dag_shape_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps graphs from being layered: one graph a supplier, its shape by the key."""
    kind = F.col("s_suppkey") % 6
    ints = lambda *x: F.array(*[F.lit(v) for v in x])
    widths = F.when(kind == 1, ints(3)).when(kind == 2, ints(2, 0, 2)).when(kind == 3, F.array().cast("array<int>")).otherwise(ints(2, 3, 2))
    graphs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dag_id"), widths.alias("widths"), F.when(kind == 4, 2).otherwise(0).alias("start"), F.when(kind == 5, -1).otherwise(1).alias("end"))
    edges = graphs.select("dag_id", F.lit(0).alias("layer"), F.lit(1).alias("from"), F.lit(1).alias("to"))
    return L.dag_problems(edges, graphs)


def written(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Lines of a report that was written to files and read again."""
    path = scratch(spark, form)
    sink.write_report(edited(spark, sf_dir), path, form)
    return spark.read.text(path)


def paf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "paf")


def sam_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "sam")


def tsv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "tsv")


def record_files(rows: DataFrame, key: str, order: str, record: Column) -> str:
    """Folder of one text file for each key, written by Spark in the order of another column."""
    path = scratch(rows.sparkSession, "records")
    rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("__order"), record.alias("value")).repartition("key").sortWithinPartitions("key", "__order").select("key", "value").write.partitionBy("key").text(path)
    return path


def read_back(records: DataFrame) -> DataFrame:
    return records.select(F.regexp_extract("source", "key=([^/]*)/", 1).alias("source"), F.col("idx").cast("long").alias("idx"), "id", "seq")


def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers in one FASTQ file a nation, read in splits."""
    record = F.concat(F.lit("@"), F.col("s_suppkey"), F.lit("\n"), F.lower("s_name"), F.lit("\r\n+\nIIII\n"))
    return read_back(sequences.read_fastq(spark, record_files(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", record)))


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in one FASTA file a size, read in splits."""
    record = F.concat(F.lit(">"), F.col("p_partkey"), F.lit(" "), F.col("p_type"), F.lit("\n"), F.regexp_replace("p_name", " ", "\n"))
    return read_back(sequences.read_fasta(spark, record_files(table(spark, sf_dir, "part"), "p_size", "p_partkey", record)))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in one file a nation: FASTA, FASTQ or raw by the nation's number, found by the files' first symbols."""
    kind = F.col("c_nationkey") % 3
    record = F.when(kind == 0, F.concat(F.lit(">"), "c_custkey", F.lit("\n"), "c_name")).when(kind == 1, F.concat(F.lit("@"), "c_custkey", F.lit("\n"), "c_name", F.lit("\n+\n!"))).otherwise(F.col("c_name"))
    found = read_back(sequences.read_records(spark, record_files(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", record)))
    return found.withColumn("id", F.when(F.col("source").cast("int") % 3 == 2, "raw").otherwise(F.col("id")))


QUERIES = {f.__name__: f for f in (paf_lines, sam_lines, tsv_lines, cigar_lines, text_blocks, json_lines, json_document, certificates, score_only_certificates, lcs_subsequence, path_cells, adaptive_band_path, fixed_band_path, affine_band_path, affine_auto_path, lcs_bit_len, batch_status, input_errors, viterbi_checks, raw_parse, zip_records, sam_clips, dag_shape_problems, paf_files, sam_files, tsv_files, fastq_files, fasta_files, mixed_files)}

EDITED = """b AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, upper(concat_ws(' ', p_name, p_brand, p_type)) AS b FROM part),
e AS (SELECT k, kind, length(b) AS n, CASE WHEN kind = 2 THEN concat(substr(b, 1, 5), '~', substr(b, 6)) ELSE b END AS q,
       CASE kind WHEN 1 THEN concat(substr(b, 1, 5), '~', substr(b, 6)) WHEN 3 THEN concat(substr(b, 1, 5), '~', substr(b, 7)) ELSE b END AS t,
       CASE kind WHEN 0 THEN concat(length(b), '=') WHEN 3 THEN concat('5=1X', length(b) - 6, '=') ELSE concat('5=1', substr('ID', kind, 1), length(b) - 5, '=') END AS c,
       CASE kind WHEN 0 THEN concat(length(b), '=') WHEN 3 THEN concat('5=1X', length(b) - 6, '=') ELSE concat('5=1', substr('DI', kind, 1), length(b) - 5, '=') END AS swapped,
       CASE WHEN kind = 0 THEN 0 ELSE 1 END AS d, length(b) + CASE WHEN kind IN (1, 2) THEN 1 ELSE 0 END AS steps FROM b)"""
TAB = "chr(9)"


def line(*fields: str) -> str:
    return f"concat_ws({TAB}, {', '.join(fields)})"


def framed(*fields: str) -> str:
    """Digest of length-framed fields; lengths under 65,536."""
    one = lambda x: f"unhex(format('{{:02x}}{{:02x}}000000000000', octet_length(encode({x})) % 256, octet_length(encode({x})) // 256)) || encode({x})"
    return "sha256(" + " || ".join(one(x) for x in fields) + ")"


def certificate_sql(query: str, target: str, trace: str, result: list[str], source: str) -> str:
    settings = "'" + parameters("edit-distance", LINEAR) + "'"
    return f"""{source}, g AS (SELECT *, sha256({query}) AS query_sha256, sha256({target}) AS target_sha256, sha256({settings}) AS parameters_sha256, CAST({trace} AS VARCHAR) AS trace_sha256 FROM x),
h AS (SELECT pair_index, query_sha256, target_sha256, parameters_sha256, trace_sha256, {framed(*result)} AS result_sha256 FROM g)
SELECT *, {framed("query_sha256", "target_sha256", "parameters_sha256", "coalesce(trace_sha256, '<none>')", "result_sha256")} AS certificate_sha256 FROM h"""


_COMMON = ("k", "k", "concat('t', k)")
_SPAN = ("0", "length(q)", "0", "length(t)")
_SAYS = lambda x: f"CAST({x} AS VARCHAR)"
_GAPPED = ("CASE WHEN kind = 1 THEN concat(substr(q, 1, 5), '-', substr(q, 6)) ELSE q END", "CASE WHEN kind = 2 THEN concat(substr(t, 1, 5), '-', substr(t, 6)) ELSE t END")
_JSON = """concat('{"schema_version":"', 'SCHEMA', '","pair_index":', k, ',"query_id":"', k, '","target_id":"t', k, '","mode":"edit-distance","score":null,"distance":', d, ',"path_score":', d,
 ',"verification_status":"path_only","verified":null,"query_start":0,"query_end":', length(q), ',"target_start":0,"target_end":', length(t), ',"cigar":"', c, '","block_size":0,"path_length":', steps + 1,
 ',"backend":"adaptive-banded","band":', CASE WHEN kind IN (1, 2, 3) THEN 1 ELSE 0 END, ',"operation_counts":[{"op":"match","count":', n - CASE WHEN kind = 3 THEN 1 ELSE 0 END, '}', CASE kind WHEN 1 THEN ',{"op":"insert","count":1}' WHEN 2 THEN ',{"op":"delete","count":1}' WHEN 3 THEN ',{"op":"mismatch","count":1}' ELSE '' END,
 '],"aligned_query":"', CASE WHEN kind = 1 THEN concat(substr(q, 1, 5), '-', substr(q, 6)) ELSE q END, '","aligned_target":"', CASE WHEN kind = 2 THEN concat(substr(t, 1, 5), '-', substr(t, 6)) ELSE t END, '"}')""".replace("SCHEMA", A.SCHEMA_VERSION)
_BANDED = AFFINE_SQL.replace("CASE WHEN j = 0 THEN", f"CASE WHEN j > {AFFINE_WIDTH} THEN [-1000000, -1000000, -1000000] WHEN j = 0 THEN").replace("list_append(acc, [list_max", f"list_append(acc, CASE WHEN abs(i + 1 - j[1][1]) > {AFFINE_WIDTH} THEN [CAST(-1000000 AS BIGINT), -1000000, -1000000] ELSE [list_max").replace("greatest(acc[len(acc)][1] - 4, acc[len(acc)][3] - 1)]),", "greatest(acc[len(acc)][1] - 4, acc[len(acc)][3] - 1)] END),").replace("[[CAST(-1000000 AS BIGINT), greatest(h[1][1] - 4, h[1][2] - 1), -1000000]]", f"[[CAST(-1000000 AS BIGINT), CASE WHEN i + 1 > {AFFINE_WIDTH} THEN -1000000 ELSE greatest(h[1][1] - 4, h[1][2] - 1) END, -1000000]]")
_BANDED = "SELECT pair_index, CASE WHEN s > -500000 THEN s ELSE -1000000 END AS score, CASE WHEN s > -500000 THEN s ELSE -1000000 END AS path_score, CASE WHEN s > -500000 THEN 'path_only' ELSE 'failed' END AS verification_status FROM (" + _BANDED % "s" + ")"

#: Every step of the paths of edited pairs.
_STEPS = """s AS (SELECT *, unnest(range(steps)) AS step FROM e),
o AS (SELECT *, CASE WHEN step = 5 THEN ['match', 'insert', 'delete', 'mismatch'][kind + 1] ELSE 'match' END AS op, step - CASE WHEN kind = 1 AND step > 5 THEN 1 ELSE 0 END AS a, step - CASE WHEN kind = 2 AND step > 5 THEN 1 ELSE 0 END AS z FROM s)"""
_STEP = "concat_ws(chr(9), step, op, CASE WHEN op <> 'insert' THEN CAST(a AS VARCHAR) ELSE '<none>' END, CASE WHEN op <> 'delete' THEN CAST(z AS VARCHAR) ELSE '<none>' END, CASE WHEN op <> 'insert' THEN q[a + 1] ELSE '<none>' END, CASE WHEN op <> 'delete' THEN t[z + 1] ELSE '<none>' END)"
_TRACED = f"WITH {EDITED}, {_STEPS}, x AS (SELECT k AS pair_index, any_value(q) AS q, any_value(t) AS t, any_value(c) AS c, any_value(d) AS d, any_value(steps) AS steps, string_agg({_STEP}, chr(10) ORDER BY step) AS trace FROM o GROUP BY k)"

ORACLES = {
    "paf_lines": f"WITH {EDITED} SELECT k AS pair_index, " + line("k", "length(q)", "0", "length(q)", "'+'", "concat('t', k)", "length(t)", "0", "length(t)", "n - CASE WHEN kind = 3 THEN 1 ELSE 0 END", "steps", "255", "concat('NM:i:', d)", "concat('cg:Z:', swapped)", "'vs:Z:path_only'", "concat('pi:i:', k)") + " AS value FROM e",
    "sam_lines": f"WITH {EDITED} SELECT k AS pair_index, " + line("k", "0", "concat('t', k)", "1", "255", "swapped", "'*'", "0", "0", "q", "'*'", "concat('NM:i:', d)", "'VS:Z:path_only'", "concat('PI:i:', k)") + " AS value FROM e",
    "tsv_lines": f"WITH {EDITED} SELECT k AS pair_index, " + line(*_COMMON, "'edit-distance'", "''", "d", "d", "'path_only'", *_SPAN, "c", "0", "steps + 1", *["''"] * 4) + " AS value FROM e",
    "cigar_lines": f"WITH {EDITED} SELECT k AS pair_index, " + line(*_COMMON, "'edit-distance'", "''", "d", *_SPAN, "'path_only'", "steps + 1", "c") + " AS value FROM e",
    "text_blocks": f"""WITH {EDITED} SELECT k AS pair_index, concat_ws(chr(10), concat('pair ', k, ': ', k, ' vs t', k), 'mode: edit-distance', concat('distance: ', d), 'backend: adaptive-banded', concat('path_score: ', d),
  'verification_status: path_only', 'verified: not_full', concat('query: ', k, ' [0..', length(q), '), target: t', k, ' [0..', length(t), ')'), concat('cigar: ', c), 'block_size: 0', concat('path_length: ', steps + 1),
  concat('aligned_query: ', {_GAPPED[0]}), concat('aligned_target: ', {_GAPPED[1]}), '') AS value FROM e""",
    "json_lines": f"WITH {EDITED} SELECT k AS pair_index, {_JSON} AS value FROM e",
    "json_document": f"WITH {EDITED} SELECT k AS place, '{{' AS opens, k < max(k) OVER () AS goes_on, CAST(d AS BIGINT) AS distance FROM e UNION ALL SELECT -1, '[', false, -1000000 UNION ALL SELECT max(k) + 1, ']', false, -1000000 FROM e",
    "certificates": certificate_sql("q", "t", framed("CAST(steps AS VARCHAR)", "trace"), ["'edit-distance'", "'adaptive-banded'", "'<none>'", _SAYS("d"), _SAYS("d"), "'path_only'", "'<none>'", "'0'", *[_SAYS(x) for x in (*_SPAN, "c", "steps + 1")], "trace_sha256"], _TRACED),
    "score_only_certificates": certificate_sql("q", "t", "NULL", ["'edit-distance'", "'myers'", "'<none>'", _SAYS("levenshtein(q, t)"), "'<none>'", "'score_only'", "'<none>'", "'0'", *[_SAYS(x) for x in _SPAN], "''", "'0'", "'<none>'"], f"WITH {PARTS}, x AS (SELECT * FROM p)"),
    "lcs_subsequence": f"WITH {EDITED} SELECT k AS pair_index, n - CASE WHEN kind = 3 THEN 1 ELSE 0 END AS score, CASE kind WHEN 2 THEN t WHEN 3 THEN concat(substr(q, 1, 5), substr(q, 7)) ELSE q END AS common FROM e",
    "path_cells": f"WITH {EDITED}, {_STEPS} SELECT k AS pair_index, step, op, CASE WHEN op <> 'insert' THEN a ELSE -1000000 END AS query_pos, CASE WHEN op <> 'delete' THEN z ELSE -1000000 END AS target_pos, CASE WHEN op <> 'insert' THEN q[a + 1] ELSE '' END AS query_base, CASE WHEN op <> 'delete' THEN t[z + 1] ELSE '' END AS target_base FROM o",
    "adaptive_band_path": f"""WITH RECURSIVE {PARTS}, d AS (SELECT *, levenshtein(q, t) AS d, abs(length(q) - length(t)) AS low, greatest(length(q), length(t)) AS m FROM p),
g AS (SELECT pair_index, d, m, low AS b FROM d UNION ALL SELECT pair_index, d, m, least(2 * b + 1, m) FROM g WHERE b < d)
SELECT pair_index, d AS distance, d AS path_score, max(b) AS band, 'adaptive-banded' AS backend, CASE WHEN m <= {A.VERIFY_LIMIT} THEN 'full' ELSE 'path_only' END AS verification_status FROM g GROUP BY pair_index, d, m""",
    "fixed_band_path": f"WITH {PARTS}, d AS (SELECT *, levenshtein(q, t) AS d FROM p) SELECT pair_index, CASE WHEN d <= {NARROW} THEN d ELSE -1000000 END AS path_score, CASE WHEN d <= {NARROW} THEN {NARROW} ELSE -1000000 END AS band, CASE WHEN d <= {NARROW} THEN 'path_only' ELSE 'failed' END AS verification_status, CASE WHEN d > {NARROW} THEN 'no alignment inside the band' ELSE '' END AS error FROM d",
    "affine_band_path": _BANDED,
    "affine_auto_path": "SELECT pair_index, path_score, 'wavefront' AS backend, 'full' AS verification_status FROM (" + AFFINE_SQL % "path_score" + ")",
    "lcs_bit_len": "SELECT pair_index, CASE WHEN length(t) <= 128 THEN n ELSE -1000000 END AS length FROM (" + linear_sql(simple(1, 1000000), 0, "t, " + LAST + "n", PARTS.replace("AS t FROM", "AS t0 FROM").replace("p AS (SELECT a.p", "p0 AS (SELECT a.p") + ", p AS (SELECT pair_index, q, CASE WHEN pair_index % 5 = 0 THEN repeat(t0, 4) ELSE t0 END AS t FROM p0)") + ")",
    "batch_status": """WITH p AS (SELECT concat(a.text, CASE WHEN a.item_id % 3 = 0 THEN 'é' ELSE '' END) AS q, concat(b.text, CASE WHEN b.item_id % 3 = 0 THEN 'é' ELSE '' END) AS t FROM benchmark AS a JOIN benchmark AS b ON b.item_id = a.item_id + 1),
s AS (SELECT CASE WHEN octet_length(encode(q)) > length(q) OR octet_length(encode(t)) > length(t) THEN 'failed' WHEN greatest(length(q), length(t)) <= 2048 THEN 'full' ELSE 'score_only' END AS status FROM p)
SELECT status, count(*) AS n, (SELECT bool_and(status <> 'failed') FROM s) AS sound FROM s GROUP BY status""",
    "input_errors": f"""WITH {PARTS} SELECT pair_index, CASE pair_index % 4 WHEN 0 THEN concat('query ', pair_index, ': no sequence') WHEN 1 THEN concat('query ', pair_index, ': not ASCII') WHEN 2 THEN concat('target ', pair_index + 1, ': symbol outside matrix classes') ELSE '' END AS error,
CASE WHEN pair_index % 4 = 3 THEN 'path_only' ELSE 'failed' END AS verification_status, CASE WHEN pair_index % 4 = 3 THEN 8 ELSE -1000000 END AS score FROM p""",
    "viterbi_checks": "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'no state; transitions are not square over the states; an observation lacks a score for each state' WHEN 2 THEN 'transitions are not square over the states' WHEN 3 THEN 'no observation' WHEN 4 THEN 'an observation lacks a score for each state' ELSE '' END AS problems FROM customer",
    "raw_parse": "SELECT format('in/part.{}.txt', p_partkey) AS source, 0 AS idx, format('part.{}', p_partkey) AS id, upper(replace(p_name, ' ', '')) AS seq FROM part",
    "zip_records": """WITH a AS (SELECT row_number() OVER (ORDER BY concat(p_brand, '.fa'), p_partkey) - 1 AS i, p_partkey AS k, upper(replace(p_name, ' ', '')) AS s FROM part),
b AS (SELECT row_number() OVER (ORDER BY concat(p_size, '.fa'), p_partkey) - 1 AS i, p_partkey AS k, upper(replace(p_name, ' ', '')) AS s FROM part)
SELECT a.i AS pair_index, CAST(a.k AS VARCHAR) AS query_id, CAST(b.k AS VARCHAR) AS target_id, a.s AS query, b.s AS target FROM a JOIN b ON a.i = b.i""",
    "sam_clips": f"WITH {EDITED} SELECT k AS pair_index, " + line("k", "0", "concat('t', k)", "1", "255", "concat(CASE WHEN k % 3 > 0 THEN concat(k % 3, 'S') ELSE '' END, n, '=2S')", "'*'", "0", "0", "concat(repeat('~', k % 3), q, '^^')", "'*'", "concat('AS:i:', 2 * n)", "'NM:i:0'", "'VS:Z:path_only'", "concat('PI:i:', k)") + " AS value FROM e WHERE kind = 0",
    "dag_shape_problems": """SELECT s_suppkey AS dag_id, unnest(CASE s_suppkey % 6 WHEN 1 THEN ['needs two layers or more', 'edge outside its layers'] WHEN 2 THEN ['a layer is empty', 'edge outside its layers'] WHEN 3 THEN ['needs two layers or more', 'edge outside its layers']
  WHEN 4 THEN ['start outside the first layer'] WHEN 5 THEN ['end outside the last layer'] ELSE [] END) AS problem FROM supplier""",
    "fastq_files": "SELECT CAST(s_nationkey AS VARCHAR) AS source, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx, CAST(s_suppkey AS VARCHAR) AS id, upper(s_name) AS seq FROM supplier",
    "fasta_files": "SELECT CAST(p_size AS VARCHAR) AS source, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS idx, CAST(p_partkey AS VARCHAR) AS id, upper(replace(p_name, ' ', '')) AS seq FROM part",
    "mixed_files": """SELECT CAST(c_nationkey AS VARCHAR) AS source, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS seq FROM customer WHERE c_nationkey % 3 < 2
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 0, 'raw', upper(string_agg(c_name, '' ORDER BY c_custkey)) FROM customer WHERE c_nationkey % 3 = 2 GROUP BY c_nationkey""",
}
ORACLES["paf_files"] = f"SELECT value FROM ({ORACLES['paf_lines']})"
ORACLES["sam_files"] = f"SELECT value FROM ({ORACLES['sam_lines']}) UNION ALL SELECT concat('@HD', {TAB}, 'VN:1.6', {TAB}, 'SO:unknown') UNION ALL SELECT * FROM (WITH {EDITED} SELECT concat('@SQ', {TAB}, 'SN:t', k, {TAB}, 'LN:', length(t)) FROM e)"
ORACLES["tsv_files"] = f"SELECT value FROM ({ORACLES['tsv_lines']}) UNION ALL SELECT '{reports.header(reports.TSV_FIELDS)}'"
