"""Named queries on result formats and the flagship query, with DuckDB equivalents where paths are unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.operators.align import align
from trellica.plans.align_queries import PARTS
from trellica.plans.pairs import item_pairs, part_pairs
from trellica.sources import reports


def sam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sam_header(part_pairs(spark, sf_dir).withColumn("target_length", F.length("target")))


def score_only_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that do not depend on a path, read back from the JSON lines."""
    lines = reports.json_lines(align(part_pairs(spark, sf_dir), "edit-distance", score_only=True))
    return lines.select("pair_index", F.get_json_object("value", "$.distance").cast("long").alias("distance"), F.get_json_object("value", "$.verification_status").alias("status"), F.get_json_object("value", "$.query_end").cast("long").alias("query_end"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts, reduced to printable ASCII (the mode compares bytes), against their neighbours: routed exact edit distance with path, re-score and verification."""
    out = align(item_pairs(spark, sf_dir), "edit-distance", verify=True)
    return out.select("pair_index", "query_id", "target_id", "distance", "path_score", "verification_status", "backend").orderBy("pair_index")


QUERIES = {f.__name__: f for f in (sam_header, score_only_json, flagship)}

ORACLES = {
    "sam_header": f"WITH {PARTS} SELECT -1 AS place, concat('@HD', chr(9), 'VN:1.6', chr(9), 'SO:unknown') AS value UNION ALL SELECT pair_index, concat('@SQ', chr(9), 'SN:', pair_index + 1, chr(9), 'LN:', length(t)) FROM p",
    "score_only_json": f"WITH {PARTS} SELECT pair_index, levenshtein(q, t) AS distance, 'score_only' AS status, length(q) AS query_end FROM p",
    "flagship": """WITH p AS (SELECT a.item_id AS pair_index, regexp_replace(a.text, '[^ -~]', '', 'g') AS q, regexp_replace(b.text, '[^ -~]', '', 'g') AS t FROM benchmark AS a JOIN benchmark AS b ON b.item_id = a.item_id + 1),
d AS (SELECT *, levenshtein(q, t) AS d, greatest(length(q), length(t)) AS m FROM p)
SELECT pair_index, CAST(pair_index AS VARCHAR) AS query_id, CAST(pair_index + 1 AS VARCHAR) AS target_id, d AS distance, d AS path_score, 'full' AS verification_status,
       CASE WHEN d <= least(greatest(abs(length(q) - length(t)), greatest(least(m // 32, 512), 8)), m) THEN 'adaptive-banded' ELSE 'linear-space' END AS backend FROM d""",
}
