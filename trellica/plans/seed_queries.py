"""Named queries on seeding and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.functions.scoring import Scoring
from trellica.operators import seeding as S
from trellica.plans.align_queries import PARTS, linear_sql, simple
from trellica.plans.pairs import part_pairs, table

K, WINDOW, FLANK = 4, 3, 2


def kmer_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("text"))
    return S.kmers(rows, "p_partkey", "text", K).select("p_partkey", "pos", S.fnv1a(F.col("kmer")).alias("hash"))


def minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minimizers(part_pairs(spark, sf_dir), "pair_index", "query", K, WINDOW)


def minimizer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minimizer_hits(part_pairs(spark, sf_dir), K, WINDOW)


def seed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = S.seed_chain(S.minimizer_hits(part_pairs(spark, sf_dir), K, WINDOW))
    return chain.select("pair_index", F.size("chain").cast("long").alias("seeds"))


def seeded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of every pair, null where query and target share no seed."""
    out = S.seeded_windows(part_pairs(spark, sf_dir), K, WINDOW, FLANK)
    return out.select("pair_index", F.col("chain").isNotNull().alias("seeded"), *[F.col(f"{s}_{e}").cast("long").alias(f"{s}_{e}") for s in ("query", "target") for e in ("from", "to")])


def seeded_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every pair inside its window; the score recomputed from its path must be the optimum."""
    out = S.align_seeded(part_pairs(spark, sf_dir), Scoring(), K, WINDOW, FLANK, verify=True)
    return out.select("pair_index", "score", "path_score", "verification_status", *[F.col(f"{s}_{e}").cast("long").alias(f"{s}_{e}") for s in ("query", "target") for e in ("start", "end")], "error")


QUERIES = {f.__name__: f for f in (kmer_hashes, minimizers, minimizer_hits, seed_chain, seeded_windows, seeded_global)}

FNV = "CAST(list_reduce(list_transform(range(1, {k} + 1), lambda j: CAST(ascii(s[j]) AS UHUGEINT)), lambda h, c: (CASE WHEN h >= 256 THEN xor(h, c) ELSE xor(h, c) END * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS HUGEINT)".format(k=K)
HASHED = """k AS (SELECT id, side, n, pos, s, {fnv} AS h FROM (SELECT id, side, length(text) - {k} + 1 AS n, unnest(range(0, length(text) - {k} + 1)) AS pos, text FROM x WHERE length(text) >= {k}) AS e, LATERAL (SELECT substr(e.text, e.pos + 1, {k}) AS s)),
w AS (SELECT id, side, pos AS place, n, arg_min(struct_pack(h := h, p := pos, s := s), struct_pack(h := h, p := pos)) OVER (PARTITION BY id, side ORDER BY pos ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING) AS m FROM k),
z AS (SELECT id, side, m.p AS pos, m.h AS h, m.s AS kmer, lag(m.p) OVER (PARTITION BY id, side ORDER BY place) AS before FROM w WHERE place <= greatest(n - {window}, 0)),
mini AS (SELECT id, side, pos, CAST(h - 9223372036854775808::HUGEINT AS BIGINT) AS hash, kmer FROM z WHERE before IS NULL OR before <> pos)""".format(fnv=FNV, k=K, window=WINDOW, last=WINDOW - 1)
BOTH = f"WITH RECURSIVE {PARTS}, x AS (SELECT pair_index AS id, 'q' AS side, q AS text FROM p UNION ALL SELECT pair_index, 't', t FROM p), {HASHED}"
HITS = BOTH + f", hits AS (SELECT DISTINCT a.id AS pair_index, a.pos AS query_pos, b.pos AS target_pos, {K} AS length FROM mini AS a JOIN mini AS b ON a.id = b.id AND a.side = 'q' AND b.side = 't' AND a.hash = b.hash AND a.kmer = b.kmer)"
#: The earliest longest chain of each pair, by one list of lengths and of first hits, and the window around it.
WINDOWS = HITS + f""", l AS (SELECT pair_index, list(query_pos ORDER BY query_pos, target_pos) AS a, list(target_pos ORDER BY query_pos, target_pos) AS b FROM hits GROUP BY pair_index),
c AS (SELECT pair_index, a, b, 1 AS i, [CAST(1 AS BIGINT)] AS n, [CAST(1 AS BIGINT)] AS head FROM l
  UNION ALL SELECT pair_index, a, b, i + 1, list_append(n, list_max(fit) + 1), list_append(head, CASE WHEN list_max(fit) = 0 THEN i + 1 ELSE head[list_position(fit, list_max(fit))] END)
  FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN a[j] < a[i + 1] AND b[j] < b[i + 1] THEN n[j] ELSE 0 END) AS fit FROM c WHERE i < len(a))),
e AS (SELECT pair_index, a, b, head, list_position(n, list_max(n)) AS e FROM c WHERE i = len(a)),
spans AS (SELECT p.pair_index, q, t, greatest(0, a[head[e]] - {FLANK}) AS query_from, least(length(q), a[e] + {K + FLANK}) AS query_to,
             greatest(0, b[head[e]] - {FLANK}) AS target_from, least(length(t), b[e] + {K + FLANK}) AS target_to FROM e JOIN p ON p.pair_index = e.pair_index)"""
INSIDE = linear_sql(simple(2, 1), -2, "CAST(h[len(h)] AS BIGINT) AS score, 'full' AS status", "p AS (SELECT pair_index, substr(q, query_from + 1, query_to - query_from) AS q, substr(t, target_from + 1, target_to - target_from) AS t FROM spans)")

ORACLES = {
    "kmer_hashes": f"WITH x AS (SELECT p_partkey AS id, 'q' AS side, upper(p_name) AS text FROM part), {HASHED} SELECT id AS p_partkey, pos, CAST(h - 9223372036854775808::HUGEINT AS BIGINT) AS hash FROM k",
    "minimizers": BOTH + " SELECT id AS pair_index, pos, hash, kmer FROM mini WHERE side = 'q'",
    "minimizer_hits": HITS + " SELECT * FROM hits",
    "seed_chain": HITS + """, c AS (SELECT pair_index, query_pos, target_pos, 1 AS n FROM hits
  UNION SELECT c.pair_index, h.query_pos, h.target_pos, c.n + 1 FROM c JOIN hits AS h ON h.pair_index = c.pair_index AND h.query_pos > c.query_pos AND h.target_pos > c.target_pos)
SELECT pair_index, max(n) AS seeds FROM c GROUP BY pair_index""",
    "seeded_windows": WINDOWS + " SELECT p.pair_index, w.pair_index IS NOT NULL AS seeded, query_from, query_to, target_from, target_to FROM p LEFT JOIN spans AS w ON w.pair_index = p.pair_index",
    "seeded_global": WINDOWS + f""" SELECT p.pair_index, n.score, n.score AS path_score, n.status AS verification_status,
  query_from AS query_start, query_to AS query_end, target_from AS target_start, target_to AS target_end, CASE WHEN w.pair_index IS NULL THEN 'no shared seed' END AS error
FROM p LEFT JOIN spans AS w ON w.pair_index = p.pair_index LEFT JOIN ({INSIDE}) AS n ON n.pair_index = p.pair_index""",
}
