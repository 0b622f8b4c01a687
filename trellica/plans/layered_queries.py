"""Named queries on layered programs, and on sequence parsing, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.functions.certificate import framed_sha256
from trellica.operators import layered as L
from trellica.plans.align_queries import PARTS
from trellica.plans.pairs import part_pairs, table
from trellica.sources import sequences

NODES, LAYERS = 5, 7
TYPES = ("click", "error", "purchase", "signup", "view")
INITIAL = [0, -4, -2]
TRANSITIONS = [[3, -2, 0], [-1, 2, 1], [0, 1, 2]]
EMISSIONS = {"click": [2, -3, 0], "error": [-4, 3, 1], "purchase": [2, -2, 1], "signup": [0, 1, -1], "view": [1, 0, 2]}


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One graph per return flag; lines of orders are edges between classes of parts and suppliers, scored by quantity."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dag_id"), (F.col("l_linenumber") - 1).alias("layer"), F.pmod("l_partkey", F.lit(NODES)).cast("int").alias("from"), F.pmod("l_suppkey", F.lit(NODES)).cast("int").alias("to"), (F.floor("l_quantity") - 20).alias("score"))
    edges = line.groupBy("dag_id", "layer", "from", "to").agg(F.max("score").alias("score")).withColumn("edge_ord", F.col("from") * NODES + F.col("to"))
    return edges, edges.select("dag_id").distinct().select("dag_id", F.lit(0).alias("start"), F.lit(0).alias("end"))


def dag_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, ends = part_graph(spark, sf_dir)
    scores, steps = L.longest_path_steps(edges, ends, LAYERS)
    return scores.join(L.path_score(steps, edges), "dag_id", "left").select("dag_id", "score", "path_score")


def dag_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a graph with one node less in every layer cannot hold."""
    edges, ends = part_graph(spark, sf_dir)
    widths = ends.withColumn("widths", F.array_repeat(F.lit(NODES - 1), LAYERS + 1))
    return L.dag_problems(edges, widths)


def decoded(spark: SparkSession, sf_dir: str, block: int, fanout: int) -> DataFrame:
    """Decoding of every user's events in blocks, with the score recomputed from the states of all blocks."""
    array = lambda x: F.array(*[F.lit(v) for v in x])
    by_type = F.create_map(*[x for t in TYPES for x in (F.lit(t), array(EMISSIONS[t]))])
    steps = L.number_steps(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    steps = steps.select("user_id", "step", F.element_at(by_type, F.col("event_type")).alias("emission"))
    found = L.viterbi_blocks(steps, "user_id", "step", "emission", INITIAL, TRANSITIONS, block, fanout)
    moves = found.select("*", F.posexplode(F.slice("states", 2, F.size("states") - 1)).alias("no", "state"))
    moves = moves.select("user_id", "score", "start", "end", "state", (F.col("block") * block + F.col("no")).alias("step"), F.get("states", F.col("no")).alias("before"))
    gain = F.get(F.get(F.array(*[array(r) for r in TRANSITIONS]), F.col("before")), F.col("state")) + F.get("emission", F.col("state"))
    first = F.when(F.col("step") == 0, F.get(array(INITIAL), F.col("before"))).otherwise(0)
    return moves.join(steps, ["user_id", "step"]).groupBy("user_id", "score", "start", "end").agg(F.sum(gain + first).alias("path_score"))


def viterbi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, 256, 256)


def viterbi_block_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decoding in blocks of few steps, whose matrices are joined three at a time."""
    return decoded(spark, sf_dir, 4, 3)


def two_state_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.floor("value").alias("v"))
    steps = L.number_steps(events, "id", ["ts", "event_id"])
    cost = F.array(F.array(v % 7, v % 5 + 1), F.array(v % 3 + 2, v % 11))
    total = L.fold_matrices(steps.withColumn("cost", cost), "id", "step", "cost", 2, block=16)
    return total.select(F.col("id").alias("user_id"), F.get("total", F.lit(0)).alias("to_first"), F.get("total", F.lit(1)).alias("to_second"))


def sha256_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pairs(spark, sf_dir).select("pair_index", F.sha2("query", 256).alias("query_sha256"), F.sha2("target", 256).alias("target_sha256"), framed_sha256(F.col("query"), F.col("target")).alias("framed_sha256"))


def fasta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts written as one FASTA file a brand, with wrapped lines, and parsed again."""
    record = F.concat(F.lit(">"), F.col("p_partkey"), F.lit(" "), F.col("p_type"), F.lit("\n"), F.regexp_replace("p_name", " ", "\n"), F.lit("\n"))
    files = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", record.alias("r")))), lambda x: x["r"]), "").alias("text"))
    return sequences.parse(files).select("source", F.col("idx").cast("long").alias("idx"), "id", "seq")


def fastq_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers written as one FASTQ file a nation, with blank lines between records, and parsed again."""
    record = F.concat(F.lit("@"), F.col("s_suppkey"), F.lit("\n"), F.lower("s_name"), F.lit("\n+\nIIII\n\n"))
    files = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", record.alias("r")))), lambda x: x["r"]), "").alias("text"))
    return sequences.parse(files).select("source", F.col("idx").cast("long").alias("idx"), "id", "seq")


QUERIES = {f.__name__: f for f in (dag_longest_path, dag_problems, viterbi_score, viterbi_block_path, two_state_shortest_path, sha256_inputs, fasta_parse, fastq_parse)}

EDGES = f"e AS (SELECT l_returnflag AS dag_id, l_linenumber - 1 AS layer, l_partkey % {NODES} AS f, l_suppkey % {NODES} AS t, max(CAST(floor(l_quantity) AS BIGINT) - 20) AS score FROM lineitem GROUP BY ALL)"
_LIST = lambda x: "[" + ", ".join(map(str, x)) + "]"
_EMIT = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {_LIST(EMISSIONS[t])}" for t in TYPES) + " END"
_NEXT = ", ".join("greatest(" + ", ".join(f"h[{i + 1}] + ({TRANSITIONS[i][j]})" for i in range(3)) + f") + v[i + 1][{j + 1}]" for j in range(3))
_BEST = max(range(3), key=lambda s: (INITIAL[s], s))
_ENDS = "CASE WHEN h[3] = list_max(h) THEN 2 WHEN h[2] = list_max(h) THEN 1 ELSE 0 END"

_FRAME = lambda x: f"unhex(format('{{:02x}}{{:02x}}000000000000', octet_length(encode({x})) % 256, octet_length(encode({x})) // 256)) || encode({x})"

ORACLES = {
    "sha256_inputs": f"WITH {PARTS} SELECT pair_index, sha256(q) AS query_sha256, sha256(t) AS target_sha256, sha256({_FRAME('q')} || {_FRAME('t')}) AS framed_sha256 FROM p",
    "dag_longest_path": f"""WITH RECURSIVE {EDGES},
r AS (SELECT DISTINCT dag_id, CAST(0 AS BIGINT) AS layer, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS score FROM e
  UNION ALL SELECT r.dag_id, r.layer + 1, e.t, max(r.score + e.score) FROM r JOIN e ON e.dag_id = r.dag_id AND e.layer = r.layer AND e.f = r.node GROUP BY r.dag_id, r.layer, e.t)
SELECT d.dag_id, r.score, r.score AS path_score FROM (SELECT DISTINCT dag_id FROM e) AS d LEFT JOIN r ON r.dag_id = d.dag_id AND r.layer = {LAYERS} AND r.node = 0""",
    "dag_problems": f"WITH {EDGES} SELECT DISTINCT dag_id, 'edge outside its layers' AS problem FROM e WHERE f > {NODES - 2} OR t > {NODES - 2} OR layer > {LAYERS - 1}",
    "viterbi_score": f"""WITH RECURSIVE s AS (SELECT user_id, list({_EMIT} ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
r AS (SELECT user_id, v, 0 AS i, {_LIST([INITIAL[s] if s == _BEST else -1000000 for s in range(3)])} AS h FROM s
  UNION ALL SELECT user_id, v, i + 1, [{_NEXT}] FROM r WHERE i < len(v))
SELECT user_id, CAST(list_max(h) AS BIGINT) AS score, {_BEST} AS start, {_ENDS} AS "end", CAST(list_max(h) AS BIGINT) AS path_score FROM r WHERE i = len(v)""",
    "two_state_shortest_path": """WITH RECURSIVE s AS (SELECT user_id, list(CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
r AS (SELECT user_id, v, 0 AS i, CAST(0 AS BIGINT) AS a, CAST(1000000000 AS BIGINT) AS b FROM s
  UNION ALL SELECT user_id, v, i + 1, least(a + v[i + 1] % 7, b + v[i + 1] % 3 + 2), least(a + v[i + 1] % 5 + 1, b + v[i + 1] % 11) FROM r WHERE i < len(v))
SELECT user_id, a AS to_first, b AS to_second FROM r WHERE i = len(v)""",
    "fasta_parse": "SELECT p_brand AS source, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, CAST(p_partkey AS VARCHAR) AS id, upper(replace(p_name, ' ', '')) AS seq FROM part",
    "fastq_parse": "SELECT CAST(s_nationkey AS VARCHAR) AS source, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx, CAST(s_suppkey AS VARCHAR) AS id, upper(s_name) AS seq FROM supplier",
}

ORACLES["viterbi_block_path"] = ORACLES["viterbi_score"]
