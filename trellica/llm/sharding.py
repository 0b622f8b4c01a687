"""Sharding by jump consistent hashing (operator 10).

The shard of a row follows from its key and the number of shards alone: no ring table, and when a shard is appended only
about 1/(n+1) of the rows move, all of them into the new shard. Lamping and Veach, "A fast, minimal memory, consistent
hash algorithm" (2014).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellica.llm._store import cut, table

#: Multiplier of the published jump hash (fixed value).
JUMP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for all keys at once; the expected number of passes is ln(shards)."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.flatnonzero(ahead < shards)
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * JUMP + np.uint64(1)
        ahead[live] = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column form of jump_hash() for a bigint key."""

    @F.pandas_udf("int")
    def jump(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64), shards))

    return jump(key)


def assign_shards(df: DataFrame, key: str, text: str, shards: int = 8, keep_text: bool = True, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add text size and crc32, the shard for `shards` and for one more, and a gapless slot inside each shard.

    Integer keys are used as they are, any other type through xxhash64 of its text form. A null key counts as key 0; a
    null or empty text has size 1 (no bytes, plus one) and crc32 0. Rows with equal keys share a shard; repeated rows get
    slots of their own. Very long texts are hashed whole. An empty table gives an empty result. Columns of the input named like an output column are
    replaced.
    """
    names = ["size", "text_crc32", "shard", "slot", "grown_shard"]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    as_long = F.col(key).cast("long") if dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(F.col(key).cast("string"))
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    df = df.withColumn("size", (F.octet_length(raw) + 1).cast("long")).withColumn("text_crc32", F.crc32(raw))
    df = df.withColumn("__key", F.coalesce(as_long, F.lit(0).cast("long")))
    df = df.withColumn("shard", shard_of(F.col("__key"), shards)).withColumn("grown_shard", shard_of(F.col("__key"), shards + 1))
    df = df if keep_text else df.drop(text)
    return number_slots(df, "shard", ["__key", "size", "text_crc32"], rows_per_bucket).drop("__key")


def number_slots(df: DataFrame, group: str, order: list[str], rows_per_bucket: int) -> DataFrame:
    """A gapless `slot` from 0 inside each value of `group`, in the given order, without gathering a group in one task.

    Rows are sorted globally, ties by a hash of their other columns; a random last key only lets many rows that are equal in
    all of them spread. They are materialised with a row id and cut into even runs of that id; each run is numbered by
    itself and a small table of run counts (groups x rows / rows_per_bucket) gives its first slot. The cut also fixes the row ids, which a recomputed task could deal anew.
    """
    content = [F.col(f"`{c}`") for c, kind in df.dtypes if c not in order and "map<" not in kind and "variant" not in kind]
    df = df.withColumns({"__content": F.xxhash64(F.lit(0), *content), "__tie": F.rand(7)})
    df = cut(df.orderBy(*order, "__content", "__tie").drop("__content", "__tie").withColumn("__row", F.monotonically_increasing_id()))
    df = df.withColumn("__run", F.floor(F.col("__row") / rows_per_bucket))
    counts = df.groupBy(group, "__run").count()
    first = counts.select(group, "__run", (F.sum("count").over(Window.partitionBy(group).orderBy("__run")) - F.col("count")).alias("__first"))
    numbered = df.withColumn("slot", F.row_number().over(Window.partitionBy(group, "__run").orderBy("__row")).cast("long") - 1)
    return numbered.join(first, [group, "__run"]).withColumn("slot", F.col("slot") + F.col("__first")).drop("__row", "__run", "__first")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `key`."""
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 8, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The published generator and jump in 128-bit arithmetic; at most as many jumps as there are shards.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
poly AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tbl),
crc_of AS (
  SELECT t, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                            lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc
  FROM (SELECT DISTINCT t FROM d), poly),
k AS (SELECT DISTINCT coalesce(doc_id, 0) AS key, n FROM d, (VALUES (8), (9)) AS s(n)),
jump AS (
  SELECT key, n, CAST(key AS UBIGINT)::UHUGEINT AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM k
  UNION ALL
  SELECT key, n, nxt, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592)::DOUBLE + 1.0))) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS nxt FROM jump WHERE j < n)),
s AS (SELECT key, n, CAST(max(b) AS INTEGER) AS shard FROM jump WHERE j >= n GROUP BY key, n)
SELECT d.doc_id, d.size, CAST(c.crc AS BIGINT) AS text_crc32, 'key' AS law, a.shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY coalesce(d.doc_id, 0), d.size, c.crc) - 1 AS slot, g.shard AS grown_shard
FROM d
JOIN crc_of AS c ON c.t = d.t
JOIN s AS a ON a.key = coalesce(d.doc_id, 0) AND a.n = 8
JOIN s AS g ON g.key = coalesce(d.doc_id, 0) AND g.n = 9
"""
