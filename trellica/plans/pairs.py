"""Inputs of the named queries: sequence pairs and series made from the driver's tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of each (id, seq) row with the row whose id follows: an equi-join on the id."""
    left = rows.select(F.col("id").alias("pair_index"), F.col("id").cast("string").alias("query_id"), F.col("seq").alias("query"))
    right = rows.select((F.col("id") - 1).alias("pair_index"), F.col("id").cast("string").alias("target_id"), F.col("seq").alias("target"))
    return left.join(right, "pair_index")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of parts with neighbouring keys, as upper-case ASCII strings."""
    text = F.upper(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return neighbours(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("seq")))


def letter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with letters only, for matrix scoring."""
    text = F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^A-Z]", "")
    return neighbours(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("seq")))


def item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts with neighbouring ids, reduced to printable ASCII."""
    text = F.regexp_replace("text", "[^ -~]", "")
    return neighbours(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.alias("seq")))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, series): whole-number values of all events of a user in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.floor("value").cast("int").alias("v"))))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.transform(ordered, lambda e: e["v"]).alias("series"))


def series_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_series(spark, sf_dir)
    left = rows.select(F.col("id").alias("pair_index"), F.col("series").alias("query"))
    return left.join(rows.select((F.col("id") - 1).alias("pair_index"), F.col("series").alias("target")), "pair_index")
