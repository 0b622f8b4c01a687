"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing and sharding, each stage written as Parquet.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Belongs to the subpackage trellica.llm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellica.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from trellica.llm._store import ensure_checkpoint_dir, table


def aside(docs: DataFrame, *named: str) -> DataFrame:
    """docs with all but the named columns in one struct, where no column that an operator adds can meet them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    return docs.select(*named, F.struct(*rest).alias("__rest")) if rest else docs.select(*named)


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows that aside() made."""
    held = rows.schema["__rest"].dataType.names if "__rest" in rows.columns else []
    return rows.select(*[F.col("__rest").getField(c).alias(c) if c in held else F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts are scored by the model's bias alone; very long texts are scored whole, by their worst passage;
    repeated rows and rows without an id are judged by their text like any other; without labels of both classes the one
    class seen decides (clean where there are none). An empty table gives an empty one; clashing columns stay as they are.
    """
    scored = toxicity.toxicity(aside(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return back(scored.where("predicted = 0"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null, empty and wordless texts link with nothing and stay, as do rows without an id. Rows that share an id are one
    document: all of its rows stay or go together, and of rows equal in every column one stays. Texts are compared whole.
    An empty table gives an empty one; further columns are only carried.
    """
    found = ngram_join.near_duplicates(docs)
    keep = found.where("id = component_id").select(F.col("id").alias("doc_id"))
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates()
    return named.unionByName(docs.where("doc_id IS NULL"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold nothing and stay; rows that share an id count as one text and stay or go together; rows
    without an id stay; whole texts are searched, however long. An empty table gives an empty one, an empty benchmark
    rejects nothing; further columns are only carried.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order.

    A null source is a source of its own; rows that share an id are repeated alike, a null id counts as the empty id;
    texts are not looked at. Columns named copy, rate or shuffle_key stay as they are. An empty table gives an empty one.
    """
    return back(mixing.mix_sources(aside(docs, "doc_id", "source"), mixing.WEIGHTS), docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot.

    A null id counts as key 0, a null or empty text has size 1; repeated rows get slots of their own, in the order of
    id, size and checksum. Columns named like one that is added are replaced. An empty table gives an empty one.
    """
    return sharding.assign_shards(docs, "doc_id", "text", 8)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The toxicity model is learnt, so SQL cannot give the rows; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate results are Parquet in the shared folder of spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
