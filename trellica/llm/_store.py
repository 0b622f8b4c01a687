"""Settings and cut points shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Public Spark setting: an action's shuffle files go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; only a local master (tests) gets a folder of our own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame, chain: bool = False) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so later reads survive lost executors.

    `chain` says that df is one chain of steps without joins: no stage of it can outlive the action then, and the shuffle
    files behind it go at once, so the disk holds those of one step at a time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not chain:
        return df.checkpoint(eager=True)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
