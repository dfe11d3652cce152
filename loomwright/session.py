"""Session helpers: reading tables, and cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder, a Parquet file or directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset and
    get a temporary one: on a cluster that would be the driver's own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomwright-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there: the lineage ends, and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks that the session is set up to run at once, at least one."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """``df`` over at least as many partitions as tasks can run, or ``waves`` times as many, so that rows of uneven work
    even out. Inputs of enough files or splits stay as they are; only
    small ones, a file of one split, are shuffled, so that work per row does not run in a single task."""
    wanted = waves * parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever the driver's working folder. Executors
    that do not share that folder need it by --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
