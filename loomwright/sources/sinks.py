"""Writing results: partitioned append, replacement per project, and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Append Parquet, one folder per value; rows of a value are brought together first, so that files stay few, but those
    of a very frequent one are split."""
    df.hint("rebalance", by).write.mode("append").partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str, values: list | None = None) -> None:
    """Replace the folders of the values that occur in ``df``, and leave all others as they are. Of the given ``values``,
    such as the projects of a run, those that ``df`` no longer has lose their old rows as well."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if values:
        there = {r[0] for r in df.where(F.col(by).isin(values)).select(by).distinct().collect()}  # at most the given values
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for v in values:
            if v not in there:
                folder = jvm.org.apache.hadoop.fs.Path(path, f"{by}={v}")
                folder.getFileSystem(conf).delete(folder, True)


def export_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """CSV with a header: the given columns under the given titles."""
    df.select(*[F.col(c).alias(t) for c, t in columns.items()]).write.mode("overwrite").option("header", "true").csv(path)


def vector_rows(requirements: DataFrame, code: DataFrame) -> DataFrame:
    """(type, id, vector) of both sources, components joined by semicolons; rows without a vector are left out."""
    pick = lambda df, kind: df.where(F.col("vector").isNotNull()).select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), F.array_join(F.transform("vector", lambda x: x.cast("string")), ";").alias("vector"))
    return pick(requirements, "requirement").unionByName(pick(code, "code"))


def resumed(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a stage that an earlier run has written whole to ``path``; else the stage is built, written and read. A stage
    that broke off has left no mark of success and is built anew. So is one without rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        done = spark.read.parquet(path)
        if not done.isEmpty():
            return done
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
