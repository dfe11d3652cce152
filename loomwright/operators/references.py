"""References to records that do not exist: missing, deleted, or arriving later than the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one ``HOT_SHARE``-th of all references; there can be at most ``HOT_SHARE`` such keys.
HOT_SHARE = 64


def parent_intervals(parents: DataFrame, key: str = "id", version: str = "update_time", born: str = "create_time", deleted: str = "deleted") -> DataFrame:
    """One row per parent key: the validity interval that its current version states.

    Current is the version with the latest ``version`` time; a null time is the earliest. Among versions of the same
    time the one with the later ``born``, then the deleted one, wins, so that repeated rows cannot change the result.
    Null keys are dropped, null ``deleted`` counts as 0. Columns: ``_key``, ``_born``, ``_gone``.
    """
    current = F.max(F.struct(F.col(version), F.col(born), F.coalesce(F.col(deleted), F.lit(0)).alias("gone"))).alias("v")
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(current)
        .select("_key", F.col(f"v.{born}").alias("_born"), (F.col("v.gone") == 1).alias("_gone"))
    )


def reference_stream(refs: DataFrame, table: str, key: str = "project_id", row_id: str = "id", born: str = "create_time", deleted: str = "deleted") -> DataFrame:
    """References of rows that are not deleted themselves and name a parent, under common column names."""
    return refs.where(F.col(key).isNotNull() & (F.coalesce(F.col(deleted), F.lit(0)) != 1)).select(
        F.lit(table).alias("ref_table"), F.col(row_id).alias("row_id"), F.col(key).alias("_key"), F.col(born).alias("ref_time")
    )


def _salted(refs: DataFrame, parents: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Spread the references of hot keys over ``salts`` partitions, and repeat only those keys' parents.

    The list of hot keys has at most ``HOT_SHARE`` rows whatever the input, since each holds more than that share.
    """
    per_key = refs.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.sum("n")).first()[0] or 0
    hot = per_key.where(F.col("n") * HOT_SHARE > max(total, HOT_SHARE * 1000)).select("_key", F.lit(True).alias("_hot"))
    spread: Column = F.when(F.col("_hot"), F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    repeat: Column = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        refs.join(F.broadcast(hot), "_key", "left").withColumn("_salt", spread).drop("_hot"),
        parents.join(F.broadcast(hot), "_key", "left").withColumn("_salt", F.explode(repeat)).drop("_hot"),
    )


def orphan_references(references: DataFrame, intervals: DataFrame, salts: int = 16) -> DataFrame:
    """Classify references against parent validity intervals; only orphans are returned.

    Both streams are hash-partitioned on (key, salt), sorted, and merged in one linear pass (a sort-merge join; the
    parent side has one row per key, so nothing is buffered). The first of these that holds is the reason:
    ``missing`` (no parent has the key), ``deleted`` (the parent's current version is deleted), ``late`` (the reference
    has a time and it is strictly before the parent's). A parent without a time is never late.

    Columns: ref_table, row_id, ref_time, reason. Repeated references give one row. Empty inputs give an empty result,
    or, without any parent, every reference as missing.
    """
    refs, parents = _salted(references, intervals, salts)
    merged = refs.join(parents.withColumn("_known", F.lit(True)).hint("merge"), ["_key", "_salt"], "left")
    reason = (
        F.when(F.col("_known").isNull(), F.lit("missing"))
        .when(F.col("_gone"), F.lit("deleted"))
        .when(F.col("ref_time") < F.col("_born"), F.lit("late"))
    )
    return merged.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("ref_table", "row_id", "ref_time", "reason").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference's time (null stays null) and reason."""
    return orphans.groupBy("ref_table", F.date_format("ref_time", "yyyy-MM").alias("month"), "reason").agg(F.countDistinct("row_id").alias("orphans"))
