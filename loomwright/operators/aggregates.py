"""Aggregations with fixed axes, conditional counts, agreement and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import cut


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def day_axis(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day from first to last (yyyy-MM-dd), column ``day`` as text."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def on_axis(axis: DataFrame, facts: DataFrame, key: str, zero: list[str]) -> DataFrame:
    """All keys of the axis, with the facts' counts or 0; facts off the axis are left out."""
    return axis.join(facts, key, "left").fillna(0, subset=zero)


def daily(df: DataFrame, time: str, conditions: dict[str, Column]) -> DataFrame:
    """Per day: total, and how many rows meet each condition. Rows without a time are left out."""
    return df.where(F.col(time).isNotNull()).groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("total"), *[count_if(c).alias(k) for k, c in conditions.items()])


def seeded_counts(spark: SparkSession, df: DataFrame, key: Column, keys: list[str]) -> DataFrame:
    """How often each of ``keys`` occurs, with 0 for those that do not; other values are left out."""
    seed = spark.createDataFrame([(k,) for k in keys], "key string")
    return on_axis(seed, df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")), "key", ["n"])


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def confusion(df: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with accuracy, miss rate and false-positive rate (each 0 without cases)."""
    counts = df.groupBy(*(by or [])).agg(count_if(truth & said).alias("tp"), count_if(~truth & said).alias("fp"), count_if(truth & ~said).alias("fn"), count_if(~truth & ~said).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select("*", F.round(rate(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(rate(fn, tp + fn), 6).alias("miss_rate"), F.round(rate(fp, fp + tn), 6).alias("fp_rate"))


def kappa(df: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two boolean columns, per group of ``by``: n, agreement, expected agreement, kappa (1 where chance
    agreement is sure)."""
    s = df.where(a.isNotNull() & b.isNotNull()).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), count_if(a == b).alias("same"), count_if(a).alias("a1"), count_if(b).alias("b1"))
    n = F.col("n").cast("double")
    po = F.when(n > 0, F.col("same") / n)
    pe = F.when(n > 0, F.col("a1") / n * (F.col("b1") / n) + (1 - F.col("a1") / n) * (1 - F.col("b1") / n))
    return s.select(*(by or []), "n", F.round(po, 6).alias("po"), F.round(pe, 6).alias("pe"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over rows with both values; null for fewer than two rows or without variance."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(F.covar_pop(a, b), spread), 6).alias("correlation"))


def majority(df: DataFrame, item: str, vote: Column) -> DataFrame:
    """Majority of boolean votes per item: false on a tie, null where no vote counts."""
    return df.groupBy(item).agg(count_if(vote).alias("yes"), count_if(~vote).alias("no")).withColumn("verdict", F.when(F.col("yes") + F.col("no") > 0, F.col("yes") > F.col("no")))


def failure_runs(df: DataFrame, group: str, order: list[str], failed: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive failures per group: first and last order value, length.

    Gaps and islands: a run's number is the count of successes before it. Rows are range-partitioned by group and order, and
    counted within their partition; a group that spreads over several partitions carries its count on from one to the next
    by the partitions' sums. So no task holds a whole group, however frequent it is.
    """
    from pyspark.sql import Window

    ranged = cut(df.withColumn("_f", F.coalesce(failed, F.lit(False))).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))  # both uses must see the same ranges
    ok = F.sum(F.when(F.col("_f"), 0).otherwise(1))
    local = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(group, "_part").agg(ok.alias("_n"))
    parts = Window.partitionBy(group).orderBy("_part")
    carried = sums.withColumn("_before", F.sum("_n").over(parts) - F.col("_n")).withColumn("_k", F.row_number().over(parts)).where("_k > 1").select(group, "_part", "_before")
    # only groups that cross a border between partitions are left: at most a row per partition
    counted = ranged.withColumn("_local", ok.over(local)).join(F.broadcast(carried), [group, "_part"], "left")
    runs = counted.where("_f").groupBy(group, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("_run"))
    found = runs.agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length"))
    return found.where(F.col("length") >= least).drop("_run")
