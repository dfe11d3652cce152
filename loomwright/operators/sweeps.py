"""Replays and sweeps of thresholds and weights over scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.scoring import ScoringParams, raw_similarity
from loomwright.operators.aggregates import count_if, rate


def with_each(df: DataFrame, values: list[dict[str, float]]) -> DataFrame:
    """Every row once per parameter set; the sets are an array literal in the plan, so nothing is joined."""
    structs = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in values])
    return df.select("*", F.explode(structs).alias("_p")).select("*", "_p.*").drop("_p")


def sweep_thresholds() -> list[dict[str, float]]:
    """T1 = 0.60 .. 0.95 in steps of 0.05, T2 = 0.625 T1 in hundredths."""
    return [{"t1": round(i * 0.05, 2), "t2": round(round(i * 0.05, 2) * 0.625 + 1e-9, 2)} for i in range(12, 20)]


def sweep(df: DataFrame, score: Column, values: list[dict[str, float]]) -> DataFrame:
    """Per threshold pair: consistent (above t1), general (from t2), serious."""
    rows = with_each(df.select(score.alias("_s")), values)
    return rows.groupBy("t1", "t2").agg(count_if(F.col("_s") > F.col("t1")).alias("consistent"), count_if((F.col("_s") <= F.col("t1")) & (F.col("_s") >= F.col("t2"))).alias("general"), count_if(F.col("_s") < F.col("t2")).alias("serious"))


def graded_grid(df: DataFrame, truth: Column, said: Column, values: list[dict[str, float]]) -> DataFrame:
    """Per parameter set: accuracy, miss rate and false-positive rate of ``said``, ranked by accuracy, then by the sum of
    both rates, then by the parameters."""
    names = list(values[0])
    rows = with_each(df, values).groupBy(*names)
    m = rows.agg(count_if(truth & said).alias("tp"), count_if(~truth & said).alias("fp"), count_if(truth & ~said).alias("fn"), count_if(~truth & ~said).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    m = m.select(*names, F.round(rate(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(rate(fn, tp + fn), 6).alias("miss"), F.round(rate(fp, fp + tn), 6).alias("fpr"))
    return m.orderBy(F.desc("accuracy"), F.col("miss") + F.col("fpr"), *names)


def replay(df: DataFrame, semantic: Column, constraint: Column, invariant: Column, base: ScoringParams, alpha: float, beta: float, gamma: float, t1: float, t2: float) -> DataFrame:
    """Every pair's level under the base parameters and under custom ones; custom weights are normalised, and the base's
    are used if they add up to nothing."""
    total = alpha + beta + gamma
    a, b, g = (alpha / total, beta / total, gamma / total) if total > 0 else (base.alpha, base.beta, base.gamma)
    level = lambda s, x, y: F.when(s > x, "consistent").when(s >= y, "general").otherwise("serious")
    before = level(raw_similarity(semantic, constraint, invariant, base), base.t1, base.t2)
    after = level(a * semantic + b * constraint + g * invariant, t1, t2)
    return df.select("*", before.alias("before"), after.alias("after"))
