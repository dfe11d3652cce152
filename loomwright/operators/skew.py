"""Joins whose left side may hold a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which each key's left rows spread over ``salts`` partitions by the integer ``salt``, and the right side,
    which should be an aggregate with one row per key, is repeated as often. The result is that of the plain join."""
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int")).join(repeated, [*keys, "_salt"], how).drop("_salt")
