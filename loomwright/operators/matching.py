"""Greedy one-to-one matching in score order, in its declarative form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut


def greedy_matches(pairs: DataFrame, left: str, right: str, rank: str, consistent: str, max_rounds: int = 1000) -> DataFrame:
    """(left, right, rank, kind): pairs taken in rank order.

    A consistent pair always counts and marks both ends. An inconsistent pair is taken only while both its ends are
    free, and takes them. Ranks must be unique. Sequentially: walk the pairs by rank. Here: inconsistent pairs that come
    after a consistent one of either end are out; of the rest, those that are first for both their ends are taken, and
    all pairs of their ends leave, until none is left, an error after ``max_rounds``. Each round is two aggregations and two anti joins; the number of
    rounds is the longest chain of pairs that wait for each other.
    """
    ok = pairs.where(F.col(consistent))
    first = lambda end: ok.groupBy(end).agg(F.min(rank).alias(f"_ok_{end}"))
    after = lambda end: F.coalesce(F.col(f"_ok_{end}") > F.col(rank), F.lit(True))
    open_ = cut(pairs.where(~F.col(consistent)).join(first(left), left, "left").join(first(right), right, "left").where(after(left) & after(right)).select(left, right, rank))
    taken = None
    rounds = 0
    while True:
        best = lambda end: open_.groupBy(end).agg(F.min(rank).alias(rank))  # noqa: E731,B023
        now = cut(open_.join(best(left), [left, rank], "left_semi").join(best(right), [right, rank], "left_semi").select(left, right, rank))
        if now.isEmpty():
            break
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"pairs still wait for each other after {max_rounds} rounds")
        taken = cut(now if taken is None else taken.unionByName(now)) if rounds % 16 == 0 else now if taken is None else taken.unionByName(now)
        open_ = cut(open_.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
    result = ok.select(left, right, rank, F.lit("consistent").alias("kind"))
    return result if taken is None else result.unionByName(taken.withColumn("kind", F.lit("defect")))


def unmatched(items: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Items that no match names."""
    return items.join(matches.select(key), key, "left_anti")
