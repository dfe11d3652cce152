"""Optional, visibility, search, scope and retention filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_given(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns equal the given values; null and blank values ask for nothing."""
    conditions = [F.col(k) == v for k, v in wanted.items() if v is not None and str(v).strip()]
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def visible(facts: DataFrame, projects: DataFrame, key: str, owner: int | None) -> DataFrame:
    """Facts of the owner's projects, all of them for None (an administrator); a semi-join, so none for no project."""
    mine = projects if owner is None else projects.where(F.col("create_user_id") == owner)
    return facts.join(mine.select(F.col("id").alias(key)), key, "left_semi")


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in one of the columns, without regard to case; no character of it is special."""
    needle = F.lit(text.lower())
    return df.where(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns]))


def in_scope(value: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a name is included and not excluded; no include pattern means all. ``*`` stands for any text, and ``a.b.*``
    also for a.b itself."""

    def one(pattern: str) -> str:
        if pattern.endswith(".*"):
            return f"{re.escape(pattern[:-2])}(\\..*)?"
        return ".*".join(map(re.escape, pattern.split("*")))

    matches = lambda patterns: value.rlike("^(?:" + "|".join(map(one, patterns)) + ")$")
    inside = matches(include) if include else value.isNotNull()
    return inside & ~matches(exclude) if exclude else inside


def expired(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows whose time is more than ``days`` days before ``as_of``."""
    return df.where(F.col(time) < F.expr(f"timestamp_ntz '{as_of}' - interval {int(days)} days"))


def within(n: int | None, least: int, most: int, default: int) -> int:
    """A page size, limit or number of days as asked for, held within its bounds; the default where none is given."""
    return max(least, min(most, default if n is None else n))


def defaulted(c: Column, value: str) -> Column:
    """The value where the column is null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(value))
