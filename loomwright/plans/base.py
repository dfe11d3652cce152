"""Base relations that the named queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.session import read_table


def kept(df: DataFrame) -> DataFrame:
    """Rows that are not logically deleted."""
    return df.where(F.coalesce("deleted", F.lit(0)) == 0)


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """Current version of each project that is not deleted (latest update; ties: latest creation, then deleted)."""
    t = read_table(spark, sf, "tg_project")
    rest = [c for c in t.columns if c not in ("id", "update_time", "create_time", "deleted")]
    order = F.struct("update_time", "create_time", F.coalesce("deleted", F.lit(0)).alias("deleted"), *rest)
    return t.where("id is not null").groupBy("id").agg(F.max(order).alias("v")).select("id", "v.*").where("deleted = 0")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return kept(read_table(spark, sf, "tg_analysis_task").distinct())


def requirements(spark: SparkSession, sf: str) -> DataFrame:
    return kept(read_table(spark, sf, "tg_requirement").distinct())


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "defect_detection_case")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def r6(c: Column, name: str) -> Column:
    return F.round(c.cast("double"), 6).alias(name)


#: Names of states in the texts of the project tables, beside the default ones; a parameter of the state functions.
STATES = [*T.STATE_NAMES, "DRAFT", "QUEUED", "APPROVED", "LOCKED", "CLOSED", "REVOKED", "ON_HOLD"]


def states(text: Column) -> Column:
    return T.states(text, STATES)


def states_sql(text: str) -> str:
    """T.states in SQL."""
    words = list(T.STATE_WORDS.items())
    earlier = lambda i: "".join(f" AND NOT contains({text}, '{w}')" for w, s in words[:i] if s == words[i][1])
    meant = ", ".join(f"CASE WHEN contains({text}, '{w}'){earlier(i)} AND NOT contains(lower({text}), '{s.lower()}') THEN '{s}' END" for i, (w, s) in enumerate(words))
    return f"list_concat(list_filter([{', '.join(repr(s) for s in STATES)}], lambda s: contains(lower({text}), lower(s))), list_filter([{meant}], lambda s: s IS NOT NULL))"


def bounds_sql(text: str) -> str:
    """T.quantified_bounds in SQL."""
    return f"list_transform(regexp_extract_all({text}, '{T.BOUND}'), lambda m: regexp_extract(m, '([0-9]{{1,6}})', 1)::INT)"


WITH = """
WITH projects AS (
  SELECT * FROM (
    SELECT id, project_name, industry_type, tech_stack, create_user_id, status, requirement_count, coverage_rate, defect_count, create_time, update_time, coalesce(deleted, 0) AS gone,
           row_number() OVER (PARTITION BY id ORDER BY update_time DESC NULLS LAST, create_time DESC NULLS LAST, coalesce(deleted, 0) DESC, project_name DESC NULLS LAST, industry_type DESC NULLS LAST,
                              tech_stack DESC NULLS LAST, create_user_id DESC NULLS LAST, status DESC NULLS LAST, requirement_count DESC NULLS LAST, coverage_rate DESC NULLS LAST, defect_count DESC NULLS LAST) AS rn
    FROM tg_project WHERE id IS NOT NULL) WHERE rn = 1 AND gone = 0),
tasks AS (SELECT DISTINCT * FROM tg_analysis_task WHERE coalesce(deleted, 0) = 0),
requirements AS (SELECT DISTINCT * FROM tg_requirement WHERE coalesce(deleted, 0) = 0),
cases AS (SELECT * FROM defect_detection_case)
"""
