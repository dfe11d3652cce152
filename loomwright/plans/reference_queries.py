"""Queries of the orphan-reference operator over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.operators.references import orphan_references, orphan_report, parent_intervals, reference_stream
from loomwright.session import read_table

REFERRING = ("tg_analysis_task", "tg_requirement")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    task, requirement = (reference_stream(read_table(spark, sf_dir, t), t) for t in REFERRING)
    return orphan_references(task.unionByName(requirement), parent_intervals(read_table(spark, sf_dir, "tg_project")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "row_id", "reason").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

_ORPHANS = """
WITH cur AS (
  SELECT id, create_time AS born, coalesce(deleted, 0) AS gone,
         row_number() OVER (PARTITION BY id ORDER BY update_time DESC NULLS LAST, create_time DESC NULLS LAST, coalesce(deleted, 0) DESC) AS rn
  FROM tg_project WHERE id IS NOT NULL),
refs AS (
  SELECT 'tg_analysis_task' AS ref_table, id AS row_id, project_id, create_time FROM tg_analysis_task
  WHERE project_id IS NOT NULL AND coalesce(deleted, 0) <> 1
  UNION ALL
  SELECT 'tg_requirement', id, project_id, create_time FROM tg_requirement
  WHERE project_id IS NOT NULL AND coalesce(deleted, 0) <> 1),
orphans AS (
  SELECT DISTINCT r.ref_table, r.row_id, r.create_time,
         CASE WHEN c.id IS NULL THEN 'missing' WHEN c.gone = 1 THEN 'deleted' WHEN r.create_time < c.born THEN 'late' END AS reason
  FROM refs r LEFT JOIN (SELECT * FROM cur WHERE rn = 1) c ON c.id = r.project_id)
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT DISTINCT ref_table, row_id, reason FROM orphans WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS
    + "SELECT ref_table, strftime(create_time, '%Y-%m') AS month, reason, count(DISTINCT row_id) AS orphans FROM orphans WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
