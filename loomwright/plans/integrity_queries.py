"""Incremental comparison, merges, change capture, hash chains and dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import changes as C
from loomwright.plans.base import WITH, cases, projects
from loomwright.session import read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_HASH = "CASE WHEN coalesce(length({c}), 0) = 0 THEN '' ELSE sha256({c}) END"


@query(f"SELECT file_id, {_HASH.format(c='content')} AS hash FROM source_file")
def s8_content_hashes(spark, sf):
    return read_table(spark, sf, "source_file").select("file_id", C.content_hash(F.col("content")).alias("hash"))


# the old snapshot of the files: what was uploaded before the cut, the new one: the latest upload per name
_CUT = "2025-09-01"
_SNAPSHOTS = f"""old AS (SELECT repo || '/' || file_name AS path, max(sha256(coalesce(content, ''))) AS h FROM source_file WHERE upload_time < '{_CUT}' GROUP BY 1), new AS (SELECT repo || '/' || file_name AS path, max(sha256(coalesce(content, ''))) AS h FROM source_file WHERE upload_time >= '2025-06-01' GROUP BY 1),
plan AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'same' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"""


def _snapshots(spark, sf):
    files = read_table(spark, sf, "source_file").select(F.concat_ws("/", "repo", "file_name").alias("path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"), "upload_time")
    at = lambda c: F.lit(c).cast("timestamp_ntz")
    take = lambda df: df.groupBy("path").agg(F.max("h").alias("h"))
    return take(files.where(F.col("upload_time") < at(_CUT))), take(files.where(F.col("upload_time") >= at("2025-06-01")))


@query(f"WITH {_SNAPSHOTS} SELECT * FROM plan")
def i1_j15_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return C.diff(old, new, "path", "h")


@query(f"WITH {_SNAPSHOTS} SELECT o.* FROM old o JOIN plan p ON p.path = o.path AND change = 'same' UNION ALL SELECT n.* FROM new n JOIN plan p ON p.path = n.path AND change IN ('changed', 'added')")
def i2_merge(spark, sf):
    old, new = _snapshots(spark, sf)
    return C.merged(old, new, C.diff(old, new, "path", "h"), "path")


@query("SELECT DISTINCT id, semantic_vector IS NULL AS to_compute FROM tg_requirement")
def i3_reuse(spark, sf):
    return read_table(spark, sf, "tg_requirement").select("id", F.col("semantic_vector").isNull().alias("to_compute")).distinct()


_FIELDS = ["status", "requirement_count", "coverage_rate", "defect_count", "deleted"]


@query(
    "WITH v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_time, create_time) AS k FROM (SELECT DISTINCT * FROM tg_project)), p AS (SELECT a.id, a.k, "
    + ", ".join(f"a.{f}::VARCHAR AS o_{f}, b.{f}::VARCHAR AS n_{f}" for f in _FIELDS)
    + " FROM v a JOIN v b ON a.id = b.id AND b.k = a.k + 1) "
    + " UNION ALL ".join(f"SELECT id || '@' || k AS version, '{f}' AS field, o_{f} AS old_value, n_{f} AS new_value FROM p WHERE o_{f} IS DISTINCT FROM n_{f}" for f in _FIELDS)
)
def i5_j16_field_changes(spark, sf):
    from pyspark.sql import Window

    versions = read_table(spark, sf, "tg_project").distinct().withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("update_time", "create_time")))
    key = lambda shift: F.concat(F.col("id").cast("string"), F.lit("@"), (F.col("k") - shift).cast("string"))
    return C.field_changes(versions.withColumn("version", key(0)), versions.withColumn("version", key(1)), "version", _FIELDS)


# a log with chained hashes: each user's events, every 97th of them altered
_CHAIN_FIELDS = ["user_id", "event_type", "value", "props", "ts"]
_PARTS = "coalesce(user_id::VARCHAR, '') || '|' || coalesce(event_type, '') || '|' || coalesce({value}::VARCHAR, '') || '|' || coalesce(props, '') || '|' || coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '')"
_CHAIN_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_PARTS.format(value='value')} AS parts FROM events),
h AS (SELECT user_id, i, sha256('GENESIS|' || parts) AS hash FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, sha256(h.hash || '|' || e.parts) FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)"""


def _log(spark, sf):
    """The events of a user as a log whose entries are chained by their hashes."""
    events = read_table(spark, sf, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return events


def _chained(spark, sf):
    log = _log(spark, sf).withColumn("second", F.left("ts", F.lit(19)))
    fields = [*_CHAIN_FIELDS[:-1], "second"]
    return C.append_chain(log, "user_id", ["ts", "event_id"], fields, "hash"), fields


@query(_CHAIN_SQL + " SELECT event_id, hash FROM h JOIN e USING (user_id, i)")
def x1_x2_chain_hashes(spark, sf):
    return _chained(spark, sf)[0].select("event_id", "hash")


@query(
    _CHAIN_SQL
    + f""", w AS (SELECT e.*, h.hash, lag(h.hash) OVER (PARTITION BY user_id ORDER BY i) AS prev, CASE WHEN event_type = 'error' AND value > 15 THEN 15.0 ELSE value END AS now FROM e JOIN h USING (user_id, i)),
c AS (SELECT *, hash = sha256(coalesce(prev, 'GENESIS') || '|' || {_PARTS.format(value='now')}) AS fine FROM w)
SELECT user_id, count(*) AS total, min(CASE WHEN NOT fine THEN i - 1 END) AS first_broken FROM c GROUP BY 1"""
)
def x1_x3_w7_chain(spark, sf):
    """Chains in which the values of errors were lowered to 15 after the entries had been chained."""
    log, fields = _chained(spark, sf)
    lowered = F.when((F.col("event_type") == "error") & (F.col("value") > 15), 15.0).otherwise(F.col("value"))
    return C.verify_chain(log.withColumn("value", lowered), "user_id", ["ts", "event_id"], fields, "hash")


@query(
    """SELECT 'unique:case_id' AS check, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS bad FROM (SELECT count(*) AS n FROM defect_detection_case GROUP BY case_id)
UNION ALL SELECT 'enum:severity', count(*) FROM defect_detection_case WHERE severity IS NULL OR severity NOT IN ('high', 'medium', 'low')
UNION ALL SELECT 'enum:requirement_type', count(*) FROM defect_detection_case WHERE requirement_type IS NULL OR requirement_type NOT IN ('functional', 'data')"""
)
def x4_dataset_checks(spark, sf):
    return C.dataset_checks(cases(spark, sf), "case_id", {"severity": ["high", "medium", "low"], "requirement_type": ["functional", "data"]})


# how the status of a task, and that of its project, stand for states of a defect
_TASK = {"pending": "pending", "running": "processing", "completed": "resolved", "failed": "ignored", "terminated": "ignored", "interrupted": "pending", "paused": "falsePositive"}
_PROJECT = {"created": "pending", "analyzing": "processing", "completed": "resolved", "failed": "falsePositive"}
_named = lambda c, names: f"CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(
    WITH
    + f", l AS (SELECT id, max(project_id) AS project_id, max({_named('status', _TASK)}) AS s FROM tg_analysis_task GROUP BY 1), r AS (SELECT l.id, {_named('p.status', _PROJECT)} AS s FROM l JOIN projects p ON p.id = l.project_id) SELECT l.id, CASE WHEN l.s IS NOT DISTINCT FROM r.s THEN 'unchanged' WHEN l.s || '>' || r.s IN ("
    + ", ".join(f"'{a}>{b}'" for a, bs in C.DEFECT_MOVES.items() for b in bs)
    + ") THEN 'changed' ELSE 'skipped' END AS action FROM l JOIN r USING (id)"
)
def x5_f13_status_merge(spark, sf):
    named = lambda c, names: F.coalesce(*[F.when(F.lower(F.trim(c)) == k, v) for k, v in names.items()])
    local = read_table(spark, sf, "tg_analysis_task").groupBy("id").agg(F.max("project_id").alias("project_id"), F.max(named("status", _TASK)).alias("status"))
    current = projects(spark, sf).select(F.col("id").alias("project_id"), named("status", _PROJECT).alias("status"))
    remote = local.select("id", "project_id").join(current, "project_id").select("id", "status")
    return C.status_merge(local, remote, "id")


@query("SELECT DISTINCT p.repo, p.file_name FROM parse_failure p WHERE p.create_time < TIMESTAMP '2026-06-01' - INTERVAL 30 DAY AND NOT EXISTS (SELECT 1 FROM source_file f WHERE f.repo = p.repo AND f.file_name = p.file_name)")
def x6_unreferenced(spark, sf):
    old = read_table(spark, sf, "parse_failure").where(F.col("create_time") < F.expr("timestamp_ntz '2026-06-01 00:00:00' - interval 30 days"))
    return old.join(read_table(spark, sf, "source_file"), ["repo", "file_name"], "left_anti").select("repo", "file_name").distinct()


@query("SELECT DISTINCT id, CASE WHEN end_time IS NULL AND lower(trim(status)) NOT IN ('completed', 'failed') THEN 'interrupted' ELSE lower(trim(status)) END AS status FROM tg_analysis_task")
def x7_recovery(spark, sf):
    s = F.lower(F.trim("status"))
    return read_table(spark, sf, "tg_analysis_task").select("id", F.when(F.col("end_time").isNull() & ~s.isin("completed", "failed"), "interrupted").otherwise(s).alias("status")).distinct()


@query("WITH p AS (SELECT user_id, min(event_id % 20) AS lo, max(event_id % 20) + 1 AS n FROM events GROUP BY 1) SELECT user_id, i AS missing FROM p, range(0, 20) x(i) WHERE i < n AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_id % 20 = i)")
def s19_missing_chunks(spark, sf):
    parts = read_table(spark, sf, "events").select("user_id", (F.col("event_id") % 20).alias("i"))
    total = parts.groupBy("user_id").agg((F.max("i") + 1).alias("n"))
    return C.missing_chunks(parts.join(total, "user_id"), "user_id", "i", "n").select("user_id", F.col("missing").cast("long"))


@query(
    """WITH a AS (SELECT project_name AS k, max(industry_type) AS v FROM tg_project WHERE deleted = 0 GROUP BY 1), b AS (SELECT project_name AS k, max(tech_stack) AS v FROM tg_project WHERE deleted = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.k, b.k) IS NOT NULL"""
)
def s12_dictionary_override(spark, sf):
    from loomwright.sources.readers import overridden

    t = read_table(spark, sf, "tg_project").where("project_name is not null")
    inner = t.where("deleted = 0").groupBy(F.col("project_name").alias("k")).agg(F.max("industry_type").alias("v"))
    outer = t.where("deleted = 1").groupBy(F.col("project_name").alias("k")).agg(F.max("tech_stack").alias("v"))
    return overridden(inner, outer, "k", "v")
