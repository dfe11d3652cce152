"""Scans, filters, joins, rankings and set operations over the project tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import filters as P
from loomwright.operators import ranking as R
from loomwright.operators.aggregates import count_if
from loomwright.plans.base import WITH, cases, projects, r6, requirements, tasks
from loomwright.session import read_table

QUERIES, ORACLE = {}, {}
PAIR = ["project", "req_id", "file", "method_name"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(WITH + "SELECT id, requirement_id FROM requirements WHERE project_id = (SELECT min(id) FROM projects) ")
def s1_project_scan(spark, sf):
    first = projects(spark, sf).agg(F.min("id").alias("project_id"))
    return requirements(spark, sf).join(F.broadcast(first), "project_id", "left_semi").select("id", "requirement_id").orderBy("requirement_id", "id")  # one row


@query("SELECT case_id, file_path, method_name FROM defect_detection_case WHERE case_id = 'DEFECT-00000007'")
def s2_point_lookup(spark, sf):
    return cases(spark, sf).where("case_id = 'DEFECT-00000007'").select("case_id", "file_path", "method_name")


@query("SELECT file_path, case_id, length(code_content) AS n FROM defect_detection_case")
def s3_ordered_scan(spark, sf):
    return cases(spark, sf).select("file_path", "case_id", F.length("code_content").cast("long").alias("n")).orderBy("file_path", "case_id")


@query("SELECT case_id, quality_precision FROM defect_detection_case WHERE severity = 'high' AND NOT false_positive")
def s4_f1_optional_filter(spark, sf):
    found = P.where_given(cases(spark, sf), severity="high", defect_type=None, defect_sub_type=" ").where("not false_positive")
    return found.select("case_id", "quality_precision").orderBy(F.desc("quality_precision"), "case_id")


@query(WITH + "SELECT t.id FROM tasks t WHERE project_id IN (SELECT id FROM projects WHERE create_user_id = (SELECT min(create_user_id) FROM projects))")
def f2_j12_visible_tasks(spark, sf):
    owner = projects(spark, sf).agg(F.min("create_user_id")).first()[0]
    return P.visible(tasks(spark, sf), projects(spark, sf), "project_id", owner).select("id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'voucher') OR contains(lower(source), 'voucher') OR contains(lower(doc_type), 'voucher')")
def f3_search(spark, sf):
    return P.search(read_table(spark, sf, "documents"), "VOUCHER", "text", "source", "doc_type").select("doc_id")


@query("SELECT DISTINCT id FROM tg_analysis_task WHERE deleted = 1")
def f4_recycle_bin(spark, sf):
    return read_table(spark, sf, "tg_analysis_task").where("deleted = 1").select("id").distinct()


@query("SELECT DISTINCT id FROM tg_requirement WHERE update_time < TIMESTAMP '2025-06-30' - INTERVAL 30 DAY AND deleted = 1")
def f5_expired(spark, sf):
    return P.expired(read_table(spark, sf, "tg_requirement").where("deleted = 1"), "update_time", "2025-06-30 00:00:00", 30).select("id").distinct()


@query(WITH + "SELECT id FROM requirements WHERE requirement_type IS NOT NULL AND trim(requirement_type) <> ''")
def f6_keyed(spark, sf):
    return requirements(spark, sf).where("requirement_type is not null and trim(requirement_type) <> ''").select("id")


@query("SELECT file_id FROM source_file WHERE regexp_matches(file_name, '^(src/api(/.*)?|.*Service.*)$') AND NOT regexp_matches(file_name, '^(.*Helper.*|.*\\.PY)$')")
def f7_scope(spark, sf):
    return read_table(spark, sf, "source_file").where(P.in_scope(F.col("file_name"), ["src/api*", "*Service*"], ["*Helper*", "*.PY"])).select("file_id")


@query("SELECT CASE WHEN contains(s, 'pass') OR (contains(s, 'sat') AND NOT contains(s, 'unsat')) THEN 'pass' WHEN contains(s, 'fail') OR contains(s, 'unsat') THEN 'fail' ELSE 'unknown' END AS bucket, count(*) AS n FROM (SELECT lower(coalesce(reason, '')) AS s FROM second_annotation) GROUP BY 1")
def f12_spec_buckets(spark, sf):
    from loomwright.functions.text import spec_bucket

    return read_table(spark, sf, "second_annotation").groupBy(spec_bucket(F.col("reason")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT t.id, coalesce(p.project_name, 'unknown') AS project FROM tasks t LEFT JOIN projects p ON p.id = t.project_id")
def j2_project_names(spark, sf):
    names = projects(spark, sf).select(F.col("id").alias("project_id"), "project_name")
    return tasks(spark, sf).join(names, "project_id", "left").select("id", F.coalesce("project_name", F.lit("unknown")).alias("project"))


@query(WITH + "SELECT p.id, coalesce(n, 0) AS open FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n FROM tasks WHERE lower(trim(status)) <> 'completed' GROUP BY 1) t ON t.project_id = p.id")
def j3_open_counts(spark, sf):
    late = tasks(spark, sf).where("lower(trim(status)) <> 'completed'").groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    return projects(spark, sf).select("id").join(late, "id", "left").fillna(0)


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY project, req_id, file, method_name ORDER BY defect_type, start_time, participant, end_time) AS rn FROM participant_verdict WHERE defect_type IS NOT NULL) SELECT c.pair_id, d.defect_type FROM consistency_pair c LEFT JOIN d ON d.project = c.project AND d.req_id = c.req_id AND d.file = c.file AND d.method_name = c.method_name AND d.rn = 1")
def j4_w4_first_defect(spark, sf):
    first = R.first_per(read_table(spark, sf, "participant_verdict").where("defect_type is not null"), PAIR, [F.asc("defect_type"), F.asc("start_time"), F.asc("participant"), F.asc("end_time")])
    return read_table(spark, sf, "consistency_pair").join(first.select(*PAIR, "defect_type"), PAIR, "left").select("pair_id", "defect_type")


_TOP = "SELECT pair_id, participant, minutes FROM (SELECT c.pair_id, v.participant, round(v.end_time - v.start_time, 6) AS minutes, v.start_time, row_number() OVER (PARTITION BY c.pair_id ORDER BY round(v.end_time - v.start_time, 6) DESC, v.participant, v.start_time, v.verdict) AS rn FROM participant_verdict v JOIN consistency_pair c ON v.project = c.project AND v.req_id = c.req_id AND v.file = c.file AND v.method_name = c.method_name) WHERE rn <= 3"


@query(_TOP)
def j5_w1_slowest_verdicts(spark, sf):
    rows = read_table(spark, sf, "participant_verdict").join(read_table(spark, sf, "consistency_pair"), PAIR).withColumn("minutes", F.round(F.col("end_time") - F.col("start_time"), 6))
    return R.top_per(rows, ["pair_id"], [F.desc("minutes"), F.asc("participant"), F.asc("start_time"), F.asc("verdict")], 3).select("pair_id", "participant", "minutes")


@query("SELECT file, pair_id FROM (SELECT file, pair_id, row_number() OVER (PARTITION BY file ORDER BY n DESC, pair_id) AS rn FROM (SELECT c.file, c.pair_id, count(v.verdict) AS n FROM consistency_pair c LEFT JOIN participant_verdict v ON v.project = c.project AND v.req_id = c.req_id AND v.file = c.file AND v.method_name = c.method_name GROUP BY 1, 2)) WHERE rn <= 3")
def j6_w2_most_judged(spark, sf):
    n = read_table(spark, sf, "consistency_pair").join(read_table(spark, sf, "participant_verdict"), PAIR, "left").groupBy("file", "pair_id").agg(F.count("verdict").alias("n"))
    return R.top_per(n, ["file"], [F.desc("n"), F.asc("pair_id")], 3).select("file", "pair_id")


@query("SELECT c.pair_id FROM consistency_pair c WHERE NOT EXISTS (SELECT 1 FROM second_annotation s WHERE s.pair_id = c.pair_id)")
def j9_j11_never_judged(spark, sf):
    return read_table(spark, sf, "consistency_pair").join(read_table(spark, sf, "second_annotation"), "pair_id", "left_anti").select("pair_id")


@query("SELECT c.pair_id, v.participant, s.annotator, s.consistent FROM participant_verdict v JOIN consistency_pair c ON v.project = c.project AND v.req_id = c.req_id AND v.file = c.file AND v.method_name = c.method_name JOIN second_annotation s ON s.pair_id = c.pair_id WHERE s.consistent IS NOT NULL")
def j8_j13_j14_composite_join(spark, sf):
    second = read_table(spark, sf, "second_annotation").where("consistent is not null").select("pair_id", "annotator", "consistent")
    return read_table(spark, sf, "participant_verdict").join(read_table(spark, sf, "consistency_pair"), PAIR).join(second, "pair_id").select("pair_id", "participant", "annotator", "consistent")


@query("SELECT case_id, round(CASE WHEN hi - lo < 0.001 THEN quality_precision ELSE (quality_precision - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT case_id, quality_precision, min(quality_precision) OVER (PARTITION BY defect_type) AS lo, max(quality_precision) OVER (PARTITION BY defect_type) AS hi FROM defect_detection_case)")
def w5_m3_minmax(spark, sf):
    from loomwright.functions.scoring import calibrated

    ranges = cases(spark, sf).groupBy("defect_type").agg(F.min("quality_precision").alias("lo"), F.max("quality_precision").alias("hi"))
    scaled = F.round(calibrated(F.col("quality_precision"), "minmax", lo=F.col("lo"), hi=F.col("hi")), 6)
    key = F.coalesce("defect_type", F.lit("")).alias("_t")
    return cases(spark, sf).select("case_id", "quality_precision", key).join(ranges.select(key, "lo", "hi"), "_t").select("case_id", scaled.alias("scaled"))


@query("SELECT case_id, row_number() OVER (ORDER BY quality_precision DESC NULLS LAST, case_id, file_path) - 1 AS ord FROM defect_detection_case")
def w6_global_rank(spark, sf):
    rows = cases(spark, sf).select("case_id", "file_path", (-F.coalesce("quality_precision", F.lit(-1.0))).alias("k"))
    return R.numbered(rows, ["k", "case_id", "file_path"]).select("case_id", F.col("ord").cast("long"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def w9_page(spark, sf):
    return R.page(read_table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 3, 20)


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT *, ceil(n * 0.1)::BIGINT AS want, greatest(1, n // ceil(n * 0.1)::BIGINT) AS stride FROM n) SELECT doc_id, i AS ord FROM p WHERE i % stride = 0 AND i / stride < want")
def w12_systematic_sample(spark, sf):
    return R.systematic_sample(read_table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.1).select("doc_id", F.col("ord").cast("long"))


@query("WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id FROM n WHERE i % greatest(1, ceil(n / 800.0)::BIGINT) = 0")
def w13_thinned(spark, sf):
    return R.thinned(read_table(spark, sf, "events").select("event_id"), ["event_id"], 800).select("event_id")


_QUEUE = "SELECT case_id, CASE WHEN severity = 'high' AND NOT false_positive THEN 0 WHEN quality_precision < 0.5 THEN 1 WHEN severity = 'medium' THEN 2 ELSE 3 END AS priority, file_path FROM defect_detection_case"


@query(
    """SELECT 'task' AS source, id::VARCHAR AS key, NULL AS detail FROM (SELECT DISTINCT id FROM tg_analysis_task WHERE deleted = 1) UNION ALL SELECT 'failure', failure_id::VARCHAR, reason FROM parse_failure UNION ALL SELECT 'case', case_id, defect_type FROM defect_detection_case WHERE false_positive"""
)
def u1_u2_concatenated(spark, sf):
    a = f4_recycle_bin(spark, sf).select(F.lit("task").alias("source"), F.col("id").cast("string").alias("key"))
    b = read_table(spark, sf, "parse_failure").select(F.lit("failure").alias("source"), F.col("failure_id").cast("string").alias("key"), F.col("reason").alias("detail"))
    c = cases(spark, sf).where("false_positive").select(F.lit("case").alias("source"), F.col("case_id").alias("key"), F.col("defect_type").alias("detail"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SELECT repo, file_name FROM source_file WHERE content IS NULL UNION SELECT repo, file_name FROM parse_failure")
def u3_union_distinct(spark, sf):
    return read_table(spark, sf, "source_file").where("content is null").select("repo", "file_name").unionByName(read_table(spark, sf, "parse_failure").select("repo", "file_name")).distinct()


@query("SELECT repo, file_name FROM parse_failure EXCEPT SELECT repo, file_name FROM source_file")
def u4_difference(spark, sf):
    return read_table(spark, sf, "parse_failure").select("repo", "file_name").subtract(read_table(spark, sf, "source_file").select("repo", "file_name"))


@query(r"""WITH t AS (SELECT case_id, list_distinct(list_transform(regexp_extract_all(original_text, '[A-Za-z]{3,}'), lambda w: lower(w))) AS a, list_distinct(list_transform(regexp_extract_all(code_content, '[A-Za-z]{3,}'), lambda w: lower(w))) AS b FROM defect_detection_case)
SELECT case_id, round(len(list_intersect(a, b))::DOUBLE / len(a), 6) AS overlap FROM t WHERE len(a) > 0 AND b IS NOT NULL""")
def u5_overlap(spark, sf):
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]{3,})"), F.lit(1)), F.lower))
    t = cases(spark, sf).select("case_id", words(F.col("original_text")).alias("a"), words(F.col("code_content")).alias("b")).where(F.size("a") > 0).where(F.col("b").isNotNull())
    return t.select("case_id", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("overlap"))
