"""Aggregates over projects, runs, verdicts and call logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions.scoring import grade, health
from loomwright.operators import aggregates as A
from loomwright.operators.ranking import first_per, top_n
from loomwright.plans.base import WITH, cases, day, projects, r6, requirements, tasks
from loomwright.session import read_table

AS_OF, FIRST_DAY, LAST_DAY = "2026-03-31", "2026-03-02", "2026-03-31"


def done():
    return F.lower(F.trim("status")) == "completed"


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(WITH + "SELECT strftime(create_time, '%Y-%m-%d') AS day, count(*) AS total, sum(CASE WHEN lower(trim(status)) = 'completed' THEN 1 ELSE 0 END)::BIGINT AS success FROM tasks WHERE create_time IS NOT NULL GROUP BY 1")
def a1_daily_tasks(spark, sf):
    return A.daily(tasks(spark, sf), "create_time", {"success": done()})


@query(WITH + "SELECT count(*) AS n FROM tasks WHERE create_time >= '2025-06-01' AND create_time < '2025-09-01' AND project_id IN (SELECT id FROM projects)")
def a2_range_count(spark, sf):
    span = (F.col("create_time") >= F.lit("2025-06-01").cast("timestamp_ntz")) & (F.col("create_time") < F.lit("2025-09-01").cast("timestamp_ntz"))
    return tasks(spark, sf).where(span).join(projects(spark, sf).select(F.col("id").alias("project_id")), "project_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1")
def a3_daily_logins(spark, sf):
    return read_table(spark, sf, "events").where("event_type = 'signup'").groupBy(day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    WITH
    + """SELECT count(*) AS projects, count(coverage_rate) AS analysed, floor(avg(coverage_rate) * 100 + 0.5)::BIGINT AS coverage, coalesce(sum(defect_count), 0)::BIGINT AS defects,
 sum(CASE WHEN create_time >= '2026-03-30' AND create_time < '2026-04-01' THEN 1 ELSE 0 END)::BIGINT AS this_week,
 sum(CASE WHEN create_time >= '2026-03-23' AND create_time < '2026-03-30' THEN 1 ELSE 0 END)::BIGINT AS last_week,
 CASE WHEN sum(CASE WHEN create_time >= '2026-03-23' AND create_time < '2026-03-30' THEN 1 ELSE 0 END) = 0 THEN ''
 ELSE floor((sum(CASE WHEN create_time >= '2026-03-30' AND create_time < '2026-04-01' THEN 1 ELSE 0 END) - sum(CASE WHEN create_time >= '2026-03-23' AND create_time < '2026-03-30' THEN 1 ELSE 0 END)) * 100.0
   / sum(CASE WHEN create_time >= '2026-03-23' AND create_time < '2026-03-30' THEN 1 ELSE 0 END) + 0.5)::BIGINT::VARCHAR || '%' END AS delta FROM projects"""
)
def a4_workspace(spark, sf):
    as_of = F.to_date(F.lit(AS_OF))
    week = F.date_trunc("week", as_of).cast("timestamp_ntz")
    last = F.date_sub(F.date_trunc("week", as_of).cast("date"), 7).cast("timestamp_ntz")
    tomorrow = F.date_add(as_of, 1).cast("timestamp_ntz")
    t = F.col("create_time")
    s = projects(spark, sf).agg(
        F.count(F.lit(1)).alias("projects"), F.count("coverage_rate").alias("analysed"), F.floor(F.avg("coverage_rate") * 100 + 0.5).alias("coverage"), F.coalesce(F.sum("defect_count"), F.lit(0)).cast("long").alias("defects"),
        A.count_if((t >= week) & (t < tomorrow)).alias("this_week"), A.count_if((t >= last) & (t < week)).alias("last_week"),
    )
    delta = F.floor((F.col("this_week") - F.col("last_week")) * 100.0 / F.col("last_week") + 0.5)
    return s.withColumn("delta", F.when(F.col("last_week") == 0, "").otherwise(F.concat(delta.cast("string"), F.lit("%"))))


@query(
    WITH
    + """SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(t.n, 0) AS tasks, coalesce(a.n, 0) AS annotations
FROM range(DATE '2026-03-02', DATE '2026-04-01', INTERVAL 1 DAY) x(d)
LEFT JOIN (SELECT strftime(create_time, '%Y-%m-%d') AS day, count(*) AS n FROM tasks GROUP BY 1) t ON t.day = strftime(d, '%Y-%m-%d')
LEFT JOIN (SELECT strftime(generated_at, '%Y-%m-%d') AS day, count(*) AS n FROM second_annotation GROUP BY 1) a ON a.day = strftime(d, '%Y-%m-%d')"""
)
def a5_usage_trend(spark, sf):
    axis = A.day_axis(spark, FIRST_DAY, LAST_DAY)
    runs = tasks(spark, sf).groupBy(day("create_time").alias("day")).agg(F.count(F.lit(1)).alias("tasks"))
    seen = read_table(spark, sf, "second_annotation").groupBy(day("generated_at").alias("day")).agg(F.count(F.lit(1)).alias("annotations"))
    return A.on_axis(A.on_axis(axis, runs, "day", ["tasks"]), seen, "day", ["annotations"])


_STATES = ["created", "analyzing", "completed", "failed", "archived", "paused"]


@query(WITH + "SELECT k AS key, (SELECT count(*) FROM projects WHERE lower(trim(status)) = k) AS n FROM unnest(['created', 'analyzing', 'completed', 'failed', 'archived', 'paused']) x(k)")
def a6_status_frequency(spark, sf):
    return A.seeded_counts(spark, projects(spark, sf), F.lower(F.trim("status")), _STATES)


@query(
    """SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(sum(CASE WHEN NOT consistent THEN 1 END), 0)::BIGINT AS serious, coalesce(sum(CASE WHEN consistent THEN 1 END), 0)::BIGINT AS general
FROM range(DATE '2026-03-02', DATE '2026-04-01', INTERVAL 1 DAY) x(d) LEFT JOIN second_annotation a ON strftime(generated_at, '%Y-%m-%d') = strftime(d, '%Y-%m-%d') GROUP BY 1"""
)
def a7_defect_trend(spark, sf):
    level = F.when(~F.col("consistent"), "serious").when(F.col("consistent"), "general")
    rows = read_table(spark, sf, "second_annotation").select(day("generated_at").alias("day"), level.alias("level"))
    pivot = rows.groupBy("day").pivot("level", ["serious", "general"]).agg(F.count(F.lit(1)))
    return A.on_axis(A.day_axis(spark, FIRST_DAY, LAST_DAY), pivot, "day", ["serious", "general"])


@query("SELECT coalesce(nullif(trim(defect_type), ''), 'unknown') AS type, count(*) AS n FROM second_annotation GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def a7_top_types(spark, sf):
    kind = F.coalesce(F.nullif(F.trim("defect_type"), F.lit("")), F.lit("unknown"))
    return top_n(read_table(spark, sf, "second_annotation").groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("type")], 6)


@query("SELECT severity, count(*) AS total, sum(CASE WHEN false_positive THEN 1 ELSE 0 END)::BIGINT AS fp, round(sum(CASE WHEN false_positive THEN 1 ELSE 0 END) * 1000.0 / count(*)) / 10 AS fp_rate FROM defect_detection_case GROUP BY 1")
def a8_board(spark, sf):
    n, fp = F.count(F.lit(1)), A.count_if(F.col("false_positive"))
    return cases(spark, sf).groupBy("severity").agg(n.alias("total"), fp.alias("fp"), (F.round(fp * 1000.0 / n) / 10).alias("fp_rate"))


@query(
    WITH
    + """, o AS (SELECT project_id, count(*) AS open, sum(CASE WHEN lower(trim(status)) = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed FROM tasks WHERE lower(trim(status)) <> 'completed' GROUP BY 1)
SELECT coalesce(industry_type, '') AS industry, count(*) AS projects, sum(coalesce(open, 0))::BIGINT AS open, sum(coalesce(failed, 0))::BIGINT AS failed, round(sum(coverage_rate::DECIMAL(18, 6))::DOUBLE / count(coverage_rate), 6) AS coverage, grouping(coalesce(industry_type, ''))::INT AS is_total
FROM projects p LEFT JOIN o ON o.project_id = p.id GROUP BY ROLLUP (coalesce(industry_type, ''))"""
)
def a9_portfolio(spark, sf):
    late = tasks(spark, sf).where(~done()).groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("open"), A.count_if(F.lower(F.trim("status")) == "failed").alias("failed"))
    rows = projects(spark, sf).withColumn("industry", F.coalesce("industry_type", F.lit(""))).join(late, "id", "left").fillna(0, ["open", "failed"])
    return rows.rollup("industry").agg(
        F.count(F.lit(1)).alias("projects"), F.sum("open").alias("open"), F.sum("failed").alias("failed"), F.round(F.try_divide(F.sum(F.col("coverage_rate").cast("decimal(18,6)")).cast("double"), F.count("coverage_rate")), 6).alias("coverage"), F.grouping("industry").cast("int").alias("is_total")
    )


@query(
    """WITH n AS (SELECT defect_type, case_id, file_path FROM defect_detection_case ORDER BY case_id DESC, file_path LIMIT 200),
e AS (SELECT defect_type, case_id AS example FROM n QUALIFY row_number() OVER (PARTITION BY defect_type ORDER BY case_id DESC, file_path) = 1)
SELECT c.defect_type AS type, c.severity, count(*) AS hits, max(e.example) AS example FROM defect_detection_case c LEFT JOIN e ON e.defect_type IS NOT DISTINCT FROM c.defect_type GROUP BY 1, 2"""
)
def a10_patterns(spark, sf):
    newest = top_n(cases(spark, sf).select("defect_type", "case_id", "file_path"), [F.desc("case_id"), F.asc("file_path")], 200)
    example = first_per(newest, ["defect_type"], [F.desc("case_id"), F.asc("file_path")]).select(F.col("defect_type").alias("_t"), F.col("case_id").alias("example"))
    hits = cases(spark, sf).groupBy("defect_type", "severity").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(F.broadcast(example), F.col("defect_type").eqNullSafe(F.col("_t")), "left").select(F.col("defect_type").alias("type"), "severity", "hits", "example")  # at most 200 rows


@query(
    WITH
    + """SELECT project_id, count(*) AS total, count(DISTINCT CASE WHEN invariants IS NOT NULL THEN requirement_id END) AS covered,
 round(count(DISTINCT CASE WHEN invariants IS NOT NULL THEN requirement_id END) * 100.0 / count(DISTINCT requirement_id), 2) AS coverage,
 sum(CASE WHEN priority = 'must' THEN 1 ELSE 0 END)::BIGINT AS high, greatest(0, 100 - 10 * sum(CASE WHEN priority = 'must' THEN 1 ELSE 0 END) - 3 * sum(CASE WHEN priority = 'important' THEN 1 ELSE 0 END))::BIGINT AS score
FROM requirements WHERE project_id IS NOT NULL GROUP BY 1"""
)
def a11_project_stats(spark, sf):
    high, mid = A.count_if(F.col("priority") == "must"), A.count_if(F.col("priority") == "important")
    covered = F.countDistinct(F.when(F.col("invariants").isNotNull(), F.col("requirement_id")))
    return requirements(spark, sf).where("project_id is not null").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), covered.alias("covered"), F.round(covered * 100.0 / F.countDistinct("requirement_id"), 2).alias("coverage"), high.alias("high"), F.greatest(F.lit(0), 100 - 10 * high - 3 * mid).cast("long").alias("score")
    )


@query(
    WITH
    + """, r AS (SELECT project_id, count(DISTINCT requirement_id) AS reqs FROM requirements GROUP BY 1), c AS (SELECT project_id, round(avg(threshold_t1), 6) AS t1 FROM tasks GROUP BY 1)
SELECT t.id AS task_id, coalesce(strftime(t.end_time, '%Y-%m-%d %H:%M'), '') AS finished, coalesce(r.reqs, 0) AS reqs, c.t1 FROM tasks t LEFT JOIN r ON r.project_id = t.project_id LEFT JOIN c ON c.project_id = t.project_id WHERE lower(trim(t.status)) = 'completed'"""
)
def a12_quality_trend(spark, sf):
    reqs = requirements(spark, sf).groupBy("project_id").agg(F.countDistinct("requirement_id").alias("reqs"))
    mean = tasks(spark, sf).groupBy("project_id").agg(r6(F.avg("threshold_t1"), "t1"))
    finished = tasks(spark, sf).where(done()).join(reqs, "project_id", "left").join(mean, "project_id", "left")
    return finished.select(F.col("id").alias("task_id"), F.coalesce(F.date_format("end_time", "yyyy-MM-dd HH:mm"), F.lit("")).alias("finished"), F.coalesce("reqs", F.lit(0)).alias("reqs"), "t1")


@query("SELECT coalesce(decision_path, 'RULE') AS path, count(*) AS n, sum(CASE WHEN annotator LIKE 'llm%' THEN 1 ELSE 0 END)::BIGINT AS by_model FROM second_annotation GROUP BY 1")
def a14_judge_paths(spark, sf):
    return read_table(spark, sf, "second_annotation").groupBy(F.coalesce("decision_path", F.lit("RULE")).alias("path")).agg(F.count(F.lit(1)).alias("n"), A.count_if(F.col("annotator").startswith("llm")).alias("by_model"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS scene, count(*) AS calls, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS success, floor(sum(value) / count(*))::BIGINT AS latency
FROM events GROUP BY GROUPING SETS ((), (strftime(ts, '%Y-%m-%d')), (event_type))"""
)
def a15_call_usage(spark, sf):
    # an aggregate over a grouping column sees its nulled form, so success is computed beside it
    calls = read_table(spark, sf, "events").select(day("ts").alias("day"), F.col("event_type").alias("scene"), "value", (F.col("event_type") != "error").alias("ok"))
    sets = calls.groupingSets([[], ["day"], ["scene"]], "day", "scene")
    return sets.agg(F.count(F.lit(1)).alias("calls"), A.count_if(F.col("ok")).alias("success"), F.floor(F.sum("value") / F.count(F.lit(1))).alias("latency"))


@query(WITH + "SELECT p.id, round(p.coverage_rate, 4) AS coverage, (coalesce(p.defect_count, 0) + coalesce(t.n, 0))::BIGINT AS defects FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n FROM tasks WHERE lower(trim(status)) = 'failed' GROUP BY 1) t ON t.project_id = p.id")
def a16_write_back(spark, sf):
    failed = tasks(spark, sf).where(F.lower(F.trim("status")) == "failed").groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return projects(spark, sf).join(failed, "id", "left").select("id", F.round("coverage_rate", 4).alias("coverage"), (F.coalesce("defect_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("defects"))


_CONFUSION = """SELECT tp, fp, fn, tn, CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) END AS accuracy, CASE WHEN tp + fn = 0 THEN 0 ELSE round(fn::DOUBLE / (tp + fn), 6) END AS miss_rate,
 CASE WHEN fp + tn = 0 THEN 0 ELSE round(fp::DOUBLE / (fp + tn), 6) END AS fp_rate FROM c"""


@query("WITH c AS (SELECT sum((NOT false_positive AND quality_precision >= 0.5)::INT)::BIGINT AS tp, sum((false_positive AND quality_precision >= 0.5)::INT)::BIGINT AS fp, sum((NOT false_positive AND quality_precision < 0.5)::INT)::BIGINT AS fn, sum((false_positive AND quality_precision < 0.5)::INT)::BIGINT AS tn FROM defect_detection_case) " + _CONFUSION)
def a19_confusion(spark, sf):
    return A.confusion(cases(spark, sf), ~F.col("false_positive"), F.col("quality_precision") >= 0.5)


@query("SELECT count(*) AS n, round(corr(quality_precision, quality_recall), 6) AS correlation FROM defect_detection_case WHERE quality_precision IS NOT NULL AND quality_recall IS NOT NULL")
def a23_correlation(spark, sf):
    return A.correlation(cases(spark, sf), "quality_precision", "quality_recall")


_SIGNALS = {"comment": r"//|/\*|#", "loop": r"\bfor\b|\bwhile\b", "branch": r"\bif\b", "text": "\"|'", "call": r"\w\("}
_SIGNAL_SQL = " UNION ALL ".join(f"SELECT '{k}' AS signal, NOT false_positive AS bad, regexp_matches(code_content, '{p.replace(chr(39), chr(39) * 2)}')::INT AS hit, (length(code_content) - length(regexp_replace(code_content, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')))::DOUBLE / greatest(length(code_content), 1) AS x FROM defect_detection_case WHERE code_content IS NOT NULL" for k, p in _SIGNALS.items())


@query(
    f"""WITH s AS ({_SIGNAL_SQL}), m AS (SELECT signal, round(avg(CASE WHEN bad THEN x END), 6) AS mean_defect, round(avg(CASE WHEN NOT bad THEN x END), 6) AS mean_ok, round(avg(CASE WHEN bad THEN hit END), 6) AS hit_defect, round(avg(CASE WHEN NOT bad THEN hit END), 6) AS hit_ok FROM s GROUP BY 1)
SELECT *, CASE WHEN mean_defect - mean_ok > 0.01 THEN 'defect' WHEN mean_defect - mean_ok < -0.01 THEN 'ok' ELSE 'none' END AS direction FROM m"""
)
def a24_signals(spark, sf):
    code = F.col("code_content")
    signals = F.array(*[F.struct(F.lit(k).alias("signal"), code.rlike(p).cast("int").alias("hit"), ((F.length(code) - F.length(F.regexp_replace(code, p, ""))) / F.greatest(F.length(code), F.lit(1))).alias("x")) for k, p in _SIGNALS.items()])
    rows = cases(spark, sf).where(code.isNotNull()).select((~F.col("false_positive")).alias("bad"), F.explode(signals).alias("s")).select("bad", "s.*")
    mean = lambda c, when, name: F.round(F.avg(F.when(when, c)), 6).alias(name)
    m = rows.groupBy("signal").agg(mean(F.col("x"), F.col("bad"), "mean_defect"), mean(F.col("x"), ~F.col("bad"), "mean_ok"), mean(F.col("hit"), F.col("bad"), "hit_defect"), mean(F.col("hit"), ~F.col("bad"), "hit_ok"))
    gap = F.col("mean_defect") - F.col("mean_ok")
    return m.withColumn("direction", F.when(gap > 0.01, "defect").when(gap < -0.01, "ok").otherwise("none"))


def _vote():
    return F.when(F.lower(F.trim("verdict")).isin("defective", "不一致", "有缺陷"), True).when(F.lower(F.trim("verdict")).isin("consistent", "一致", "无缺陷"), False)
_VOTE_SQL = "CASE WHEN lower(trim(verdict)) IN ('defective', '不一致', '有缺陷') THEN true WHEN lower(trim(verdict)) IN ('consistent', '一致', '无缺陷') THEN false END"
_TRUTH_SQL = "t AS (SELECT pair_id, sum((NOT consistent)::INT) * 2 > count(*) AS bad FROM second_annotation WHERE consistent IS NOT NULL GROUP BY 1)"


@query(
    f"""WITH {_TRUTH_SQL}, v AS (SELECT upper(trim(participant)) AS p, {_VOTE_SQL} AS said, bad, end_time - start_time AS minutes FROM participant_verdict v
 JOIN consistency_pair c ON v.project = c.project AND v.req_id = c.req_id AND v.file = c.file AND v.method_name = c.method_name JOIN t ON t.pair_id = c.pair_id),
r AS (SELECT p, count(*) AS n, sum((said AND bad)::INT)::BIGINT AS tp, sum(bad::INT)::BIGINT AS defects, sum((said AND NOT bad)::INT)::BIGINT AS fp, sum((NOT bad)::INT)::BIGINT AS fine, sum(minutes) AS minutes FROM v WHERE said IS NOT NULL GROUP BY 1)
SELECT count(*) AS participants, round(avg(CASE WHEN defects = 0 THEN 0 ELSE tp::DOUBLE / defects END), 6) AS macro_detect, round(avg(CASE WHEN fine = 0 THEN 0 ELSE fp::DOUBLE / fine END), 6) AS macro_fp, round(sum(tp)::DOUBLE / sum(defects), 6) AS micro_detect, round(sum(minutes), 2) AS minutes FROM r"""
)
def a25_human_baseline(spark, sf):
    truth = A.majority(read_table(spark, sf, "second_annotation").where("consistent is not null"), "pair_id", ~F.col("consistent")).select("pair_id", F.col("verdict").alias("bad"))
    pairs = read_table(spark, sf, "consistency_pair").join(truth, "pair_id")
    said = read_table(spark, sf, "participant_verdict").join(pairs, ["project", "req_id", "file", "method_name"]).select(F.upper(F.trim("participant")).alias("p"), _vote().alias("said"), "bad", (F.col("end_time") - F.col("start_time")).alias("minutes"))
    said, bad = said.where("said is not null"), F.col("bad")
    per = said.groupBy("p").agg(A.count_if(F.col("said") & bad).alias("tp"), A.count_if(bad).alias("defects"), A.count_if(F.col("said") & ~bad).alias("fp"), A.count_if(~bad).alias("fine"), F.sum("minutes").alias("minutes"))
    return per.agg(F.count(F.lit(1)).alias("participants"), r6(F.avg(A.rate(F.col("tp"), F.col("defects"))), "macro_detect"), r6(F.avg(A.rate(F.col("fp"), F.col("fine"))), "macro_fp"), r6(F.sum("tp") / F.sum("defects"), "micro_detect"), F.round(F.sum("minutes"), 2).alias("minutes"))


@query(f"SELECT pair_id, sum(v::INT)::BIGINT AS yes, sum((NOT v)::INT)::BIGINT AS no, sum(v::INT) > sum((NOT v)::INT) AS verdict FROM (SELECT pair_id, {_VOTE_SQL} AS v FROM participant_verdict v JOIN consistency_pair c ON v.project = c.project AND v.req_id = c.req_id AND v.file = c.file AND v.method_name = c.method_name) WHERE v IS NOT NULL GROUP BY 1")
def a26_majority(spark, sf):
    votes = read_table(spark, sf, "participant_verdict").join(read_table(spark, sf, "consistency_pair"), ["project", "req_id", "file", "method_name"])
    return A.majority(votes.withColumn("v", _vote()).where("v is not null"), "pair_id", F.col("v"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def a27_median(spark, sf):
    return read_table(spark, sf, "events").groupBy("event_type").agg(r6(F.percentile("value", F.lit(0.5)), "median"))


@query(
    WITH
    + """, s AS (SELECT id, CASE WHEN coverage_rate IS NULL THEN floor(0.55 * greatest(0.0, 100 - 8.0 * coalesce(defect_count, 0)) + 0.45 * st + 0.5) ELSE floor(55.0 * coverage_rate + 0.25 * greatest(0.0, 100 - 8.0 * coalesce(defect_count, 0)) + 0.2 * st + 0.5) END::BIGINT AS score
FROM (SELECT *, CASE WHEN lower(trim(status)) = 'completed' THEN 100.0 WHEN lower(trim(status)) = 'failed' THEN 20.0 ELSE 60.0 END AS st FROM projects))
SELECT id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade FROM s"""
)
def a28_health(spark, sf):
    state = F.when(done(), 100.0).when(F.lower(F.trim("status")) == "failed", 20.0).otherwise(60.0)
    return projects(spark, sf).select("id", health(F.col("coverage_rate"), F.coalesce("defect_count", F.lit(0)), state).cast("long").alias("score")).withColumn("grade", grade(F.col("score")))


@query(WITH + "SELECT id, project_id, strftime(create_time, '%Y-%m-%d %H:%M') AS created FROM tasks WHERE create_time IS NOT NULL ORDER BY create_time DESC, id LIMIT 15")
def a30_recent_tasks(spark, sf):
    return top_n(tasks(spark, sf).where("create_time is not null"), [F.desc("create_time"), F.asc("id")], 15).select("id", "project_id", F.date_format("create_time", "yyyy-MM-dd HH:mm").alias("created"))


@query("SELECT event_type AS stage, count(*) AS calls, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a31_stage_usage(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, event_type <> 'purchase' AS failed FROM events), r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS length FROM r WHERE failed GROUP BY user_id, run HAVING count(*) >= 5"""
)
def k1_failure_runs(spark, sf):
    runs = A.failure_runs(read_table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase", 5)
    return runs.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})
