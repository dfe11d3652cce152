"""Best partners, summaries, ids, review queues, extracted states, graphs and formats of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import extraction as E
from loomwright.functions import text as T
from loomwright.operators import aggregates as A
from loomwright.operators import filters as P
from loomwright.operators import ranking as R
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


@query("SELECT pair_id, method_name FROM consistency_pair WHERE method_name <> '[字段清单]'")
def f8_without_field_lists(spark, sf):
    return read_table(spark, sf, "consistency_pair").where(F.col("method_name") != "[字段清单]").select("pair_id", "method_name")


@query(WITH + "SELECT id, coalesce(nullif(trim(industry_type), ''), 'unknown') AS industry, coalesce(nullif(trim(tech_stack), ''), '-') AS stack FROM projects")
def f11_defaulted(spark, sf):
    return projects(spark, sf).select("id", P.defaulted(F.col("industry_type"), "unknown").alias("industry"), P.defaulted(F.col("tech_stack"), "-").alias("stack"))


_FIRST = "row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn"


@query(WITH + f"SELECT project_id, id FROM (SELECT project_id, id, {_FIRST.format(by='project_id', order='create_time NULLS LAST, id, original_text')} FROM requirements WHERE project_id IS NOT NULL) WHERE rn = 1")
def w3_first_requirement(spark, sf):
    rows = requirements(spark, sf).where("project_id is not null")
    return R.first_per(rows, ["project_id"], [F.asc_nulls_last("create_time"), F.asc("id"), F.asc("original_text")]).select("project_id", "id")


# a pair's similarity: the share of its verdicts that find it consistent
_SIM = """c AS (SELECT DISTINCT pair_id, project, req_id, file, method_name FROM consistency_pair),
s AS (SELECT c.pair_id, c.project, c.req_id, c.file, c.method_name, round(avg(CASE WHEN lower(trim(v.verdict)) = 'consistent' THEN 1.0 ELSE 0.0 END), 6) AS sim FROM c JOIN participant_verdict v ON v.project = c.project AND v.req_id = c.req_id AND v.file = c.file AND v.method_name = c.method_name GROUP BY ALL)"""


def _similar(spark, sf):
    pairs = read_table(spark, sf, "consistency_pair").select("pair_id", *PAIR).distinct()
    said = F.coalesce(F.lower(F.trim("verdict")) == "consistent", F.lit(False)).cast("double")
    return pairs.join(read_table(spark, sf, "participant_verdict"), PAIR).groupBy("pair_id", *PAIR).agg(F.round(F.avg(said), 6).alias("sim"))


def _best(spark, sf, side, other):
    """Each item of one side with the best of its three likeliest partners, and that partner; items without one too."""
    items = read_table(spark, sf, "consistency_pair").select(*side).distinct()
    top = R.top_per(_similar(spark, sf), side, [F.desc("sim"), F.asc("pair_id")], 3).where("rank = 1")
    partners = read_table(spark, sf, "consistency_pair").select("pair_id", *other).distinct()
    return items.join(top.select(*side, "pair_id", "sim"), side, "left").join(partners, "pair_id", "left").select(*side, "pair_id", "sim", *other)


_BEST = "SELECT {i}, t.pair_id, t.sim, {o} FROM (SELECT DISTINCT {side} FROM consistency_pair) i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {side} ORDER BY sim DESC, pair_id) AS rn FROM s) t ON {on} AND t.rn = 1"


def _best_sql(side, other):
    return "WITH " + _SIM + " " + _BEST.format(i=", ".join(f"i.{c}" for c in side), o=", ".join(f"t.{c}" for c in other), side=", ".join(side), on=" AND ".join(f"t.{c} = i.{c}" for c in side))


@query(_best_sql(["project", "req_id"], ["file", "method_name"]))
def j5_requirement_best_code(spark, sf):
    return _best(spark, sf, ["project", "req_id"], ["file", "method_name"])


@query(_best_sql(["project", "file", "method_name"], ["req_id"]))
def j6_code_best_requirement(spark, sf):
    return _best(spark, sf, ["project", "file", "method_name"], ["req_id"])


@query(WITH + ", b AS (SELECT requirement_id, left(original_text, 40) AS summary FROM (SELECT requirement_id, original_text, row_number() OVER (PARTITION BY requirement_id ORDER BY id, original_text) AS rn FROM requirements WHERE original_text IS NOT NULL) WHERE rn = 1) SELECT p.pair_id, p.req_id, b.summary FROM consistency_pair p LEFT JOIN b ON b.requirement_id = p.req_id")
def j7_summaries(spark, sf):
    first = R.first_per(requirements(spark, sf).where("original_text is not null"), ["requirement_id"], [F.asc("id"), F.asc("original_text")])
    summaries = first.select(F.col("requirement_id").alias("req_id"), F.left("original_text", F.lit(40)).alias("summary"))
    return read_table(spark, sf, "consistency_pair").join(summaries, "req_id", "left").select("pair_id", "req_id", "summary")


@query(f"WITH {_SIM}, u AS (SELECT DISTINCT file, method_name FROM consistency_pair), m AS (SELECT file, method_name, max(sim) AS sim, bool_or(sim > 0.8) AS matched FROM s GROUP BY 1, 2) SELECT u.file, u.method_name, coalesce(m.sim, 0)::DOUBLE AS sim FROM u LEFT JOIN m USING (file, method_name) WHERE NOT coalesce(matched, false) AND coalesce(m.sim, 0) < 0.4")
def j10_a18_out_of_scope_code(spark, sf):
    """Code without a match (similarity above 0.8) whose highest similarity stays below 0.4, 0 where there is none."""
    pairs, units = _similar(spark, sf), read_table(spark, sf, "consistency_pair").select("file", "method_name").distinct()
    most = pairs.groupBy("file", "method_name").agg(F.max("sim").alias("sim"))
    bare = units.join(pairs.where("sim > 0.8"), ["file", "method_name"], "left_anti").join(most, ["file", "method_name"], "left")
    return bare.select("file", "method_name", F.coalesce("sim", F.lit(0.0)).alias("sim")).where("sim < 0.4")


@query(WITH + "SELECT id, md5(concat_ws(' ', original_text, requirement_type, state_set, invariants, constraint_rules)) AS doc FROM requirements")
def t11_requirement_documents(spark, sf):
    return requirements(spark, sf).select("id", F.md5(F.concat_ws(" ", "original_text", "requirement_type", "state_set", "invariants", "constraint_rules")).alias("doc"))


@query("SELECT case_id, 'CODE-' || left(sha256(concat_ws('|', file_path, class_name, method_name)), 8) AS code_id, 'DEF-' || left(sha256(case_id), 8) AS defect_id FROM defect_detection_case")
def t31_business_ids(spark, sf):
    """Ids from the content, so that a second run gives the same."""
    short = lambda c: F.left(F.sha2(c, 256), F.lit(8))
    return cases(spark, sf).select("case_id", F.concat(F.lit("CODE-"), short(F.concat_ws("|", "file_path", "class_name", "method_name"))).alias("code_id"), F.concat(F.lit("DEF-"), short(F.col("case_id"))).alias("defect_id"))


@query(WITH + "SELECT id, floor(epoch(create_time))::BIGINT - 28800 AS epoch_seconds, coalesce(strftime(end_time, '%Y-%m-%d %H:%M'), '') AS ended FROM tasks")
def d5_d6_times(spark, sf):
    """Seconds since the epoch of times that are local at eight hours east, whatever the session's zone, and minutes as text."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', create_time)") - 8 * 3600
    return tasks(spark, sf).select("id", seconds.alias("epoch_seconds"), F.coalesce(F.date_format("end_time", "yyyy-MM-dd HH:mm"), F.lit("")).alias("ended"))


@query(
    """WITH v AS (SELECT pair_id, lower(trim(annotator)) AS who, bool_or(NOT consistent) AS bad FROM second_annotation WHERE consistent IS NOT NULL GROUP BY 1, 2),
s AS (SELECT a.who AS first, b.who AS second, count(*) AS n, sum((a.bad = b.bad)::INT)::DOUBLE AS same, sum(a.bad::INT)::DOUBLE AS a1, sum(b.bad::INT)::DOUBLE AS b1 FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.who < b.who GROUP BY 1, 2),
p AS (SELECT *, same / n AS po, a1 / n * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS pe FROM s)
SELECT first, second, n, round(po, 6) AS po, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM p"""
)
def a22_kappa_all_pairs(spark, sf):
    """Agreement of every two second annotators on the pairs that both judged."""
    v = read_table(spark, sf, "second_annotation").where("consistent is not null").groupBy("pair_id", F.lower(F.trim("annotator")).alias("who")).agg(F.bool_or(~F.col("consistent")).alias("bad"))
    both = v.select("pair_id", F.col("who").alias("first"), F.col("bad").alias("a")).join(v.select("pair_id", F.col("who").alias("second"), F.col("bad").alias("b")), "pair_id").where("first < second")
    return A.kappa(both, F.col("a"), F.col("b"), ["first", "second"]).select("first", "second", "n", "po", "kappa")


_REVIEW = """q AS (SELECT case_id, file_path, false_positive AS defect, row_number() OVER (ORDER BY case_id, file_path) AS ord,
 CASE WHEN severity = 'high' AND NOT false_positive THEN 0 WHEN coalesce(quality_precision, 0) <= 0.52 THEN 1 WHEN coalesce(abs(quality_precision - quality_recall), 0) >= 0.25 THEN 2 ELSE 3 END AS class FROM defect_detection_case),
n AS (SELECT *, count(*) FILTER (WHERE class < 3) OVER () AS first, row_number() OVER (PARTITION BY class ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY class) AS size FROM q),
p AS (SELECT *, CASE WHEN class < 3 THEN FALSE ELSE i % greatest(1, size // ceil(size * 0.05)::BIGINT) = 0 AND i / greatest(1, size // ceil(size * 0.05)::BIGINT) < ceil(size * 0.05) END AS probe FROM n),
o AS (SELECT *, CASE WHEN class < 3 OR probe THEN row_number() OVER (ORDER BY CASE WHEN class < 3 THEN class WHEN probe THEN 3 ELSE 4 END, ord) END AS place FROM p),
r AS (SELECT case_id, file_path, defect, ord, CASE WHEN place <= 200 THEN CASE WHEN class < 3 THEN class ELSE 3 END END AS reason, CASE WHEN place <= 200 THEN place END AS place, class FROM o)"""


def _review(spark, sf):
    gray = F.coalesce("quality_precision", F.lit(0.0)) <= 0.52
    risky = F.coalesce(F.abs(F.col("quality_precision") - F.col("quality_recall")), F.lit(0.0)) >= 0.25
    classes = [(F.col("severity") == "high") & ~F.col("false_positive"), gray, risky]
    rows = cases(spark, sf).select("case_id", "file_path", "severity", "false_positive", "quality_precision", "quality_recall")
    return R.review_plan(rows, classes, ["case_id", "file_path"], 0.05, 200)


@query(f"WITH {_REVIEW} SELECT case_id, file_path, reason, place FROM r WHERE place IS NOT NULL")
def w14_review_plan(spark, sf):
    return _review(spark, sf).where("place is not null").select("case_id", "file_path", "reason", "place")


@query(f"WITH {_REVIEW}, d AS (SELECT count(*) AS judged, count(*) FILTER (WHERE defect) AS bad FROM r WHERE reason = 3) SELECT case_id, file_path FROM (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM r WHERE class = 3 AND place IS NULL), d WHERE k <= CASE WHEN bad > 0 AND bad::DOUBLE / judged >= 0.01 THEN 50 ELSE 0 END")
def w15_probe_escalation(spark, sf):
    """If enough probes prove defective, the first 50 of the rest join the queue."""
    plan = _review(spark, sf)
    return R.escalated(plan, F.col("false_positive"), ["case_id", "file_path"], 0.01, 50).select("case_id", "file_path")


_CHAINS = "regexp_extract_all({t}, '" + E.CHAIN + "')"
_EXPLICIT = "list_concat(flatten(list_transform(" + _CHAINS + ", lambda m: [regexp_extract(m, '" + E.CHAIN + "', 1), regexp_extract(m, '" + E.CHAIN + "', 2)])), regexp_extract_all({t}, '" + E.NAMED + "', 1))"
_ARROWS = "list_transform(" + _CHAINS + ", lambda m: lower(regexp_extract(m, '" + E.CHAIN + "', 1) || '->' || regexp_extract(m, '" + E.CHAIN + "', 2)))"
_UNIQUE = "list_filter({x}, lambda s, i: list_position({x}, s) = i)"


@query(
    WITH
    + ", t AS (SELECT id, original_text, list_transform("
    + _EXPLICIT.replace("{t}", "original_text")
    + ", lambda s: lower(s)) AS e, "
    + _ARROWS.replace("{t}", "original_text")
    + f" AS a FROM requirements WHERE original_text IS NOT NULL), u AS (SELECT id, original_text, {_UNIQUE.format(x='e')} AS e, {_UNIQUE.format(x='a')} AS a FROM t) "
    + f"SELECT id, array_to_string(e, ',') AS states, coalesce(list_filter(e, lambda s: regexp_matches(s, '{'|'.join(E.INITIAL_PARTS)}'))[1], 'initial') AS initial, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE list_filter(['initial->processing', CASE WHEN contains(original_text, '成功') THEN 'processing->completed' END, CASE WHEN contains(original_text, '失败') THEN 'processing->failed' END], lambda x: x IS NOT NULL) END, ',') AS transitions FROM u"
)
def t22_explicit_states(spark, sf):
    t = F.col("original_text")
    return requirements(spark, sf).where(t.isNotNull()).select("id", F.array_join(E.explicit_states(t), ",").alias("states"), E.initial_state(t).alias("initial"), F.array_join(E.explicit_transitions(t), ",").alias("transitions"))


_INVARIANT = "必须|不得|不能|始终|must|never|always"


@query(WITH + rf"SELECT id, array_to_string(list_transform(list_filter(list_transform(string_split_regex(original_text, '[。；;！!？?\n]'), lambda s: trim(s)), lambda s: s <> '' AND regexp_matches(s, '{_INVARIANT}')), lambda s: left(s, 60)), '|') AS invariants FROM requirements WHERE original_text IS NOT NULL")
def t23_invariants(spark, sf):
    t = F.col("original_text")
    return requirements(spark, sf).where(t.isNotNull()).select("id", F.array_join(E.invariant_sentences(t, _INVARIANT), "|").alias("invariants"))


_STATES = "CASE WHEN state_set IS NULL OR trim(state_set, '[]') = '' THEN [] ELSE string_split_regex(upper(regexp_replace(state_set, '^\\[|\\]$', '', 'g')), ', *') END"


@query(
    WITH
    + f""", g AS (SELECT id, {_STATES} AS s, CAST(coalesce(try_cast(state_transitions AS JSON), '[]') AS JSON[]) AS t FROM requirements), e AS (SELECT id, s, list_transform(t, lambda x: {{'a': list_position(s, json_extract_string(x, '$.from')), 'b': list_position(s, json_extract_string(x, '$.to'))}}) AS e FROM g)
SELECT id, len(s)::BIGINT AS nodes, len(e)::BIGINT AS edges, greatest(0, len(s) - 1)::BIGINT AS branches, len(list_filter(e, lambda x: x.a > 0 AND x.b > 0 AND x.b <= x.a))::BIGINT AS loops, least(1, len(s))::BIGINT AS returns, 0::BIGINT AS throws, 0::BIGINT AS exception_edges, len(list_filter(e, lambda x: x.a > 0 AND x.b > 0 AND x.b <= x.a)) > 0 AS loop_present, greatest(1, len(e) - len(s) + 2)::BIGINT AS complexity FROM e"""
)
def g1_graph_features(spark, sf):
    """A requirement's states as the nodes of a graph, the last one a return, and its changes as edges, written as JSON and
    read again."""
    states = T.listed(F.upper("state_set"))
    moves = F.coalesce(F.from_json("state_transitions", "array<struct<from:string,to:string>>"), F.from_json(F.lit("[]"), "array<struct<from:string,to:string>>"))
    node = lambda s, i: F.struct((i + 1).alias("id"), F.when(i + 1 == F.size(states), "return").otherwise("if").alias("type"))
    place = lambda s: F.array_position(states, s)
    edge = lambda m: F.struct(place(m["from"]).alias("from"), place(m["to"]).alias("to"), F.lit("").alias("label"))
    graph = F.to_json(F.struct(F.transform(states, node).alias("nodes"), F.transform(moves, edge).alias("edges")))
    f = requirements(spark, sf).select("id", E.graph_features(F.from_json(graph, E.GRAPH)).alias("f"))
    return f.select("id", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("nodes", "edges", "branches", "loops", "returns", "throws", "exception_edges", "complexity")], "f.loop_present")


_SPEC = "'module m' || chr(10) || 'abstract sig State {}' || chr(10) || coalesce('pred init { state = ' || initial_state || ' }' || chr(10), '') || coalesce('fact { ' || nullif(constraint_rules, '') || ' }' || chr(10), '') || CASE WHEN state_transitions IS NOT NULL THEN 'pred transition { state'' = x }' ELSE '// check it' END"


@query(
    WITH
    + f", s AS (SELECT id, regexp_replace(regexp_replace({_SPEC}, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS spec FROM requirements) SELECT id, round(("
    + " + ".join("regexp_matches(spec, '" + "|".join(p).replace("'", "''") + "')::INT" for p in E.SPEC_ELEMENTS.values())
    + f")::DOUBLE / {len(E.SPEC_ELEMENTS)}, 6) AS coverage FROM s"
)
def a21_spec_coverage(spark, sf):
    line = lambda start, c, end: F.coalesce(F.concat(F.lit(start), c, F.lit(end + "\n")), F.lit(""))
    rules = F.nullif(F.col("constraint_rules"), F.lit(""))
    spec = F.concat(F.lit("module m\nabstract sig State {}\n"), line("pred init { state = ", F.col("initial_state"), " }"), line("fact { ", rules, " }"), F.when(F.col("state_transitions").isNotNull(), "pred transition { state' = x }").otherwise("// check it"))
    return requirements(spark, sf).select("id", r6(E.spec_coverage(spec), "coverage"))
