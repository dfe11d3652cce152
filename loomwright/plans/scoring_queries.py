"""Vector similarity, scoring, matching, replays and parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import scoring as S
from loomwright.functions import signals as G
from loomwright.functions import text as T
from loomwright.operators import sweeps as W
from loomwright.operators.matching import greedy_matches, unmatched
from loomwright.operators.blocks import against_all
from loomwright.operators.ranking import numbered, top_n, top_per
from loomwright.plans import signal_queries as Q
from loomwright.plans.base import WITH, cases, r6, states, states_sql, tasks
from loomwright.session import read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# scored rows: precision, recall and their mean stand for the semantic, constraint and invariant score
_SCORED = "s AS (SELECT case_id, file_path, false_positive, quality_precision AS sem, quality_recall AS con, (quality_precision + quality_recall) / 2 AS inv, abs(quality_precision - quality_recall) AS risk FROM defect_detection_case WHERE quality_precision IS NOT NULL AND quality_recall IS NOT NULL)"


def scored(spark, sf):
    p, r = F.col("quality_precision"), F.col("quality_recall")
    return cases(spark, sf).where(p.isNotNull() & r.isNotNull()).select("case_id", "file_path", "false_positive", p.alias("sem"), r.alias("con"), ((p + r) / 2).alias("inv"), F.abs(p - r).alias("risk"))


SEM, CON, INV = "sem", "con", "inv"


@query()
def m1_nearest_vectors(spark, sf):
    """Top 5 rows per query vector (vec_id divisible by 50), by mapped cosine; the query set is broadcast after a check of
    its size, each partition keeps its 5 best per query before the shuffle."""
    v = read_table(spark, sf, "embeddings").select("vec_id", "embedding", S.norm(F.col("embedding")).alias("n"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"), F.col("n").alias("qn"))
    pairs = against_all(q, v, F.round(S.mapped_cosine(S.dot(F.col("qe"), F.col("embedding")), F.col("qn"), F.col("n")), 6).alias("similarity"), ["query_id"], ["vec_id"])
    return top_per(pairs.where("query_id <> vec_id"), ["query_id"], [F.desc("similarity"), F.asc("vec_id")], 5).select("query_id", "vec_id", "similarity", "rank")


ORACLE["m1_nearest_vectors"] = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round((1 + list_dot_product(a.e, b.e) / (a.n * b.n)) / 2, 6) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""


@query(f"WITH {_SCORED} SELECT case_id, round(greatest(0, least(1, sem)), 6) AS linear, round(1 / (1 + exp(-greatest(-30, least(30, (sem - 0.6) / 0.05)))), 6) AS sigmoid FROM s")
def m3_calibrations(spark, sf):
    x = F.col(SEM)
    return scored(spark, sf).select("case_id", r6(S.calibrated(x, "linear"), "linear"), r6(S.calibrated(x, "sigmoid", 0.6, 0.0), "sigmoid"))


@query(
    f"""WITH {_SCORED}, t AS (SELECT *, (0.5 * sem + 0.2 * con + 0.3 * inv) AS raw, least(0.65, 2 * risk) AS rk FROM s), u AS (SELECT *, raw * (1 - rk * 0.55) AS total FROM t)
SELECT case_id, round(raw, 6) AS raw, round(total, 6) AS total, CASE WHEN total > 0.52 AND rk < 0.35 THEN 'consistent' WHEN total >= 0.5 THEN 'general' ELSE 'serious' END AS status,
 CASE WHEN con < 0.6 THEN 'constraint' WHEN inv < 0.7 THEN 'invariant' WHEN sem < 0.2 THEN 'semantic' WHEN inv < con THEN 'mismatch_invariant' ELSE 'mismatch_constraint' END AS sub_type FROM u"""
)
def m11_m15_status(spark, sf):
    sem, con, inv = F.col(SEM), F.col(CON), F.col(INV)
    risk = S.risk({"numeric": F.col("risk")})
    raw = S.raw_similarity(sem, con, inv, S.CALIBRATED)
    total = S.penalised(raw, risk, S.CALIBRATED)
    return scored(spark, sf).select("case_id", r6(raw, "raw"), r6(total, "total"), S.status(total, risk, S.CALIBRATED).alias("status"), S.sub_type(sem, con, inv).alias("sub_type"))


@query(
    rf"""WITH n AS (SELECT case_id, list_filter(list_transform(regexp_extract_all(original_text, '\b([0-9]{{1,4}})\b', 1), lambda x: x::INT), lambda x: x > 0) AS a, list_filter(list_transform(regexp_extract_all(code_content, '\b([0-9]{{1,4}})\b', 1), lambda x: x::INT), lambda x: x > 0) AS b, {states_sql('original_text')} AS sa, {states_sql('code_content')} AS sb FROM defect_detection_case WHERE original_text IS NOT NULL AND code_content IS NOT NULL)
SELECT case_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 0.45 * (1 - least(list_min(a), list_min(b))::DOUBLE / greatest(list_min(a), list_min(b))) END, 6) AS numeric,
 CASE WHEN len(sa) = 0 OR len(list_intersect(sa, sb))::DOUBLE / len(sa) >= 0.5 THEN 0 ELSE 0.45 END::DOUBLE AS states FROM n"""
)
def m4_m5_penalties(spark, sf):
    text, code = F.col("original_text"), F.col("code_content")
    rows = cases(spark, sf).where(text.isNotNull() & code.isNotNull())
    return rows.select("case_id", r6(S.numeric_penalty(T.numbers(text), T.numbers(code)), "numeric"), S.state_penalty(states(text), states(code)).alias("states"))


_EXPECT = {"loop": (r"每|批量|each|every|for all", r"\bfor\b|\bwhile\b"), "branch": (r"若|如果|超过|if|above", r"\bif\b|\bswitch\b"), "failure": (r"失败|错误|拒绝|fail|refuse", r"catch|except|err|warn"), "steps": (r"先|然后|再|then|before", r"\bif\b[\s\S]*\bif\b")}


@query(
    "WITH e AS (SELECT case_id, "
    + ", ".join(f"regexp_matches(lower(original_text), '{a}') AS w{i}, regexp_matches(lower(code_content), '{b}') AS h{i}" for i, (a, b) in enumerate(_EXPECT.values()))
    + " FROM defect_detection_case WHERE original_text IS NOT NULL AND code_content IS NOT NULL) SELECT case_id, round(CASE WHEN "
    + " + ".join(f"w{i}::INT" for i in range(4))
    + " = 0 THEN 0.5 ELSE ("
    + " + ".join(f"CASE WHEN w{i} THEN CASE WHEN h{i} THEN 1.0 ELSE 0.3 END ELSE 0 END" for i in range(4))
    + ") / ("
    + " + ".join(f"w{i}::INT" for i in range(4))
    + ") END, 6) AS invariant FROM e"
)
def m7_structure(spark, sf):
    text, code = F.lower("original_text"), F.lower("code_content")
    wanted = [text.rlike(a) for a, _ in _EXPECT.values()]
    hits = [F.when(w, F.when(code.rlike(b), 1.0).otherwise(0.3)).otherwise(0.0) for w, (_, b) in zip(wanted, _EXPECT.values())]
    n = sum((w.cast("int") for w in wanted), F.lit(0))
    return cases(spark, sf).where("original_text is not null and code_content is not null").select("case_id", r6(F.when(n == 0, 0.5).otherwise(sum(hits, F.lit(0.0)) / n), "invariant"))


_BUGS = {k: (w, f"regexp_matches(code_content, '(?i){'|'.join(p)}')") for k, (w, p) in G.CODE_BUGS.items()} | {"one_sided_compare": (G.ONE_SIDED[0], f"(regexp_matches(code_content, '(?i){G.ONE_SIDED[1]}') AND regexp_matches(lower(code_content), '{G.ONE_SIDED[2]}'))")}


@query("SELECT case_id, round(least(0.8, (" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for w, c in _BUGS.values()) + ")::DOUBLE), 6) AS risk, " + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, (_, c) in _BUGS.items()) + "], lambda e: e IS NOT NULL), ',') AS found FROM defect_detection_case WHERE code_content IS NOT NULL")
def r5_m16_code_bugs(spark, sf):
    code = F.col("code_content")
    each = G.code_bugs(code)
    names = F.filter(F.array(*[F.when(c > 0, k) for k, c in each.items()]), lambda x: x.isNotNull())
    return cases(spark, sf).where(code.isNotNull()).select("case_id", r6(F.least(F.lit(0.8), sum(each.values(), F.lit(0.0))), "risk"), F.array_join(names, ",").alias("found"))


def _pairs(spark, sf):
    """Scored pairs of files and methods: the votes of one annotator on each pair, in score order."""
    votes = read_table(spark, sf, "participant_verdict").select("file", "method_name", F.round(F.col("end_time") - F.col("start_time"), 4).alias("score"), (F.lower(F.trim("verdict")) == "consistent").alias("consistent"))
    best = votes.where("consistent is not null").groupBy("file", "method_name").agg(F.max(F.struct("score", "consistent")).alias("b")).select("file", "method_name", "b.*")
    return numbered(best.withColumn("k", -F.col("score")), ["k", "file", "method_name"], "rank")


@query()
def w6_u1_greedy_matches(spark, sf):
    return greedy_matches(_pairs(spark, sf), "file", "method_name", "rank", "consistent").select("file", "method_name", "kind")


@query()
def j9_unmatched_files(spark, sf):
    return unmatched(read_table(spark, sf, "consistency_pair").select("file").distinct(), w6_u1_greedy_matches(spark, sf), "file")


_LEVEL = "CASE WHEN {s} > {x} THEN 'consistent' WHEN {s} >= {y} THEN 'general' ELSE 'serious' END"
_BASE, _CUSTOM = _LEVEL.format(s="(0.4 * sem + 0.35 * con + 0.25 * inv)", x=0.8, y=0.5), _LEVEL.format(s="(0.5 * sem + 0.25 * con + 0.25 * inv)", x=0.7, y=0.45)


@query(f"WITH {_SCORED}, r AS (SELECT {_BASE} AS before, {_CUSTOM} AS after FROM s) SELECT before, after, count(*) AS n FROM r GROUP BY 1, 2")
def m21_replay(spark, sf):
    return W.replay(scored(spark, sf), F.col(SEM), F.col(CON), F.col(INV), S.LEGACY, 2.0, 1.0, 1.0, 0.7, 0.45).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SCORED}, r AS (SELECT case_id, file_path, {_BASE} AS before, {_CUSTOM} AS after FROM s) SELECT case_id, before, after FROM r WHERE before <> after ORDER BY case_id, file_path LIMIT 8")
def w11_first_flips(spark, sf):
    rows = W.replay(scored(spark, sf), F.col(SEM), F.col(CON), F.col(INV), S.LEGACY, 2.0, 1.0, 1.0, 0.7, 0.45).where("before <> after")
    return top_n(rows, [F.asc("case_id"), F.asc("file_path")], 8).select("case_id", "before", "after")


@query(f"WITH {_SCORED}, p AS (SELECT round(i * 0.05, 2)::DOUBLE AS t1, round(round(i * 0.05, 2)::DOUBLE * 0.625 + 1e-9, 2)::DOUBLE AS t2 FROM range(12, 20) x(i)) SELECT t1, t2, sum((sem > t1)::INT)::BIGINT AS consistent, sum((sem <= t1 AND sem >= t2)::INT)::BIGINT AS general, sum((sem < t2)::INT)::BIGINT AS serious FROM s, p GROUP BY 1, 2")
def m22_sweep(spark, sf):
    return W.sweep(scored(spark, sf), F.col(SEM), W.sweep_thresholds())


_GRID = "SELECT {names}, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN tp + fn = 0 THEN 0 ELSE round(fn::DOUBLE / (tp + fn), 6) END AS miss, CASE WHEN fp + tn = 0 THEN 0 ELSE round(fp::DOUBLE / (fp + tn), 6) END AS fpr FROM (SELECT {names}, sum((bad AND said)::INT) AS tp, sum((NOT bad AND said)::INT) AS fp, sum((bad AND NOT said)::INT) AS fn, sum((NOT bad AND NOT said)::INT) AS tn FROM g GROUP BY {names})"


@query(f"WITH {_SCORED}, g AS (SELECT t1, NOT false_positive AS bad, (sem < t1 OR risk >= 0.35) AS said FROM s, (SELECT round(0.4 + i * 0.02, 2)::DOUBLE AS t1 FROM range(0, 26) x(i))) " + _GRID.format(names="t1"))
def m23_w17_calibration(spark, sf):
    said = (F.col(SEM) < F.col("t1")) | (F.col("risk") >= 0.35)
    return W.graded_grid(scored(spark, sf), ~F.col("false_positive"), said, [{"t1": round(0.4 + i * 0.02, 2)} for i in range(26)])


_WEIGHTS = [{"a": a / 10, "b": b / 10, "g": (10 - a - b) / 10, "t1": t / 10} for a in range(2, 7, 2) for b in range(2, 7, 2) if a + b < 10 for t in (5, 6, 7)]


@query(f"WITH {_SCORED}, p AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, (10 - a - b) / 10.0::DOUBLE AS g, t / 10.0::DOUBLE AS t1 FROM range(2, 7, 2) x(a), range(2, 7, 2) y(b), (VALUES (5), (6), (7)) z(t) WHERE a + b < 10), g AS (SELECT a, b, p.g, t1, NOT false_positive AS bad, a * sem + b * con + p.g * inv < t1 AS said FROM s, p) " + _GRID.format(names="a, b, g, t1"))
def m24_weight_grid(spark, sf):
    said = F.col("a") * F.col(SEM) + F.col("b") * F.col(CON) + F.col("g") * F.col(INV) < F.col("t1")
    return W.graded_grid(scored(spark, sf), ~F.col("false_positive"), said, _WEIGHTS)


@query(f"WITH {_SCORED}, g AS (SELECT gate, NOT false_positive AS bad, (sem < 0.6 OR (risk >= gate AND sem < 0.8)) AS said FROM s, (SELECT i / 20.0::DOUBLE AS gate FROM range(2, 13) x(i))) " + _GRID.format(names="gate"))
def m25_gate_sweep(spark, sf):
    said = (F.col(SEM) < 0.6) | ((F.col("risk") >= F.col("gate")) & (F.col(SEM) < 0.8))
    return W.graded_grid(scored(spark, sf), ~F.col("false_positive"), said, [{"gate": i / 20} for i in range(2, 13)])


@query(f"WITH {_SCORED}, g AS (SELECT v, NOT false_positive AS bad, CASE v WHEN 0 THEN sem WHEN 1 THEN (1 + sem) / 2 ELSE sqrt(sem) END < 0.75 AS said FROM s, range(0, 3) x(v)) " + _GRID.format(names="v"))
def m26_ablation(spark, sf):
    x = F.when(F.col("v") == 0, F.col(SEM)).when(F.col("v") == 1, (1 + F.col(SEM)) / 2).otherwise(F.sqrt(F.col(SEM)))
    return W.graded_grid(scored(spark, sf), ~F.col("false_positive"), x < 0.75, [{"v": i} for i in range(3)]).withColumn("v", F.col("v").cast("long"))


_VERDICTS = """v AS (SELECT pair_id, lower(trim(annotator)) AS who, bool_and(consistent) AS ok FROM second_annotation GROUP BY 1, 2),
k AS (SELECT p.pair_id, avg(CASE WHEN lower(trim(d.verdict)) = 'defective' THEN 1.0 WHEN lower(trim(d.verdict)) = 'consistent' THEN 0.0 END) AS risk, max(d.end_time - d.start_time) AS spent FROM consistency_pair p JOIN participant_verdict d ON p.project = d.project AND p.req_id = d.req_id AND p.file = d.file AND p.method_name = d.method_name GROUP BY 1),
r AS (SELECT pair_id, coalesce(risk, 0) AS risk, CASE WHEN risk = 1 THEN 0.45 ELSE 0 END AS bound, 0.4 + 0.6 * (1 - coalesce(risk, 0)) AS total FROM k)"""


def _verdicts(spark, sf):
    """Verdicts of second annotators (null where they gave none), and risks and similarity that the participants' share of
    defective verdicts stands for."""
    v = read_table(spark, sf, "second_annotation").groupBy("pair_id", F.lower(F.trim("annotator")).alias("who")).agg(F.bool_and("consistent").alias("ok"))
    said = F.lower(F.trim("verdict"))
    share = F.avg(F.when(said == "defective", 1.0).when(said == "consistent", 0.0)).alias("risk")
    k = read_table(spark, sf, "consistency_pair").join(read_table(spark, sf, "participant_verdict"), ["project", "req_id", "file", "method_name"]).groupBy("pair_id").agg(share)
    risk = F.coalesce("risk", F.lit(0.0))
    return v, k.select("pair_id", risk.alias("risk"), F.when(F.col("risk") == 1, 0.45).otherwise(0.0).alias("bound"), (0.4 + 0.6 * (1 - risk)).alias("total"))


@query(
    f"""WITH {_VERDICTS}, m AS (SELECT a.pair_id, a.who AS first, b.who AS second, a.ok AS x, b.ok AS y, risk, bound, total FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.who < b.who JOIN r ON r.pair_id = a.pair_id),
d AS (SELECT *, CASE WHEN x = y THEN NOT x ELSE risk >= 0.30 END AS bad, x IS NOT NULL AND y IS NOT NULL AS two FROM m),
p AS (SELECT *, CASE WHEN two THEN NOT (bad OR bound >= 0.45) ELSE coalesce(x, y) END AS ok, CASE WHEN two THEN CASE WHEN NOT bad AND bound >= 0.45 THEN 'RULE_QUANTIFY_VETO' WHEN x = y THEN CASE WHEN x THEN 'LLM_CONSENSUS_CONSISTENT' ELSE 'LLM_CONSENSUS_DEFECT' END WHEN bad THEN 'LLM_ARBITRATION_DEFECT' ELSE 'LLM_ARBITRATION_KEEP' END WHEN coalesce(x, y) IS NOT NULL THEN 'LLM_SINGLE' END AS path FROM d)
SELECT pair_id, first, second, CASE WHEN ok IS NULL THEN 'general_inconsistent' WHEN ok THEN 'consistent' WHEN total < 0.5 THEN 'serious_inconsistent' ELSE 'general_inconsistent' END AS status, CASE WHEN ok IS NULL THEN 'RULE_FALLBACK' ELSE path END AS path FROM p"""
)
def m18_m20_judge_merge(spark, sf):
    """All pairs of second annotators of an item: the ladder, and what it writes back."""
    v, r = _verdicts(spark, sf)
    a, b = v.select("pair_id", F.col("who").alias("first"), F.col("ok").alias("x")), v.select("pair_id", F.col("who").alias("second"), F.col("ok").alias("y"))
    both = a.join(b, "pair_id").where("first < second").join(r, "pair_id").withColumn("m", S.merged_verdict(F.col("x"), F.col("y"), F.col("risk"), F.col("bound")))
    back = S.written_back(F.col("m.consistent"), F.col("m.path"), F.col("total"), F.lit(0.5), F.lit("general_inconsistent"))
    return both.select("pair_id", "first", "second", back.alias("b")).select("pair_id", "first", "second", "b.status", "b.path")


@query(f"WITH {_VERDICTS} SELECT pair_id, who, ok OR (NOT ok AND total >= 0.70) AS consistent, CASE WHEN NOT ok AND total >= 0.70 THEN 'LLM_SIM_GATE' WHEN ok IS NOT NULL THEN 'LLM_SINGLE' END AS path FROM v JOIN r USING (pair_id)")
def m19_similarity_gate(spark, sf):
    v, r = _verdicts(spark, sf)
    return v.join(r, "pair_id").select("pair_id", "who", S.gated_verdict(F.col("ok"), F.col("total")).alias("g")).select("pair_id", "who", "g.consistent", "g.path")


_DETAIL = "'{\"pairRisk\":' || round(risk, 4)::VARCHAR || ',\"detail\":\"' || coalesce(who, '') || '\"' || CASE WHEN ok IS NULL THEN '' ELSE ',\"variantA\":' || ok::VARCHAR END || '}'"


@query(f"WITH {_VERDICTS} SELECT pair_id, who, {_DETAIL} AS detail FROM v JOIN r USING (pair_id) WHERE risk > 0.001 AND risk < 1")
def t26_judge_details(spark, sf):
    v, r = _verdicts(spark, sf)
    detail = F.to_json(F.struct(F.round("risk", 4).alias("pairRisk"), F.coalesce("who", F.lit("")).alias("detail"), F.col("ok").alias("variantA")))
    return v.join(r, "pair_id").where("risk > 0.001 and risk < 1").select("pair_id", "who", detail.alias("detail"))


@query(WITH + "SELECT id, abs(weight_alpha + weight_beta + weight_gamma - 1) <= 0.01 AND least(weight_alpha, weight_beta, weight_gamma) >= 0 AND greatest(weight_alpha, weight_beta, weight_gamma) <= 1 AND threshold_t1 > threshold_t2 AS valid FROM tasks WHERE weight_alpha IS NOT NULL AND weight_beta IS NOT NULL AND weight_gamma IS NOT NULL")
def f14_valid_weights(spark, sf):
    w = [F.col(f"weight_{x}") for x in ("alpha", "beta", "gamma")]
    ok = (F.abs(w[0] + w[1] + w[2] - 1) <= 0.01) & (F.least(*w) >= 0) & (F.greatest(*w) <= 1) & (F.col("threshold_t1") > F.col("threshold_t2"))
    return tasks(spark, sf).where(w[0].isNotNull() & w[1].isNotNull() & w[2].isNotNull()).select("id", ok.alias("valid"))


_SIGNALS = {"state": ("r1_r3_t15_signals", "state"), "numeric": ("r1_r3_t15_signals", "numeric"), "validation": ("r1_r3_t15_signals", "validation"), "inversion": ("r4_logic_inversion", "inversion"), "bugs": ("r5_m16_code_bugs", "risk"), "null": ("r7_null_dereference", "risk"), "flow": ("r8_state_flow", "violation"), "bound": ("r10_bound_mismatch", "bound")}
_PARTS = {name: (ORACLE | Q.ORACLE)[name] for name in dict.fromkeys(q for q, _ in _SIGNALS.values())}


@query(
    "WITH "
    + ", ".join(f"x_{name} AS ({sql})" for name, sql in _PARTS.items())
    + ", s AS (SELECT case_id, "
    + ", ".join(f"x_{q}.{c} AS s_{k}" for k, (q, c) in _SIGNALS.items())
    + " FROM x_r1_r3_t15_signals "
    + " ".join(f"JOIN x_{name} USING (case_id)" for name in _PARTS if name != "r1_r3_t15_signals")
    + ") SELECT case_id, round(greatest(0, least(0.65, "
    + " + ".join(f"{S.RISK_WEIGHTS.get(k, 1.0)} * s_{k}" for k in _SIGNALS)
    + "))::DOUBLE, 6) AS risk, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN s_{k} > 0 THEN '{k}' END" for k in _SIGNALS)
    + "], lambda x: x IS NOT NULL), ',') AS signals FROM s"
)
def m15_m16_risk(spark, sf):
    """The weighted risk of all signals, and which of them speak."""
    t, c = F.col("original_text"), F.col("code_content")
    each = {
        "state": G.state_mismatch(states(t), states(c)),
        "numeric": F.round(G.numeric_mismatch(t, c), 6),
        "validation": G.missing_validation(t, c),
        "inversion": G.logic_inversion(t, c),
        "bugs": F.round(F.least(F.lit(0.8), sum(G.code_bugs(c).values(), F.lit(0.0))), 6),
        "null": G.null_dereference(c),
        "flow": G.state_flow_violation(t, c, states(t)),
        "bound": G.bound_mismatch(t, c, F.split(c, r"\r\n|\r|\n")),
    }
    rows = cases(spark, sf).where(t.isNotNull() & c.isNotNull()).select("case_id", *[x.alias(k) for k, x in each.items()])
    named = F.filter(F.array(*[F.when(F.col(k) > 0, k) for k in each]), lambda x: x.isNotNull())
    return rows.select("case_id", r6(S.risk({k: F.col(k) for k in each}), "risk"), F.array_join(named, ",").alias("signals"))
