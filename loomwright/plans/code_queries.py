"""Static checks, localisation, specifications and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import code as K
from loomwright.operators import units as U
from loomwright.plans.base import WITH, cases, requirements
from loomwright.session import read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SPLIT = r"string_split_regex({c}, '\r\n|\r|\n')"


def _lines_sql(table, key, name, code):
    parts = _SPLIT.format(c=code)
    return f"l AS (SELECT {key}, lower(regexp_extract({name}, '\\.([A-Za-z]+)$', 1)) AS lang, unnest({parts}) AS line, generate_subscripts({parts}, 1) AS line_no FROM {table} WHERE {code} IS NOT NULL)"


def _check(lang, name, pattern):
    quoted = pattern.replace("'", "''")
    return f"SELECT case_id, lang, line_no, '{name}' AS check FROM l WHERE lang = '{lang}' AND regexp_matches(line, '{quoted}')"


@query("WITH " + _lines_sql("defect_detection_case", "case_id", "file_path", "code_content") + " " + " UNION ALL ".join(_check(lang, name, p) for lang, checks in K.CHECKS.items() for name, p in checks.items()))
def g5_static_defects(spark, sf):
    return K.static_defects(K.code_lines(cases(spark, sf), "case_id", "file_path", "code_content"), "case_id")


_EVIDENCE = {"compare": (r"(==|<=|>=|<|>) *[0-9]+", 1.0), "branch": (r"\b(if|for|while)\b", 0.6), "shift": (r"<<|>>", 0.4), "log": (r"log\.|logger\.|cerr|fputs|Println", 0.5), "todo": (r"TODO|FIXME", 0.8), "return": (r"\breturn\b", 0.3)}
_SCORE = " + ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN {w} ELSE 0 END" for p, w in _EVIDENCE.values())
_LOCATED = "WITH " + _lines_sql("defect_detection_case", "case_id", "file_path", "code_content") + f", s AS (SELECT case_id, line_no, round(({_SCORE})::DOUBLE, 6) AS score FROM l WHERE lang IN ('java', 'py', 'go', 'c', 'cpp')), t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, line_no DESC) AS rank FROM s WHERE score > 0)"


def _located(spark, sf):
    return K.locate(K.code_lines(cases(spark, sf), "case_id", "file_path", "code_content"), "case_id", _EVIDENCE)


@query(_LOCATED + " SELECT case_id, line_no, score, rank FROM t WHERE rank <= 3")
def l1_w8_located_lines(spark, sf):
    return _located(spark, sf)


@query(_LOCATED + ", x AS (SELECT case_id, min(line_no) AS true_line FROM l WHERE regexp_matches(line, 'return') GROUP BY 1), n AS (SELECT x.case_id, min(rank) AS r FROM x JOIN t USING (case_id) WHERE rank <= 3 AND abs(line_no - true_line) <= 2 GROUP BY 1) SELECT count(*) AS cases, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hit3 FROM x LEFT JOIN n USING (case_id)")
def l2_hit_rates(spark, sf):
    lines = K.code_lines(cases(spark, sf), "case_id", "file_path", "code_content")
    truth = lines.where(F.col("line").rlike("return")).groupBy("case_id").agg(F.min("line_no").alias("true_line"))
    return K.hit_rates(truth, _located(spark, sf), "case_id")


_NAMES = "CASE WHEN state_set IS NULL OR trim(state_set, '[]') = '' THEN [] ELSE string_split_regex(regexp_replace(state_set, '^\\[|\\]$', '', 'g'), ', *') END"
_INVARIANTS = _NAMES.replace("state_set", "invariants")
_SPEC = f"""concat_ws(chr(10), 'module ' || requirement_id, 'abstract sig State {{}}', nullif(array_to_string(list_transform({_NAMES}, lambda s: 'one sig ' || s || ' extends State {{}}'), chr(10)), ''), nullif(array_to_string(list_transform({_INVARIANTS}, lambda s: 'fact {{ ' || s || ' }}'), chr(10)), ''))"""


def _specs(spark, sf):
    return requirements(spark, sf).select("id", K.spec_text(F.col("requirement_id"), T.listed(F.col("state_set")), T.listed(F.col("invariants"))).alias("spec"))


@query(WITH + f"SELECT id, md5({_SPEC}) AS spec FROM requirements")
def spec_texts(spark, sf):
    return _specs(spark, sf).select("id", F.md5("spec").alias("spec"))


@query(
    WITH
    + f", s AS (SELECT id, {_SPEC} AS spec FROM requirements) "
    + r"SELECT id, regexp_matches(spec, '(?m)^module ') AS module, regexp_matches(spec, '\bsig \w+') AS sig, regexp_matches(spec, '\bfact\b') AS fact, regexp_matches(spec, '\bpred \w+') AS pred, regexp_matches(spec, '\b(check|assert)\b') AS check, regexp_matches(spec, '\brun\b') AS run, length(replace(spec, '{', '')) = length(replace(spec, '}', '')) AS balanced FROM s"
)
def spec_flags(spark, sf):
    return _specs(spark, sf).select("id", K.spec_flags(F.col("spec")).alias("f")).select("id", "f.*")


_EDGES = """e AS (SELECT id, json_extract_string(j, '$.from') AS src, json_extract_string(j, '$.to') AS dst FROM (SELECT id, unnest(CAST(try_cast(state_transitions AS JSON) AS JSON[])) AS j FROM requirements WHERE state_transitions IS NOT NULL))"""


@query(
    WITH.replace("WITH projects", "WITH RECURSIVE projects")
    + f", {_EDGES}, r AS (SELECT id, upper(initial_state) AS state FROM requirements WHERE initial_state IS NOT NULL UNION SELECT e.id, e.dst FROM r JOIN e ON e.id = r.id AND e.src = r.state) SELECT DISTINCT id, state FROM r"
)
def spec_reachable(spark, sf):
    reqs = requirements(spark, sf)
    edges = reqs.select("id", F.explode(F.from_json("state_transitions", "array<struct<from:string,to:string>>")).alias("e")).select("id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"))
    starts = reqs.where("initial_state is not null").select("id", F.upper("initial_state").alias("state"))
    return K.reachable(edges, starts, "id")


@query(f"SELECT file_id, lang, count(*) AS lines, sum((trim(line, ' ') <> '')::INT)::BIGINT AS filled FROM (WITH {_lines_sql('source_file', 'file_id', 'file_name', 'content')} SELECT * FROM l) WHERE lang IN ('java', 'py', 'go', 'c', 'cpp') GROUP BY 1, 2")
def s7_s11_line_inventory(spark, sf):
    lines = K.code_lines(read_table(spark, sf, "source_file"), "file_id", "file_name", "content")
    return lines.groupBy("file_id", "lang").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.trim("line") != "").cast("int")).alias("filled"))


@query()
def g2_g4_code_units(spark, sf):
    return U.code_units(read_table(spark, sf, "source_file"), "file_id", "file_name", "content")


@query()
def g7_g8_function_defects(spark, sf):
    return U.function_static_defects(read_table(spark, sf, "source_file"), "file_id", "file_name", "content")


@query()
def g6_python_defects(spark, sf):
    return U.python_static_defects(read_table(spark, sf, "source_file"), "file_id", "file_name", "content")


_FACTS = r"regexp_extract_all({s}, 'fact [{{] ([^{{}}]*) [}}]', 1)"


@query(WITH + f", s AS (SELECT id, {_SPEC} AS spec FROM requirements), c AS (SELECT id, {_FACTS.format(s='spec')} AS facts, regexp_extract_all(spec, 'one sig (\\w+) extends', 1) AS states FROM s) SELECT id, len(facts)::BIGINT AS clauses, len(list_filter(facts, lambda f: regexp_matches(f, '>=|<=|>|<|=')))::BIGINT AS invariants, array_to_string(states, ',') AS states FROM c")
def spec_clauses(spark, sf):
    facts = F.regexp_extract_all("spec", F.lit(r"fact [{] ([^{}]*) [}]"), F.lit(1))
    states = F.regexp_extract_all("spec", F.lit(r"one sig (\w+) extends"), F.lit(1))
    return _specs(spark, sf).select("id", F.size(facts).cast("long").alias("clauses"), F.size(F.filter(facts, lambda f: f.rlike(">=|<=|>|<|="))).cast("long").alias("invariants"), F.array_join(states, ",").alias("states"))
