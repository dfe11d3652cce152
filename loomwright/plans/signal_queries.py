"""Risk signals, evidence and narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import signals as G
from loomwright.plans.base import WITH, bounds_sql, cases, r6, requirements, states, states_sql
from loomwright.session import read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BARE = r"regexp_replace(regexp_replace({c}, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g')"
_BASE = f"""b AS (SELECT case_id, original_text AS t, code_content AS c, {states_sql('original_text')} AS ts, {states_sql('code_content')} AS cs,
 list_distinct(list_transform(regexp_extract_all(original_text, '([0-9]{{1,4}})'), lambda x: x::INT)) AS tn FROM defect_detection_case WHERE original_text IS NOT NULL AND code_content IS NOT NULL)"""
_NUMBERS = r"list_filter(list_transform(regexp_extract_all({x}, '\b([0-9]{{1,4}})\b', 1), lambda x: x::INT), lambda x: x > 0)"
_WANTED = _NUMBERS.format(x=r"regexp_replace(t, '[0-9]+\.[0-9]+', ' ', 'g')")
_PLAIN = r"regexp_replace(regexp_replace({bare}, '[0-9]+\.[0-9]+', ' ', 'g'), '[+\-]\s*1\b', ' ', 'g')".format(bare=_BARE.format(c="c"))
_THERE = f"list_filter({_NUMBERS.format(x=_PLAIN)}, lambda x: x NOT IN ({', '.join(map(str, G.CONVERSIONS))}))"
_PARAMETERS = ", ".join("CASE WHEN regexp_matches(lower(t), '" + "|".join(w.lower() for w in words) + f"') THEN '{p}' END" for p, words in G.PARAMETERS.items())
_VALIDATED = ", ".join(f"CASE WHEN regexp_matches({_BARE.format(c='c')}, '{G.validation_pattern(p)}') THEN '{p}' END" for p in G.PARAMETERS)


def _rows(spark, sf):
    t, c = F.col("original_text"), F.col("code_content")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("([0-9]{1,4})"), F.lit(1)), lambda x: x.cast("int")))
    return cases(spark, sf).where(t.isNotNull() & c.isNotNull()).select("case_id", t.alias("t"), c.alias("c"), numbers.alias("tn"))


@query(
    f"""WITH {_BASE}, n AS (SELECT *, {_WANTED} AS w, {_THERE} AS h, list_filter([{_PARAMETERS}], lambda p: p IS NOT NULL) AS ps, list_filter([{_VALIDATED}], lambda p: p IS NOT NULL) AS vs, {_BARE.format(c='c')} AS bare FROM b),
m AS (SELECT *, len(list_filter(w, lambda x: list_contains(h, x))) AS eq, len(list_filter(w, lambda x: NOT list_contains(h, x) AND len(list_filter(h, lambda y: least(x, y) * 10 >= greatest(x, y))) > 0)) AS near, len(list_intersect(ps, vs))::DOUBLE / len(ps) AS share FROM n)
SELECT case_id, CASE WHEN len(ts) = 0 THEN 0 WHEN len(list_intersect(ts, cs)) = 0 THEN 0.55 WHEN len(list_intersect(ts, cs)) < len(ts) THEN 0.25 ELSE 0 END::DOUBLE AS state, round((CASE WHEN eq + near = 0 THEN 0 ELSE 0.45 * near / (eq + near) END)::DOUBLE, 6) AS numeric,
 CASE WHEN NOT regexp_matches(t, '{G.CHECK_WORDS}') OR len(ps) = 0 OR regexp_matches(bare, '{G.DELEGATES}') OR share >= 0.75 THEN 0 WHEN share >= 0.5 THEN 0.2 WHEN share >= 0.25 THEN 0.4 ELSE 0.6 END::DOUBLE AS validation FROM m"""
)
def r1_r3_t15_signals(spark, sf):
    t, c = F.col("t"), F.col("c")
    return _rows(spark, sf).select("case_id", G.state_mismatch(states(t), states(c)).alias("state"), r6(G.numeric_mismatch(t, c), "numeric"), G.missing_validation(t, c).alias("validation"))


@query(
    f"WITH {_BASE}, n AS (SELECT case_id, t, {_WANTED} AS w, {_BARE.format(c='c')} AS bare FROM b) SELECT case_id, CASE WHEN regexp_matches(t, '{G.LOWER_BOUNDS}') AND len(list_filter(w, lambda n: "
    + r"regexp_matches(bare, '<\s*' || n || '\b|\b' || n || '\s*<([^=]|$)'))) > 0 THEN 0.35 ELSE 0 END::DOUBLE AS inversion FROM n"
)
def r4_logic_inversion(spark, sf):
    return _rows(spark, sf).select("case_id", G.logic_inversion(F.col("t"), F.col("c")).alias("inversion"))


_ORDER = "list_transform(list_sort(list_transform({s}, lambda s, i: {{'at': CASE WHEN contains(upper({t}), s) THEN strpos(upper({t}), s) ELSE 1073741824 END, 'i': i, 's': s}})), lambda x: x.s)"


@query(WITH + f", s AS (SELECT id, original_text AS t, {states_sql('original_text')} AS s FROM requirements WHERE original_text IS NOT NULL) SELECT id, array_to_string({_ORDER.format(s='s', t='t')}, '>') AS flow FROM s")
def r8_state_order(spark, sf):
    t = F.col("original_text")
    return requirements(spark, sf).where(t.isNotNull()).select("id", F.array_join(G.state_order(t, states(t)), ">").alias("flow"))


_MOVES = "list_transform(regexp_extract_all(c, '" + G.MOVE + "'), lambda m: {'a': list_position(o, regexp_extract(m, '" + G.MOVE + "', 1)), 'b': list_position(o, regexp_extract(m, '" + G.MOVE + "', 2))})"


@query(
    f"WITH {_BASE}, o AS (SELECT *, {_ORDER.format(s='ts', t='t')} AS o FROM b), m AS (SELECT *, {_MOVES} AS m FROM o) "
    + f"SELECT case_id, CASE WHEN regexp_matches(t, '{'|'.join(G.ORDER_WORDS)}') AND len(ts) >= 3 AND len(list_filter(m, lambda x: x.a > 0 AND x.b > 0 AND x.b <> x.a + 1)) > 0 THEN 0.4 ELSE 0 END::DOUBLE AS violation FROM m"
)
def r8_state_flow(spark, sf):
    """No code of the test tables moves between named constants, so all are 0 there; unit tests have cases with violations."""
    t, c = F.col("t"), F.col("c")
    return _rows(spark, sf).select("case_id", G.state_flow_violation(t, c, states(t)).alias("violation"))


_WINDOWS = ", ".join(f"CASE WHEN contains(original_text, '{w}') THEN substr(original_text, greatest(1, strpos(original_text, '{w}') - 10), 30) END" for w in G.CONSTRAINT_WORDS)


@query(WITH + f"SELECT id, array_to_string(list_filter([{_WINDOWS}], lambda x: x IS NOT NULL), '|') AS excerpts FROM requirements WHERE original_text IS NOT NULL")
def t23_constraint_windows(spark, sf):
    return requirements(spark, sf).where("original_text is not null").select("id", F.array_join(G.windows(F.col("original_text")), "|").alias("excerpts"))


@query(WITH + "SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(constraint_rules, ''), ';'), lambda x: trim(x)), lambda x: x <> ''))), ' & ') AS propositions FROM requirements")
def t24_propositions(spark, sf):
    return requirements(spark, sf).select("id", F.array_join(G.propositions(F.col("constraint_rules")), " & ").alias("propositions"))


@query(WITH + """, p AS (SELECT id, list_distinct(list_filter(list_transform(string_split(coalesce(constraint_rules, '') || ';' || coalesce(invariants, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS ps, coalesce(atomic_constraints, '') AS c FROM requirements)
SELECT id, round(CASE WHEN len(ps) = 0 THEN -1 ELSE len(list_filter(ps, lambda p: contains(c, regexp_extract(p, '^([A-Za-z]*)', 1))))::DOUBLE / len(ps) END, 6) AS satisfied FROM p""")
def m9_satisfied(spark, sf):
    """The propositions of a requirement's own rules and invariants, looked up in its atomic constraints."""
    parts = G.propositions(F.col("constraint_rules"), F.col("invariants"))
    return requirements(spark, sf).select("id", r6(G.satisfied(parts, F.coalesce("atomic_constraints", F.lit(""))), "satisfied"))


@query(r"""WITH l AS (SELECT case_id, list_transform(string_split_regex(code_content, '\r\n|\r|\n'), lambda x: trim(x, ' ')) AS ls FROM defect_detection_case WHERE code_content IS NOT NULL)
SELECT case_id, least(15, len(list_filter(ls, lambda x: regexp_matches(x, '\b(final|const|#define)\b.*[=0-9]|^#define'))))::BIGINT AS constants, least(40, len(list_filter(ls, lambda x: regexp_matches(x, '^(public|private|protected|static|def|func|boolean|bool)\b.*\('))))::BIGINT AS signatures FROM l""")
def m17_evidence(spark, sf):
    e = G.evidence(F.col("code_content"))
    return cases(spark, sf).where("code_content is not null").select("case_id", e.alias("e")).select("case_id", F.size("e.constants").cast("long").alias("constants"), F.size("e.signatures").cast("long").alias("signatures"))


@query("SELECT annotator, pair_id, '[' || coalesce(defect_type, 'unknown') || '] ' || coalesce(decision_path, '-') || ': ' || coalesce(reason, 'no reason given') AS narrative FROM second_annotation")
def t29_narratives(spark, sf):
    return read_table(spark, sf, "second_annotation").select("annotator", "pair_id", G.narrative(F.col("defect_type"), F.col("decision_path"), F.col("reason")).alias("narrative"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def t26_t27_replies(spark, sf):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return read_table(spark, sf, "events").where("props is not null").select("event_id", G.reply(wrapped, "k bigint")["k"].alias("k"))


@query("SELECT doc_id, round(len(list_filter(['version', '版本', 'author', '编写人', 'req-001'], lambda w: contains(regexp_replace(lower(text), '[ \\t\\r\\n]+', '', 'g'), w)))::DOUBLE / 5, 6) AS covered FROM documents WHERE text IS NOT NULL")
def a20_key_coverage(spark, sf):
    return read_table(spark, sf, "documents").where("text is not null").select("doc_id", r6(G.key_coverage(F.col("text"), ["version", "版本", "author", "编写人", "REQ-001"]), "covered"))


_NAMED = r"""list_transform(list_filter(string_split_regex(c, '\r\n|\r|\n'), lambda x: contains(lower(x), 'static') AND contains(lower(x), 'final') AND regexp_matches(x, '\w+\s*=\s*-?[0-9]+')), lambda x: {'n': regexp_extract(x, '(\w+)\s*=\s*-?[0-9]+', 1), 'v': try_cast(regexp_extract(x, '\w+\s*=\s*(-?[0-9]+)', 1) AS BIGINT)})"""
_USED = r"list_filter(list_transform(regexp_extract_all(c, '[<>]=?\s*([0-9]{1,6})\b', 1), lambda x: x::INT), lambda x: x > 0)"


@query(
    f"""WITH b AS (SELECT case_id, code_content AS c, list_filter({bounds_sql('original_text')}, lambda x: x > 0) AS w FROM defect_detection_case WHERE original_text IS NOT NULL AND code_content IS NOT NULL), u AS (SELECT *, {_USED} AS used, {_NAMED} AS named FROM b)
"""
    + r"""SELECT case_id, CASE WHEN len(list_filter(named, lambda k: k.v IS NOT NULL AND regexp_matches(c, '(^|[^\w''])' || k.n || '\s*[<>]=?|[<>]=?\s*' || k.n || '\b') AND len(list_filter(w, lambda x: x <> k.v AND greatest(x, k.v) <= 5 * least(x, k.v))) > 0)) > 0
 OR len(list_filter(w, lambda x: NOT regexp_matches(c, '(^|[^0-9])' || x || '([^0-9]|$)') AND len(list_filter(used, lambda v: x <> v AND greatest(x, v) <= 5 * least(x, v))) > 0)) > 0 THEN 0.45 ELSE 0 END::DOUBLE AS bound FROM u"""
)
def r10_bound_mismatch(spark, sf):
    c = F.col("code_content")
    lines = F.split(c, r"\r\n|\r|\n")
    return cases(spark, sf).where("original_text is not null and code_content is not null").select("case_id", G.bound_mismatch(F.col("original_text"), c, lines).alias("bound"))


@query("SELECT case_id, round(CASE WHEN original_text IS NULL OR trim(original_text) = '' OR code_content IS NULL OR trim(code_content) = '' OR quality_precision IS NULL OR quality_precision < 0.3 THEN CASE WHEN quality_recall >= 0 THEN 0.35 + 0.65 * quality_recall ELSE 0.5 END ELSE greatest(0, least(1, quality_precision)) END, 6) AS constraint_score FROM defect_detection_case")
def m6_constraint_score(spark, sf):
    matched = F.when(F.col("quality_precision") >= 0.3, F.col("quality_precision"))
    return cases(spark, sf).select("case_id", r6(G.constraint_score(F.col("original_text"), F.col("code_content"), matched, F.col("quality_recall")), "constraint_score"))


@query(
    "SELECT case_id, CASE WHEN len(list_filter(regexp_extract_all(code_content, '\\b(\\w+)" + G.LOOKUP + "', 1), lambda v: NOT regexp_matches(code_content, '(?i)\\b' || v || '\\s*(==|!=)\\s*null') AND regexp_matches(code_content, '\\b' || v || '" + G.LOOKUP + "[\\s\\S]*?(?i:\\b' || v || '\\s*\\.)'))) > 0 THEN 0.35 ELSE 0 END::DOUBLE AS risk FROM defect_detection_case WHERE code_content IS NOT NULL"
)
def r7_null_dereference(spark, sf):
    return cases(spark, sf).where("code_content is not null").select("case_id", G.null_dereference(F.col("code_content")).alias("risk"))
