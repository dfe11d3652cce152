"""Cleaning, segmentation, extraction and term statistics over requirement and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import documents as D
from loomwright.operators.terms import inverse_document_frequency, nearest_texts, term_frequencies
from loomwright.plans.base import WITH, bounds_sql, cases, kept, requirements, states, states_sql
from loomwright.session import parallelism, read_table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _any(words):
    return "|".join(w.lower() for w in words)


def _clean(x):
    for pattern, to in ((r"<[^<>]{1,200}>", " "), (r"!?\[([^\[\]]*)\]\([^()]*\)", r"\1"), (r"\[\^[^\[\]]+\]", ""), (r"^[ \t]*((#{1,6}[ \t]+)|(>[ \t]?))+", ""), (r"[*_`~]{1,3}", ""), (r"[ \t　]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x}, ' ')"


_LINES = r"SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
_NOISE = r"(regexp_matches(lower(trim(c, ' ')), '^[-=_*. \t]{3,}$') OR regexp_matches(lower(trim(c, ' ')), '^\|?[ \t:|-]{3,}\|?$') OR regexp_matches(lower(trim(c, ' ')), '^(第 *[0-9]+ *页.*|page *[0-9]+.*|- *[0-9]+ *-|[0-9]+ */ *[0-9]+)$') OR regexp_matches(lower(trim(c, ' ')), '(\.{4,}|…{2,}) *[0-9]+$'))"
_CONTENT = f"(regexp_matches(c, '{T.NUMBERING}') OR regexp_matches(lower(c), '{_any(T.BEHAVIOUR_WORDS)}'))"


@query(f"WITH l AS ({_LINES}), c AS (SELECT doc_id, pos, {_clean('line')} AS c FROM l) SELECT doc_id, count(*) AS lines, sum({_NOISE}::INT)::BIGINT AS noise, sum({_CONTENT}::INT)::BIGINT AS content, md5(string_agg(c, chr(10) ORDER BY pos)) AS clean FROM c GROUP BY 1")
def t1_t3_lines(spark, sf):
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), T.clean_line)
    docs = read_table(spark, sf, "documents").where("text is not null").select("doc_id", lines.alias("c"))
    n = lambda c: F.size(c).cast("long")
    return docs.select("doc_id", n("c").alias("lines"), n(F.filter("c", T.is_noise_line)).alias("noise"), n(F.filter("c", T.looks_like_content)).alias("content"), F.md5(F.array_join("c", "\n")).alias("clean"))


@query(
    f"""WITH l AS ({_LINES}), t AS (SELECT doc_id, pos, line, trim(line, ' ') AS raw, count(*) OVER (PARTITION BY doc_id, trim(line, ' ')) AS times FROM l), c AS (SELECT *, {_clean('line')} AS c FROM t)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(c, chr(10) ORDER BY pos)) AS text FROM c WHERE NOT {_NOISE} AND NOT (times >= 3 AND length(c) <= 24 AND NOT {_CONTENT}) AND c <> '' GROUP BY 1"""
)
def t4_clean_documents(spark, sf):
    return D.clean_documents(read_table(spark, sf, "documents")).withColumn("text", F.md5("text"))


@query(
    f"""WITH l AS ({_LINES}), m AS (SELECT doc_id, pos, trim(line, ' ') AS raw, sum(regexp_matches(trim(line, ' '), '{T.NUMBERING}')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM l),
g AS (SELECT *, sum((raw = '')::INT) OVER (PARTITION BY doc_id, item ORDER BY pos) AS gone FROM m WHERE item > 0)
SELECT doc_id, item::BIGINT AS seq, string_agg(raw, ' ' ORDER BY pos) AS text FROM g WHERE gone = 0 GROUP BY 1, 2"""
)
def t5_numbered_segments(spark, sf):
    return D.numbered_segments(D.document_lines(read_table(spark, sf, "documents")))


@query(
    rf"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^。！？!?;；\r\n]+[。！？!?;；]?)', 1)) AS s, generate_subscripts(regexp_extract_all(text, '([^。！？!?;；\r\n]+[。！？!?;；]?)', 1), 1) AS pos FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, sum(regexp_matches(lower(s), '{_any(T.BEHAVIOUR_WORDS)}')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM s)
SELECT doc_id, seq::BIGINT AS seq, string_agg(s, '' ORDER BY pos) AS text FROM i GROUP BY 1, 2 HAVING length(string_agg(s, '' ORDER BY pos)) >= 10"""
)
def t6_sentence_segments(spark, sf):
    return D.sentence_segments(read_table(spark, sf, "documents"))


_NORMAL = rf"regexp_replace(regexp_replace(original_text, '^[ \t\r\n]*{T.NUMBERING[1:]}', ''), '[ \t\r\n　]+', '', 'g')"


@query(WITH + f", n AS (SELECT id, {_NORMAL} AS t FROM requirements WHERE original_text IS NOT NULL), k AS (SELECT min(id) AS id, t FROM n GROUP BY t) SELECT id, t AS text, printf('REQ-%04d', row_number() OVER (ORDER BY id)) AS business_id FROM k")
def t7_t8_w16_business_ids(spark, sf):
    items = requirements(spark, sf).where("original_text is not null").select("id", T.normalize_requirement(F.col("original_text")).alias("text"))
    return D.business_ids(items, ["id"], "text")


_WORDS = "regexp_extract_all({t}, '([A-Za-z_][A-Za-z_0-9]*)', 1)"
_ASCII = "list_filter(list_concat(flatten(list_transform({w}, lambda x: list_filter(string_split_regex(lower(regexp_replace(x, '([A-Z])', '_\\1', 'g')), '_+'), lambda y: y <> ''))), list_transform({w}, lambda x: lower(x))), lambda y: length(y) >= 2)".replace("{w}", _WORDS)
_HAN = "flatten(list_transform(regexp_extract_all({t}, '([一-龥]{{2,}})', 1), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"
_ALSO = ", ".join(f"CASE WHEN contains({{t}}, '{w}') THEN {{{{'term': '{e}', 'weight': {T.EQUIVALENT_WEIGHT}::DOUBLE}}}} END" for w, es in T.EQUIVALENTS.items() for e in es)
_TERMS = "list_concat(list_transform(list_concat(" + _ASCII + ", " + _HAN + "), lambda x: {{'term': x, 'weight': 1.0::DOUBLE}}), list_filter([" + _ALSO + "], lambda x: x IS NOT NULL))"


def _frequencies(name, key, source):
    return f"{name}_t AS (SELECT {key}, {_TERMS.format(t='original_text')} AS ts FROM {source} WHERE original_text IS NOT NULL), {name} AS (SELECT {key}, x.term AS term, sum(x.weight) / max(n) AS tf FROM (SELECT {key}, list_sum(list_transform(ts, lambda x: x.weight)) AS n, unnest(ts) AS x FROM {name}_t WHERE len(ts) > 0) GROUP BY 1, 2)"


_TF = _frequencies("f", "id", "requirements")


@query(WITH + ", " + _TF + " SELECT id, term, round(tf, 6) AS tf FROM f")
def t9_t10_term_frequencies(spark, sf):
    return term_frequencies(requirements(spark, sf), "id", T.weighted_terms(F.col("original_text"))).withColumn("tf", F.round("tf", 6))


@query(WITH + ", " + _TF + " SELECT term, count(*) AS df, round(ln(((SELECT count(DISTINCT id) FROM f) + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM f GROUP BY 1")
def a17_idf(spark, sf):
    tf = term_frequencies(requirements(spark, sf), "id", T.weighted_terms(F.col("original_text")))
    return inverse_document_frequency(tf, "id").withColumn("idf", F.round("idf", 6))


@query(
    WITH
    + ", "
    + _TF
    + ", "
    + _frequencies("cf", "case_id", "cases")
    + """,
idf AS (SELECT term, ln(((SELECT count(DISTINCT id) FROM f) + 1.0) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY 1),
q AS (SELECT f.id, f.term, tf * coalesce(idf, 1) AS w FROM f LEFT JOIN idf USING (term)), r AS (SELECT case_id, cf.term, tf * coalesce(idf, 1) AS w FROM cf LEFT JOIN idf USING (term)),
qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM q GROUP BY 1), rn AS (SELECT case_id, sqrt(sum(w * w)) AS n FROM r GROUP BY 1),
d AS (SELECT q.id, r.case_id, sum(q.w * r.w) AS dot FROM q JOIN r USING (term) GROUP BY 1, 2),
s AS (SELECT d.id, d.case_id, round(least(1, dot / (qn.n * rn.n)), 6) AS similarity FROM d JOIN qn USING (id) JOIN rn USING (case_id))
SELECT id, case_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, case_id) AS rank FROM s) WHERE rank <= 3"""
)
def m2_w1_nearest_cases(spark, sf):
    n = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))  # given, so that small tables stay spread
    docs = kept(read_table(spark, sf, "tg_requirement"))
    row = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]  # hashes pass nulls over
    docs = docs.select("id", "original_text", F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(""), *row).alias("k2"))
    docs = docs.repartition(n, "id").distinct()  # as requirements(), with 128 bits that stand for a row; all of an id in one place
    return nearest_texts(docs, cases(spark, sf).repartition(n, "case_id"), "id", "case_id", "original_text", 3, 6)


@query(
    WITH
    + rf"""SELECT id, array_to_string(list_transform(regexp_extract_all(original_text, '(?:^|[^A-Za-z0-9_])([0-9]{{1,4}})(?:毫秒|分钟|秒|天|次|条|字|位|元)', 1), lambda x: x), ',') AS near_units,
 array_to_string({bounds_sql('original_text')}, ',') AS bounds,
 array_to_string({states_sql('original_text')}, ',') AS states FROM requirements WHERE original_text IS NOT NULL"""
)
def t12_t14_numbers_and_states(spark, sf):
    t = F.col("original_text")
    near = F.regexp_extract_all(t, F.lit(r"(?:^|[^A-Za-z0-9_])([0-9]{1,4})(?:毫秒|分钟|秒|天|次|条|字|位|元)"), F.lit(1))
    return requirements(spark, sf).where(t.isNotNull()).select("id", F.array_join(near, ",").alias("near_units"), F.array_join(T.quantified_bounds(t).cast("array<string>"), ",").alias("bounds"), F.array_join(states(t), ",").alias("states"))


@query(
    WITH
    + rf"""SELECT id, left(trim(regexp_extract(regexp_replace(trim(original_text, ' '), '{T.NUMBERING}', ''), '^([^。.!?！？;；\n\r]*)', 1), ' '), 50) AS title,
 CASE WHEN regexp_matches(lower(original_text), '{_any(T.MUST_WORDS)}') THEN 'must' WHEN regexp_matches(lower(original_text), '{_any(T.IMPORTANT_WORDS)}') THEN 'important' WHEN regexp_matches(lower(original_text), '{_any(T.OPTIONAL_WORDS)}') THEN 'optional' ELSE 'normal' END AS priority,
 CASE WHEN regexp_matches(lower(original_text), '{_any(T.NON_FUNCTIONAL_WORDS)}') THEN 'non_functional' WHEN regexp_matches(lower(original_text), '{_any(T.CONSTRAINT_WORDS)}') THEN 'constraint' ELSE 'functional' END AS kind,
 CASE WHEN length(original_text) > 40 THEN left(original_text, 40) || '…' ELSE original_text END AS short FROM requirements WHERE original_text IS NOT NULL"""
)
def t18_t20_f9_titles(spark, sf):
    t = F.col("original_text")
    return requirements(spark, sf).where(t.isNotNull()).select("id", T.title(t).alias("title"), T.priority(t).alias("priority"), T.requirement_type(t).alias("kind"), T.truncated(t, 40).alias("short"))


_PAIRS = T.CONTRADICTIONS
_VAGUE = [*T.AMBIGUOUS_WORDS, "some", "several", "quickly", "reasonable"]
_ISSUES = ", ".join(
    [f"CASE WHEN contains(t, '{w}') THEN {{'type': 'ambiguity', 'keyword': '{w}', 'at': '{w}'}} END" for w in _VAGUE]
    + [f"CASE WHEN contains(t, '{a}') AND regexp_matches(t, '(^|[^不]){b}') THEN {{'type': 'contradiction', 'keyword': '{a} / {b}', 'at': '{a}'}} END" for a, b in _PAIRS]
    + [
        f"CASE WHEN regexp_matches(t, '{T.SENSITIVE_ACTIONS}') AND NOT regexp_matches(t, '{T.PERMISSION_WORDS}') THEN {{'type': 'missing_boundary', 'keyword': '敏感操作：' || regexp_extract(t, '{T.SENSITIVE_ACTIONS}'), 'at': regexp_extract(t, '{T.SENSITIVE_ACTIONS}')}} END",
        f"CASE WHEN regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '{T.RANGE_WORDS}') THEN {{'type': 'missing_boundary', 'keyword': '数量边界', 'at': regexp_extract(t, '[0-9]+')}} END",
    ]
)


@query(WITH + f", i AS (SELECT id, t, unnest(list_filter([{_ISSUES}], lambda x: x IS NOT NULL)) AS i FROM (SELECT id, original_text AS t FROM requirements WHERE original_text IS NOT NULL)) SELECT id, i.type AS type, i.keyword AS keyword, substr(t, greatest(0, strpos(t, i.at) - 16) + 1, strpos(t, i.at) - 1 + length(i.at) + 15 - greatest(0, strpos(t, i.at) - 16)) AS excerpt FROM i")
def t21_quality_issues(spark, sf):
    return D.quality_issues(requirements(spark, sf), "id", "original_text", _VAGUE, _PAIRS)


@query(WITH + f""", e AS (SELECT id, map({list(T.CONSTRAINT_KINDS)}, [{", ".join(f"len(regexp_extract_all(original_text, '(?:{p})'))" for p in T.CONSTRAINT_KINDS.values())}]) AS m FROM requirements WHERE original_text IS NOT NULL)
SELECT id, k AS kind, n FROM (SELECT id, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS n FROM e) WHERE n > 0""")
def t25_constraint_counts(spark, sf):
    t = F.col("original_text")
    return requirements(spark, sf).where(t.isNotNull()).select("id", F.explode(T.constraint_counts(t)).alias("kind", "n")).withColumn("n", F.col("n").cast("long"))


@query(r"""SELECT case_id, md5(regexp_replace(regexp_replace(code_content, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')) AS code FROM defect_detection_case WHERE code_content IS NOT NULL""")
def t17_without_comments(spark, sf):
    return cases(spark, sf).where("code_content is not null").select("case_id", F.md5(T.strip_comments(F.col("code_content"))).alias("code"))


@query(
    f"""SELECT case_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(original_text, '([A-Za-z]{{3,}})', 1), lambda w: lower(w)), lambda w: NOT list_contains({T.STOP_WORDS}, w)))), ',') AS words,
 string_split(class_name, '.')[-1] AS simple_class FROM defect_detection_case WHERE original_text IS NOT NULL"""
)
def t16_t30_words(spark, sf):
    return cases(spark, sf).where("original_text is not null").select("case_id", F.array_join(T.meaningful_words(F.col("original_text")), ",").alias("words"), T.simple_name(F.col("class_name")).alias("simple_class"))


@query(
    WITH
    + """, j AS (SELECT id, CASE WHEN trim(state_set, '[]') = '' OR state_set IS NULL THEN [] ELSE string_split_regex(regexp_replace(state_set, '^\\[|\\]$', '', 'g'), ', *') END AS names, try_cast(state_transitions AS JSON) AS j FROM requirements)
SELECT id, len(names)::BIGINT AS n_states, coalesce(json_array_length(j), 0)::BIGINT AS n_edges, coalesce(upper(json_extract_string(j, '$[0].from')) || '>' || upper(json_extract_string(j, '$[0].to')), '') AS first_edge,
 greatest(1, coalesce(json_array_length(j), 0) - len(names) + 2)::BIGINT AS complexity FROM j"""
)
def t22_t28_a29_state_machines(spark, sf):
    edges = F.from_json("state_transitions", "array<struct<from:string,to:string>>")
    n_edges, n_states = F.coalesce(F.when(edges.isNotNull(), F.size(edges)), F.lit(0)).cast("long"), F.size(T.listed(F.col("state_set"))).cast("long")
    first = F.coalesce(F.concat(F.upper(F.get(edges, F.lit(0))["from"]), F.lit(">"), F.upper(F.get(edges, F.lit(0))["to"])), F.lit(""))
    return requirements(spark, sf).select("id", n_states.alias("n_states"), n_edges.alias("n_edges"), first.alias("first_edge"), F.greatest(F.lit(1), n_edges - n_states + 2).alias("complexity"))


@query(WITH + r"""SELECT id, regexp_extract(semantic_vector, '"terms": *"([^"]*)"', 1) AS terms, (semantic_vector LIKE '%"vector"%') AS dense FROM requirements WHERE semantic_vector IS NOT NULL""")
def s17_t28_vector_terms(spark, sf):
    v = F.from_json("semantic_vector", "terms string, vector array<double>, dim int")
    return requirements(spark, sf).where("semantic_vector is not null").select("id", F.coalesce(v["terms"], F.lit("")).alias("terms"), v["vector"].isNotNull().alias("dense"))
