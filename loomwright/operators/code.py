"""Static checks, line localisation, specification parsing and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.ranking import top_per
from loomwright.session import cut

LANGUAGES = ["java", "py", "go", "c", "cpp"]

# Static checks of one line; functions of C, C++ and Go are checked as a whole, and Python on its syntax tree.
CHECKS = {
    "java": {"sql_concat": r"\"(SELECT|UPDATE|DELETE|INSERT) [^\"]*\" *\+", "endless_loop": r"while *\( *true *\)", "empty_catch": r"catch *\([^()]*\) *\{ *\}", "index_equals_size": r"<= *\w+\.(size|length)\(", "string_identity": r"\w == \"", "get_zero": r"\.get\(0\)"},
    "py": {"bare_except": r"except *:", "mutable_default": r"def \w+\([^()]*= *(\[\]|\{\})", "eval": r"\beval\(", "none_equality": r"== None", "sql_format": r"(SELECT|UPDATE|DELETE) .*%s?.* % "},
}


def code_lines(files: DataFrame, id_col: str, name_col: str, code_col: str) -> DataFrame:
    """(id_col, lang, line_no, line) of each line of files with a known extension."""
    lang = F.lower(F.regexp_extract(name_col, r"\.([A-Za-z]+)$", 1))
    rows = files.where(F.col(code_col).isNotNull()).select(id_col, lang.alias("lang"), F.posexplode(F.split(code_col, r"\r\n|\r|\n")).alias("_p", "line"))
    return rows.where(F.col("lang").isin(LANGUAGES)).select(id_col, "lang", (F.col("_p") + 1).cast("long").alias("line_no"), "line")


def static_defects(lines: DataFrame, id_col: str) -> DataFrame:
    """(id_col, lang, line_no, check) of each line that a check of its language matches."""
    hits = [F.when((F.col("lang") == lang) & F.col("line").rlike(p), name) for lang, checks in CHECKS.items() for name, p in checks.items()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return lines.select(id_col, "lang", "line_no", F.explode(found).alias("check"))


def locate(lines: DataFrame, id_col: str, evidence: dict[str, tuple[str, float]], k: int = 3) -> DataFrame:
    """(id_col, line_no, score, rank): the k lines with the most evidence, by weight of the patterns that they match; of
    equal ones the later line comes first."""
    score = sum((F.when(F.col("line").rlike(p), w).otherwise(0.0) for p, w in evidence.values()), F.lit(0.0))
    scored = lines.select(id_col, "line_no", F.round(score, 6).alias("score")).where("score > 0")
    return top_per(scored, [id_col], [F.desc("score"), F.desc("line_no")], k)


def hit_rates(truth: DataFrame, located: DataFrame, id_col: str, within: int = 2) -> DataFrame:
    """One row: cases, and the share of those whose true line is within ``within`` lines of the first, and of any, of the
    located ones. truth(id_col, true_line)."""
    near = located.join(truth, id_col).where(F.abs(F.col("line_no") - F.col("true_line")) <= within).groupBy(id_col).agg(F.min("rank").alias("_r"))
    all_ = truth.join(near, id_col, "left")
    return all_.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.when(F.col("_r") == 1, 1.0).otherwise(0.0)), 6).alias("hit1"), F.round(F.avg(F.when(F.col("_r").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit3"))


def reachable(edges: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    """(group, state) that can be reached from the group's start along edges(group, src, dst); starts(group, state) are
    included. Breadth first: each round joins the frontier with the edges and keeps what is new."""
    seen = cut(starts.select(group, "state").distinct())
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(edges, (frontier[group] == edges[group]) & (frontier["state"] == edges["src"])).select(frontier[group], edges["dst"].alias("state")).distinct()
        frontier = cut(step.join(seen, [group, "state"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def spec_text(name: Column, states: Column, invariants: Column) -> Column:
    """A structural specification: a signature, its states and its facts."""
    body = F.array_join(F.transform(states, lambda s: F.concat(F.lit("one sig "), s, F.lit(" extends State {}"))), "\n")
    facts = F.array_join(F.transform(invariants, lambda x: F.concat(F.lit("fact { "), x, F.lit(" }"))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("module "), name), F.lit("abstract sig State {}"), F.nullif(body, F.lit("")), F.nullif(facts, F.lit("")))


def spec_flags(spec: Column) -> Column:
    """What a specification has: module, signature, fact, predicate, check, run, balanced braces."""
    opened, closed = F.length(spec) - F.length(F.replace(spec, F.lit("{"), F.lit(""))), F.length(spec) - F.length(F.replace(spec, F.lit("}"), F.lit("")))
    return F.struct(
        spec.rlike(r"(?m)^module ").alias("module"), spec.rlike(r"\bsig \w+").alias("sig"), spec.rlike(r"\bfact\b").alias("fact"), spec.rlike(r"\bpred \w+").alias("pred"), spec.rlike(r"\b(check|assert)\b").alias("check"), spec.rlike(r"\brun\b").alias("run"), (opened == closed).alias("balanced")
    )
