"""States, transitions and invariants of requirement texts, features of control-flow graphs, and coverage of specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A state change A -> B, with a remark in brackets after A.
CHAIN = r"([A-Z][A-Z0-9_]{1,20})\s*(?:[（(][^）)]*[）)])?\s*->\s*([A-Z][A-Z0-9_]{1,20})"
NAMED = r"状态(?:变更为|变为|改为|为|下)?\s*([A-Za-z][A-Za-z0-9_]{1,20})"

# Parts of the names of initial states, and states where a text names none.
INITIAL_PARTS = ["pending", "new", "created", "ready", "initial"]
DEFAULT_STATES = ["initial", "processing", "completed", "failed"]


def explicit_states(text: Column) -> Column:
    """Names in state changes, then names that follow the word for a state; lower case, each once."""
    chains = F.regexp_extract_all(text, F.lit(CHAIN), F.lit(0))
    ends = F.flatten(F.transform(chains, lambda m: F.array(F.regexp_extract(m, CHAIN, 1), F.regexp_extract(m, CHAIN, 2))))
    return F.array_distinct(F.transform(F.concat(ends, F.regexp_extract_all(text, F.lit(NAMED), F.lit(1))), F.lower))


def initial_state(text: Column) -> Column:
    """The first explicit state with a name for a beginning, else ``initial``."""
    starts = F.filter(explicit_states(text), lambda s: s.rlike("|".join(INITIAL_PARTS)))
    return F.coalesce(F.get(starts, F.lit(0)), F.lit("initial"))


def explicit_transitions(text: Column) -> Column:
    """a->b of each state change. A name ends one change before it can begin the next, so in A -> B -> C -> D only the first
    and the last are taken. Without any, a text on success or failure gets the default ones."""
    chains = F.regexp_extract_all(text, F.lit(CHAIN), F.lit(0))
    found = F.array_distinct(F.transform(chains, lambda m: F.lower(F.concat(F.regexp_extract(m, CHAIN, 1), F.lit("->"), F.regexp_extract(m, CHAIN, 2)))))
    usual = F.array(F.lit("initial->processing"), F.when(F.contains(text, F.lit("成功")), "processing->completed"), F.when(F.contains(text, F.lit("失败")), "processing->failed"))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(usual, lambda x: x.isNotNull()))


def invariant_sentences(text: Column, pattern: str, longest: int = 60) -> Column:
    """Sentences with a word of the pattern, each up to a length."""
    parts = F.transform(F.split(text, r"[。；;！!？?\n]"), lambda s: F.trim(s))
    return F.transform(F.filter(parts, lambda s: (s != "") & s.rlike(pattern)), lambda s: F.left(s, F.lit(longest)))


GRAPH = "nodes array<struct<id:int,type:string>>, edges array<struct<from:int,to:int,label:string>>"


def graph_features(graph: Column) -> Column:
    """Features of a control-flow graph of GRAPH's form: counts of nodes and edges, branches, loops, returns, throws and
    exception edges, whether an edge leads back, and the cyclomatic complexity (at least 1). Null for a null graph.

    An edge leads back if its target stands no later in the list of nodes than its source; edges to a handler do not
    count. Where nodes are not marked as loops, edges that lead back stand for them.
    """
    nodes, edges = F.coalesce(graph["nodes"], F.from_json(F.lit("[]"), "array<struct<id:int,type:string>>")), F.coalesce(graph["edges"], F.from_json(F.lit("[]"), "array<struct<from:int,to:int,label:string>>"))
    ids = F.transform(nodes, lambda n: n["id"])
    of_type = lambda *types: F.size(F.filter(nodes, lambda n: n["type"].isin(*types)))
    handler = lambda e: F.coalesce(e["label"] == "catch", F.lit(False))
    place = lambda i: F.array_position(ids, i)
    back = F.size(F.filter(edges, lambda e: ~handler(e) & (place(e["from"]) > 0) & (place(e["to"]) > 0) & (place(e["to"]) <= place(e["from"]))))
    return F.when(
        graph.isNotNull(),
        F.struct(
            F.size(nodes).alias("nodes"),
            F.size(edges).alias("edges"),
            of_type("if", "switch", "goto").alias("branches"),
            F.greatest(of_type("loop"), back).alias("loops"),
            of_type("return").alias("returns"),
            of_type("throw").alias("throws"),
            F.size(F.filter(edges, handler)).alias("exception_edges"),
            (back > 0).alias("loop_present"),
            F.greatest(F.lit(1), F.size(edges) - F.size(nodes) + 2).alias("complexity"),
        ),
    )


# Elements of a specification, as alternatives of patterns.
SPEC_ELEMENTS = {
    "module": [r"\bmodule\s+\w+"],
    "entity": [r"\bsig\s+\w+\s*\{[^}]*state[^}]*\}"],
    "states": [r"\babstract\s+sig\s+State\b", r"\bone\s+sig\s+\w+\s+extends\s+State\b"],
    "init": [r"\bpred\s+init\b[^}]*state\s*=\s*\w+[^}]*\}"],
    "transition": [r"\bpred\s+transition\b[^}]*state'[^}]*\}"],
    "fact": [r"\bfact\b"],
    "check": [r"\b(check|assert)\s+\w+"],
}


def spec_coverage(spec: Column) -> Column:
    """Share of the elements that a specification has, comments aside; 0 for a blank one."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(spec, F.lit("")), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return sum((bare.rlike("|".join(p)).cast("int") for p in SPEC_ELEMENTS.values()), F.lit(0)) / float(len(SPEC_ELEMENTS))
