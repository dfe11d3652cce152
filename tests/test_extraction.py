import json

from pyspark.sql import functions as F

from loomwright.functions import extraction as E
from loomwright.operators import ranking as R
from loomwright.operators.aggregates import kappa


def values(spark, make, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.x for r in df.withColumn("x", make(F.col("t"))).orderBy("i").collect()]


def test_states_and_transitions(spark):
    chain = "PENDING（待支付）-> PAID（已支付）-> SHIPPED -> COMPLETED"
    texts = [chain, "状态变更为 Created，之后状态为PAID", "操作成功，否则失败", "", None]
    join = lambda f: lambda t: F.array_join(f(t), ",")
    assert values(spark, join(E.explicit_states), texts) == ["pending,paid,shipped,completed", "created,paid", "", "", None]
    assert values(spark, join(E.explicit_transitions), texts) == ["pending->paid,shipped->completed", "initial->processing", "initial->processing,processing->completed,processing->failed", "initial->processing", "initial->processing"]
    assert values(spark, E.initial_state, texts) == ["pending", "created", "initial", "initial", "initial"]


def test_invariants(spark):
    texts = ["金额必须大于零。列表可排序；不得删除" + "x" * 80, "无", ""]
    got = values(spark, lambda t: E.invariant_sentences(t, "必须|不得"), texts)
    assert got == [["金额必须大于零", ("不得删除" + "x" * 80)[:60]], [], []]


def test_graph_features(spark):
    def graph(nodes, edges):
        return json.dumps({"nodes": [{"id": i, "type": t} for i, t in nodes], "edges": [{"from": a, "to": b, "label": x} for a, b, x in edges]})

    texts = [
        graph([(0, "start"), (1, "if"), (2, "stmt"), (3, "return")], [(0, 1, ""), (1, 2, "true"), (1, 3, "false"), (2, 1, "")]),
        graph([(0, "start"), (1, "loop"), (2, "throw")], [(0, 1, ""), (2, 0, "catch"), (1, 9, "")]),
        graph([(0, "start")], [(0, 0, "")]),
        json.dumps({"nodes": []}),
        "no JSON",
        None,
    ]
    names = ("nodes", "edges", "branches", "loops", "returns", "throws", "exception_edges", "loop_present", "complexity")
    got = values(spark, lambda t: E.graph_features(F.from_json(t, E.GRAPH)), texts)
    assert [tuple(g[n] for n in names) for g in got[:4]] == [(4, 4, 1, 1, 1, 0, 0, True, 2), (3, 3, 0, 1, 0, 1, 1, False, 2), (1, 1, 0, 1, 0, 0, 0, True, 2), (0, 0, 0, 0, 0, 0, 0, False, 2)]
    assert got[5] is None


def test_spec_coverage(spark):
    whole = "module m\nabstract sig State {}\nsig Order { state: State }\npred init { o.state = A }\npred transition { state' = B }\nfact { x }\ncheck safe"
    texts = [whole, "module m // fact\n/* check a */", "", None]
    assert [round(x * 7) for x in values(spark, E.spec_coverage, texts)] == [7, 1, 0, 0]


def test_review_plan(spark):
    rows = [(i, "suspect" if i % 10 == 0 else "gray" if i % 10 == 1 else "risk" if i % 10 == 2 else "clear") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, kind string").repartition(3)
    classes = [F.col("kind") == k for k in ("suspect", "gray", "risk")]

    def plan(rate, cap):
        got = R.review_plan(df, classes, ["id"], rate, cap)
        return got, [(r.id, r.reason) for r in sorted(got.where("place is not null").collect(), key=lambda r: r.place)]

    clear = [i for i, k in rows if k == "clear"]
    wanted = [(i, c) for c in range(3) for i, k in rows if i % 10 == c] + [(clear[k * 10], 3) for k in range(7)]
    whole, order = plan(0.1, 0)
    assert order == wanted and whole.count() == 100
    assert plan(0.1, 33)[1] == wanted[:33] and plan(0.1, 15)[1] == wanted[:15] and plan(0.0, 50)[1] == wanted[:30]
    rest = [i for i in clear if (i, 3) not in wanted]
    assert [r.id for r in R.escalated(whole, F.col("id") == clear[0], ["id"], 0.1, 5).orderBy("id").collect()] == rest[:5]
    assert R.escalated(whole, F.col("id") == clear[0], ["id"], 0.2, 5).count() == 0
    assert R.escalated(whole, F.lit(False), ["id"], 0.0, 5).count() == 0


def test_kappa_per_group(spark):
    df = spark.createDataFrame([("x", True, True), ("x", False, False), ("y", True, False), ("y", False, True), ("y", None, True)], "g string, a boolean, b boolean")
    assert {(r.g, r.n, r.kappa) for r in kappa(df, F.col("a"), F.col("b"), ["g"]).collect()} == {("x", 2, 1.0), ("y", 2, -1.0)}
