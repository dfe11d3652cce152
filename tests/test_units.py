from pyspark.sql import functions as F

from loomwright.functions import scoring as S
from loomwright.functions import signals as G
from loomwright.functions import text as T
from loomwright.operators.documents import clean_documents, document_lines, numbered_segments, quality_issues
from loomwright.operators.units import code_units, function_static_defects, python_static_defects

JAVA = """package a;
class A {
    // if (x) { y(); }
    public static int f(int a, String b) throws E {
        for (int i = 0; i < 3; i++) { if (a > 1 && b != null) { callMe("}"); } }
        return 1;
    }

    int g() { return 2; }
}
"""
GO = "package a\n\nfunc (s *S) Load(id string) (int, error) {\n\tif id == \"{\" {\n\t\treturn 0, nil\n\t}\n\treturn 1, nil\n}\n"
PY = "def f(x=[]):\n    try:\n        return eval(x) if x == None else 1\n    except:\n        pass\n\nclass A:\n    def g(self):\n        return 'SELECT * FROM t WHERE a = %s' % self\n"


def test_units_and_checks(spark):
    files = spark.createDataFrame([(1, "A.JAVA", JAVA), (2, "b.go", GO), (3, "c.py", PY), (4, "d.py", "def ("), (5, "e.py", None), (6, "f.txt", "x"), (7, "g.java", "class A { void f() { if (x) {")], "id long, name string, language string")
    got = {(r.id, r["name"]): (r.start_line, r.end_line, r.complexity) for r in code_units(files, "id", "name", "language").collect()}
    assert got == {(1, "f"): (4, 7, 4), (1, "g"): (9, 9, 1), (2, "Load"): (3, 8, 2), (3, "f"): (1, 5, 3), (3, "g"): (8, 9, 1)} | {k: v for k, v in got.items() if k[0] == 7}
    found = {(r.id, r.line_no, r.check) for r in python_static_defects(files, "id", "name", "language").collect()}
    assert found == {(3, 1, "mutable_default"), (3, 3, "eval"), (3, 3, "none_equality"), (3, 4, "bare_except"), (3, 9, "sql_format")}


def test_null_dereference(spark):
    rows = ["A v = m.get(k); v.run();", "A v = m.get(k); if (v != null) v.run();", "A v = m.get(k);", "x = 1;"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, c string")
    assert [r.x for r in df.orderBy("i").select(G.null_dereference(F.col("c")).alias("x")).collect()] == [0.35, 0.0, 0.0, 0.0]


def values(spark, column, rows):
    """The column over rows of (text, code)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, c string")
    return [r.x for r in df.withColumn("x", column).orderBy("i").collect()]


def test_states(spark):
    assert values(spark, F.array_join(T.states(F.col("t")), ","), [("订单 pending 后已支付，再已发货", ""), ("待支付或待处理", ""), ("无", "")]) == ["PENDING,PAID,SHIPPED", "PENDING", ""]
    assert values(spark, F.array_join(T.states(F.col("t"), ["DRAFT", "LOCKED"], {}), ","), [("draft 与 LOCKED", "")]) == ["DRAFT,LOCKED"]
    got = values(spark, G.state_mismatch(T.states(F.col("t")), T.states(F.col("c"))), [("PAID 和 SHIPPED", "PAID"), ("PAID", "x"), ("PAID", "PAID"), ("x", "PAID")])
    assert got == [0.25, 0.55, 0.0, 0.0]


def test_numeric_mismatch(spark):
    rows = [
        ("最多 500 个字符", "if (s.length() > 1000)"),  # 1000 is a conversion, so nothing compares
        ("最多 500 个字符", "if (s.length() > 900)"),
        ("最多 500 个字符", "if (s.length() > 500 && n > 400)"),
        ("60 秒内最多 10 条", "limit = 10; window = 30;"),
        ("重试 3 次", "i = i + 1; // 3"),
        ("重试 1 次", "maxRetry = 1;"),
        ("费率 0.5，共 7 次", "x * 0.5; n > 8"),
        ("5 次", "n > 900"),
        ("3 与 3 与 4", "a = 3; b = 5;"),
        ("没有", "n > 5"),
    ]
    got = [round(x, 6) for x in values(spark, G.numeric_mismatch(F.col("t"), F.col("c")), rows)]
    assert got == [0.0, 0.45, 0.0, 0.225, 0.0, 0.0, 0.45, 0.0, 0.15, 0.0]


def test_missing_validation(spark):
    rows = [
        ("必须校验用户id和数量", "f(x);"),
        ("必须校验用户id和数量", "if (userId == null) return;"),
        ("必须校验用户id和数量", "if (userId == null || quantity <= 0) return;"),
        ("必须校验用户id和数量", "validateAll(req);"),
        ("必须校验用户id和数量", "// userId == null\nf(x);"),
        ("按数量查询", "f(x);"),
        ("必须校验", "f(x);"),
    ]
    assert values(spark, G.missing_validation(F.col("t"), F.col("c")), rows) == [0.6, 0.2, 0.0, 0.0, 0.6, 0.0, 0.0]


def test_state_flow(spark):
    move = 'if (STATUS_{}.equals(o.getStatus())) {{ o.setStatus(Order.STATUS_{}); }}'
    text = "订单状态依次为 PENDING、PAID、SHIPPED、COMPLETED 流转"
    rows = [(text, move.format("PAID", "COMPLETED")), (text, move.format("PAID", "SHIPPED")), (text, move.format("PAID", "OTHER")), ("PENDING、PAID、SHIPPED", move.format("PENDING", "SHIPPED")), (text, "x")]
    assert values(spark, G.state_flow_violation(F.col("t"), F.col("c"), T.states(F.col("t"))), rows) == [0.4, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, F.array_join(G.state_order(F.col("t"), T.states(F.col("t"))), ">"), [("已支付，先 COMPLETED 后 PENDING", "")]) == ["COMPLETED>PENDING>PAID"]


def test_bounds(spark):
    bounds = F.array_join(T.quantified_bounds(F.col("t")).cast("array<string>"), ",")
    assert values(spark, bounds, [("60 秒内最多10条，不超过约500，第 7 章", ""), ("1234567秒", ""), ("", "")]) == ["60,10,500", "234567", ""]
    literal = [
        ("不超过500字符", "if (s.length() > 1000) {"),
        ("不超过500字符", "if (s.length() > 500) {"),
        ("不超过500字符", "int m = 500; if (s.length() > 1000) {"),
        ("不超过500字符", "if (s.length() > 9000) {"),
        ("不超过500字符", "s.length() == 1000"),
        ("没有", "n > 3"),
    ]
    assert values(spark, G.bound_mismatch(F.col("t"), F.col("c")), literal) == [0.45, 0.0, 0.0, 0.0, 0.0, 0.0]
    lines = F.split(F.col("c"), "\n")
    named = [
        ("60秒内有效", "static final int WINDOW = 30;\nif (age > WINDOW) {"),
        ("60秒内有效", "static final int WINDOW = 60;\nif (age > WINDOW) {"),
        ("60秒内有效", "static final int WINDOW = 30;\nuse(WINDOW)"),
        ("60秒内有效", "int WINDOW = 30;\nif (age > WINDOW) {"),
        ("60秒内有效", "static final int WINDOW = -30;\nif (age > WINDOW) {"),
        ("60秒内有效", "static final int WINDOW = 99999999999;\nif (age > WINDOW) {"),
    ]
    assert values(spark, G.bound_mismatch(F.col("t"), F.col("c"), lines), named) == [0.45, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_code_bugs(spark):
    each = G.code_bugs(F.col("c"))
    rows = [("", x) for x in ("list.get(list.size())", "catch (E e) { }", "double a == b", "{ return true; }", "x / 0", "class C implements Comparator { x(); return 1; }", "return 1;", "x / 05")]
    got = values(spark, F.array_join(F.filter(F.array(*[F.when(c > 0, F.lit(k)) for k, c in each.items()]), lambda x: x.isNotNull()), ","), rows)
    assert got == ["get_size", "empty_catch", "float_equality", "constant_return", "division_by_zero", "one_sided_compare", "", ""]


def test_penalties(spark):
    numeric = F.round(S.numeric_penalty(T.numbers(F.col("t")), T.numbers(F.col("c"))), 6)
    assert values(spark, numeric, [("10 或 60", "20"), ("10", "10"), ("10", ""), ("0 与 10", "5")]) == [0.225, 0.0, 0.0, 0.225]
    assert values(spark, S.state_penalty(T.states(F.col("t")), T.states(F.col("c"))), [("PAID SHIPPED", "PAID"), ("PAID SHIPPED COMPLETED", "PAID"), ("x", "")]) == [0.0, 0.45, 0.0]


def test_verdicts(spark):
    rows = [
        (True, True, 0.9, 0.0, True, "LLM_CONSENSUS_CONSISTENT"),
        (False, False, 0.0, 0.9, False, "LLM_CONSENSUS_DEFECT"),
        (True, False, 0.3, 0.0, False, "LLM_ARBITRATION_DEFECT"),
        (True, False, 0.29, 0.0, True, "LLM_ARBITRATION_KEEP"),
        (True, False, 0.29, 0.45, False, "RULE_QUANTIFY_VETO"),
        (True, True, 0.0, 0.45, False, "RULE_QUANTIFY_VETO"),
        (True, True, 0.0, 0.44, True, "LLM_CONSENSUS_CONSISTENT"),
        (None, False, 0.0, 0.9, False, "LLM_SINGLE"),
        (None, None, 0.9, 0.9, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a boolean, b boolean, r double, q double, ok boolean, path string")
    for row in df.withColumn("m", S.merged_verdict(F.col("a"), F.col("b"), F.col("r"), F.col("q"))).collect():
        assert (row.m.consistent, row.m.path) == (row.ok, row.path), row
    gate = [(False, 0.7, True, "LLM_SIM_GATE"), (False, 0.69, False, "LLM_SINGLE"), (True, 0.1, True, "LLM_SINGLE")]
    df = spark.createDataFrame(gate, "a boolean, t double, ok boolean, path string")
    assert all((r.g.consistent, r.g.path) == (r.ok, r.path) for r in df.withColumn("g", S.gated_verdict(F.col("a"), F.col("t"))).collect())
    back = [(True, "p", 0.1, "consistent", "p"), (False, "p", 0.49, "serious_inconsistent", "p"), (False, None, 0.5, "general_inconsistent", "LLM"), (None, None, 0.1, "rules", "RULE_FALLBACK")]
    df = spark.createDataFrame(back, "a boolean, p string, t double, s string, q string")
    assert all((r.b.status, r.b.path) == (r.s, r.q) for r in df.withColumn("b", S.written_back(F.col("a"), F.col("p"), F.col("t"), F.lit(0.5), F.lit("rules"))).collect())


def test_transitions_take_every_second_arrow(spark):
    df = spark.createDataFrame([("DRAFT -> QUEUED -> SHIPPED -> CLOSED",), ("x",)], "t string")
    assert [r.x for r in df.select(F.array_join(T.transitions(F.col("t"), ["DRAFT", "QUEUED", "SHIPPED", "CLOSED"]), ",").alias("x")).collect()] == ["DRAFT>QUEUED,SHIPPED>CLOSED", ""]


def test_documents(spark):
    text = "# Title\nhead\n1. first\n   goes on\n\nhead\nREQ-002: **must** hold\n-----\nPage 3\nhead\n<b>x</b> [y](http://z)"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in clean_documents(docs).collect()}
    assert clean == {1: "Title\n1. first\ngoes on\nREQ-002: must hold\nx y"}
    items = {(r.doc_id, r.text) for r in numbered_segments(document_lines(docs)).collect()}
    assert items == {(1, "1. first goes on"), (1, "REQ-002: **must** hold ----- Page 3 head <b>x</b> [y](http://z)")}


C_CODE = """#include <stdio.h>
int leak(int n) {
    /* free(p) */
    char *p = malloc(n);
    p[0] = 'a';
    return 0;
}
int fine(int n) {
    char *p = malloc(n);
    if (p == NULL) { return 1; }
    free(p);
    return 0;
}
void copy(char *a, const char *b) {
    // strcpy
    strcpy(a, b);
    strcat(a, b);
}
int open_it(const char *n) {
    FILE *f = fopen(n, "r");
    return f != 0;
}
"""
GO_CODE = """package a

func Bad(n string) int {
\tf, err := os.Open(n)
\t// if err != nil, Close
\treturn f.Size()
}

func Good(n string) error {
\tf, err := os.Open(n)
\tif err != nil {
\t\treturn err
\t}
\tdefer f.Close()
\treturn nil
}

func Drop() {
\tx, _ := load(1)
\tfor _, v := range x {
\t\tuse(v)
\t}
\tmu.Lock()
\tpanic("stop")
}
"""


def test_function_defects(spark):
    files = spark.createDataFrame([(1, "a.C", C_CODE), (2, "b.go", GO_CODE), (3, "c.cpp", "void f() {\n  try { g(); }\n  catch (...) { }\n}\n"), (4, "d.go", None), (5, "e.c", ""), (6, "f.java", C_CODE)], "id long, name string, code string")
    found = {(r.id, r["name"], r.line_no, r.check) for r in function_static_defects(files, "id", "name", "code").collect()}
    assert found == {
        (1, "leak", 4, "null_risk"),  # the comment counts as freeing, as the raw text is looked at
        (1, "copy", 16, "unbounded_call"),
        (1, "open_it", 20, "file_not_closed"),
        (2, "Bad", 3, "error_not_checked"),
        (2, "Bad", 4, "not_closed"),
        (2, "Drop", 19, "error_ignored"),
        (2, "Drop", 23, "not_unlocked"),
        (2, "Drop", 24, "panic"),
        (3, "f", 3, "catch_all"),
    }, found


def test_quality_issues(spark):
    rows = [(1, "必须在合适的时间导出 5 条，不得禁止"), (2, "仅管理员可删除，最多 3 条"), (3, "必须完成，不不得"), (4, None), (5, "")]
    got = quality_issues(spark.createDataFrame(rows, "id long, t string"), "id", "t", T.AMBIGUOUS_WORDS, T.CONTRADICTIONS)
    assert {(r.id, r.type, r.keyword) for r in got.collect()} == {(1, "ambiguity", "合适"), (1, "contradiction", "必须 / 禁止"), (1, "contradiction", "必须 / 不得"), (1, "missing_boundary", "敏感操作：导出"), (1, "missing_boundary", "数量边界")}
    assert {r.excerpt for r in got.where("keyword = '合适'").collect()} == {"必须在合适的时间导出 5 条，不得禁止"}


def test_terms(spark):
    got = values(spark, F.transform(T.weighted_terms(F.col("t"), {"数量": ["quantity"]}), lambda x: F.concat(x["term"], F.lit("*"), x["weight"].cast("string"))), [("数量和 getName", ""), ("一 a", ""), ("", "")])
    assert got == [["get*1.0", "name*1.0", "getname*1.0", "数量*1.0", "量和*1.0", "quantity*0.5"], [], []]


def test_logic_inversion(spark):
    rows = [("至少 5 次", "if (n < 5)"), ("至少 5 次", "if (n <= 5)"), ("至少 5 次", "if (5 < n)"), ("至少 5 次", "if (5 <= n)"), ("不超过 5 次", "if (n < 5)"), ("至少 5 次", "// n < 5\nn > 5"), ("至少 5 次", "n < 55"), ("金额大于 8 元才可提交", "x < 8"), ("至少 0.5", "x < 5")]
    assert values(spark, G.logic_inversion(F.col("t"), F.col("c")), rows) == [0.35, 0.0, 0.35, 0.0, 0.0, 0.0, 0.0, 0.35, 0.0]


def test_null_dereference_order_and_names(spark):
    rows = [("", x) for x in ("v.run(); v = m.get(k);", "v = a.b.getOrDefault(k, 1); use(); V.run();", "v = m.get(k); if (V == null) {} v.run();", "w = m.get(k); v.run();", "v = m.find(k); v.run();", "")]
    assert values(spark, G.null_dereference(F.col("c")), rows) == [0.0, 0.35, 0.0, 0.0, 0.0, 0.0]
