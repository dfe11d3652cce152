import ast
import random
import warnings
from pathlib import Path

import pytest

from loomwright.llm.syntax import check_files, explain, failure_rates, parse

VALID = {
    "java": [
        "",
        "package a.b;\nimport java.util.*;\npublic sealed interface S permits A {}\nrecord A(int x, String... y) implements S { A { x++; } }\n",
        "class T<K extends Comparable<K>> { Map<String, List<List<K>>> m = new HashMap<>(); int f(final int[] a) throws E { for (var x : a) { if (x >>> 2 > 1) m.get(x).add((K) x); } return a.length > 0 ? -1 : +1; } }",
        'class T { String s = """\n  <<<<<<< x\n  "quoted" \\"""\n  """; Runnable r = () -> { }; Function<A, B> g = A::new; int h = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; }',
        "class T { @Override public void f() { try (var r = open()) { r.run(); } catch (A | B e) { throw e; } finally { } do x[0]++; while (x[0] < 3); if (o instanceof String s && s.isEmpty()) return; new T().f(); } }",
        "enum E { A(1) { void f() {} }, B; E(int... x) {} }\n@interface I { int v() default 1; }",
        "class T { boolean f(int a, int b) { return a < b && b > (a); } char c = '\\''; char d = '）'; }",
    ],
    "go": [
        "package main\n\nimport \"fmt\"\n\nfunc f(id string, qty int) bool {\n\tleft := '\\''\n\tif left > 3 {\n\t\treturn true\n\t} else {\n\t\tfmt.Println(\"a\")\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\treturn qty > 1\n}\n",
        "package a\n\ntype S[T any] struct {\n\tx, y int `json:\"x\"`\n\t*B\n}\n\nfunc (s *S[T]) M(a ...int) (int, error) {\n\tm := map[string][]int{\"a\": {1, 2}}\n\tswitch v := a.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase x := <-c:\n\tcase c <- 1:\n\t}\n\tfor k, v := range m {\n\t}\n\tgo func() {}()\n\tdefer f(a...)\n\treturn s.x[1:2], nil\n}\n",
        "package a\n\nvar s = `raw\n<<<<<<< x\n`\n\nconst (\n\tA = iota\n\tB\n)\n\ntype I interface {\n\t~int | string\n\tF() error\n}\n",
    ],
    "c": [
        "",
        '#include <stdio.h>\n#define MAX 3\n#if 0\nint broken( {\n<<<<<<< draft\n#endif\nstruct A { int id; unsigned x : 3; };\nstatic int f(const char* id, int n) {\n    for (int i = 0; i < n; i++) { fputs("a" "b", stderr); }\n    return (int) n > *id;\n}\n',
        "typedef int (*cb)(void *, size_t);\nenum E { A = 1, B, };\nint a[] = { [0] = 1, 2 };\nint main(void) { struct A x = { .id = 3 }; A *p = &x; goto end; end: return p->id ? sizeof(int) : sizeof x; }",
        "#ifdef DEBUG\nthis is not code\n#else\nint x;\n#endif\n",
    ],
    "cpp": [
        "",
        '#include <string>\nnamespace a::b {\nclass K : public Base<int> {\npublic:\n    explicit K(int x) : x_(x), y_{1} {}\n    virtual ~K() = default;\n    bool f(const std::string& id, int n) const override { std::cerr << "x" << std::endl; auto g = [&](auto v) -> int { return v; }; return n < 3 && n > 1; }\n    K operator+(const K& o) const;\nprivate:\n    std::map<int, std::vector<std::string>> m_;\n};\n}\n',
        'template <typename T, int N = 3>\nT max(T a, T b) { for (const auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) {} } return static_cast<T>(a) > b ? a : b; }\nauto s = R"x(<<<<<<< " )x";\n',
        "static int f(const char* id, int qty) {\n    char c = '\\'';\n    return qty >> 3;\n}\n",
    ],
    "python": ["", "x = 1", "def f(a, /, *b, c: int = 1, **d) -> int:\n\tif a:\n\t\treturn f'{a!r:>{c}} {{}}'\n\telse: pass\n", "match x:\n  case [1, *y] if y: pass\n  case A(b=1) | {'k': 2, **z}: pass\n"],
}
BROKEN = {
    "java": ["class A {", "class A { int x = (1; }", "class A { void f() { int i = 0） } }", "package a\nclass A {}", "class A { }\n<<<<<<< HEAD\n", 'class A { String s = "abc\n"; }', "class A { void f() { x > 1; } }", "class A { char c = ''; }", "class A { } }"],
    "go": ["", "func f() {}", "package a\nfunc f() {\n", "package a\nfunc f()\n{\n}\n", "package a.b;\n", "package a\nfunc f() {\n\tx := (1\n}\n", "package a\nvar s = `x\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n"],
    "c": ["int f( {", "int x", "class A {};", "int f(void) { return std::x; }", "#if 1\nint x;\n", "#endif\n", "int f(void) { if (x { } }", "import logging\n", 'char* s = "a;\n', "/* open", "# comment\n"],
    "cpp": ["class A { int x; }", "class A { void f() { } ", "int f() { return 1 }", "def f():\n  pass\n", "package a.b;\n", "<?xml version='1.0'?>"],
    "python": ["def f(:\n pass", "if x:\npass\n", "x = (1", "x = 'a", "  x = 1\n y = 2", "int x = 1;", "x = 012", "for i in range(3):\n<<<<<<< HEAD\n  pass\n", "f'{x'", "x = （1)"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        for variant in (text, text.replace("\n", "\r\n")):
            assert parse(variant, language) == (True, -1), variant


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for text in BROKEN[language]:
        assert not parse(text, language)[0], text


def _truth(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return False
    return True


def test_python_against_the_interpreter():
    rnd = random.Random(5)
    files = sorted(Path(ast.__file__).parent.glob("*.py"))
    for path in rnd.sample(files, 25):
        text = path.read_text(encoding="utf-8", errors="ignore")[:20_000]
        for _ in range(4):
            assert parse(text, "python")[0] == _truth(text), path
            lines = text.splitlines(keepends=True)
            k = rnd.randrange(len(lines))
            cut = rnd.randrange(len(text))
            text = rnd.choice([text[:cut], "".join(lines[:k] + lines[k + 1 :]), text[:cut] + text[cut + 1 :]]) or "x"


def test_causes():
    text = "class A {\n<<<<<<< HEAD\n  int x;\n=======\n  int y;\n>>>>>>> b\n}\n"
    assert explain(text, "java", parse(text, "java")[1]) == "conflict"
    assert explain("class A {\n  int f() {\n", "java", 21) == "truncated"
    assert explain("package a\n\nvar x = 1\n", "java", 11) == "other_language:go"


def test_deep_and_long():
    deep = "x = " + "(" * 3000 + "1" + ")" * 3000 + "\n"
    assert parse(deep, "python")[0]
    assert parse("x = 1" + " + 1" * 50_000, "python")[0]
    assert parse("class A { int[] x = {" + "1," * 50_000 + "}; }", "java")[0]


def test_operator(spark):
    rows = [(1, "r", "A.JAVA", "class A {}", "z"), (1, "r", "A.JAVA", "class A {}", "z"), (2, "r", "b.py", "x = (", "z"), (3, "r", "c.go", "", "z"), (4, "s", "d.c", None, "z"), (5, None, None, "x", "z"), (6, "s", "e.txt", "x", "z"), (7, "s", "f.cpp", "", "z")]
    files = spark.createDataFrame(rows, "file_id long, repo string, file_name string, content string, valid string")
    got = {(r.file_id, r.language, r.valid) for r in check_files(files).collect()}
    assert got == {(1, "java", True), (2, "python", False), (3, "go", False), (4, "c", None), (7, "cpp", True)}
    hints = spark.createDataFrame([("r", "b.py"), ("r", "b.py"), ("r", None), ("r", "A.JAVA")], "repo string, file_name string")
    rates = {(r.repo, r.language): (r.files, r.invalid, r.hinted, r.hinted_invalid) for r in failure_rates(check_files(files, keep=("repo", "file_name")), hints).collect()}
    assert rates == {("r", "java"): (2, 0, 2, 0), ("r", "python"): (1, 1, 1, 1), ("r", "go"): (1, 1, 0, 0), ("s", "cpp"): (1, 0, 0, 0)}
    assert check_files(files.limit(0)).count() == 0
