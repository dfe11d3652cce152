"""Methods of source files as rows, with control-flow measures, and checks of Python files on their syntax tree."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How methods begin, and words that branch, by language.
_BEGINS = {
    "java": re.compile(r"^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^<>]+>\s+)?[\w.<>\[\], ?]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\{", re.M),
    "go": re.compile(r"^func\s+(?:\([^()]*\)\s*)?(\w+)\s*\(.*\{[ \t]*$", re.M),
    "c": re.compile(r"^[ \t]*(?:[\w:<>,*&~]+\s+)+[*&]?((?:\w+::)*~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^{};]*)?\{", re.M),
}
_BEGINS["cpp"] = _BEGINS["c"]
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof", "synchronized"}
_LITERALS = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_DECISIONS = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?=[^?]*:)")
_CALLS = re.compile(r"\b([a-zA-Z_]\w*)\s*\(")

UNIT = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("complexity", T.LongType()), T.StructField("terms", T.StringType())]
)


def _terms(code: str) -> str:
    """Behaviour terms: loop, branch, failure and return if present, then the names called, split at capitals."""
    kinds = [k for k, p in (("loop", r"\b(?:for|while)\b"), ("branch", r"\b(?:if|switch|elif)\b"), ("failure", r"\b(?:catch|except|throw|raise|panic)\b"), ("return", r"\breturn\b")) if re.search(p, code)]
    calls = [w for c in _CALLS.findall(code) if c not in _NOT_NAMES for w in re.sub(r"(?<!^)(?=[A-Z])|_", " ", c).lower().split()]
    return " ".join(dict.fromkeys(kinds + calls))


def _blanked(code: str) -> str:
    """Literals and comments blanked out, line ends kept."""
    return _LITERALS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _functions(bare: str, language: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, first character, first character of the body, end) of each method; an unclosed one reaches to the end."""
    end = -1
    for m in _BEGINS[language].finditer(bare):
        if m[1] in _NOT_NAMES or m.start() < end:
            continue
        depth, at = 1, m.end()
        while depth and at < len(bare):
            step = _BRACE.search(bare, at)
            if step is None:
                at = len(bare)
                break
            depth += 1 if step[0] == "{" else -1
            at = step.end()
        end = at
        yield m[1], m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), at


_BRACE = re.compile(r"[{}]")


def braced_units(code: str, language: str) -> Iterator[tuple]:
    """Methods of a language with braces; literals and comments do not count."""
    bare = _blanked(code)
    for name, begin, body, end in _functions(bare, language):
        inside = bare[body:end]
        yield name, bare.count("\n", 0, begin) + 1, bare.count("\n", 0, max(begin, end - 1)) + 1, 1 + len(_DECISIONS.findall(inside)), _terms(inside)


# C functions that write without a bound, in the order in which they are looked for.
UNBOUNDED = ["gets(", "strcpy(", "strcat(", "sprintf("]
_ALLOCATES = re.compile(r"\b(?:malloc|calloc|realloc)\s*\(")
_DISCARDS = re.compile(r"(?m)(?:^|[\s,;{])_\s*:?=\s*(?!range\b)[^\n;=][^\n;]*\)[ \t]*(?:;|\{|$)")


def c_function_defects(text: str, bare: str) -> Iterator[tuple[int, str]]:
    """(place, check) in one function of C or C++: an allocation that is never freed or never compared with null, a file
    that is never closed, the first call without a bound, and handlers of everything."""

    def call(name: str) -> int:
        m = re.search(rf"\b{name}\s*\(", bare)
        return m.start() if m else 0

    if _ALLOCATES.search(bare):
        if "free(" not in text:
            yield call("malloc"), "memory_leak"
        if not any(w in text for w in ("NULL", "nullptr", "assert")):
            yield call("malloc"), "null_risk"
    if re.search(r"\bfopen\s*\(", bare) and "fclose(" not in text:
        yield call("fopen"), "file_not_closed"
    for name in UNBOUNDED:
        if name in text:
            yield text.index(name), "unbounded_call"
            break
    for m in re.finditer(r"\bcatch\s*\(\s*\.\.\.\s*\)", bare):
        yield m.start(), "catch_all"


def go_function_defects(text: str, bare: str) -> Iterator[tuple[int, str]]:
    """(place, check) in one function of Go: an error that is received and never looked at, or thrown away, something that is
    opened and never closed, or locked and never unlocked, and panics. Comments guard nothing."""
    plain = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", " ", text)
    if any(w in plain for w in (", err :=", ", err =", "err :=")) and not any(w in plain for w in ("err != nil", "err == nil", "if err")):
        yield 0, "error_not_checked"
    for m in _DISCARDS.finditer(bare):
        yield bare.index("_", m.start()), "error_ignored"
    for name, undo, check in (("Open", "Close", "not_closed"), ("Lock", "Unlock", "not_unlocked")):
        m = re.search(rf"\.{name}\s*\(", bare)
        if m and undo not in plain:
            yield m.start(), check
    m = re.search(r"(?<![\w.])panic\s*\(", bare)
    if m:
        yield m.start(), "panic"


def function_defects(code: str, language: str) -> Iterator[tuple[str, int, str]]:
    """(function, line, check) of a file of C, C++ or Go."""
    find = {"c": c_function_defects, "cpp": c_function_defects, "go": go_function_defects}.get(language)
    bare = _blanked(code) if find else ""
    for name, begin, _, end in _functions(bare, language) if find else ():
        for place, check in find(code[begin:end], bare[begin:end]):
            yield name, code.count("\n", 0, begin + place) + 1, check


def python_units(code: str) -> Iterator[tuple]:
    """Functions of a Python file, nested ones included; none where it does not parse."""
    tree = _tree(code)
    if tree is None:
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            decisions = sum(isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)) for x in ast.walk(node)) + sum(len(x.values) - 1 for x in ast.walk(node) if isinstance(x, ast.BoolOp))
            yield node.name, node.lineno, node.end_lineno, 1 + decisions, _terms(ast.unparse(ast.Module(node.body, [])))


def _tree(code: str) -> ast.Module | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def python_defects(code: str) -> Iterator[tuple[int, str]]:
    """(line, check): bare except, mutable default, comparison with None, eval or exec, SQL put together from values."""
    tree = _tree(code)
    for x in ast.walk(tree) if tree else ():
        if isinstance(x, ast.ExceptHandler) and x.type is None:
            yield x.lineno, "bare_except"
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*x.args.defaults, *x.args.kw_defaults]):
            yield x.lineno, "mutable_default"
        elif isinstance(x, ast.Compare) and any(isinstance(o, (ast.Eq, ast.NotEq)) and isinstance(c, ast.Constant) and c.value is None for o, c in zip(x.ops, x.comparators)):
            yield x.lineno, "none_equality"
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in ("eval", "exec"):
            yield x.lineno, "eval"
        elif isinstance(x, ast.BinOp) and isinstance(x.op, (ast.Mod, ast.Add)) and isinstance(x.left, ast.Constant) and isinstance(x.left.value, str) and re.match(r"(?i)\s*(select|update|delete|insert)\b", x.left.value):
            yield x.lineno, "sql_format"


_LANGUAGES = {"java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "py": "python"}


def code_units(files: DataFrame, id_col: str, name_col: str, code_col: str) -> DataFrame:
    """(id_col, language, name, start_line, end_line, complexity, terms): a row per method. Null code, files of other
    languages and Python files that do not parse give none. One narrow stage; the languages' extractors are registered in
    one table."""
    return _expand(files, id_col, name_col, code_col, lambda code, lang: python_units(code) if lang == "python" else braced_units(code, lang), UNIT)


def python_static_defects(files: DataFrame, id_col: str, name_col: str, code_col: str) -> DataFrame:
    """(id_col, language, line_no, check) of each finding in Python files."""
    schema = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("check", T.StringType())])
    return _expand(files.where(F.lower(F.col(name_col)).endswith(".py")), id_col, name_col, code_col, lambda code, _: python_defects(code), schema)


def function_static_defects(files: DataFrame, id_col: str, name_col: str, code_col: str) -> DataFrame:
    """(id_col, language, name, line_no, check) of each finding in the functions of C, C++ and Go files."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("check", T.StringType())])
    return _expand(files.where(F.lower(F.col(name_col)).rlike(r"\.(go|c|h|cpp|cc|hpp)$")), id_col, name_col, code_col, function_defects, schema)


def _expand(files: DataFrame, id_col: str, name_col: str, code_col: str, extract, fields: T.StructType) -> DataFrame:
    src = files.where(F.col(code_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(name_col).alias("_name"), F.col(code_col).alias("_code"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType), T.StructField("language", T.StringType()), *fields.fields])

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, code in zip(b["_id"], b["_name"], b["_code"]):
                lang = _LANGUAGES.get((name or "").rpartition(".")[2].lower())
                if lang:
                    rows += [(i, lang, *r) for r in extract(code, lang)]
            yield pd.DataFrame(rows, columns=schema.names)

    return src.mapInPandas(expand, schema).withColumnRenamed("_id", id_col)
