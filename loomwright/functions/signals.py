"""Risk signals and evidence that compare a requirement's text with code, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import numbers, quantified_bounds

# Words around which a constraint is quoted.
CONSTRAINT_WORDS = ["不超过", "不得", "必须", "at most", "no more than", "must"]


def state_mismatch(wanted: Column, there: Column) -> Column:
    """0.55 where the code names none of the text's states, 0.25 where only some, else 0."""
    share = F.size(F.array_intersect(wanted, there))
    return F.when(F.size(wanted) == 0, 0.0).when(share == 0, 0.55).when(share < F.size(wanted), 0.25).otherwise(0.0)


# Factors between units of time and of size, which are no evidence of a limit.
CONVERSIONS = [24, 60, 3600, 1000, 1024]


def plain_code(code: Column) -> Column:
    """Without comments, decimal numbers, and steps by one."""
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"[0-9]+\.[0-9]+", " "), r"[+\-]\s*1\b", " ")


def numeric_mismatch(text: Column, code: Column) -> Column:
    """0.45 of the share of the text's numbers that the code has near (at least a tenth) but not equal, among those that it
    has near or equal. Decimal numbers, steps by one and unit conversions do not count; a repeated number counts as often."""
    wanted = F.filter(numbers(F.regexp_replace(text, r"[0-9]+\.[0-9]+", " ")), lambda x: x > 0)
    there = F.filter(numbers(plain_code(code)), lambda x: (x > 0) & ~x.isin(CONVERSIONS))
    equal = F.size(F.filter(wanted, lambda x: F.array_contains(there, x)))
    near = F.size(F.filter(wanted, lambda x: ~F.array_contains(there, x) & F.exists(there, lambda y: F.least(x, y) * 10 >= F.greatest(x, y))))
    return F.when(equal + near == 0, 0.0).otherwise(0.45 * near / (equal + near))


def coverage_band(share: Column) -> Column:
    """0, 0.2, 0.4 or 0.6 for a coverage from 0.75, 0.5, 0.25, or below."""
    return F.when(share >= 0.75, 0.0).when(share >= 0.5, 0.2).when(share >= 0.25, 0.4).otherwise(0.6)


# Parameters that texts speak of, and their wordings.
PARAMETERS = {
    "userId": ["用户id", "用户 id", "用户标识", "用户ID", "userId", "user id"],
    "channel": ["渠道类型", "渠道", "channel"],
    "content": ["通知内容", "消息内容", "content"],
    "duration": ["考试时长", "时长", "duration"],
    "passingScore": ["及格分数", "及格线", "passingscore", "passing score"],
    "title": ["考试标题", "标题", "title"],
    "amount": ["金额", "amount"],
    "quantity": ["数量", "quantity"],
    "orderId": ["订单id", "订单编号", "orderid", "order id"],
    "studentId": ["学生id", "学生标识", "studentid", "student id"],
}
CHECK_WORDS = "校验|验证|不能为空|非空|必填|合法|无效"
DELEGATES = r"(?i)\b(validate|check|verify)\w*\s*\("


def parameters(text: Column, names: dict[str, list[str]] = PARAMETERS) -> Column:
    """Parameters that the text speaks of, in the order of the list."""
    has = lambda words: F.lower(text).rlike("|".join(dict.fromkeys(w.lower() for w in words)))
    return F.filter(F.array(*[F.when(has(words), F.lit(p)) for p, words in names.items()]), lambda p: p.isNotNull())


def validation_pattern(name: str) -> str:
    """How code looks that checks a parameter: against null, emptiness, or a number."""
    p, getter = name.lower(), "get" + name.lower()
    return rf"(?i){p}\s*[=!]=\s*null|null\s*[=!]=\s*{p}|\b{p}\.is(empty|blank)\(\)|\b{p}\.length\(\)\s*[<>]=?\s*0|strings\.isempty\(\s*{p}\s*\)|\b{p}\s*[<>]=?\s*-?[0-9]+|\b{p}\s*%\s*[0-9]+|\.{getter}\s*\(\)\s*[<>]=?\s*-?[0-9]+"


def validated(code: Column, names: dict[str, list[str]] = PARAMETERS) -> Column:
    """Parameters that the code checks."""
    return F.filter(F.array(*[F.when(code.rlike(validation_pattern(p)), F.lit(p)) for p in names]), lambda p: p.isNotNull())


def missing_validation(text: Column, code: Column, names: dict[str, list[str]] = PARAMETERS) -> Column:
    """By the share of the text's parameters that the code checks, where the text asks for checks and the code does not
    hand them over to a method that validates, checks or verifies."""
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    wanted = parameters(text, names)
    share = F.size(F.array_intersect(wanted, validated(bare, names))) / F.size(wanted)
    asked = text.rlike(CHECK_WORDS) & (F.size(wanted) > 0) & ~bare.rlike(DELEGATES)
    return F.when(asked, coverage_band(share)).otherwise(0.0)


# How a text asks for more than a number.
LOWER_BOUNDS = "必须大于|必须超过|不低于|至少|大于[^，。；]{0,8}才|高于[^，。；]{0,8}才|超过[^，。；]{0,8}才"


def logic_inversion(text: Column, code: Column) -> Column:
    """0.35 where the text asks for more than a number N and the code, comments aside, tests for less than N or has N less
    than something."""
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    wanted = F.filter(numbers(F.regexp_replace(text, r"[0-9]+\.[0-9]+", " ")), lambda x: x > 0)
    turned = lambda n: F.regexp_like(bare, F.concat(F.lit(r"<\s*"), n, F.lit(r"\b|\b"), n, F.lit(r"\s*<([^=]|$)")))
    return F.when(text.rlike(LOWER_BOUNDS) & F.exists(wanted, lambda n: turned(n.cast("string"))), 0.35).otherwise(0.0)


def state_order(text: Column, names: Column) -> Column:
    """The given states by their first place in the text, those only meant by a word last."""
    at = lambda s: F.when(F.instr(F.upper(text), s) > 0, F.instr(F.upper(text), s)).otherwise(1 << 30)
    placed = F.transform(names, lambda s, i: F.struct(at(s).alias("at"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(placed), lambda x: x["s"])


# Words that announce an order of states, and how code moves from one to another.
ORDER_WORDS = ["顺序", "依次", "流转", "状态转换"]
MOVE = r"(?s)STATUS_(\w+)\s*\.equals\([^)]*getStatus\(\)\)[^}]*?setStatus\([^)]*STATUS_(\w+)\)"


def state_flow_violation(text: Column, code: Column, names: Column) -> Column:
    """0.4 where the text orders at least three states and the code moves from one to another that is not its next."""
    order = state_order(text, names)
    moves = F.regexp_extract_all(code, F.lit(MOVE), F.lit(0))
    place = lambda m, k: F.array_position(order, F.regexp_extract(m, MOVE, k))
    skips = F.exists(moves, lambda m: (place(m, 1) > 0) & (place(m, 2) > 0) & (place(m, 2) != place(m, 1) + 1))
    return F.when(text.rlike("|".join(ORDER_WORDS)) & (F.size(names) >= 3) & skips, 0.4).otherwise(0.0)


def windows(text: Column, before: int = 10, after: int = 20) -> Column:
    """Excerpts around the first place of each constraint word that the text has, in the order of the words."""
    cut = [F.when(F.contains(text, F.lit(w)), F.substring(text, F.greatest(F.lit(1), F.instr(text, w) - before), F.lit(before + after))) for w in CONSTRAINT_WORDS]
    return F.filter(F.array(*cut), lambda x: x.isNotNull())


def propositions(*texts: Column) -> Column:
    """Distinct non-empty parts of semicolon-separated rules, sorted."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(t, F.lit("")), ";") for t in texts]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")))


def satisfied(parts: Column, code: Column) -> Column:
    """Share of the propositions whose first word the code contains; -1 without propositions."""
    hits = F.size(F.filter(parts, lambda p: F.contains(code, F.regexp_extract(p, r"^([A-Za-z]*)", 1))))
    return F.when(F.size(parts) == 0, -1.0).otherwise(hits / F.size(parts))


def evidence(code: Column, constants: int = 15, signatures: int = 40) -> Column:
    """(constants, signatures): lines that define constants, and lines that open a method, each up to a number."""
    lines = F.split(code, r"\r\n|\r|\n")
    first = lambda pattern, n: F.slice(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike(pattern)), 1, n)
    return F.struct(first(r"\b(final|const|#define)\b.*[=0-9]|^#define", constants).alias("constants"), first(r"^(public|private|protected|static|def|func|boolean|bool)\b.*\(", signatures).alias("signatures"))


def reply(text: Column, schema: str) -> Column:
    """The JSON object of a model's reply: fences stripped, from the first brace to the last; null where there is none."""
    return F.from_json(F.regexp_extract(F.regexp_replace(text, r"```[a-z]*", ""), r"(?s)(\{.*\})", 1), schema)


def narrative(kind: Column, place: Column, reason: Column) -> Column:
    """One sentence on a defect."""
    return F.concat(F.lit("["), F.coalesce(kind, F.lit("unknown")), F.lit("] "), F.coalesce(place, F.lit("-")), F.lit(": "), F.coalesce(reason, F.lit("no reason given")))


def key_coverage(text: Column, keys: list[str]) -> Column:
    """Share of the keys that the text contains, white space aside."""
    bare = F.regexp_replace(F.lower(text), r"[ \t\r\n]+", "")
    return F.size(F.filter(F.array(*[F.lit(k.lower().replace(" ", "")) for k in keys]), lambda k: F.contains(bare, k))) / float(len(keys))



def named_constants(lines: Column) -> Column:
    """(name, value) of the numeric constants that lines of a class define; the last of a name counts."""
    defined = F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("static")) & F.contains(F.lower(x), F.lit("final")) & x.rlike(r"\w+\s*=\s*-?[0-9]+"))
    each = F.transform(defined, lambda x: F.struct(F.regexp_extract(x, r"(\w+)\s*=\s*-?[0-9]+", 1).alias("name"), F.try_to_number(F.regexp_extract(x, r"\w+\s*=\s*(-?[0-9]+)", 1), F.lit("S999999999999999999")).cast("long").alias("value")))
    each = F.filter(each, lambda x: x["value"].between(-(1 << 31), (1 << 31) - 1))
    names = F.array_distinct(F.transform(each, lambda x: x["name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(each, lambda x: x["name"] == n), -1))


def bound_mismatch(text: Column, code: Column, lines: Column | None = None) -> Column:
    """0.45 where the code compares with a limit of the text's magnitude (within a factor of five) that is not the text's: a
    named constant of the class (``lines``), or else a number, unless the code has the text's number anywhere."""
    bounds = F.filter(quantified_bounds(text), lambda b: b > 0)
    alike = lambda a, b: (a != b) & (F.greatest(a, b) <= 5 * F.least(a, b))
    compared = lambda n: F.regexp_like(code, F.concat(F.lit(r"(^|[^\w'])"), n, F.lit(r"\s*[<>]=?|[<>]=?\s*"), n, F.lit(r"\b")))
    constants = named_constants(lines if lines is not None else F.array().cast("array<string>"))
    named = F.exists(constants, lambda c: compared(c["name"]) & F.exists(bounds, lambda b: alike(b, c["value"])))
    used = F.filter(F.transform(F.regexp_extract_all(code, F.lit(r"[<>]=?\s*([0-9]{1,6})\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: x > 0)
    absent = lambda b: ~F.regexp_like(code, F.concat(F.lit("(^|[^0-9])"), b.cast("string"), F.lit("([^0-9]|$)")))
    literal = F.exists(bounds, lambda b: absent(b) & F.exists(used, lambda u: alike(b, u)))
    return F.when(named | literal, 0.45).otherwise(0.0)


# Common bugs, their weights, and how they read (without regard to case).
CODE_BUGS = {
    "get_size": (0.45, [r"\.get\(\s*[a-z]+\.size\(\s*\)\s*\)"]),
    "empty_catch": (0.35, [r"catch\s*\([^\)]*\)\s*\{\s*\}"]),
    "float_equality": (0.25, [r"(float|double)\s+\w+\s*==\s*", r"\.\s*compare\s*\([^)]*==[^)]*\)"]),
    "constant_return": (0.30, [r"\{\s*return\s+(true|false|null|0|1|-1)\s*;\s*\}"]),
    "division_by_zero": (0.40, [r"/\s*0\b"]),
}
ONE_SIDED = (0.35, r"return\s+[1-9\-]\s*;", "comparator|compare")


def code_bugs(code: Column) -> dict[str, Column]:
    """The weight of each common bug that the code has, else 0; a comparator that returns a constant counts as one-sided."""
    found = {k: F.when(code.rlike("(?i)" + "|".join(p)), w).otherwise(0.0) for k, (w, p) in CODE_BUGS.items()}
    weight, returns, words = ONE_SIDED
    return found | {"one_sided_compare": F.when(code.rlike("(?i)" + returns) & F.lower(code).rlike(words), weight).otherwise(0.0)}


#: A value that comes from a lookup: what follows the name that it is given.
LOOKUP = r"\s*=\s*\w+(?:\.\w+)*\.get(?:OrDefault)?\([^)]*\)\s*;"


def null_dereference(code: Column) -> Column:
    """0.35 where a value that came from a lookup is used after it and compared with null nowhere."""
    names = F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b(\w+)" + LOOKUP), F.lit(1)))
    guarded = lambda v: F.regexp_like(code, F.concat(F.lit(r"(?i)\b"), v, F.lit(r"\s*(==|!=)\s*null")))
    used = lambda v: F.regexp_like(code, F.concat(F.lit(r"\b"), v, F.lit(LOOKUP + r"[\s\S]*?(?i:\b"), v, F.lit(r"\s*\.)")))
    return F.when(F.exists(names, lambda v: ~guarded(v) & used(v)), 0.35).otherwise(0.0)


def constraint_score(text: Column, code: Column, matched: Column, coverage: Column) -> Column:
    """The matched degree (null or below 0 for no constraint), held within 0..1; without a constraint, or with a blank side,
    0.35 + 0.65 of the coverage where that is known (not below 0), else 0.5."""
    simple = F.when(coverage >= 0, 0.35 + 0.65 * coverage).otherwise(0.5)
    blank = (F.trim(F.coalesce(text, F.lit(""))) == "") | (F.trim(F.coalesce(code, F.lit(""))) == "")
    return F.when(blank | matched.isNull() | (matched < 0), simple).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), matched)))
