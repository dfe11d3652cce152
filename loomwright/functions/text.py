"""Scalar text functions as column expressions (JVM regular expressions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the domain.
MUST_WORDS = ["必须", "务必", "must", "shall", "required"]
IMPORTANT_WORDS = ["应", "应该", "重要", "should", "important"]
OPTIONAL_WORDS = ["可以", "可选", "may", "optional"]
NON_FUNCTIONAL_WORDS = ["性能", "响应时间", "并发", "安全", "可用性", "毫秒", "performance", "latency", "within", "security"]
CONSTRAINT_WORDS = ["约束", "限制", "不得", "不超过", "at most", "no more than", "lie between", "constraint"]
AMBIGUOUS_WORDS = ["等", "等等", "适当", "合适", "合理", "可能", "也许", "若干", "一些", "方便", "友好"]
CONTRADICTIONS = [("必须", "禁止"), ("必须", "不得"), ("禁止", "允许"), ("不得", "允许"), ("启用", "禁用")]
STATE_NAMES = ["PENDING", "PAID", "SHIPPED", "UNPUBLISHED", "PUBLISHED", "ACTIVE", "INACTIVE", "SUCCESS", "FAILED", "COMPLETED", "CANCELLED"]
STATE_WORDS = {"未发布": "UNPUBLISHED", "已发布": "PUBLISHED", "待支付": "PENDING", "已支付": "PAID", "已发货": "SHIPPED", "已完成": "COMPLETED", "已取消": "CANCELLED", "待处理": "PENDING"}
UNITS = ["秒", "分钟", "min", "second", "条", "次", "字符", "个字", "分"]
BOUND_WORDS = ["最多", "不低于", "至少", "不超过", "上限", "窗口"]
BEHAVIOUR_WORDS = ["应", "必须", "需要", "可以", "不得", "shall", "must", "should", "may"]
SENSITIVE_ACTIONS = "删除|修改|更新|导出"
PERMISSION_WORDS = "权限|角色|授权|管理员|审批|登录"
RANGE_WORDS = "至少|最多|不超过|不低于|大于|小于|等于|以内|以上|以下|少于|多于|范围|之间"
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "are", "was", "from", "into", "then", "than", "not"]

NUMBERING = r"^(REQ-[0-9]+[:：]|[0-9]+[.、)]|[一二三四五六七八九十]+、)"


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text, without regard to case, contains one of the words."""
    return F.lower(text).rlike("|".join(w.lower() for w in words))


def clean_line(line: Column) -> Column:
    """Without markup: tags, images and links (their text stays), footnotes, heading and quote marks, emphasis, runs of blanks."""
    for pattern, to in (
        (r"<[^<>]{1,200}>", " "),
        (r"!?\[([^\[\]]*)\]\([^()]*\)", "$1"),
        (r"\[\^[^\[\]]+\]", ""),
        (r"^[ \t]*((#{1,6}[ \t]+)|(>[ \t]?))+", ""),
        (r"[*_`~]{1,3}", ""),
        (r"[ \t　]+", " "),
    ):
        line = F.regexp_replace(line, pattern, to)
    return F.trim(line)


def is_noise_line(line: Column) -> Column:
    """Separators, table rules, page numbers and lines of a table of contents."""
    line = F.lower(F.trim(line))
    return line.rlike(r"^[-=_*. \t]{3,}$") | line.rlike(r"^\|?[ \t:|-]{3,}\|?$") | line.rlike(r"^(第 *[0-9]+ *页.*|page *[0-9]+.*|- *[0-9]+ *-|[0-9]+ */ *[0-9]+)$") | line.rlike(r"(\.{4,}|…{2,}) *[0-9]+$")


def looks_like_content(line: Column) -> Column:
    """Numbered, or with a word of behaviour."""
    return line.rlike(NUMBERING) | any_of(line, BEHAVIOUR_WORDS)


def normalize_requirement(text: Column) -> Column:
    """Without numbering and white space."""
    return F.regexp_replace(F.regexp_replace(text, r"^[ \t\r\n]*" + NUMBERING[1:], ""), r"[ \t\r\n　]+", "")


def split_camel(text: Column) -> Column:
    """Lower-case parts at capitals and underscores, acronyms letter by letter."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"([A-Z])", "_$1")), "_+"), lambda x: x != "")


def ascii_terms(text: Column) -> Column:
    """Terms of two letters or more: the words split at capitals, and the words in lower case, so plain words count twice."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z_0-9]*)"), F.lit(1))
    split = F.flatten(F.transform(words, split_camel))
    whole = F.transform(words, F.lower)
    return F.filter(F.concat(split, whole), lambda x: F.length(x) >= 2)


def han_pairs(text: Column) -> Column:
    """Overlapping pairs of Han characters that stand together; they take the place of a word segmentation."""
    runs = F.regexp_extract_all(text, F.lit("([一-龥]{2,})"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def terms(text: Column) -> Column:
    """ASCII terms, then pairs of Han characters."""
    return F.concat(ascii_terms(text), han_pairs(text))


# Words of the domain and their English equivalents; a dictionary file can take their place.
EQUIVALENTS = {
    "数量": ["quantity", "count"], "状态": ["status", "state"], "编号": ["number", "id"], "金额": ["amount"], "时间": ["time"], "用户": ["user"], "订单": ["order"], "列表": ["list"],
    "查询": ["query", "find"], "删除": ["delete", "remove"], "更新": ["update"], "审核": ["audit", "review"], "登录": ["login"], "日期": ["date"], "重试": ["retry"], "锁定": ["lock"],
}
#: Weight of an equivalent beside a term.
EQUIVALENT_WEIGHT = 0.5


def weighted_terms(text: Column, equivalents: dict[str, list[str]] = EQUIVALENTS) -> Column:
    """(term, weight): each term with 1, and the English equivalents of the dictionary's words that the text has, once each."""
    own = F.transform(terms(text), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))
    also = F.array(*[F.when(F.contains(text, F.lit(w)), F.struct(F.lit(e).alias("term"), F.lit(EQUIVALENT_WEIGHT).alias("weight"))) for w, es in equivalents.items() for e in es])
    return F.concat(own, F.filter(also, lambda x: x.isNotNull()))


def term_text(text: Column) -> Column:
    """What of a text its weighted terms depend on: words and Han characters, without numbers; the terms are the same."""
    return F.regexp_replace(text, "[^A-Za-z_0-9一-龥]+[0-9]*|(?<![A-Za-z_0-9])[0-9]+", " ")


def numbers(text: Column) -> Column:
    """Integers of one to four digits that stand alone among ASCII word characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([0-9]{1,4})(?![A-Za-z0-9_])"), F.lit(1)), lambda x: x.cast("int"))


#: A number of up to six digits with a unit, or soon after a word for a bound.
BOUND = rf"(?i)[0-9]{{1,6}}\s*(?:{'|'.join(UNITS)})|(?:{'|'.join(BOUND_WORDS)})[^0-9]{{0,6}}[0-9]{{1,6}}"


def quantified_bounds(text: Column) -> Column:
    """Numbers with a unit, or soon after a word for a bound, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(BOUND), F.lit(0)), lambda m: F.regexp_extract(m, "([0-9]{1,6})", 1).cast("int"))


def states(text: Column, names: list[str] = STATE_NAMES, words: dict[str, str] = STATE_WORDS) -> Column:
    """Names of states that the text contains without regard to case, in the order of the list; then those for which it
    has a word."""
    named = F.filter(F.array(*map(F.lit, names)), lambda s: F.contains(F.lower(text), F.lower(s)))
    meant = F.filter(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(s)) for w, s in words.items()]), lambda s: s.isNotNull())
    return F.array_distinct(F.concat(named, meant))


def transitions(text: Column, names: list[str] = STATE_NAMES) -> Column:
    """State changes written with an arrow. In a chain A -> B -> C -> D every second arrow is taken."""
    name = "|".join(names)
    found = F.regexp_extract_all(text, F.lit(rf"({name}) *(?:->|→) *({name})"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, " *(->|→) *", ">"))


def meaningful_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words, sorted."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})"), F.lit(1)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))))


def strip_comments(code: Column) -> Column:
    """Without block comments, then without line comments."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def title(text: Column) -> Column:
    """First sentence without numbering, at most 50 characters."""
    return F.left(F.trim(F.regexp_extract(F.regexp_replace(F.trim(text), NUMBERING, ""), r"^([^。.!?！？;；\n\r]*)", 1)), F.lit(50))


def priority(text: Column) -> Column:
    return F.when(any_of(text, MUST_WORDS), "must").when(any_of(text, IMPORTANT_WORDS), "important").when(any_of(text, OPTIONAL_WORDS), "optional").otherwise("normal")


def requirement_type(text: Column) -> Column:
    return F.when(any_of(text, NON_FUNCTIONAL_WORDS), "non_functional").when(any_of(text, CONSTRAINT_WORDS), "constraint").otherwise("functional")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def simple_name(qualified: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(qualified, r"\."), -1)


def spec_bucket(status: Column) -> Column:
    """pass, fail or unknown by what a verification status contains."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.contains("pass") | (s.contains("sat") & ~s.contains("unsat")), "pass").when(s.contains("fail") | s.contains("unsat"), "fail").otherwise("unknown")


def listed(text: Column) -> Column:
    """Elements of a list written as [a, b]; null and empty lists have none."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[|\]$", ""))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r", *"))


def vector(text: Column) -> Column:
    """The vector of a {"vector": [...], ...} text, or null where there is none."""
    return F.from_json(text, "vector array<double>")["vector"]


# Constraint kinds and how they read.
CONSTRAINT_KINDS = {
    "bound": r"不超过|至多|最多|at most|no more than|up to",
    "range": r"[0-9]+到[0-9]+|between [0-9]+ and [0-9]+",
    "count": r"[0-9]+次|[0-9]+ times",
    "time": r"[0-9]+(毫秒|秒|分钟|天)|[0-9]+ (ms|seconds|minutes|days)",
    "state": "[A-Z]{4,}(?:_[A-Z]+)?",
    "reason": r"原因|reason",
    "lock": r"锁定|locked",
    "unique": r"重复|same number",
    "approval": r"确认|签字|approval",
    "audit": r"审计|audit",
    "default": r"默认|default",
    "failure": r"失败|fails",
}


def constraint_counts(text: Column) -> Column:
    """How often each kind of constraint is expressed: a map with one entry per kind that occurs."""
    entries = [x for kind, pattern in CONSTRAINT_KINDS.items() for x in (F.lit(kind), F.size(F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))))]
    return F.map_filter(F.create_map(*entries), lambda _, n: n > 0)
