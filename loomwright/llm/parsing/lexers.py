"""Scanners: source text to token kinds, texts and offsets. What no token can start with becomes a token ``ERR``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ID = r"[^\W\d]\w*"


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)

    def add(self, kind: str, text: str, at: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.at.append(at)


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Reserved words and operators of the languages.
JAVA_WORDS = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
)
GO_WORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
PYTHON_WORDS = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
C_WORDS = _words(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Generic _Alignas _Alignof _Atomic _Noreturn _Static_assert _Thread_local __attribute__ __extension__ __inline __inline__ __restrict typeof __typeof__ asm __asm__ __volatile__"
)
CPP_WORDS = _words(
    "alignas alignof asm auto bool break case catch char char8_t char16_t char32_t class concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while __attribute__"
)

_C_NUMBER = r"(?:0[xX][0-9a-fA-F'_]*(?:\.[0-9a-fA-F'_]*)?(?:[pP][+-]?\d+)?|0[bB][01'_]+|(?:\d[\d'_]*)?\.?\d[\d'_]*\.?(?:[eE][+-]?\d[\d_]*)?)"


def _escaped(quote: str) -> str:
    return rf"{quote}(?:[^{quote}\\\n\r]|\\[^\n\r])*{quote}"


_SPACE = r"(?P<space>[ \t\r\n\f\v]+|//[^\n\r]*|/\*[\s\S]*?\*/)"

_JAVA = re.compile(
    _SPACE
    + r'|(?P<STR>"""[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|'
    + _escaped('"')
    + r""")|(?P<CHAR>'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n\r]))[\udc00-\udfff]?')"""
    + r"|(?P<NUM>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*\.?(?:\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w]))"
    + rf"|(?P<ID>\$?(?:{_ID}|\$)[\w$]*)"
    + r"|(?P<G>>(?=>))|(?P<op>\.\.\.|<<=|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-(){}\[\];,.@=<>!~?:+*/&|^%])"
)
_GO = re.compile(
    r"(?P<line>\n|//[^\n]*)|(?P<space>[ \t\r]+|/\*[^*\n]*(?:\*(?!/)[^*\n]*)*\*/)|(?P<long>/\*[\s\S]*?\*/)"
    + r"|(?P<STR>`[^`]*`|"
    + _escaped('"')
    + r""")|(?P<CHAR>'(?:[^'\\\n\r]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\'"]))')"""
    + r"|(?P<NUM>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*\.?(?:\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?(?!\w))"
    + rf"|(?P<ID>{_ID})"
    + r"|(?P<op>\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-(){}\[\];,.=<>!~:+*/&|^%])"
)
_C_COMMON = (
    _SPACE
    + r'|(?P<STR>(?:u8|[uUL])?R"(?P<tag>[^()\\\s]{0,16})\([\s\S]*?\)(?P=tag)"|(?:u8|[uUL])?'
    + _escaped('"')
    + r")|(?P<CHAR>(?:u8|[uUL])?'(?:[^'\\\n\r]|\\[^\n\r])+')"
    + rf"|(?P<NUM>{_C_NUMBER}(?:[uUlLfFzZ]|[a-zA-Z_]\w*(?<=_\w))*(?![\w]))"
    + rf"|(?P<ID>\$?{_ID})"
)
_C = re.compile(_C_COMMON + r"|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-(){}\[\];,.=<>!~?:+*/&|^%])")
_CPP = re.compile(
    _C_COMMON + r"|(?P<G>>(?=>))|(?P<op>\.\.\.|<=>|<<=|->\*|->|\.\*|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-(){}\[\];,.=<>!~?:+*/&|^%])"
)


def _scan(text: str, pattern: re.Pattern, words: frozenset[str]) -> Tokens:
    out, at, n, match = Tokens(), 0, len(text), pattern.match
    kinds, texts, ats = out.kinds, out.texts, out.at
    while at < n:
        m = match(text, at)
        if m is None or m.end() == at:
            out.add("ERR", text[at], at)
            break
        kind = m.lastgroup
        if kind != "space":
            s = m[0]
            kinds.append(s if kind == "op" or kind == "ID" and s in words else kind)
            texts.append(s)
            ats.append(at)
        at = m.end()
    return out


def java(text: str) -> Tokens:
    return _scan(text.removeprefix("﻿").rstrip("\x1a"), _JAVA, JAVA_WORDS)


#: Kinds after which the end of a line ends a statement.
_GO_ENDS = {"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def go(text: str) -> Tokens:
    text = text.removeprefix("﻿")
    out, at, n, match = Tokens(), 0, len(text), _GO.match
    last = ""
    while at < n:
        m = match(text, at)
        if m is None:
            out.add("ERR", text[at], at)
            return out
        kind = m.lastgroup
        if kind in ("line", "long"):
            if last in _GO_ENDS and (kind == "long" or m[0] == "\n"):
                out.add(";", "\n", at)
                last = ";"
        elif kind != "space":
            s = m[0]
            last = s if kind == "op" or kind == "ID" and s in GO_WORDS else kind
            out.add(last, s, at)
        at = m.end()
    if last in _GO_ENDS:
        out.add(";", "\n", n)
    return out


_DIRECTIVE = re.compile(r"[ \t\f\v]*#[ \t]*(\w*)(.*)", re.S)
_KNOWN = _words("if ifdef ifndef elif elifdef elifndef else endif define undef include include_next line error warning pragma ident import embed")


def _condition(text: str, defined: dict[str, str]) -> bool:
    """Value of an #if expression; names that are not defined count as 0, and what cannot be read as true."""
    text = re.sub(r"//.*|/\*.*?\*/", " ", text)
    text = re.sub(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: "1" if (m[1] or m[2]) in defined else "0", text)
    for _ in range(8):
        text = re.sub(r"\b[A-Za-z_]\w*\b", lambda m: f"({defined[m[0]]})" if defined.get(m[0], "").strip() else "0", text)
    text = re.sub(r"(\d)[uUlL]+", r"\1", text).replace("&&", " and ").replace("||", " or ")
    text = re.sub(r"!(?!=)", " not ", text)
    if not re.fullmatch(r"(?:[\s\d()+\-*/%<>=&|^~!]|and|or|not|0[xX][0-9a-fA-F]+)*", text) or len(text) > 1000 or "**" in text or re.search(r"\d\s*\(", text):
        return True
    try:
        return bool(eval(text.replace("/", "//").strip() or "0", {"__builtins__": {}}))
    except Exception:
        return True


def preprocess(text: str, plus: bool) -> tuple[str, int]:
    """Blank out directives and the lines that they skip, keeping offsets; and the offset of a wrong directive, or -1."""
    text = text.removeprefix("﻿")
    spans = _literal_spans(text)
    defined: dict[str, str] = {"__cplusplus": "201703", "__STDC__": "1"} if plus else {"__STDC__": "1", "__STDC_VERSION__": "201710"}
    out, stack, at, wrong = [], [], 0, -1  # stack: [active, some branch taken, parent active, else seen, offset]
    for line in re.findall(r"(?:[^\n\\]|\\\r?\n|\\(?!\r?\n))*(?:\n|$)", text):
        if not line:
            continue
        m = _DIRECTIVE.match(line)
        active = not stack or stack[-1][0]
        if m and not spans(at + line.index("#")):
            word, rest = m[1], m[2]
            if word in ("if", "ifdef", "ifndef"):
                first = rest.split()[0] if rest.split() else ""
                yes = active and (_condition(rest, defined) if word == "if" else (first in defined) == (word == "ifdef"))
                if active and not rest.strip():
                    wrong = at if wrong < 0 else wrong
                stack.append([yes, yes, active, False, at])
            elif word in ("elif", "elifdef", "elifndef", "else", "endif"):
                if not stack or word != "endif" and stack[-1][3]:
                    wrong = at if wrong < 0 else wrong
                elif word == "endif":
                    stack.pop()
                else:
                    top = stack[-1]
                    first = rest.split()[0] if rest.split() else ""
                    yes = word == "else" or (_condition(rest, defined) if word == "elif" else (first in defined) == (word == "elifdef"))
                    top[0] = top[2] and not top[1] and yes
                    top[1] = top[1] or top[0]
                    top[3] = word == "else"
            elif active:
                if word == "define":
                    d = re.match(r"\s*([A-Za-z_]\w*)(\([^)]*\))?(.*)", rest, re.S)
                    if d:
                        defined[d[1]] = "" if d[2] else re.sub(r"//.*|/\*.*?\*/|\\\r?\n", " ", d[3], flags=re.S)
                    else:
                        wrong = at if wrong < 0 else wrong
                elif word == "undef":
                    defined.pop(rest.strip(), None)
                elif word == "include":
                    if not re.match(r"""\s*(?:<[^>\n]+>|"[^"\n]+"|[A-Za-z_])""", rest):
                        wrong = at if wrong < 0 else wrong
                elif word not in _KNOWN and (word or rest.strip()):
                    wrong = at if wrong < 0 else wrong
            # a comment that begins on the directive's line and goes on stays
            cut = line.find("/*")
            keep = cut if cut >= 0 and "*/" not in line[cut:] else len(line)
            out.append(re.sub(r"[^\r\n]", " ", line[:keep]) + line[keep:])
        else:
            out.append(line if active else re.sub(r"[^\r\n]", " ", line))
        at += len(line)
    if stack and wrong < 0:
        wrong = stack[-1][4]
    return "".join(out), wrong


def _literal_spans(text: str):
    """Whether an offset lies inside a comment or a raw string, so that a # there begins no directive."""
    spans = [m.span() for m in re.finditer(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|$)|R"\([\s\S]*?\)"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", text) if "\n" in m[0]]
    return lambda at: any(a < at < b for a, b in spans)


def c(text: str) -> Tokens:
    return _c_like(text, False)


def cpp(text: str) -> Tokens:
    return _c_like(text, True)


def _c_like(text: str, plus: bool) -> Tokens:
    plain, wrong = preprocess(text, plus)
    plain = re.sub(r"\\(\r?\n)", lambda m: " " * len(m[0]), plain)
    out = _scan(plain, _CPP if plus else _C, CPP_WORDS if plus else C_WORDS)
    if wrong >= 0:
        k = next((i for i, a in enumerate(out.at) if a >= wrong), len(out.at))
        out.kinds.insert(k, "ERR")
        out.texts.insert(k, "#")
        out.at.insert(k, wrong)
    return out


_PY_PREFIX = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_PY = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>#[^\r\n]*)|(?P<newline>\r\n|\n|\r)"
    + r"|(?P<FSTR>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))"
    + rf'|(?P<STR>{_PY_PREFIX}(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
    + rf"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    + r"""|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'|""(?!")|''(?!')))"""
    + r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    + r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|[1-9](?:_?\d)*|0(?:_?0)*)(?=(?:and|else|for|if|in|is|or|not)\b|\W|$))"
    + rf"|(?P<ID>{_ID})"
    + r"|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-(){}\[\];,.:=<>+*/%&|^~@])"
)
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


def python(text: str) -> Tokens:
    """Tokens with NEWLINE, INDENT and DEDENT; formatted strings become FSTART, their fields, and FEND."""
    text = text.removeprefix("﻿")
    out = Tokens()
    if "\0" in text:
        out.add("ERR", "\0", text.index("\0"))
        return out
    at, n, depth, indents, fresh = 0, len(text), 0, [(0, 0)], True
    add = out.add
    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            begin, at = at, m.end()
            if at >= n:
                break
            if text[at] in "#\r\n":
                pass
            else:
                blank = text[begin:at].rpartition("\f")[2]
                wide = 0
                for ch in blank:
                    wide = (wide // 8 + 1) * 8 if ch == "\t" else wide + 1
                where = (wide, len(blank))
                top = indents[-1]
                if (where[0] > top[0]) != (where[1] > top[1]) or (where[0] < top[0]) != (where[1] < top[1]):
                    add("ERR", "tabs", at)
                    return out
                if where > top:
                    indents.append(where)
                    add("INDENT", "", at)
                while where < indents[-1]:
                    indents.pop()
                    add("DEDENT", "", at)
                if where != indents[-1]:
                    add("ERR", "indent", at)
                    return out
                fresh = False
        m = _PY.match(text, at)
        if m is None:
            add("ERR", text[at], at)
            return out
        kind, s = m.lastgroup, m[0]
        if kind == "newline":
            if not depth:
                if not fresh:
                    add("NEWLINE", s, at)
                fresh = True
        elif kind == "FSTR":
            end = _fstring(text, at, m.end(), s, out)
            if end < 0:
                return out
            at = end
            continue
        elif kind not in ("space", "comment"):
            if kind == "op":
                depth += (s in _OPEN) - (s in _CLOSE)
                depth = max(depth, 0)
                add(s, s, at)
            else:
                add(s if kind == "ID" and s in PYTHON_WORDS else kind, s, at)
        elif s[0] == "\\" and m.end() >= n:
            add("ERR", s, at)
            return out
        at = m.end()
    if depth:
        return out  # an open bracket: the grammar stops at the end
    if not fresh:
        add("NEWLINE", "", n)
    for _ in indents[1:]:
        add("DEDENT", "", n)
    return out


def _fstring(text: str, start: int, at: int, opening: str, out: Tokens) -> int:
    """Tokens of a formatted string whose text begins at ``at``; the offset after it, or -1 with an ERR token."""
    quote = opening.lstrip("fFrR")
    raw = "r" in opening[: len(opening) - len(quote)].lower()
    out.add("FSTART", opening, start)
    end = _fparts(text, at, quote, raw, out, 0)
    if end < 0:
        out.add("ERR", "unterminated", start)
        return -1
    out.add("FEND", quote, end)
    return end + len(quote)


def _fparts(text: str, at: int, quote: str, raw: bool, out: Tokens, level: int) -> int:
    """Literal parts and fields up to the closing quote (level 0) or, in a format, to the closing brace."""
    n = len(text)
    while at < n:
        ch = text[at]
        if text.startswith(quote, at):
            return at if level == 0 else -1
        if ch == "\\" and not raw:
            named = text.startswith("N{", at + 1)
            at = text.find("}", at) + 1 if named else at + 2
            if at == 0:
                return -1
            continue
        if ch in "\r\n" and len(quote) == 1:
            return -1
        if level and ch == "}":
            return at
        if ch == "{":
            if level == 0 and text.startswith("{{", at):
                at += 2
                continue
            at = _ffield(text, at, quote, raw, out, level)
            if at < 0:
                return -1
            continue
        if ch == "}":
            if not text.startswith("}}", at):
                return -1
            at += 2
            continue
        at += 1
    return -1


def _ffield(text: str, at: int, quote: str, raw: bool, out: Tokens, level: int) -> int:
    out.add("{", "{", at)
    at, depth, n = at + 1, 0, len(text)
    while at < n:
        ch = text[at]
        if depth == 0 and (ch == "}" or ch in ":!=" and not text.startswith(("!=", "=="), at)):
            if ch == "=":
                out.add("FEQ", "=", at)
                at += 1
                continue
            if ch == "!":
                m = re.compile(r"![rsa]").match(text, at)
                if m is None:
                    return -1
                out.add("FCONV", m[0], at)
                at = m.end()
                continue
            if ch == ":":
                out.add("FSPEC", ":", at)
                at = _fparts(text, at + 1, quote, raw, out, level + 1)
                if at < 0:
                    return -1
            out.add("}", "}", at)
            return at + 1
        m = _PY.match(text, at)
        if m is None:
            return -1
        kind, s = m.lastgroup, m[0]
        if kind == "FSTR":
            at = _fstring(text, at, m.end(), s, out)
            if at < 0:
                return -1
            continue
        if kind == "op":
            depth += (s in _OPEN) - (s in _CLOSE)
            if depth < 0:
                return -1
            out.add(s, s, at)
        elif kind not in ("space", "comment", "newline"):
            out.add(s if kind == "ID" and s in PYTHON_WORDS else kind, s, at)
        at = m.end()
    return -1
