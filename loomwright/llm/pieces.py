"""Comments and string literals of source files, with their place, and the texts that they write with escapes."""

from __future__ import annotations

import re

_ESCAPE = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\[0-3][0-7]{2})+|\\u+\{([0-9a-fA-F]{1,6})\}|(?:\\u+[0-9a-fA-F]{4})+|\\U[0-9a-fA-F]{8}|\\.", re.S)

_STRING = r'"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'
_LINE, _BLOCK, _CHAR = r"//[^\r\n]*", r"/\*(?:[\s\S]*?\*/|[\s\S]*$)", r"'(?:[^'\\\r\n]|\\[^\r\n])+'"
_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*(?:"""|$)'

_PIECES = {
    "java": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_TRIPLE}|{_STRING})|{_CHAR}"),
    "go": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>`[^`]*(?:`|$)|{_STRING})|{_CHAR}"),
    "c": re.compile(rf'(?P<comment>{_LINE}|{_BLOCK})|(?P<string>(?:u8|[uUL])?R"(?P<tag>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=tag)"|{_STRING})|(?m:^[ \t]*#[ \t]*include[^\r\n]*)|{_CHAR}'),
    "python": re.compile(
        rf"(?P<comment>#[^\r\n]*)|(?P<string>[a-zA-Z]{{0,2}}(?:{_TRIPLE}|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|$)|{_STRING}|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'))|[^\W\d]\w*"
    ),
}
_PIECES["cpp"] = _PIECES["c"]

# File extensions and the scanner that reads them.
SCANNERS = {"java": "java", "go": "go", "py": "python", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp"}


def _plain(m: re.Match) -> str:
    s = m[0]
    try:
        if m[1]:
            return chr(int(m[1], 16))
        if s[1] == "x" or s[1] in "0123" and len(s) >= 4:
            raw = bytes(int(h, 16) if h else int(o, 8) for h, o in re.findall(r"\\x(..)|\\([0-3][0-7]{2})", s))
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                return raw.decode("latin-1")
        if s[1] == "u" and len(s) >= 6:
            return b"".join(int(h, 16).to_bytes(2, "little") for h in re.findall(r"\\u+([0-9a-fA-F]{4})", s)).decode("utf-16-le", "replace")
        if s[1] == "U" and len(s) == 10:
            return chr(int(s[2:], 16))
    except (ValueError, OverflowError):
        return " "
    return s[1] if s[1] in "\\'\"`" else " "


def unescape(text: str) -> str:
    """The text that escapes stand for: character numbers in any notation; line ends and tabs become spaces."""
    return _ESCAPE.sub(_plain, text) if "\\" in text else text


def pieces(code: str, scanner: str) -> list[tuple[int, str, str]]:
    """(line, kind, text without its marks) of each comment and string literal, in order. Unclosed ones reach to the end."""
    out, line, seen = [], 1, 0
    for m in _PIECES[scanner].finditer(code):
        if m.lastgroup in ("comment", "string", "tag"):
            kind = "comment" if m["comment"] is not None else "string"
            line += code.count("\n", seen, m.start())
            seen = m.start()
            out.append((line, kind, _bare(m[0], kind)))
    return out


def _bare(s: str, kind: str) -> str:
    if kind == "comment":
        if s.startswith("/*"):
            body = s[2:-2] if s.endswith("*/") and len(s) >= 4 else s[2:]
            return re.sub(r"(?m)^[ \t]*\*+[ \t]?|^\*+", " ", body)
        return re.sub(r"^(?://+!?|#+!?)", "", s)
    raw = re.fullmatch(r'(?:u8|[uUL])?R"[^()\\\s"]{0,16}\(([\s\S]*)\)[^()\\\s"]{0,16}"', s)
    if raw:
        return raw[1]
    s = re.sub(r'^(?:u8|[A-Za-z]{0,2})(?=["\'`])', "", s)
    for mark in ('"""', "'''", '"', "'", "`"):
        if s.startswith(mark):
            return s[len(mark) : -len(mark)] if s.endswith(mark) and len(s) >= 2 * len(mark) else s[len(mark) :]
    return s
