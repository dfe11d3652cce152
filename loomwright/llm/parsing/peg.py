"""A packrat parser generator for parsing-expression grammars over token streams.

Notation, one rule per ``name <- expression`` (continuation lines are indented): ``'x'`` a token of that kind (keywords
and punctuation are their own kind), ``"x"`` an identifier with that text, ``ABC`` a token kind, ``abc`` a rule, ``/``
ordered choice, ``* + ?`` greedy repetition, ``&`` and ``!`` look-ahead, ``( )`` groups, ``#`` comments.

Each rule becomes one Python function that returns the position after it or -1, with its results kept per position, so
that parsing is linear. The furthest position at which a token was not what a rule wanted is kept for error reports.
"""

from __future__ import annotations

import re
import sys

_LEX = re.compile(r"\s*(?:(?P<lit>'(?:[^'\\]|\\.)+')|(?P<text>\"[^\"]+\")|(?P<name>[A-Za-z_]\w*)|(?P<op><-|[/*+?&!()]))")


class _Grammar:
    def __init__(self, text: str):
        self.rules: dict[str, tuple] = {}
        chunks: list[str] = []
        for line in re.sub(r"(?m)#.*$", "", text).splitlines():
            if re.match(r"\w+\s*<-", line):
                chunks.append(line)
            elif line.strip():
                chunks[-1] += " " + line
        for chunk in chunks:
            name, body = chunk.split("<-", 1)
            self.toks = [(m.lastgroup, m[m.lastgroup]) for m in _LEX.finditer(body)]
            self.at = 0
            self.rules[name.strip()] = self._choice()
            assert self.at == len(self.toks), (name, self.toks[self.at :])
        self._first()

    def _peek(self):
        return self.toks[self.at] if self.at < len(self.toks) else (None, None)

    def _choice(self):
        options = [self._seq()]
        while self._peek() == ("op", "/"):
            self.at += 1
            options.append(self._seq())
        return options[0] if len(options) == 1 else ("choice", options)

    def _seq(self):
        items = []
        while self._peek()[0] and self._peek()[1] not in ("/", ")"):
            items.append(self._item())
        return items[0] if len(items) == 1 else ("seq", items)

    def _item(self):
        kind, value = self._peek()
        if kind == "op" and value in "&!":
            self.at += 1
            return ("and" if value == "&" else "not", self._item())
        self.at += 1
        if kind == "lit":
            node = ("tok", value[1:-1])
        elif kind == "text":
            node = ("text", value[1:-1])
        elif kind == "name":
            node = ("tok", value) if value.isupper() else ("rule", value)
        else:
            assert value == "(", value
            node = self._choice()
            self.at += 1
        while self._peek()[0] == "op" and self._peek()[1] in "*+?":
            node = ({"*": "star", "+": "plus", "?": "opt"}[self._peek()[1]], node)
            self.at += 1
        return node

    def _first(self):
        self.null = dict.fromkeys(self.rules, False)
        self.start: dict[str, set] = {r: set() for r in self.rules}
        changed = True
        while changed:
            changed = False
            for r, e in self.rules.items():
                null, start = self.first(e)
                if null != self.null[r] or start != self.start[r]:
                    self.null[r], self.start[r], changed = null, start, True

    def first(self, e) -> tuple[bool, set]:
        kind, x = e
        if kind == "tok":
            return False, {x}
        if kind == "text":
            return False, {"ID"}
        if kind == "rule":
            return self.null[x], set(self.start[x])
        if kind in ("and", "not"):
            return True, set()
        if kind in ("star", "opt"):
            return True, self.first(x)[1]
        if kind == "plus":
            return self.first(x)
        if kind == "choice":
            each = [self.first(y) for y in x]
            return any(n for n, _ in each), set().union(*(s for _, s in each))
        start: set = set()
        for y in x:
            null, more = self.first(y)
            start |= more
            if not null:
                return False, start
        return True, start


class _Writer:
    def __init__(self, grammar: _Grammar):
        self.g, self.lines, self.n, self.sets = grammar, [], 0, {}

    def put(self, ind: int, line: str) -> None:
        self.lines.append(" " * ind + line)

    def var(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def starts(self, e) -> str | None:
        """Name of the set of kinds that e can start with, or None if it can be empty."""
        null, start = self.g.first(e)
        if null:
            return None
        return self.sets.setdefault(frozenset(start), f"F{len(self.sets)}")

    def far(self, ind: int) -> None:
        self.put(ind, "if p > S[0]: S[0] = p")

    def expr(self, e, i: int) -> None:
        kind, x = e
        if kind in ("tok", "text"):
            test = f"K[p] == {x!r}" if kind == "tok" else f"K[p] == 'ID' and X[p] == {x!r}"
            self.put(i, f"if {test}: p += 1")
            self.put(i, "else:")
            self.far(i + 1)
            self.put(i + 1, "p = -1")
        elif kind == "rule":
            self.put(i, f"p = r_{x}(p)")
        elif kind == "seq":
            for y in x:
                self.expr(y, i)
                if y is not x[-1]:
                    self.put(i, "if p >= 0:")
                    i += 1
            if not x:
                self.put(i, "pass")
        elif kind == "choice":
            s = self.var()
            self.put(i, f"{s} = p")
            for k, y in enumerate(x):
                if k:
                    self.put(i, "if p < 0:")
                    i += 1
                    self.put(i, f"p = {s}")
                f = self.starts(y)
                if f:
                    self.put(i, f"if K[p] in {f}:")
                    self.expr(y, i + 1)
                    self.put(i, "else:")
                    self.far(i + 1)
                    self.put(i + 1, "p = -1")
                else:
                    self.expr(y, i)
        elif kind in ("star", "plus"):
            if kind == "plus":
                self.expr(x, i)
                self.put(i, "if p >= 0:")
                i += 1
            s, f = self.var(), self.starts(x)
            self.put(i, f"while True:" if not f else f"while K[p] in {f}:")
            self.put(i + 1, f"{s} = p")
            self.expr(x, i + 1)
            self.put(i + 1, f"if p < 0 or p == {s}:")
            self.put(i + 2, f"p = {s}")
            self.put(i + 2, "break")
            if f:
                self.far(i)
        elif kind == "opt":
            s, f = self.var(), self.starts(x)
            self.put(i, f"{s} = p")
            if f:
                self.put(i, f"if K[p] in {f}:")
                self.expr(x, i + 1)
                self.put(i + 1, f"if p < 0: p = {s}")
                self.put(i, "else:")
                self.far(i + 1)
            else:
                self.expr(x, i)
                self.put(i, f"if p < 0: p = {s}")
        else:
            s, t = self.var(), self.var()
            self.put(i, f"{s} = p; {t} = S[0]")
            self.expr(x, i)
            self.put(i, f"S[0] = {t}")
            self.put(i, f"p = {s} if p {'>=' if kind == 'and' else '<'} 0 else -1")

    def source(self) -> str:
        for name, e in self.g.rules.items():
            self.put(0, f"def r_{name}(p):")
            self.put(1, f"m = M_{name}.get(p)")
            self.put(1, "if m is not None: return m")
            self.put(1, "start = p")
            self.expr(e, 1)
            self.put(1, f"M_{name}[start] = p")
            self.put(1, "return p")
        head = [f"M_{name} = {{}}" for name in self.g.rules]
        clear = [f" M_{name}.clear()" for name in self.g.rules]
        self.put(0, "def parse(kinds, texts, rule):")
        self.put(1, "global K, X")
        self.put(1, "K, X, S[0] = kinds, texts, 0")
        self.lines += clear
        self.put(1, "return rule(0), S[0]")
        sets = [f"{n} = frozenset({sorted(s)!r})" for s, n in self.sets.items()]
        return "\n".join(head + sets + self.lines)


class Parser:
    """A compiled grammar. ``run`` gives (whether all tokens were consumed, index of the furthest failure)."""

    def __init__(self, text: str, start: str = "file"):
        grammar = _Grammar(text)
        known = {x for e in grammar.rules.values() for x in _refs(e)}
        assert known <= set(grammar.rules), known - set(grammar.rules)
        self.space: dict = {"S": [0]}
        exec(compile(_Writer(grammar).source(), f"<grammar {start}>", "exec"), self.space)
        self.start = self.space[f"r_{start}"]

    def run(self, kinds: list[str], texts: list[str]) -> tuple[bool, int]:
        if sys.getrecursionlimit() < 200_000:
            sys.setrecursionlimit(200_000)
        end, far = self.space["parse"]([*kinds, "EOF", "END"], [*texts, "", ""], self.start)
        return end == len(kinds) + 1, min(far, len(kinds))


def _refs(e):
    kind, x = e
    if kind == "rule":
        yield x
    elif kind in ("seq", "choice"):
        for y in x:
            yield from _refs(y)
    elif kind not in ("tok", "text"):
        yield from _refs(x)
