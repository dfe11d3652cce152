"""A byte-pair encoding compiled into a deterministic automaton, and words encoded by table-driven transitions.

Two steps. The gadgets give an automaton over tokens. Its states are the tokens (the state after emitting token t is t)
plus a start state; an arc t -> u, labelled u, says that u may follow t in the encoding of some word. It begins as the
automaton over single bytes, where every arc exists; then one gadget per merge (a, b) -> c of rank k, in rank order:

* the arc a -> b is cut (its path now carries the label c instead),
* c gets an arc from every state that has one to a, after the cut,
* c gets the outgoing arcs that b had before the cut.

The result accepts exactly one path per byte string, the encoding. Its table has V x V bits, nearly all rows different;
so a gadget does not write its row and column out but shares those of a and b, and keeps their rank and the cut.

The second step turns that automaton round to read bytes: a word's prefix has one accepting path, so its last token is
known, and the last token of a longer prefix is the one token u that ends there and may follow the last token before u.
A state is therefore the bytes that a token may still grow from, with the last token at each of their borders. States
and transitions (state, byte) -> state are written into a table when a text first needs them and looked up from then on.
The labels of the arcs that lie on the path, read back from a word's end, are its encoding.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import regex

#: The pre-split of byte-level BPE vocabularies (a fixed, public pattern).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries after which the tables of transitions, of arcs and of encoded words start afresh. They only save time.
STATE_ENTRIES, ARC_ENTRIES, WORD_ENTRIES = 200_000, 1_000_000, 300_000

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files: printable Latin-1 stands for
    itself, the other bytes in order for the characters from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + i)] = b
    return table


class State:
    """``token`` ends the encoding of what was read. ``context`` holds the last bytes that a longer token may begin with,
    ``before`` the last token (-1: none) at each border of these, ``next`` the state after each byte."""

    __slots__ = ("token", "context", "before", "next")

    def __init__(self, token: int, context: bytes, before: tuple[int, ...]):
        self.token, self.context, self.before, self.next = token, context, before, {}


class MergeAutomaton:
    """The compiled automaton; ``encode_word`` runs it over a word's bytes, ``decode`` emits arc labels."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: b for b, i in vocab.items()}
        self.length = {i: len(b) for b, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.row_of, self.col_of, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        # tokens that some word is encoded with: single bytes, and what a gadget makes of a path that is still there
        self.tokens = {b: i for b, i in vocab.items() if len(b) == 1}
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b], a + b)
        self.starts = {token[:n] for token in self.tokens for n in range(1, len(token) + 1)}
        self._reset()

    def _gadget(self, k: int, a: int, b: int, c: int, label: bytes) -> None:
        if self._arc(a, b, k) and self.rank[c] < 0:  # a string that two merges make keeps its first source
            self.col_of[c], self.row_of[c], self.rank[c] = a, b, k
            if self.label[a] in self.tokens and self.label[b] in self.tokens:
                self.tokens[label] = c
        self.cut.setdefault(a << 20 | b, k)

    def _reset(self) -> None:
        self.start = State(-1, b"", (-1,))
        self.states = {(b"", (-1,)): self.start}

    def _arc(self, t: int, u: int, before: int) -> bool:
        """Whether u may follow t ahead of the merge of rank ``before``: follow shared rows and columns back to bytes, and
        see whether a cut lies on the way."""
        cut, rank = self.cut, self.rank
        while True:
            k = cut.get(t << 20 | u)
            if k is not None and k < before:
                return False
            rt, ru = rank[t], rank[u]
            if rt < 0 and ru < 0:
                return True
            if rt > ru:
                t, before = self.row_of[t], rt
            else:
                u, before = self.col_of[u], ru + 1

    def has_arc(self, t: int, u: int) -> bool:
        """Whether u may follow t, at the start (-1) or after a token."""
        if t < 0:
            return True
        key = t << 20 | u
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARC_ENTRIES:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(t, u, 1 << 30)
        return known

    def _step(self, state: State, x: int) -> State:
        """Write the transition of ``state`` on byte ``x`` into the table."""
        context, before = state.context + bytes([x]), state.before
        for at, t in enumerate(before):
            u = self.tokens.get(context[at:])
            if u is not None and self.has_arc(t, u):
                break
        else:
            raise ValueError(f"the vocabulary cannot write {context!r}")
        drop = next((n for n in range(len(context)) if context[n:] in self.starts), len(context))
        key = (context[drop:], (*before, u)[drop:])
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= STATE_ENTRIES:  # states in use live on, the table fills again
                self._reset()
            found = self.states[key] = State(u, *key)
        state.next[x] = found
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one accepting path: a transition per byte, then the path read back from its end."""
        state, ends = self.start, []
        for x in word:
            nxt = state.next.get(x)
            if nxt is None:
                nxt = self._step(state, x)
            state = nxt
            ends.append(state.token)
        path, at, length = [], len(word), self.length
        while at > 0:
            t = ends[at - 1]
            path.append(t)
            at -= length[t]
        return tuple(path[::-1])

    def decode(self, ids) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


class _Words(dict):
    """Paths of words already seen; a missing word runs through the automaton."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        path = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORD_ENTRIES:
            self.clear()
        if len(word) < 256:
            self[word] = path
        return path


class Tokenizer:
    """Pre-split, then the automaton per word. Null and empty texts have no tokens; special strings are ordinary text."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton, self.words, self.split = automaton, _Words(automaton), regex.compile(PRE_SPLIT).findall

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            words, extend = self.words, ids.extend
            for w in self.split(text):
                extend(words[w])
        return ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.words
        return sum([len(words[w]) for w in self.split(text)])


@lru_cache(maxsize=4)
def load_tokenizer(path: str = DEFAULT_PATH) -> Tokenizer:
    """Compile the vocabulary file at ``path``, once per Python worker."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file at {path}; give its path as a parameter")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = byte_alphabet()
    raw = lambda s: bytes(byte[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return Tokenizer(MergeAutomaton({raw(s): i for s, i in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs]))
