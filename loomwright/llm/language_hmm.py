"""A character-level hidden Markov model with one code state and one state per natural language.

A state emits each character given the two before it (a trigram model per state, interpolated with bigrams and
unigrams); it goes on with probability near one, and any state can follow. Characters are folded to a small alphabet:
letters without case, one class each for digits, runs of capitals, Han, kana, hangul and Cyrillic letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# The states, and letters beyond a-z that the languages use.
LANGUAGES = ["zh", "en", "de", "fr", "es", "ja", "ru", "ko"]
STATES = ["code", *LANGUAGES]
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâæçèéêëîïôœùûÿáíñóú¿¡"
_SIGNS = " '\"`.,:;!?()[]{}<>=+-*/\\_&|%#@$~^’–“”«»"

_OTHER, _DIGIT, _UPPER, _HAN, _KANA, _HANGUL, _CYRILLIC, _CJK_SIGN = range(8)
_FIRST = 8
SIZE = _FIRST + len(_LETTERS) + len(_SIGNS)


def _alphabet() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.int32)
    table[0x30:0x3A] = _DIGIT
    for lo, hi, kind in ((0x4E00, 0xA000, _HAN), (0x3400, 0x4DC0, _HAN), (0xF900, 0xFB00, _HAN), (0x3040, 0x3100, _KANA), (0x31F0, 0x3200, _KANA), (0xAC00, 0xD7B0, _HANGUL), (0x1100, 0x1200, _HANGUL), (0x400, 0x530, _CYRILLIC), (0x3001, 0x3040, _CJK_SIGN), (0xFF01, 0xFF10, _CJK_SIGN), (0xFF1A, 0xFF21, _CJK_SIGN)):
        table[lo:hi] = kind
    table[0x3005] = _HAN
    for i, ch in enumerate(_LETTERS + _SIGNS):
        table[ord(ch)] = _FIRST + i
        if ch.isalpha() and len(ch.upper()) == 1:
            table[ord(ch.upper())] = _FIRST + i
    for ch in "\t\r\n\u3000\xa0":
        table[ord(ch)] = table[ord(" ")]
    return table


_TABLE = _alphabet()
_SPACE = int(_TABLE[ord(" ")])


def fold(text: str) -> np.ndarray:
    """Alphabet index of each character; characters beyond U+FFFF count as other."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _TABLE[np.minimum(points, 0xFFFF)]
    out[points > 0xFFFF] = _OTHER
    capital = (points >= 65) & (points <= 90)
    beside = np.zeros_like(capital)
    beside[1:] |= capital[:-1]
    beside[:-1] |= capital[1:]
    out[capital & beside] = _UPPER
    return out


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Index of (second last, last, this) per character; a text begins after two spaces."""
    padded = np.concatenate([[_SPACE, _SPACE], codes])
    return (padded[:-2] * SIZE + padded[1:-1]) * SIZE + padded[2:]


# Which scripts a language is written in; others are next to impossible in its state.
_SCRIPTS = {_HAN: ("zh", "ja"), _KANA: ("ja",), _HANGUL: ("ko",), _CYRILLIC: ("ru",)}
_LATIN_WRITTEN = ("code", "en", "de", "fr", "es")
_ACCENTS = {"en": "", "de": "äöüß", "fr": "àâæçèéêëîïôœùûÿ", "es": "áéíñóúü¿¡"}

#: What it costs to go between code and a language, and from one language to another.
SWITCH, CHANGE = 3.0, 14.0


def _scripts() -> np.ndarray:
    """Penalty per (state, character) for the wrong script."""
    out = np.zeros((len(STATES), SIZE))
    for i, state in enumerate(STATES):
        for kind, written in _SCRIPTS.items():
            if state not in written:
                out[i, kind] = -8 if state == "code" else -30
        foreign = set(_LETTERS[26:]) - set(_ACCENTS.get(state, _LETTERS))
        out[i, [_TABLE[ord(ch)] for ch in foreign]] = -6
        if state not in _LATIN_WRITTEN:
            out[i, [_TABLE[ord(ch)] for ch in _LETTERS]] = -3
    return out


@dataclass
class Model:
    """Log emission per (state, trigram), and of a first character per state."""

    emission: np.ndarray
    enter: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray) -> "Model":
        """From counts[state, trigram]: interpolation of trigram, bigram and unigram estimates and an even floor."""
        emission = np.empty((SIZE**3, len(STATES)), dtype=np.float32)
        enter = np.empty((SIZE, len(STATES)), dtype=np.float32)
        for i, wrong in enumerate(_scripts()):
            c3 = counts[i].reshape(SIZE, SIZE, SIZE).astype(np.float64)
            c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
            p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
            p2 = (c2 + 8 * p1) / (c2.sum(axis=1, keepdims=True) + 8)
            p3 = (c3 + 8 * p2) / (c3.sum(axis=2, keepdims=True) + 8)
            emission[:, i] = (np.log(0.98 * p3 + 0.02 / SIZE) + wrong).reshape(-1)
            enter[:, i] = np.log(0.98 * p1 + 0.02 / SIZE) + wrong
        return cls(emission, enter)

    def decode(self, texts: list[str], batch: int = 1024, cells: int = 1_000_000) -> list[np.ndarray]:
        """Most probable state of each character (Viterbi), every text beginning and ending in code."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        codes = [fold(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: len(codes[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < batch and len(codes[order[end]]) * (end - at + 1) <= cells:
                end += 1
            chosen = order[at:end]
            for i, path in zip(chosen, self._decode([codes[i] for i in chosen])):
                out[i] = path
            at = end
        return out

    def _decode(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        n, longest, k = len(codes), max(map(len, codes)), len(STATES)
        if not longest:
            return [np.zeros(0, np.int8)] * n
        lengths = np.array([len(c) for c in codes])
        grams, single = np.zeros((longest, n), dtype=np.int64), np.zeros((longest, n), dtype=np.int64)
        for i, c in enumerate(codes):
            grams[: len(c), i] = trigrams(c)
            single[: len(c), i] = c
        source = np.zeros((longest, n, k), dtype=np.int8)
        score = np.full((n, k), -np.float32(1e9))
        score[:, 0] = 0
        rows, same = np.arange(n), np.arange(k, dtype=np.int8)
        for t in range(longest):
            best = score[:, 1:].argmax(axis=1).astype(np.int8) + 1
            spoken, code = score[rows, best], score[:, 0]
            # into a language: from code or from the best language; into code: from the best language
            from_code = code - SWITCH >= spoken - CHANGE
            jump = np.empty((n, k), dtype=np.float32)
            jump[:, 0] = spoken - SWITCH
            jump[:, 1:] = np.maximum(code - SWITCH, spoken - CHANGE)[:, None]
            jump += self.enter[single[t]]
            stay = score + self.emission[grams[t]]
            keep = stay >= jump
            source[t] = np.where(keep, same, np.where(from_code, 0, best)[:, None])
            source[t, :, 0] = np.where(keep[:, 0], 0, best)
            score = np.where((t < lengths)[:, None], np.maximum(stay, jump), score)
        score[:, 1:] -= SWITCH
        path = np.zeros((n, longest), dtype=np.int8)
        state = score.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = t < lengths
            path[live, t] = state[live]
            state = np.where(live, source[t, rows, state], state)
        return [path[i, : lengths[i]] for i in range(n)]


# Code that stands in literals and comments, for the code state's counts.
CODE_SEEDS = """
SELECT a, b FROM some_table WHERE state = 'X' AND n > 0 ORDER BY a DESC LIMIT 10 OFFSET 5
select count(*) from t left join u on t.id = u.id where x is not null group by name having sum(n) > 1
INSERT INTO some_table (a, b, c) VALUES (?, ?, ?) ON CONFLICT DO NOTHING
UPDATE some_table SET n = n - ? WHERE id = ? AND deleted = 0
DELETE FROM some_table WHERE id IN (1, 2, 3); CREATE TABLE x (id BIGINT PRIMARY KEY, name VARCHAR(20) NOT NULL DEFAULT ''); DROP INDEX IF EXISTS idx_name; ALTER TABLE t ADD COLUMN c INT
https://www.example.com/path/to/page.html?query=1&lang=en#top http://localhost:8080/api/v1/items/{id}/lines mailto:someone@example.org
/usr/local/lib/python3/site-packages/pkg/module.py data/in/file.csv ../src/main/resources/config.yml C:\\Temp\\out.log
application/json; charset=utf-8 text/html Content-Type: X-Request-Id Authorization: Bearer
yyyy-MM-dd HH:mm:ss %Y-%m-%dT%H:%M:%SZ %d %s %5.2f %-10s {0} {1} {} ${name} #{id} {{value}}
^[A-Za-z_][A-Za-z0-9_]*$ (\\d{4})-(\\d{2}) [^\\s]+ .*?\\.txt$
SPDX-License-Identifier: Apache-2.0 Licensed under the Apache License, Version 2.0 Copyright (c) 2020 All rights reserved. MIT License BSD-3-Clause GPL-2.0-only
NOLINT noqa: E501 F401 pylint: disable=too-many-arguments type: ignore[attr] pragma: no cover fmt: off @formatter:on eslint-disable-next-line -*- coding: utf-8 -*- vim: set ts=4 sw=4 et: clang-format off region endregion go:build linux nolint:errcheck +build ignore noinspection unchecked checkstyle:off
if (a > b) return false; for (int i = 0; i < n; i++) sum += i; while (true) { break; } else if (x == null) throw new Error(); return foo(bar(x), y); int old = n - 1; total += n * 2; list.add(item); map.get(key); x = y if z else None; print(value); for x in range(n): total += x; if a > b: return False; def f(self, x): return x; import os; const char* p = NULL; std::vector<int> v; fmt.Println(x); err != nil { return err } self.items[key] = value; public static void main(String[] args)
"""
