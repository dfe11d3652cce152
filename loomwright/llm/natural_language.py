"""Natural language hidden in the comments and string literals of source files, by a hidden Markov model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm import language_hmm as hmm
from loomwright.llm.pieces import _PIECES, SCANNERS, pieces, unescape
from loomwright.session import spread

#: Words (Han or kana characters, syllables) from which a piece holds running language.
LEAST_WORDS = 4

#: How often each line of code seeds counts.
SEED_WEIGHT = 200

_CJK = re.compile(r"[㐀-鿿豈-﫿々぀-ヿ가-힣]")
_WORD = re.compile(r"\W*([^\W\d_]+(?:['’\-][^\W\d_]+)*)\W*")


def scanner_of(path: str | None) -> str:
    """The scanner for a file name; names without a known extension are read like C."""
    return SCANNERS.get((path or "").rpartition(".")[2].lower().strip(), "c")


def _gram_rows(states: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(state * SIZE³ + trigram, count), by state."""
    for state in set(states):
        grams = np.concatenate([hmm.trigrams(hmm.fold(t)) for s, t in zip(states, texts) if s == state])
        ids, n = np.unique(grams, return_counts=True)
        yield ids.astype(np.int64) + state * hmm.SIZE**3, n.astype(np.int64)


_GRAMS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def gram_counts(code: DataFrame, labelled: DataFrame) -> DataFrame:
    """(gram, n) over all rows: code(path, code) outside comments and literals for the code state, labelled(lang, text)
    for the languages. Labels are read without case and region; other labels, null and empty texts do not count. Each
    task adds up its batches before anything moves; the result has at most one row per state and trigram."""

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rest = [_PIECES[scanner_of(p)].sub(lambda m: " " if m.lastgroup in ("comment", "string", "tag") else m[0], t) for p, t in zip(b["path"], b["code"]) if t]
            for ids, n in _gram_rows([0] * len(rest), rest):
                yield pd.DataFrame({"gram": ids, "n": n})

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(hmm.STATES.index(k), t) for g, t in zip(b["lang"], b["text"]) if t and g and (k := g.lower()[:2]) in hmm.LANGUAGES]
            for ids, n in _gram_rows([s for s, _ in rows], [t for _, t in rows]):
                yield pd.DataFrame({"gram": ids, "n": n})

    both = spread(code.select("path", "code")).mapInPandas(outside, _GRAMS).unionByName(spread(labelled.select("lang", "text")).mapInPandas(spoken, _GRAMS))
    return both.groupBy("gram").agg(F.sum("n").alias("n"))


def fit_model(counts: DataFrame) -> "FittedModel":
    """Collect the counts (bounded by states x trigrams of the folded alphabet, not by the data), and add the code seeds."""
    got = counts.toPandas()
    grams, n = got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    seeds = hmm.CODE_SEEDS.strip().splitlines()
    for ids, k in _gram_rows([0] * len(seeds), seeds):
        grams, n = np.concatenate([grams, ids]), np.concatenate([n, k * SEED_WEIGHT])
    return FittedModel(grams, n)


_built: dict[tuple, hmm.Model] = {}


class FittedModel:
    """The sparse counts, which travel to the workers; each worker builds the model from them once."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n
        self.key = (len(grams), int(grams.sum()), int(n.sum()), int((grams * n % 1_000_003).sum()))

    def model(self) -> hmm.Model:
        if self.key not in _built:
            _built.clear()
            dense = np.zeros(len(hmm.STATES) * hmm.SIZE**3, dtype=np.float32)
            np.add.at(dense, self.grams, self.n)
            _built[self.key] = hmm.Model.fit(dense.reshape(len(hmm.STATES), -1))
        return _built[self.key]


def words_by_language(text: str, path: np.ndarray) -> Counter:
    """Words per language: white-space-bounded words of letters (apostrophes and hyphens inside), and each Han, kana or
    hangul character, in the state that most of their characters have."""
    found: Counter = Counter()
    for m in re.finditer(r"\S+", text):
        if _CJK.search(m[0]):
            for q in _CJK.finditer(m[0]):
                state = path[m.start() + q.start()]
                if state:
                    found[hmm.STATES[state]] += 1
        elif w := _WORD.fullmatch(m[0]):
            inside = path[m.start() + w.start(1) : m.start() + w.end(1)]
            state = int(np.bincount(inside, minlength=len(hmm.STATES)).argmax())
            if state:
                found[hmm.STATES[state]] += 1
    return found


_FOUND = T.StructType(
    [T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("nl_lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("file_chars", T.LongType()), T.StructField("text", T.StringType())]
)


def find_language(code: DataFrame, fitted: FittedModel, id_col: str = "case_id") -> DataFrame:
    """Pieces with running language of code(id_col, path, code): id_col, line_no, kind, nl_lang, n_words, n_chars,
    file_chars, text.

    The model segments each file whole: outside comments and string literals only the code state is allowed, so the best
    path of a file is that of its pieces, each beginning and ending in code; their texts are read without marks and
    escapes. A piece counts from LEAST_WORDS words in language states; its language is that of most of them (ties: the
    first in hmm.LANGUAGES). n_chars counts the piece's characters in language states. Files with null or empty code, and
    pieces without language, give no row; repeated files repeat theirs. One narrow stage.
    """
    src = spread(code.select(F.col(id_col).alias("_id"), "path", "code").where(F.length("code") > 0))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType), *_FOUND.fields])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fitted.model()
        for b in batches:
            rows, texts = [], []
            for i, path, source in zip(b["_id"], b["path"], b["code"]):
                for line, kind, text in pieces(source, scanner_of(path)):
                    rows.append((i, line, kind, len(source)))
                    texts.append(unescape(text))
            out = []
            for (i, line, kind, size), text, path in zip(rows, texts, model.decode(texts)):
                words = words_by_language(text, path)
                if sum(words.values()) >= LEAST_WORDS:
                    most = max(words.values())
                    lang = next(k for k in hmm.LANGUAGES if words[k] == most)
                    out.append((i, line, kind, lang, sum(words.values()), int((path > 0).sum()), size, text))
            yield pd.DataFrame(out, columns=schema.names)

    return src.mapInPandas(find, schema).withColumnRenamed("_id", id_col)


def language_shares(found: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Each language's share of the characters of its file: id_col, nl_lang, n_pieces, share (at most 1)."""
    return found.groupBy(id_col, "nl_lang").agg(F.count(F.lit(1)).alias("n_pieces"), F.least(F.lit(1.0), F.sum("n_chars") / F.max("file_chars")).alias("share"))
