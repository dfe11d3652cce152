"""Source files that do not parse, by packrat parsing-expression grammars per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.parsing import grammars, lexers
from loomwright.llm.parsing.peg import Parser
from loomwright.session import spread

# File extensions and their languages.
LANGUAGES = {"java": "java", "py": "python", "go": "go", "c": "c", "cpp": "cpp"}

_MARKER = re.compile(r"<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$)")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f�]")


@lru_cache(maxsize=None)
def _parser(language: str):
    return getattr(lexers, language), Parser(getattr(grammars, language.upper()))


def parse(text: str, language: str) -> tuple[bool, int]:
    """Whether the whole text is a valid file of the language; if not, the offset of the furthest failure."""
    lex, parser = _parser(language)
    tokens = lex(text)
    valid, far = parser.run(tokens.kinds, tokens.texts)
    return valid, -1 if valid else tokens.at[far] if far < len(tokens.at) else len(text)


def explain(text: str, language: str, at: int) -> str:
    """Cause of a failure at offset ``at``: conflict, binary, other_language:NAME, truncated or unexpected."""
    begin = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
    line = re.split(r"[\r\n]", text[begin:], maxsplit=1)[0]
    if _MARKER.match(line):
        return "conflict"
    if len(_CONTROL.findall(text)) * 20 > len(text):
        return "binary"
    for other in dict.fromkeys(LANGUAGES.values()):
        if other != language and text.strip() and parse(text, other)[0]:
            return f"other_language:{other}"
    if re.search(r"(?m)^(?:<{7} .*|>{7} .*|={7})\r?$", text[:at]) and re.search(r"(?m)^={7}\r?$", text):
        return "conflict"
    if not text[at:].strip() or not text[begin + len(line) :].strip() or re.fullmatch(r"\W*(?:\.\.\.|\[?truncated\]?).*", text[at:].strip(), re.S):
        return "truncated"
    return "unexpected"


RESULT = T.StructType(
    [T.StructField("language", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("cause", T.StringType()), T.StructField("position", T.LongType()), T.StructField("line", T.LongType())]
)


def check_files(files: DataFrame, id_col: str = "file_id", name_col: str = "file_name", content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``files`` whose extension names a known language, in any case: id, ``keep`` columns, language,
    valid, cause, position and line of the furthest failure.

    A null content gives valid = null; a null name or another extension no row. Empty files are valid except in Go. One
    narrow stage; files of any length are parsed whole, in time linear in their length.
    """
    extension = F.lower(F.regexp_extract(F.col(name_col), r"\.([A-Za-z0-9]+)\s*$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension)
    src = files.select(F.col(id_col).alias("id"), F.struct(*[F.col(k) for k in keep], F.lit(0).alias("_")).alias("kept"), F.col(content_col).alias("text"), language.alias("language")).where(F.col("language").isNotNull())
    src = spread(src)

    @F.pandas_udf(RESULT)
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, languages in batches:
            rows = []
            for text, lang in zip(texts, languages):
                if text is None:
                    rows.append((lang, None, None, None, None))
                    continue
                valid, at = parse(text, lang)
                line = None if valid else len(re.findall(r"\r\n|\n|\r", text[:at])) + 1
                rows.append((lang, valid, None if valid else explain(text, lang, at), None if valid else at, line))
            frame = pd.DataFrame(rows, columns=RESULT.names)
            yield frame.astype({"valid": "boolean", "position": "Int64", "line": "Int64"})

    return src.withColumn("r", parsed("text", "language")).select(F.col("id").alias(id_col), *[F.col(f"kept.{k}").alias(k) for k in keep], "r.*")


def failure_rates(checked: DataFrame, hints: DataFrame, repo_col: str = "repo", name_col: str = "file_name") -> DataFrame:
    """Per repo and language: files, invalid ones, rate, and how far the hints (repo, file_name) agree.

    ``checked`` must keep the repo and name columns. Files without content do not count. ``hinted`` counts files that a
    hint names, ``hinted_invalid`` those of them that are invalid.
    """
    named = hints.select(F.col(repo_col).alias("_repo"), F.col(name_col).alias("_name")).where(F.col("_name").isNotNull()).distinct().withColumn("_hint", F.lit(1))
    joined = checked.where(F.col("valid").isNotNull()).join(named, (F.col(repo_col) == F.col("_repo")) & (F.col(name_col) == F.col("_name")), "left")
    bad, hint = (~F.col("valid")).cast("long"), F.coalesce("_hint", F.lit(0)).cast("long")
    return joined.groupBy(F.col(repo_col).alias("repo"), "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum(bad).alias("invalid"), (F.sum(bad) / F.count(F.lit(1))).alias("rate"), F.sum(hint).alias("hinted"), F.sum(hint * bad).alias("hinted_invalid")
    )
