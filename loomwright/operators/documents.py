"""Cleaning and segmenting documents line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.session import spread


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, line): a row per line of each non-null text."""
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("pos", "line"))


def cleaned_lines(text: Column, repeats: int = 3, short: int = 24) -> Column:
    """The clean lines of a text without noise, blank lines, and running heads: lines of at most ``short`` characters that
    occur ``repeats`` times or more in it and are no content. All of it stays within the row."""
    raw = F.split(text, r"\r\n|\r|\n")
    # equal lines stand together once sorted: a line that equals the one (repeats - 1) places before occurs so often
    before = lambda lines, i: F.element_at(lines, F.greatest(F.lit(1), i + 2 - repeats))
    often = lambda lines: F.array_distinct(F.filter(lines, lambda x, i: (i >= repeats - 1) & (x == before(lines, i))))
    pairs = F.transform(raw, lambda x: F.struct(F.trim(x).alias("raw"), T.clean_line(x).alias("clean")))
    head = lambda x, heads: (F.length(x["clean"]) <= short) & F.array_contains(heads, x["raw"]) & ~T.looks_like_content(x["clean"])
    kept = lambda heads: F.transform(F.filter(pairs, lambda x: (x["clean"] != "") & ~T.is_noise_line(x["clean"]) & ~head(x, heads)), lambda x: x["clean"])
    return _let(_let(F.array_sort(F.transform(raw, lambda x: F.trim(x))), often), kept)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, also where it is used inside another lambda."""
    return F.transform(F.array(value), then)[0]


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, text): the clean lines of each document, joined again, within the row: only an input of fewer splits than tasks is
    shuffled at all. Null texts, and texts
    without a clean line, give no row."""
    lines = spread(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)).select(id_col, cleaned_lines(F.col(text_col)).alias("_lines"))
    return lines.where(F.size("_lines") > 0).select(id_col, F.size("_lines").cast("long").alias("n_lines"), F.array_join("_lines", "\n").alias("text"))


def numbered_segments(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, seq, text): requirement items. A numbered line begins an item, a blank line ends it; text before the first
    number is left out. Gaps and islands over each document's lines."""
    doc = Window.partitionBy(id_col).orderBy("pos")
    raw = F.trim("line")
    marked = lines.withColumn("raw", raw).withColumn("start", raw.rlike(T.NUMBERING).cast("int")).withColumn("blank", (raw == "").cast("int"))
    island = F.sum("start").over(doc)
    marked = marked.withColumn("item", island).where("item > 0")
    gone = F.sum("blank").over(Window.partitionBy(id_col, "item").orderBy("pos"))
    kept = marked.withColumn("gone", gone).where("gone = 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), " ")
    return kept.groupBy(id_col, F.col("item").alias("seq")).agg(joined.alias("text"))


def sentence_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(id_col, seq, text): unnumbered text in sentences, merged until the next sentence with a word of behaviour; pieces
    of fewer than ``least`` characters are left out."""
    sentences = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(r"([^。！？!?;；\r\n]+[。！？!?;；]?)"), F.lit(1))).alias("pos", "s"))
    doc = Window.partitionBy(id_col).orderBy("pos")
    starts = (T.any_of(F.col("s"), T.BEHAVIOUR_WORDS)).cast("int")
    islands = sentences.withColumn("seq", F.sum(starts).over(doc))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "")
    return islands.groupBy(id_col, "seq").agg(joined.alias("text")).where(F.length("text") >= least)


def business_ids(items: DataFrame, order: list[str], text: str, start: int = 1) -> DataFrame:
    """Distinct texts (the first by ``order`` is kept) with ids REQ-0001, REQ-0002 and so on in that order."""
    from loomwright.operators.ranking import first_per, numbered

    kept = first_per(items, [text], [F.asc(c) for c in order])
    return numbered(kept, order, "_n", start).withColumn("business_id", F.format_string("REQ-%04d", F.col("_n"))).drop("_n")


def quality_issues(docs: DataFrame, id_col: str, text_col: str, words: list[str], pairs: list[tuple[str, str]], around: int = 15) -> DataFrame:
    """(id_col, type, keyword, excerpt): vague words; two words that exclude each other, the second without 不 before it; and
    missing boundaries: an action on data without a word on who may do it, a number without a word on its range."""
    t = F.col(text_col)
    issue = lambda kind, keyword, at: F.struct(F.lit(kind).alias("type"), keyword.alias("keyword"), at.alias("at"))
    vague = [F.when(F.contains(t, F.lit(w)), issue("ambiguity", F.lit(w), F.lit(w))) for w in words]
    against = [F.when(F.contains(t, F.lit(a)) & t.rlike(f"(^|[^不]){b}"), issue("contradiction", F.lit(f"{a} / {b}"), F.lit(a))) for a, b in pairs]
    action, number = F.regexp_extract(t, T.SENSITIVE_ACTIONS, 0), F.regexp_extract(t, "[0-9]+", 0)
    missing = [
        F.when((action != "") & ~t.rlike(T.PERMISSION_WORDS), issue("missing_boundary", F.concat(F.lit("敏感操作："), action), action)),
        F.when((number != "") & ~t.rlike(T.RANGE_WORDS), issue("missing_boundary", F.lit("数量边界"), number)),
    ]
    found = F.explode(F.filter(F.array(*vague, *against, *missing), lambda x: x.isNotNull()))
    rows = docs.where(t.isNotNull()).select(id_col, t.alias("_t"), found.alias("i"))
    first = F.expr("greatest(0, locate(i.at, _t) - 1 - %d)" % around)
    length = F.expr("locate(i.at, _t) - 1 + length(i.at) + %d" % around) - first
    return rows.select(id_col, "i.type", "i.keyword", F.substring("_t", first + 1, length).alias("excerpt"))


def ambiguity_report(docs: DataFrame, id_col: str, text_col: str, words: list[str], around: int = 15) -> DataFrame:
    """(id_col, word, excerpt) of the first occurrence of each vague word, with the text around it."""
    t = F.lower(F.col(text_col))
    rules = F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))
    found = docs.select(id_col, F.col(text_col).alias("_t"), rules.alias("word"))
    begin = F.expr("greatest(1, locate(word, lower(_t)) - %d)" % around)
    return found.select(id_col, "word", F.substring("_t", begin, F.length("word") + 2 * around).alias("excerpt"))
