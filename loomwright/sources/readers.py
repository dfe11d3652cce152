"""Reading documents, source trees, CSV and JSON data sets, and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.changes import content_hash

# Folders of version control and builds, which are not read.
SKIPPED = ["/.git/", "/.svn/", "/target/", "/build/", "/node_modules/", "/__pycache__/", "/.idea/"]
EXTENSIONS = {"java": ["java"], "python": ["py"], "go": ["go"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp"]}


def read_source_tree(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """(path, language, content, content_hash) of the source files below a folder; bytes that are no UTF-8 become
    replacement characters. Folders of version control and builds are left out, and so are empty files."""
    wanted = {x: k for k, xs in EXTENSIONS.items() for x in xs if languages is None or k in languages}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(sorted({*wanted, *map(str.upper, wanted)})) + "}").load(path)
    for folder in SKIPPED:
        files = files.where(~F.contains(F.col("path"), F.lit(folder)))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(v) for kv in wanted.items() for v in kv]), extension)
    return files.select("path", language.alias("language"), F.col("content").cast("string").alias("content")).withColumn("content_hash", content_hash(F.col("content")))


def read_documents(spark: SparkSession, paths: str) -> DataFrame:
    """(path, ok, text, error): texts of txt and md files, one row per file; other extensions, and files that are no UTF-8,
    are failures with a reason and never end the read. ``paths`` may be several, separated by commas."""
    schema = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def parse(names, contents):
        import pandas as pd

        rows = []
        for name, content in zip(names, contents):
            kind = name.rpartition(".")[2].lower()
            try:
                if kind not in ("txt", "md"):
                    raise ValueError(f"no reader for .{kind}")
                rows.append((True, bytes(content).decode("utf-8-sig"), None))
            except ValueError as e:
                rows.append((False, None, str(e)[:200]))
        return pd.DataFrame(rows, columns=schema.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([p.strip() for p in paths.split(",") if p.strip()])
    return files.select("path", parse("path", "content").alias("r")).select("path", "r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])


def read_json_items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Items of the array ``field`` of one JSON document per file; corrupt files give none."""
    df = spark.read.option("multiLine", "true").schema(f"{field} array<{schema}>").json(path)
    return df.select(F.explode(field).alias("x")).select("x.*")


def overridden(inner: DataFrame, outer: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of a dictionary whose entries an outer one replaces or adds to."""
    o = outer.select(key, F.col(value).alias("_outer"))
    return inner.join(o, key, "full").select(key, F.coalesce("_outer", value).alias(value))


def parsed_or_raw(c: str, schema: str):
    """(parsed, raw): the JSON value, and the text where it is none."""
    value = F.from_json(c, schema)
    return F.struct(value.alias("parsed"), F.when(value.isNull(), F.col(c)).alias("raw"))
