"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.consensus import Consensus, agreement, consensus, pair_labels
from loomwright.llm.mojibake import find_garbled
from loomwright.llm.natural_language import find_language, fit_model, gram_counts, language_shares
from loomwright.llm.packing import pack_documents, packing_report
from loomwright.llm.residue import find_residue, without_residue
from loomwright.llm.syntax import check_files, failure_rates
from loomwright.llm.tokens import count_tokens, encode_corpus
from loomwright.session import read_table


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(read_table(spark, sf_dir, "tg_requirement"), ["original_text", "source_file"], "id", "project_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_repaired(spark, sf_dir).select("id", "field_name").distinct()


def _language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read_table(spark, sf_dir, "defect_detection_case")
    code = cases.select("case_id", F.col("file_path").alias("path"), F.col("code_content").alias("code"))
    return find_language(code, fit_model(gram_counts(code, read_table(spark, sf_dir, "documents"))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language_pieces(spark, sf_dir).select("case_id", "line_no", "kind", "nl_lang").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language_pieces(spark, sf_dir)


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_shares(_language_pieces(spark, sf_dir).distinct())


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_labels(*(read_table(spark, sf_dir, t) for t in ("consistency_pair", "participant_verdict", "second_annotation")))


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    return consensus(_labels(spark, sf_dir), ["defective"], rest="consistent")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).items.where("label = 'defective'").select(F.col("item").alias("pair_id"))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).items.withColumnRenamed("item", "pair_id")


def p4_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators.drop("class")


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")]
    return agreement(_labels(spark, sf_dir)).select("items", "labels", *rounded)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(read_table(spark, sf_dir, "source_file")).where(~F.col("valid")).select("file_id").distinct()


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(read_table(spark, sf_dir, "source_file"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "source_file").dropDuplicates(["file_id"])
    return failure_rates(check_files(files, keep=("repo", "file_name")), read_table(spark, sf_dir, "parse_failure"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_containers(spark, sf_dir))


def p8_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_sorts(spark, sf_dir).select("doc_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(read_table(spark, sf_dir, "documents"), p8_sorts(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_shares": p3_shares, "p4_found": p4_found, "p4_labels": p4_labels, "p4_annotators": p4_annotators, "p4_agreement": p4_agreement, "p5_found": p5_found, "p5_files": p5_files, "p5_rates": p5_rates, "p6_ids": p6_ids, "p6_counts": p6_counts, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_sorts": p8_sorts, "p8_clean": p8_clean}

ORACLE: dict[str, str] = {
    "p4_agreement": """
WITH said AS (
  SELECT p.pair_id AS item, 'p' || upper(trim(translate(v.participant, 'Ｐ０１２３４５６７８９　', 'P0123456789 '))) AS annotator, v.end_time AS t,
         CASE WHEN lower(trim(v.verdict)) IN ('defective', '不一致', '有缺陷') THEN 1 WHEN lower(trim(v.verdict)) IN ('consistent', '一致', '无缺陷') THEN 0 END AS label
  FROM participant_verdict v JOIN consistency_pair p ON v.project = p.project AND v.req_id = p.req_id AND v.file = p.file AND v.method_name = p.method_name
  UNION ALL
  SELECT pair_id, 's' || lower(trim(annotator)), epoch_us(generated_at) / 1e6, CASE WHEN consistent THEN 0 ELSE 1 END
  FROM second_annotation WHERE consistent IS NOT NULL AND pair_id IN (SELECT pair_id FROM consistency_pair)),
last AS (
  SELECT item, annotator, label FROM said WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY item, annotator ORDER BY t DESC NULLS LAST, label DESC) = 1),
c AS (SELECT item, label, count(*) AS k FROM last GROUP BY 1, 2),
i AS (SELECT item, sum(k) AS n, sum(k * (k - 1)) AS same FROM c GROUP BY 1 HAVING sum(k) > 1),
t AS (SELECT count(*) AS items, sum(n)::BIGINT AS labels, sum(same / (n - 1)) / sum(n) AS observed FROM i),
e AS (SELECT sum(k * (k - 1)) AS by_chance FROM (SELECT label, sum(k) AS k FROM c WHERE item IN (SELECT item FROM i) GROUP BY 1))
SELECT items, labels, round(observed, 6) AS observed, round(by_chance / (labels::DOUBLE * (labels - 1)), 6) AS expected,
       round(1 - (1 - observed) / (1 - by_chance / (labels::DOUBLE * (labels - 1))), 6) AS alpha
FROM t, e
""",
}
