import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.terms import _units, idf_of_texts, inverse_document_frequency, nearest, nearest_texts, term_frequencies
from loomwright.plans.text_queries import ORACLE, m2_w1_nearest_cases

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]


def sentence(i):
    return " ".join(WORDS[j] for j in range(len(WORDS)) if i >> j & 1)


def written(spark):
    """Records that the stages of this session have shuffled."""
    sc, no_quantiles = spark._jsc.sc(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, no_quantiles, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def by_definition(queries, rows, idf, k):
    def weighed(text):
        tf = Counter(w for w in text.split())
        return {t: n / sum(tf.values()) * idf.get(t, 1.0) for t, n in tf.items()}

    out = set()
    for q, text in queries:
        a, found = weighed(text), []
        for r, other in rows:
            b = weighed(other)
            if a.keys() & b.keys():
                dot = sum(w * b.get(t, 0.0) for t, w in a.items())
                found.append((-round(min(1.0, dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))), 6), r))
        out |= {(q, r, -s, i + 1) for i, (s, r) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("blocks", [(1000, 1000), (3, 5)])
def test_nearest_is_the_best_of_all_pairs(spark, blocks):
    queries = [(i, sentence(i * 5 % 127)) for i in range(1, 40)] + [(100 + i, sentence(i)) for i in range(1, 9)] + [(200, "nowhere")]
    rows = [(f"r{i:03}", sentence(i * 11 % 60)) for i in range(1, 130)]
    idf = {w: 1 + i / 3 for i, w in enumerate(WORDS[1:])}
    split = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.struct(w.alias("term"), F.lit(1.0).alias("weight")))
    q = term_frequencies(spark.createDataFrame(queries, "id long, text string"), "id", split)
    r = term_frequencies(spark.createDataFrame(rows, "rid string, text string"), "rid", split)
    got = nearest(q, r, spark.createDataFrame(list(idf.items()), "term string, idf double"), "id", "rid", 3, 6, *blocks)
    assert {tuple(x) for x in got.collect()} == by_definition(queries, rows, idf, 3)
    assert got.count() == 3 * (len(queries) - 1)


def test_rounding_goes_by_decimal_notation():
    import numpy as np

    assert _units(np.array([0.0000005, 0.1234565, 0.1234564999, 0.9999995, 0.5]), 6).tolist() == [1, 123457, 123456, 1000000, 500000]


def test_idf_counts_an_id_with_several_rows_once(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (2, "aa aa"), (3, None), (4, "?"), (5, "cc")], "id long, text string").repartition("id")
    terms = T.weighted_terms(F.col("text"))
    want = inverse_document_frequency(term_frequencies(docs, "id", terms), "id")
    assert {tuple(x) for x in idf_of_texts(docs, "id", terms).collect()} == {tuple(x) for x in want.collect()}


def test_nearest_cases_write_no_pairs(spark, tmp_path):
    n, m = 60, 400
    spark.createDataFrame([(50 * i, f"alpha query{i % 20}x", 0) for i in range(n)], "id long, original_text string, deleted int").write.parquet(f"{tmp_path}/tg_requirement.parquet")
    spark.createDataFrame([(f"c{i}", f"alpha case{i}x") for i in range(m)], "case_id string, original_text string").write.parquet(f"{tmp_path}/defect_detection_case.parquet")
    before = written(spark)
    assert m2_w1_nearest_cases(spark, str(tmp_path)).count() == 3 * n
    assert written(spark) - before < n * m


def odd_requirements(spark):
    """Rows of ids that are no multiples of anything, ids with several rows, repeated and deleted rows, null ids and texts."""
    rows = [(i, f"{i}个订单状态 {sentence(i * 5 % 127)} 至多{i}次", "a", 0) for i in range(1, 70)]
    rows += [(i, f"{sentence(i)} 77abc a77b_{i % 3}", None, None) for i in range(70, 90)]
    rows += [(7, "beta beta 登录", "b", 0), (7, "beta beta 登录", "b", 0), (7, "beta beta 登录", None, 0), (8, None, "a", 0), (9, "gone alpha", "a", 1)]
    rows += [(None, "alpha beta", "a", 0), (None, "gamma omega", "a", 0), (200, None, "a", 0), (201, "?? 12", "a", 0), (202, "nowhere 不在", "a", 0)]
    return spark.createDataFrame(rows, "id long, original_text string, kind string, deleted int")


def odd_cases(spark):
    rows = [(f"r{i:03}", f"{i} {sentence(i * 11 % 60)} 状态{i}") for i in range(1, 130)]
    rows += [("r005", "omega 订单"), ("r005", "omega 订单"), (None, "alpha beta"), ("r900", None), ("r901", "--"), ("Z1", "only here"), ("é1", "beta beta 登录")]
    return spark.createDataFrame(rows, "case_id string, original_text string")


def test_all_requirements_meet_their_nearest_cases_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    for name, df in (("tg_requirement", odd_requirements(spark)), ("defect_detection_case", odd_cases(spark))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute("CREATE TABLE tg_project (id BIGINT, project_name INT, industry_type INT, tech_stack INT, create_user_id INT, status INT, requirement_count INT, coverage_rate INT, defect_count INT, create_time INT, update_time INT, deleted INT)")
    con.execute("CREATE VIEW tg_analysis_task AS SELECT * FROM tg_project")
    got = {(r.id, r.case_id, r.similarity, r.rank) for r in m2_w1_nearest_cases(spark, str(tmp_path)).collect()}
    assert {r[0] for r in got} == {*range(1, 90)}
    assert got == {(r[0], r[1], r[2], r[3]) for r in con.execute(ORACLE["m2_w1_nearest_cases"]).fetchall()}


@pytest.mark.parametrize("limits", [(2, 10**6), (10**6, 2)])
def test_nearest_in_blocks_is_the_same_as_by_one_index(spark, limits):
    docs = odd_requirements(spark).repartition("id")
    got = [{tuple(r) for r in nearest_texts(docs, odd_cases(spark), "id", "case_id", "original_text", 3, 6, *most).collect()} for most in ((), limits)]
    assert got[0] == got[1] and len(got[0]) > 200


def test_nearest_of_empty_tables(spark):
    docs, rows = odd_requirements(spark), odd_cases(spark)
    for d, r in ((docs, rows.limit(0)), (docs.limit(0), rows), (docs.limit(0), rows.limit(0))):
        assert nearest_texts(d, r, "id", "case_id", "original_text", 3, 6).count() == 0


def test_term_text_has_the_terms_of_the_text(spark):
    texts = ["有效期为77天，到期前6天发送", "77abc a77b_1 HTTPCode2x __9 9_ 9a9", "登录，录入 订 单 订单3订单", "é1é abcédef a-b", "", " 12 ", "x\n3\r\ny", "订单12订单", "a1 2b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.weighted_terms(F.col("t")).alias("a"), T.weighted_terms(T.term_text(F.col("t"))).alias("b"))
    assert all(r.a == r.b for r in df.collect())
