import pytest
from pyspark.sql import functions as F

from loomwright.sources import readers, sinks
from loomwright.streaming.trends import daily_trend, distinct_events, read_events


def test_source_tree(spark, tmp_path):
    for name, text in {"src/A.java": b"class A {}", "src/b.PY": "é".encode(), "build/C.java": b"x", "d.txt": b"x", "e.go": b""}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text)
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.content, r.content_hash) for r in readers.read_source_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"A.java", "b.PY"} and got["b.PY"][:2] == ("python", "é") and len(got["A.java"][2]) == 64


def test_documents_with_failures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x.txt").write_bytes("﻿REQ-001: ok".encode())
    (tmp_path / "a/y.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "b/z.docx").write_bytes(b"PK")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, f"{tmp_path}/a, {tmp_path}/b").collect()}
    assert got["x.txt"].text == "REQ-001: ok" and got["x.txt"].ok
    assert not got["y.md"].ok and not got["z.docx"].ok and "docx" in got["z.docx"].error


def test_csv_json_and_dictionary(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿participant,verdict\nP1,一致\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "p.csv")).select("participant", "verdict").collect()] == [("P1", "一致")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"defects": [{"id": "D1", "line": 3}, {"id": "D2"}]}')
    (tmp_path / "j/b.json").write_text("{broken")
    assert sorted(tuple(r) for r in readers.read_json_items(spark, str(tmp_path / "j"), "defects", "struct<id:string,line:int>").collect()) == [("D1", 3), ("D2", None)]
    d = lambda rows: spark.createDataFrame(rows, "k string, v string")
    assert {tuple(r) for r in readers.overridden(d([("a", "1"), ("b", "2")]), d([("b", "3"), ("c", "4")]), "k", "v").collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    x = spark.createDataFrame([('{"a": 1}',), ("plain",)], "c string").select(readers.parsed_or_raw("c", "a int").alias("x")).select("x.parsed.a", "x.raw").collect()
    assert {tuple(r) for r in x} == {(1, None), (None, "plain")} or x[1].raw in ("plain", None)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda xs: spark.createDataFrame(xs, "project_id long, v long")
    sinks.append_partitioned(rows([(1, 1), (2, 2)]), path, "project_id")
    sinks.replace_partitions(rows([(2, 9)]), path, "project_id")
    assert {(r.project_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 9)}
    sinks.replace_partitions(rows([(1, 5)]), path, "project_id", [1, 2, 3])
    assert {(r.project_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, 5)}
    sinks.export_csv(rows([(1, 1)]), str(tmp_path / "csv"), {"v": "Value"})
    assert readers.read_csv(spark, str(tmp_path / "csv")).columns == ["Value"]
    v = spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "id long, vector array<double>")
    assert [tuple(r) for r in sinks.vector_rows(v, v.where("id = 2")).collect()] == [("requirement", "1", "0.5;1.0")]


def test_resumed(spark, tmp_path):
    path, runs = str(tmp_path / "stage"), []

    def build(n):
        runs.append(n)
        return spark.range(n)

    assert sinks.resumed(spark, path, lambda: build(0)).count() == 0
    assert sinks.resumed(spark, path, lambda: build(3)).count() == 3  # a stage without rows is built again
    assert sinks.resumed(spark, path, lambda: build(5)).count() == 3 and runs == [0, 3]
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert sinks.resumed(spark, path, lambda: build(7)).count() == 7


@pytest.mark.parametrize("mode", ["complete"])
def test_stream_equals_batch(spark, tmp_path, mode):
    events = spark.sql("select id as event_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, id % 5 as user_id, if(id % 4 = 0, 'error', 'click') as event_type, 1.0D as value, '{}' as props from range(100)")
    events.write.parquet(str(tmp_path / "in"))
    q = daily_trend(read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("trend").outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.day, r.total, r.errors) for r in spark.table("trend").collect()}
    want = {tuple(r) for r in events.groupBy(F.date_format("ts", "yyyy-MM-dd")).agg(F.count(F.lit(1)), F.sum((F.col("event_type") == "error").cast("long"))).collect()}
    assert got == want
    assert distinct_events(read_events(spark, str(tmp_path / "in"))).isStreaming
