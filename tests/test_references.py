import datetime as dt
import random

from loomwright.operators.references import orphan_references, orphan_report, parent_intervals, reference_stream

PARENT = "id long, update_time timestamp_ntz, create_time timestamp_ntz, deleted int, ref_table string"
CHILD = "id long, project_id long, create_time timestamp_ntz, deleted int, reason string"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def run(spark, children, parents, salts=4):
    p = parent_intervals(spark.createDataFrame([(i, day(u), day(c), d, "x") for i, u, c, d in parents], PARENT))
    c = reference_stream(spark.createDataFrame([(i, k, day(c), d, "x") for i, k, c, d in children], CHILD), "child")
    return orphan_references(c, p, salts)


def expected(children, parents):
    best = {}
    for i, u, c, d in parents:
        if i is not None:
            key = (u is not None, u or 0, c is not None, c or 0, d or 0)
            if i not in best or key > best[i][0]:
                best[i] = (key, c, d or 0)
    out = set()
    for i, k, c, d in children:
        if k is None or d == 1:
            continue
        if k not in best:
            out.add((i, "missing"))
        elif best[k][2] == 1:
            out.add((i, "deleted"))
        elif c is not None and best[k][1] is not None and c < best[k][1]:
            out.add((i, "late"))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    maybe = lambda n: rnd.choice([None, *range(n)])
    parents = [(rnd.choice([None, *range(30)]), maybe(9), maybe(9), rnd.choice([None, 0, 0, 1])) for _ in range(80)]
    children = [(i, rnd.choice([None, 3, 3, 3, *range(40)]), maybe(9), rnd.choice([None, 0, 0, 1])) for i in range(400)]
    children += children[:50]
    got = run(spark, children, parents)
    rows = got.collect()
    assert {(r.row_id, r.reason) for r in rows} == expected(children, parents)
    report = orphan_report(got).collect()
    assert sum(r.orphans for r in report) == len({(r.row_id, r.ref_time, r.reason) for r in rows})


def test_hot_key_is_salted(spark):
    children = [(i, 7 if i % 3 else i + 100, 5, 0) for i in range(70_000)]
    got = run(spark, children, [(7, 1, 9, 0)], salts=8)
    assert {r.reason: r["count"] for r in got.groupBy("reason").count().collect()} == {"late": 46_666, "missing": 23_334}


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1, 0)]).count() == 0
    assert [(r.row_id, r.reason) for r in run(spark, [(1, 2, None, None)], []).collect()] == [(1, "missing")]
