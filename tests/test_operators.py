import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions.scoring import ScoringParams
from loomwright.operators import changes as C
from loomwright.operators import filters as P
from loomwright.operators import ranking as R
from loomwright.operators.aggregates import confusion, correlation, failure_runs, kappa, majority
from loomwright.operators.blocks import against_all
from loomwright.operators.code import reachable
from loomwright.operators.documents import clean_documents
from loomwright.operators.matching import greedy_matches
from loomwright.operators.skew import spread_join


def sequential(pairs):
    left, right, out = set(), set(), set()
    for a, b, rank, ok in sorted(pairs, key=lambda p: p[2]):
        if ok:
            left.add(a)
            right.add(b)
            out.add((a, b, rank, "consistent"))
        elif a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b, rank, "defect"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    cells = rnd.sample([(a, b) for a in range(12) for b in range(12)], 90)
    pairs = [(a, b, i, rnd.random() < 0.15) for i, (a, b) in enumerate(cells)]
    got = greedy_matches(spark.createDataFrame(pairs, "l long, r long, rank long, ok boolean"), "l", "r", "rank", "ok")
    assert {tuple(x) for x in got.collect()} == sequential(pairs)


def test_greedy_empty(spark):
    assert greedy_matches(spark.createDataFrame([], "l long, r long, rank long, ok boolean"), "l", "r", "rank", "ok").count() == 0


def test_chain(spark):
    rows, prev = [], "GENESIS"
    for i in range(20):
        text = "|".join([prev, str(i), "" if i % 3 else f"v{i}"])
        h = hashlib.sha256(text.encode()).hexdigest()
        rows.append(("a", i, None if i % 3 else f"v{i}", h))
        prev = h
    sound = spark.createDataFrame(rows, "g string, i long, v string, h string")
    check = lambda df: tuple(C.verify_chain(df, "g", ["i"], ["i", "v"], "h").first())
    assert check(sound) == ("a", 20, None)
    assert check(sound.withColumn("v", F.when(F.col("i") == 7, "x").otherwise(F.col("v")))) == ("a", 20, 7)
    assert check(sound.withColumn("h", F.when(F.col("i") != 4, F.col("h")))) == ("a", 20, 4)


def test_diff_and_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None)], "p string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("e", "5")], "p string, h string")
    plan = C.diff(old, new, "p", "h")
    assert {tuple(r) for r in plan.collect()} == {("a", "same"), ("b", "changed"), ("c", "same"), ("d", "removed"), ("e", "added")}
    assert {tuple(r) for r in C.merged(old, new, plan, "p").collect()} == {tuple(r) for r in new.collect()}
    assert C.diff(old.limit(0), new.limit(0), "p", "h").count() == 0


def test_numbering_queue_and_sample(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long").repartition(7)
    assert sorted((r.k, r.ord) for r in R.numbered(df, ["k"]).collect()) == [(i, i) for i in range(101)]
    assert sorted(r.k for r in R.systematic_sample(df.where("k < 10"), ["k"], 0.2).collect()) == [0, 5]
    assert [r.k for r in R.page(df, [F.col("k")], 2, 10).collect()] == list(range(10, 20))
    queue = R.capped_queue(df.where("k < 6"), [F.col("k") == 4, F.col("k") % 2 == 0], ["k"], 3).collect()
    assert sorted((r.place, r.k, r.picked) for r in queue) == [(1, 4, True), (2, 0, True), (3, 2, True), (4, 1, False), (5, 3, False), (6, 5, False)]


def test_filters(spark):
    df = spark.createDataFrame([("com.a.B", "50%"), ("com.a", "x"), ("org.c.D", None), (None, "50%")], "n string, t string")
    names = lambda d: sorted(str(r.n) for r in d.collect())
    assert names(df.where(P.in_scope(F.col("n"), ["com.a.*"], []))) == ["com.a", "com.a.B"]
    assert names(df.where(P.in_scope(F.col("n"), [], ["*c.D"]))) == ["com.a", "com.a.B"]
    assert names(P.search(df, "0%", "n", "t")) == ["None", "com.a.B"]
    assert P.where_given(df, n=None, t=" ").count() == 4


def test_measures(spark):
    def flags(n, a, b):
        return [(a, b)] * n

    both = spark.createDataFrame(flags(41, True, True) + flags(4, True, False) + flags(7, False, True) + flags(63, False, False), "a boolean, b boolean")
    k = kappa(both, F.col("a"), F.col("b")).first()
    assert (k.n, round(k.po, 4), round(k.kappa, 4)) == (115, 0.9043, 0.8016)
    hold = spark.createDataFrame(flags(19, True, True) + flags(3, False, True) + flags(38, False, False), "t boolean, s boolean")
    m = confusion(hold, F.col("t"), F.col("s")).first()
    assert (m.accuracy, m.miss_rate, round(m.fp_rate, 4)) == (0.95, 0.0, 0.0732)
    assert kappa(both.limit(0), F.col("a"), F.col("b")).first().kappa is None
    assert correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first().correlation is None
    tie = majority(spark.createDataFrame([(1, True), (1, False), (2, None)], "i long, v boolean"), "i", F.col("v")).collect()
    assert {r.i: r.verdict for r in tie} == {1: False, 2: None}


def test_failure_runs(spark):
    df = spark.createDataFrame([("u", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 1])], "u string, i long, f int")
    assert [tuple(r) for r in failure_runs(df, "u", ["i"], F.col("f") == 1, 3).collect()] == [("u", 3, 5, 3)]


def test_failure_runs_of_a_hot_group(spark):
    """A group that spreads over all partitions: as by walking through it."""
    rnd = random.Random(5)
    rows = [("hot", i, rnd.random() < 0.7) for i in range(900)] + [(f"g{i % 30}", i, rnd.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, bad boolean").repartition(7)
    wanted = set()
    for g in {r[0] for r in rows}:
        run = []
        for _, i, bad in [*sorted(r for r in rows if r[0] == g), (g, None, False)]:
            if bad:
                run.append(i)
            else:
                if len(run) >= 3:
                    wanted.add((g, run[0], run[-1], len(run)))
                run = []
    got = failure_runs(df, "g", ["i"], F.col("bad"), 3)
    assert {(r.g, r.first, r.last, r.length) for r in got.collect()} == wanted
    assert failure_runs(df.limit(0), "g", ["i"], F.col("bad"), 3).count() == 0


def test_blocks_meet_all_rows(spark):
    q = spark.createDataFrame([(i, float(i)) for i in range(30)], "q long, x double")
    r = spark.createDataFrame([(i, float(i)) for i in range(40)], "r long, y double")
    got = against_all(q, r, (F.col("x") * F.col("y")).alias("s"), ["q"], ["r"], block=4)
    assert {tuple(x) for x in got.collect()} == {(a, b, float(a * b)) for a in range(30) for b in range(40)}


def test_blocks_by_shuffle(spark):
    """More blocks than are broadcast: rows spread by a salt, and no pair is lost or doubled."""
    q = spark.createDataFrame([(i, float(i)) for i in range(30)], "q long, x double")
    r = spark.createDataFrame([(i, float(i)) for i in range(40)], "r long, y double")
    got = against_all(q, r, (F.col("x") * F.col("y")).alias("s"), ["q"], ["r"], block=4, broadcast_blocks=2)
    pairs = [tuple(x) for x in got.collect()]
    assert len(pairs) == 1200 and set(pairs) == {(a, b, float(a * b)) for a in range(30) for b in range(40)}


def test_matching_says_when_it_does_not_end(spark):
    """A chain in which every pair waits for the one before."""
    chain = [(i, i, 2 * i, False) for i in range(40)] + [(i + 1, i, 2 * i + 1, False) for i in range(40)]
    pairs = spark.createDataFrame(chain, "l long, r long, rank long, ok boolean")
    assert {(m.l, m.r) for m in greedy_matches(pairs, "l", "r", "rank", "ok").collect()} == {(i, i) for i in range(40)}
    waiting = spark.createDataFrame([(i, i, 100 - 2 * i, False) for i in range(9)] + [(i + 1, i, 99 - 2 * i, False) for i in range(9)], "l long, r long, rank long, ok boolean")
    with pytest.raises(RuntimeError, match="wait for each other"):
        greedy_matches(waiting, "l", "r", "rank", "ok", max_rounds=1)


def test_clean_lines_stay_in_the_row(spark):
    text = "Head 1\r\n# Title\nHead 1\n\nbody <b>x</b>\n---\nHead 1\nThe form must open.\nThe form must open.\nThe form must open.\n第 3 页"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a\na"), (5, "\n \n")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.text) for r in clean_documents(docs).collect()}
    assert got == {1: (5, "Title\nbody x\n" + "\n".join(["The form must open."] * 3)), 4: (2, "a\na")}
    assert clean_documents(docs.limit(0)).count() == 0


def test_reachable(spark):
    e = spark.createDataFrame([(1, "A", "B"), (1, "B", "C"), (1, "C", "A"), (1, "X", "Y"), (2, "A", "Z")], "g long, src string, dst string")
    s = spark.createDataFrame([(1, "A"), (2, "B")], "g long, state string")
    assert {tuple(r) for r in reachable(e, s, "g").collect()} == {(1, "A"), (1, "B"), (1, "C"), (2, "B")}


def test_params():
    with pytest.raises(ValueError):
        ScoringParams(0.5, 0.5, 0.5, 0.6, 0.5)
    with pytest.raises(ValueError):
        ScoringParams(0.4, 0.3, 0.3, 0.5, 0.5)


def test_spread_join_is_the_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 5}") for i in range(200)] + [(7, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v long")
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, spread_join(left, right, ["k"], F.col("i"), 4, how).collect())) == plain


def test_append_chain_is_what_verify_chain_follows(spark):
    rows = [("a", i, f"v{i}" if i % 2 else None) for i in range(50)] + [("b", i, "x") for i in range(3)] + [(None, 1, "y")]
    log = spark.createDataFrame(rows, "g string, i long, v string").repartition(3)
    chained = C.append_chain(log, "g", ["i"], ["i", "v"], "h")
    text, by = "GENESIS", {(r.g, r.i): r.h for r in chained.collect()}
    for i in range(50):
        text = hashlib.sha256(f"{text}|{i}|{f'v{i}' if i % 2 else ''}".encode()).hexdigest()
        assert by["a", i] == text
    assert {tuple(r) for r in C.verify_chain(chained, "g", ["i"], ["i", "v"], "h").collect()} == {("a", 50, None), ("b", 3, None), (None, 1, None)}
    broken = chained.withColumn("v", F.when((F.col("g") == "a") & (F.col("i") == 9), "z").otherwise(F.col("v")))
    assert {tuple(r) for r in C.verify_chain(broken, "g", ["i"], ["i", "v"], "h").collect()} == {("a", 50, 9), ("b", 3, None), (None, 1, None)}
    assert C.append_chain(log.limit(0), "g", ["i"], ["i", "v"], "h").count() == 0


def test_status_moves(spark):
    allowed = {(a, b) for a, bs in C.DEFECT_MOVES.items() for b in bs}
    assert len(allowed) == 11
    names = [*C.DEFECT_MOVES, "other", None]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    assert {(r.a, r.b) for r in df.where(C.may_follow(F.col("a"), F.col("b"))).collect()} == allowed


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from loomwright.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_bounds_of_pages(spark):
    assert [P.within(n, 1, 200, 20) for n in (None, 0, -5, 7, 500)] == [20, 1, 1, 7, 200]
    df = spark.range(300)
    assert [r.id for r in R.page(df, [F.asc("id")], 2, 3).collect()] == [3, 4, 5]
    assert R.page(df, [F.asc("id")], None, None).count() == 20 and R.page(df, [F.asc("id")], 0, 999).count() == 200
