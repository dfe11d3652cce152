import math
import random

import pytest

from loomwright.llm.consensus import agreement, consensus, latest_labels, pair_labels


def votes(seed=1, items=300):
    rnd = random.Random(seed)
    rates = {"good": 0.92, "fair": 0.8, "fair2": 0.8, "guess": 0.5, "guess2": 0.5, "liar": 0.15, "liar2": 0.15}
    truth = {f"i{k}": rnd.random() < 0.4 for k in range(items)}
    rows = [(i, a, "bad" if (t == (rnd.random() < r)) else "ok") for i, t in truth.items() for a, r in rates.items()]
    return truth, rows


def test_beats_majority_and_finds_liars(spark):
    truth, rows = votes()
    got = consensus(spark.createDataFrame(rows, "item string, annotator string, label string"), ["bad"], rest="ok")
    labels = {r.item: r.label == "bad" for r in got.items.collect()}
    right = sum(labels[i] == t for i, t in truth.items())
    majority = sum((sum(x == "bad" for j, _, x in rows if j == i) > 3) == t for i, t in truth.items())
    assert right >= 0.93 * len(truth) > majority
    trust = {r.annotator: r.reliability for r in got.annotators.collect()}
    assert trust["good"] > 0.7 and abs(trust["guess"]) < 0.25 and trust["liar"] < -0.4


def test_several_classes(spark):
    rnd = random.Random(3)
    rows = [(k, a, "abc"[k % 3] if rnd.random() < r else rnd.choice("abc")) for k in range(120) for a, r in (("x", 0.9), ("y", 0.85), ("z", 0.8), ("w", 0.1))]
    got = consensus(spark.createDataFrame(rows, "item long, annotator string, label string"), ["a", "b", "c"]).items.collect()
    assert len(got) == 120 and sum(r.label == "abc"[r.item % 3] for r in got) > 108


def test_empty_ties_and_nulls(spark):
    schema = "item string, annotator string, label string, at double"
    rows = [("i", "a", "bad", 1.0), ("i", "a", "ok", 2.0), ("i", "a", "ok", 2.0), ("i", "b", None, 9.0), (None, "b", "ok", 1.0), ("i", None, "ok", 1.0), ("j", "a", "bad", None), ("j", "a", "ok", 0.0)]
    got = {(r.item, r.annotator, r.label) for r in latest_labels(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("i", "a", "ok"), ("j", "a", "ok")}
    none = consensus(spark.createDataFrame([], "item string, annotator string, label string"), ["bad"], rest="ok")
    assert none.items.count() == 0 and none.annotators.count() == 0
    tie = spark.createDataFrame([("i", "a", "bad"), ("i", "b", "ok")], "item string, annotator string, label string")
    assert [r.label for r in consensus(tie, ["bad"], rest="ok").items.collect()] == ["ok"]
    assert agreement(tie.limit(0)).first().alpha is None


def test_spellings_of_the_project_tables(spark):
    pairs = spark.createDataFrame([("C1", "p", "R", "f", "m", "x")], "pair_id string, project string, req_id string, file string, method_name string, verdict string")
    verdicts = spark.createDataFrame(
        [("Ｐ1", "p", "R", "f", "m", "一致", 1.0), (" p1", "p", "R", "f", "m", "DEFECTIVE ", 3.0), ("P2", "p", "R", "f", "m", "unsure", 3.0), ("P3", "q", "R", "f", "m", "defective", 3.0)],
        "participant string, project string, req_id string, file string, method_name string, verdict string, end_time double",
    )
    second = spark.createDataFrame([("A", "C1", False, None), ("B", "C1", None, None)], "annotator string, pair_id string, consistent boolean, generated_at timestamp")
    got = {(r.item, r.annotator, r.label) for r in pair_labels(pairs, verdicts, second).collect()}
    assert got == {("C1", "participant:P1", "defective"), ("C1", "second:a", "defective")}


def test_alpha_by_hand(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y"), (3, "a", "y"), (3, "b", "y"), (4, "a", "y")]
    r = agreement(spark.createDataFrame(rows, "item long, annotator string, label string")).first()
    assert (r["items"], r["labels"]) == (3, 6) and abs(r.observed - 4 / 6) < 1e-9 and abs(r.alpha - (1 - (1 / 3) / (18 / 30))) < 1e-9


def test_many_annotators_take_the_shuffled_join(spark, monkeypatch):
    from loomwright.llm import consensus as module

    _, rows = votes(seed=5, items=60)
    labels = spark.createDataFrame(rows, "item string, annotator string, label string")
    want = {r.item: r.label for r in consensus(labels, ["bad"], rest="ok").items.collect()}
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert {r.item: r.label for r in consensus(labels, ["bad"], rest="ok").items.collect()} == want


def test_settles_or_says_so(spark):
    rows = [(f"i{i}", f"a{a}", "bad" if (i + a) % 3 else "good") for i in range(30) for a in range(4)]
    labels = spark.createDataFrame(rows, "item string, annotator string, label string")
    with pytest.raises(RuntimeError, match="still change"):
        consensus(labels, ["bad"], rest="good", tolerance=0.0, max_rounds=1)


def by_hand(rows, bad, rounds):
    """The messages by their definition, edge by edge."""
    says = {(i, a): float(x == bad) for i, a, x in rows}
    of_item, of_one = {}, {}
    for i, a in says:
        of_item.setdefault(i, []).append(a)
        of_one.setdefault(a, []).append(i)
    logistic = lambda x: 1 / (1 + math.exp(-x))
    sign = {e: 2 * x - 1 for e, x in says.items()}
    told = {(i, a): logistic(sum(sign[i, o] for o in of_item[i] if o != a)) for i, a in says}
    belief = {i: logistic(sum(sign[i, o] for o in of_item[i])) for i in of_item}
    for _ in range(rounds):
        weight, share = {}, sum(belief[i] for i, _ in says) / len(says)
        for i, a in says:
            others = [j for j in of_one[a] if j != i]
            p, n = sum(told[j, a] for j in others), sum(1 - told[j, a] for j in others)
            tp, tn = sum(told[j, a] * says[j, a] for j in others), sum((1 - told[j, a]) * (1 - says[j, a]) for j in others)
            sens, spec = (tp + 2) / (p + 3), (tn + 2) / (n + 3)
            weight[i, a] = math.log(sens / (1 - spec)) if says[i, a] else math.log((1 - sens) / spec)
        prior = math.log(share / (1 - share))
        total = {i: sum(weight[i, a] for a in of_item[i]) + prior for i in of_item}
        told = {(i, a): logistic(total[i] - weight[i, a]) for i, a in says}
        belief = {i: logistic(x) for i, x in total.items()}
    return belief


def test_one_item_with_a_third_of_all_labels(spark):
    """A hot item and a busy annotator, as by the definition."""
    rows = [("hot", f"a{a}", "bad" if a % 5 else "good") for a in range(60)] + [(f"i{i}", "busy", "bad" if i % 2 else "good") for i in range(60)]
    rows += [(f"i{i}", f"a{(i + k) % 60}", "bad" if i % 2 else "good") for i in range(60) for k in range(2)]
    got = consensus(spark.createDataFrame(rows, "item string, annotator string, label string"), ["bad"], rest="good")
    wanted = by_hand(rows, "bad", got.rounds)
    seen = {r.item: r.belief if r.label == "bad" else 1 - r.belief for r in got.items.collect()}
    assert seen.keys() == wanted.keys() and all(abs(seen[i] - wanted[i]) < 1e-6 for i in wanted)
