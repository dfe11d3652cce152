import random

import numpy as np

from loomwright.llm import residue as R
from loomwright.llm.residue import find_residue, without_residue

NOUNS = ["order", "invoice", "storage bin", "return slip", "access card", "shift plan"]
SENTENCES = [
    "The check for the {} misses the equal sign and must be repeated.",
    "Users can search every {} by number, date and state.",
    "Deleting a {} only sets a mark and keeps the history.",
    "提交{}之前，系统应检查数量是否超出范围。",
    "列表中的{}默认按更新时间倒序排列，空值排在最后。",
]
TRAPS = [
    "The template engine must replace {{orderNo}} and ${amount} before mail 3 is sent.",
    "通知模板里的 {{userName}} 在发送前必须换成收件人称呼，缺值时取消发送。",
    "With scripts disabled, the start page shows the notice “Please enable JavaScript” for 4 seconds.",
    "A request for a missing slip shall be answered with 404 Not Found within 20 ms.",
    "The route is /api/slips/{id}/lines and returns at most 7 lines.",
    "```\nrun.sh --input ${INPUT_DIR}\n```",
    "2026-01-02 03:04:05 ERROR [x] HTTP 503 from model gateway, waiting 3s",
    "Error handling",
]
CASES = [
    "Author: {{author}}",
    "版本: 【待填写】",
    "Users can search every {0} by number, date and state.",
    "提交${name}之前，系统应检查数量是否超出范围。",
    "Lorem ipsum dolor sit amet, consectetur elit.",
    "HTTP Status 503 – Service Unavailable",
    "请启用 JavaScript 后再查看本页面。",
    "示例文字示例文字示例文字示例文字",
    "You do not have permission to open this document.",
    "Traceback (most recent call last):\n  File \"x.py\", line 3, in run\nTimeoutError: timed out",
]


def corpus():
    rnd = random.Random(4)
    rows, truth = [], set()
    for i in range(600):
        parts = ["# " + rnd.choice(NOUNS), "Author: P1"] + [rnd.choice(SENTENCES).format(rnd.choice(NOUNS)) for _ in range(rnd.randint(2, 5))]
        if rnd.random() < 0.3:
            parts.insert(rnd.randint(2, len(parts)), rnd.choice(TRAPS))
        elif rnd.random() < 0.2:
            parts.insert(rnd.randint(2, len(parts)), rnd.choice(CASES))
            truth.add(i)
        rows.append((i, rnd.choice(["\n", "\r\n"]).join(parts), "x"))
    return rows, truth


def test_found(spark):
    rows, truth = corpus()
    extra = [(9001, None, "x"), (9002, "", "x"), (9003, " \n\t", "x"), (9004, "Deleting a {{thing}} only sets a mark and keeps the history. " * 2000, "x"), (9005, CASES[0], "x"), (9005, CASES[0], "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, sort string")
    got = find_residue(docs)
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == got.count() and 9004 in found and 9005 in found and not {9001, 9002, 9003} & set(found)
    ids = set(found) - {9004, 9005}
    assert len(ids & truth) >= 0.97 * len(truth), [rows[i][1] for i in truth - ids][:3]
    assert len(ids - truth) <= 0.03 * len(truth), [rows[i][1] for i in ids - truth][:3]
    assert {r.sort for r in found.values()} >= {"placeholder", "filler", "error", "script"}
    assert without_residue(docs, got).count() == len(rows) + 6 - len(found) - 1
    assert max(r.score for r in found.values()) <= 1 and sum(r.score < 1 for r in found.values()) > 0.2 * len(found)


def copies(rows, times):
    return [(k * 1_000_000 + i, text, sort) for k in range(times) for i, text, sort in rows]


def test_ten_times_the_corpus(spark):
    """Shares do not depend on the size of the corpus, so neither does what is found."""
    rows, _ = corpus()
    rows = rows[:200]
    found = [{r.doc_id for r in find_residue(spark.createDataFrame(x, "doc_id long, text string, sort string")).collect()} for x in (rows, copies(rows, 10))]
    assert found[1] == {k * 1_000_000 + i for k in range(10) for i in found[0]}


def test_model_finds_what_no_wording_names(spark, monkeypatch):
    """With part of the trusted wordings withheld, the model finds such passages by their words, and a label alone decides
    nothing."""
    pages = ["Service unavailable, please try again later.", "The service is unavailable, please try again later.", "This service was unavailable. Please try later again."]
    rows, _ = corpus()
    rows = rows[:300] + [(5000 + i, pages[i % 2], "x") for i in range(40)] + [(6000 + i, pages[2], "x") for i in range(5)]
    monkeypatch.setattr(R, "_TRUSTED", [("error", R.re.compile(r"^service unavailable,|^the service is unavailable"))])
    found = {r.doc_id: r for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string, sort string")).collect()}
    assert {6000, 6001, 6002, 6003, 6004} <= set(found) and found[6000].sort == "passage"


def test_context_filter_is_exact():
    seen = {"the value of the field": 2, "检查数量是否": 3}
    every = np.full(R.LEAST_BITS // 8, 255, dtype=np.uint8)
    none = np.zeros(R.LEAST_BITS // 8, dtype=np.uint8)
    assert len(R._count_contexts(seen, none)[0]) == len(R._count_contexts({}, every)[0]) == 0
    at, n = R._count_contexts(seen, every)
    counts = dict(zip(at.tolist(), n.tolist()))
    for text, left, times in (("the value of ", True, 2), ("检查数量", True, 3), (" the field", False, 2), ("数量是否", False, 3)):
        assert counts[R._side(text, left)] == times


def test_keyboard_mash_and_shapes():
    for text in ("asdf asdf asdf", "foo bar baz foo bar"[:7], "test1 test2", "qwer;zxcv."):
        assert R.trusted(text) == "filler"
    shaped = ["{{a}}", "${x}", "#{x}", "<%= x %>", "{% if x %}", "[[x]]", "@@X@@", "__ABC__", "%ABC%", "{0}", "{name}", "【待填写】", "（此处填写版本号）", "[YOUR NAME]", "[name goes here]", "<<x>>", "<name>", "(tbd)", "(to be defined)", "TBD", "XXXX", "××××", "____", "undefined", "NaN", "[object Object]", "20XX年X月X日", "［待补充：甲］", "<请填写日期>", "<describe the rule>"]
    assert all(R._shaped(f"a {x} b") for x in shaped), [x for x in shaped if not R._shaped(f"a {x} b")]


def test_empty(spark):
    assert find_residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_is_not_looked_at():
    seen = [line for line, _ in R.lines("a “Please enable JavaScript” b\n```\n${x}\n```\n`{{y}}` GET /api/{z}/lines\n《title》")]
    assert not any(R._SHAPE.search(x) for x in seen) and seen[-1] == "title" and "JavaScript" not in seen[0]
    assert [x[:2] for x in R.slots("Owner: {{owner}}")] == [("edge", "edge")]
    assert R.trusted("aaaaaaaaaaaaaaaa") is None and R.trusted("-------------") is None and R.trusted("测试测试测试测试") == "filler"
