import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import automaton as A
from loomwright.llm.automaton import DEFAULT_PATH, MergeAutomaton, load_tokenizer
from loomwright.llm.packing import SumOfSquares, merge_plan, pack_sizes, packing_report
from loomwright.llm.tokens import count_tokens, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    from loomwright.llm.automaton import PRE_SPLIT

    with open(DEFAULT_PATH.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\r\tabcdeorst'0129,.;-_中文的是检查かな한글éßñ😀<|>"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60))
def test_same_as_library(library, text):
    ids = load_tokenizer().encode(text)
    assert ids == library.encode_ordinary(text)
    assert load_tokenizer().automaton.decode(ids) == text


def test_special_strings_are_text(library):
    text = "a<|endoftext|>b"
    assert load_tokenizer().encode(text) == library.encode_ordinary(text)
    assert 50256 not in load_tokenizer().encode(text)


def test_repeated_bytes(library):
    for n in range(1, 70):
        for c in (" ", "a", "-", "é", "="):
            assert load_tokenizer().encode(c * n) == library.encode_ordinary(c * n)


def by_merges(word, ranks):
    """Byte-pair encoding by its definition: the merges in order of rank, each from left to right."""
    parts = [bytes([x]) for x in word]
    for a, b in ranks:
        out = []
        for p in parts:
            if out and out[-1] == a and p == b:
                out[-1] = a + b
                merged = True
            else:
                out.append(p)
                merged = False
            if merged:  # what was just made is not merged again by the same merge
                out.append(b"")
        parts = [p for p in out if p]
    return parts


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_gadgets_on_made_up_merges(data):
    """Also tokens that no word is encoded with, since an earlier merge cuts their path."""
    pieces, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(0, 9))):
        a, b = data.draw(st.sampled_from(pieces)), data.draw(st.sampled_from(pieces))
        if a + b not in pieces and len(a + b) < 12:
            pieces.append(a + b)
            merges.append((a, b))
    automaton = MergeAutomaton({p: i for i, p in enumerate(pieces)}, merges)
    for word in data.draw(st.lists(st.text("abc", min_size=1, max_size=14), max_size=8)):
        got = [automaton.label[i] for i in automaton.encode_word(word.encode())]
        assert got == by_merges(word.encode(), merges)


def test_tables_start_afresh(library, monkeypatch):
    monkeypatch.setattr(A, "STATE_ENTRIES", 5)
    monkeypatch.setattr(A, "ARC_ENTRIES", 3)
    monkeypatch.setattr(A, "WORD_ENTRIES", 2)
    load_tokenizer.cache_clear()
    text = "The requirement was checked twice, 检查数量 and again: unbelievable " * 3
    assert load_tokenizer().encode(text) == library.encode_ordinary(text)
    load_tokenizer.cache_clear()


def test_states_are_shared_and_few(library):
    one = load_tokenizer().automaton
    one._reset()
    one.encode_word(b"interesting")
    n = len(one.states)
    one.encode_word(b"interesting")
    assert len(one.states) == n <= 1 + len("interesting")
    assert all(s.next for s in one.states.values() if s.context == b"")


def test_corpus_edge_cases(spark, library):
    long = "检查数量 value 12 " * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, long, "x"), (4, long, "x"), (5, "﻿a\r\nb", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(docs).collect())
    assert got == sorted((i, library.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert {(r.doc_id, r.n_tokens) for r in count_tokens(docs).collect()} == {(i, len(x)) for i, x in got}
    assert encode_corpus(docs.limit(0)).count() == 0


def brute_force(sizes, capacity):
    """The rule by its definition: try each level and add up all squares."""
    levels, boxes, out = [], [], []
    cost = lambda fills: sum(fills.count(h) ** 2 for h in set(fills) if h < capacity)
    for s in sizes:
        options = [(cost(levels + [s]), 1, 0, None)]
        for h in sorted(set(levels)):
            if h + s <= capacity:
                i = max(k for k, x in enumerate(levels) if x == h)
                options.append((cost(levels[:i] + levels[i + 1 :] + [h + s]), 0, h, i))
        best = min(options, key=lambda o: o[:3])
        if best[3] is None:
            levels.append(s)
        else:
            levels[best[3]] += s
        out.append(sorted(levels))
    return out[-1] if out else []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_rule(sizes):
    packer, fill = SumOfSquares(12), {}
    for s in sizes:
        box = packer.place(s)
        fill[box] = fill.get(box, 0) + s
    assert sorted(fill.values()) == brute_force(sizes, 12)


def test_packing_whole(spark):
    rows = [(i, n) for i, n in enumerate([None, 0, 5, 10, 11, 25, 3, 3, 7, 1, 30, 2] * 40)] + [(7, 3), (7, 3)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    for per in (1000, 60):
        packed = pack_sizes(sizes, capacity=10, items_per_packer=per).collect()
        fill, pieces = {}, {}
        for r in packed:
            fill[r.container] = fill.get(r.container, 0) + r.length
            pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        assert max(fill.values()) <= 10
        assert sum(fill.values()) == sum(n or 0 for _, n in rows)
        for i, n in rows[:480]:
            if n and i != 7:
                assert sorted(pieces[i]) == [(s, min(10, n - s)) for s in range(0, n, 10)]
        assert i not in pieces or rows[0][0] not in pieces
        assert pieces[7] == [(0, 3)] * 3
        assert len(fill) <= sum(fill.values()) / 10 * 1.1
    assert pack_sizes(sizes.limit(0)).count() == 0
    assert packing_report(pack_sizes(sizes, capacity=10), 10).first().containers >= 1


def filled(packed):
    fill = {}
    for r in packed.collect():
        fill.setdefault(r.container, []).append(r.length)
    return fill


@pytest.mark.parametrize(
    "lengths, per, capacity, most",
    [
        ([1100] * 200, 50, 2048, 200),  # none fills a container, none fits beside another
        ([1024] * 200, 50, 2048, 100),  # all fill exactly
        ([700] * 201, 50, 2048, 101),
        ([1100, 900] * 101, 40, 2048, 126),  # within a quarter of the least number
        ([7] * 50 + [3] * 50, 50, 10, 50),
        ([5], 1, 10, 1),
        ([5, 5], 1, 10, 1),
        ([10] * 9, 2, 10, 9),
        (list(range(1, 101)), 100, 101, 62),  # as many items as one packer takes
        (list(range(1, 102)), 100, 101, 63),  # and one more
    ],
)
def test_packing_ends(spark, lengths, per, capacity, most):
    sizes = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    fill = filled(pack_sizes(sizes, capacity=capacity, items_per_packer=per))
    assert sorted(x for xs in fill.values() for x in xs) == sorted(lengths)
    assert max(map(sum, fill.values())) <= capacity
    assert len(fill) <= most


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 19), st.integers(1, 50)))
def test_merge_plan(counts):
    boxes, seen = {}, set()
    for level, first, number, group in merge_plan(counts, 20):
        for i in range(number):
            assert (level, first + i) not in seen
            seen.add((level, first + i))
            boxes[group + i] = boxes.get(group + i, 0) + level
    assert seen == {(h, i) for h, n in counts.items() for i in range(n)}
    assert all(x <= 20 for x in boxes.values())
