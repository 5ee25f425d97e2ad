"""Encoding against a public implementation; packing and splitting by their invariants."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import p7_encoding as p7
from corpusloom.llm import p8_packing as p8
from corpusloom.llm import p9_splitting as p9
from corpusloom.llm.bpe import DEFAULT_RANKS, PrefixTable, encoder, vocabulary

pytestmark = pytest.mark.skipif(not Path(DEFAULT_RANKS).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(DEFAULT_RANKS).with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a", "Hello  world\n\n don't <|endoftext|>", "头晕三天，口干。", "x" * 5000, "长" * 3000, "👩‍👩‍👧 é é \x7f\x00", "1234567 890", " \n \n", "ａ１　𠮷㎎"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding(reference, text):
    assert encoder().encode(text).tolist() == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encoding_of_anything(text):
    from tokenizers import Tokenizer

    global _tok
    if "_tok" not in globals():
        _tok = Tokenizer.from_file(str(Path(DEFAULT_RANKS).with_name("byte_bpe_50k.json")))
        _tok.encode_special_tokens = True
    assert encoder().encode(text).tolist() == _tok.encode(text, add_special_tokens=False).ids


@settings(deadline=None)
@given(st.text("abc d 头晕", min_size=1, max_size=20), st.text("abc 晕", max_size=8), st.integers(0, 30), st.integers(0, 6))
def test_append_and_edit_equal_a_new_table(word, more, at, drop):
    v = vocabulary()
    table = PrefixTable(v, word.encode())
    table.append(more.encode())
    whole = (word + more).encode()
    assert table.tokens() == PrefixTable(v, whole).tokens() == v.merged(whole)
    at = min(at, len(whole))
    table.edit(at, drop, more.encode())
    assert table.tokens() == v.merged(whole[:at] + more.encode() + whole[at + drop :])


def test_p7(spark, tables, reference):
    docs = [(i, t, None) for i, t in enumerate([*TEXTS, None])]
    got = {r["doc_id"]: list(r["ids"]) for r in p7.p7_ids(spark, tables(documents=docs)).collect()}
    assert got == {i: reference(t or "") for i, t, _ in docs}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=9, max_size=9))
def test_plan_uses_up_the_histogram(counts):
    histogram = np.array([0, *counts])
    plan = p8.plan_patterns(histogram, 9)
    used = Counter()
    for need, n in plan:
        assert sum(k * c for k, c in need.items()) <= 9
        for k, c in need.items():
            used[k] += n * c
    assert all(used[k] == histogram[k] for k in range(1, 10))
    lower = -(-sum(k * c for k, c in enumerate(histogram)) // 9)
    assert lower <= sum(n for _, n in plan) <= 1.6 * lower + 4


def test_nnls_fits():
    rng = np.random.default_rng(1)
    a = rng.random((20, 8))
    x = np.maximum(rng.normal(size=8), 0)
    assert np.allclose(p8.nnls(a, a @ x), x, atol=1e-5)


def test_p8(spark, tables, reference):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("头晕三天，口干。\n abc") for _ in range(rng.choice([0, 1, 9, 60, 200, 900]))), None) for i in range(150)] + [(1000, None, None), (1001, "", None)]
    limits = [(1, 64, 0), (2, 512, 32), (3, 5, 0)]
    rows = p8.p8_containers(spark, tables(documents=docs, token_limits=limits)).collect()
    size = {i: len(reference(t or "")) for i, t, _ in docs}
    for limit, capacity, _ in limits:
        own = [r for r in rows if r["limit_id"] == limit]
        per_doc, per_container, pieces = Counter(), Counter(), Counter()
        for r in own:
            per_doc[r["doc_id"]] += r["tokens"]
            per_container[r["container"]] += r["tokens"]
            pieces[r["doc_id"]] += 1
        assert max(per_container.values()) <= capacity
        assert all(per_doc[i] == n and pieces[i] >= 1 for i, n in size.items())
        assert all(pieces[i] == 1 for i, n in size.items() if n <= capacity)
        rooms: list[int] = []  # first fit, largest first
        for n in sorted((n % capacity if n > capacity else n for n in size.values()), reverse=True):
            k = next((k for k, left in enumerate(rooms) if left >= n), None)
            if k is None:
                rooms.append(capacity)
                k = len(rooms) - 1
            rooms[k] -= n
        full = sum(n // capacity for n in size.values() if n > capacity)
        assert len([v for v in per_container.values() if v]) <= 1.08 * (len(rooms) + full) + 1
    assert p8.p8_containers(spark, tables(token_limits=limits)).count() == 0


def test_p9(spark, tables, reference):
    rng = random.Random(3)
    sentence = ["头晕已经三天了。", "口干，多梦；", "Take a rest. ", "\n", "\n\n", "一二三四五六七八九十", "x" * 30, "   "]
    docs = [(i, "".join(rng.choice(sentence) for _ in range(rng.randrange(200))), None) for i in range(30)] + [(100, "长" * 4000, None), (101, None, None), (102, "", None), (103, " " * 5000, None), (104, "a" * 3000, None)]
    limits = [(1, 64, 0), (2, 100, 16), (3, 256, 64)]
    rows = sorted(p9.p9_pieces(spark, tables(documents=docs, token_limits=limits)).collect(), key=lambda r: (r["limit_id"], r["doc_id"], r["piece"]))
    text = {i: t for i, t, _ in docs}
    assert {(r["limit_id"], r["doc_id"]) for r in rows} == {(k, i) for k, c, _ in limits for i, t in text.items() if len(reference(t or "")) > c}
    by_limit = {k: (c, o) for k, c, o in limits}
    before = None
    for r in rows:
        capacity, overlap = by_limit[r["limit_id"]]
        t = text[r["doc_id"]]
        assert r["text"] == t[r["start"] : r["stop"]] and r["tokens"] == len(reference(r["text"])) <= capacity
        assert len(reference(t[r["start"] : r["own"]])) <= overlap
        if r["piece"] == 0:
            assert r["start"] == r["own"] == 0
        else:
            assert before["stop"] == r["own"] and (r["start"] < r["own"] or not overlap)
        before = r
    last = [r for r, n in zip(rows, [*rows[1:], None], strict=True) if n is None or n["piece"] == 0]
    assert all(r["stop"] == len(text[r["doc_id"]]) for r in last)


def test_p9_prefers_strong_boundaries(spark, tables):
    part = "口干多梦，" * 12
    docs = [(1, part + "。\n\n" + part + "。", None)]
    rows = p9.p9_pieces(spark, tables(documents=docs, token_limits=[(1, 190, 0)])).collect()
    assert sorted(r["stop"] for r in rows)[0] == len(part) + 3
    with pytest.raises(ValueError, match="overlap"):
        p9.split_documents(spark.createDataFrame([], "doc_id long, text string"), [(1, 10, 10)])
