import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import forms as f


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＡＢ１，", "AB1,"), ("é", "é"), ("口", "⼝"), ("a​b⁠﻿\xad", "ab"), ("a　b", "a b"), ("a\xa0b c", "a b c"), ("Раура", "Paypa"), ("Ο", "O"), ("⺼", "月"), ("ﬁ", "fi"), ("‍👩", "👩")],
)
def test_same_skeleton(a, b):
    assert f.skeleton(a) == f.skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("a b", "ab"), ("a b", "a  b"), (",", ";"), ("“", '"'), ("e", "é"), ("月", "日")])
def test_other_skeleton(a, b):
    assert f.skeleton(a) != f.skeleton(b)


def test_nulls_and_empties():
    assert f.skeleton(None) is None and f.plain(None) is None
    assert f.skeleton("") == "" and f.plain("。 ，") == ""
    codes, starts = f.plain_codes([None, "", "。"])
    assert len(codes) == 0 and starts.tolist() == [0, 0, 0, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12) | st.text("ＡａéöＯОο口⼝，。 ab1​́𠮷😀", max_size=12), max_size=6))
def test_tables_agree_with_strings(texts):
    codes, starts = f.plain_codes(texts)
    got = ["".join(map(chr, codes[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [f.plain(t) for t in texts] == got


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_forms_are_idempotent(text):
    assert f.skeleton(f.skeleton(text)) == f.skeleton(text)
    assert f.plain(f.plain(text)) == f.plain(text)


@given(st.text("abcd", min_size=1, max_size=60), st.integers(1, 20))
def test_window_hashes_tell_equal_windows(text, n):
    codes, _ = f.to_codes([text])
    h = f.window_hashes(codes, n)
    windows = [text[i : i + n] for i in range(len(text) - n + 1)]
    assert len(h) == len(windows) and len(set(h.tolist())) == len(set(windows))


def test_long_text():
    text = "长" * 200_000 + "é"
    codes, starts = f.plain_codes([text, "x"])
    assert starts.tolist() == [0, 200_001, 200_002]
    assert codes.dtype == np.uint32
    assert unicodedata.normalize("NFC", "é") == chr(codes[200_000])
