"""The pN_found queries on small tables against brute force and by cases."""

import random
import unicodedata
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import p1_cross_split as p1
from corpusloom.llm import p2_near_duplicates as p2
from corpusloom.llm import p3_pairs as p3
from corpusloom.llm import p4_confusables as p4
from corpusloom.llm import p5_ledger as p5
from corpusloom.llm import p6_leaks as p6
from corpusloom.llm.components import components
from corpusloom.llm.forms import plain
from corpusloom.llm.likeness import jaccard

ALPHABET = "头晕乏力口干睡食欲下降记录观察温水饭后散步医师咨询一二三四五六七八九十上中大小左右前后里外"


def text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def edited(rng, t, k):
    for _ in range(k):
        i = rng.randrange(len(t))
        t = t[:i] + text(rng, 2) + t[i + rng.randrange(3) :]
    return t


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def pool():
    rng = random.Random(4)
    out = []
    for i in range(60):
        base = text(rng, rng.randrange(60, 140))
        out += [base, edited(rng, base, 2), edited(rng, base, 4)] if i % 2 else [base]
    out += [out[0]] * 40 + ["，".join(out[3]), out[3].upper(), "短句", "短句", "", None, "。，"]
    return out


def test_p1(spark, tables, pool, t0):
    splits = ["train", "train", "development", "heldout", "train", None]
    rows = [(i, "s", splits[i % 6], t, None, None, t0) for i, t in enumerate(pool)]
    chats = [(1000 + i, splits[i % 6], "s", [("system", "x"), ("human", t)]) for i, t in enumerate(pool)] + [(5000, "train", "s", None), (5001, "heldout", "s", [])]
    d = tables(qa_records=rows + rows[:7], chat_samples=chats)
    want = set()
    for tbl, off in (("qa_records", 0), ("chat_samples", 1000)):
        for i, a in enumerate(pool):
            for j in range(i + 1, len(pool)):
                s = {splits[i % 6], splits[j % 6]}
                if "train" in s and s & {"development", "heldout"} and jaccard(plain(a or ""), plain(pool[j] or "")) >= 0.6:
                    want.add((tbl, off + i, off + j))
    assert pairs(p1.p1_found(spark, d)) == want
    report = p1.p1_report(spark, d).collect()
    assert {r["split"] for r in report} == {"development", "heldout"}
    for tbl, off in (("qa_records", 0), ("chat_samples", 1000)):
        kept = [(splits[i % 6], plain(t or "")) for i, t in enumerate(pool) if plain(t or "")]
        train = {t for s, t in kept if s == "train"}
        for split in ("development", "heldout"):
            own = [t for s, t in kept if s == split]
            r = next(r for r in report if r["tbl"] == tbl and r["split"] == split)
            shares = [covered(t, train) for t in own]
            linked = [sum(t == x or jaccard(t, x) >= 0.6 for x in train) for t in own]
            assert (r["records"], r["leaked"], r["train_texts"]) == (len(own), sum(n > 0 for n in linked), sum(linked))
            assert r["contained"] == sum(x >= 0.8 for x in shares) and r["mean_coverage"] == pytest.approx(sum(shares) / len(own), abs=1e-6)


def covered(text, train):
    inside = [False] * len(text)
    for k in range(len(text) - p1.SPAN + 1):
        if any(text[k : k + p1.SPAN] in t for t in train):
            inside[k : k + p1.SPAN] = [True] * p1.SPAN
    return sum(inside) / len(text)


def test_p1_reports_a_text_inside_a_longer_one(spark, tables, t0):
    rng = random.Random(12)
    inner = text(rng, 40)
    d = tables(qa_records=[(1, "s", "heldout", inner, None, None, t0), (2, "s", "train", text(rng, 400) + inner + text(rng, 400), None, None, t0)])
    (r,) = p1.p1_report(spark, d).collect()
    assert (r["records"], r["leaked"], r["contained"], r["mean_coverage"]) == (1, 0, 1, 1.0)


def test_p1_cuts_large_intervals_into_cells(spark, tables, pool, t0, monkeypatch):
    rows = [(i, "s", ("train", "heldout")[i % 2], t, None, None, t0) for i, t in enumerate(pool)]
    d = tables(qa_records=rows)
    want = pairs(p1.p1_found(spark, d))
    for name, value in (("CELL", 3), ("EVERY", 1), ("PART", 50), ("TASK", 50)):
        monkeypatch.setattr(p1, name, value)
    texts, _ = p1.representatives(p1.split_texts(spark, d))
    none = np.zeros(0, np.int64)
    counts = spark.sparkContext.broadcast(p1.run_counts(texts))
    heads, sides = p1.large_intervals(texts.mapInPandas(p1.rare_suffixes(counts, none, (none, none), 0.6), p1.RARE))
    assert len(heads) and sides.max() > 1
    assert pairs(p1.p1_found(spark, d)) == want and want


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(1, 9), max_size=40))
def test_intervals_are_never_cut(keys, sizes):
    df = pd.DataFrame({"k": np.sort(np.array(keys, np.int64)), "kind": 2})
    batches, at = [], 0
    for n in [*sizes, len(df)]:
        batches.append(df[at : at + n])
        at += n
    out = list(p1.intervals(iter(batches), "k", "kind"))
    assert [x for d, _ in out for x in d["k"]] == sorted(keys)
    assert all((number == np.unique(d["k"], return_inverse=True)[1]).all() for d, number in out)
    seen = [set(d["k"]) for d, _ in out]
    assert sum(map(len, seen)) == len(set(keys))


def test_p1_of_short_texts(spark, tables, t0):
    rng = random.Random(9)
    bases = [text(rng, n) for n in range(3, 61) for _ in range(2)]
    texts = [*bases, *(t + "外" for t in bases), *(t[: len(t) // 2] + "丙" + t[len(t) // 2 + 1 :] for t in bases)]
    texts += ["".join("丁" if k in (8, 18) else c for k, c in enumerate(t)) for t in bases if len(t) > 20]
    texts += ["".join(c + "戊" if k % 9 == 8 else c for k, c in enumerate(t)) for t in bases if len(t) > 40]
    texts += [bases[40] * 6, bases[-1] + text(rng, 30), "一二" * 60, "一二" * 2]
    side = [rng.random() < 0.5 for _ in texts]
    d = tables(qa_records=[(i, "s", "train" if s else "heldout", t, None, None, t0) for i, (s, t) in enumerate(zip(side, texts, strict=True))])
    want = {("qa_records", i, j) for j in range(len(texts)) for i in range(j) if side[i] != side[j] and jaccard(texts[i], texts[j]) >= 0.6}
    assert len(want) > 150
    assert pairs(p1.p1_found(spark, d)) == want


def test_p2(spark, tables, pool, t0):
    rows = [(i, "s", None, t, None if i % 7 == 0 else "答", None, t0) for i, t in enumerate(pool)]
    d = tables(qa_records=rows + rows[:9])
    full = [plain(r[3] or "") + plain(r[4] or "") for r in rows]
    want = {(i, j) for i in range(len(full)) for j in range(i + 1, len(full)) if jaccard(full[i], full[j]) >= 0.6 or full[i] == full[j] != ""}
    assert pairs(p2.p2_found(spark, d)) == want
    found, members = p2.near_duplicates(p2.qa_records(spark, d), exact=True)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    assert {tuple(sorted((rep[a], rep[b]))) for a, b in want if rep[a] != rep[b]} == pairs(found.select("a", "b"))
    groups = {r["id"]: r["group_id"] for r in p2.p2_groups(spark, d).collect()}
    assert set(groups) == {x for p in want for x in p}
    assert all(groups[a] == groups[b] for a, b in want)


def test_p2_cuts_large_anchors_into_cells(spark, monkeypatch):
    rng = random.Random(3)
    base = text(rng, 200)
    rows = [(i, edited(rng, base, 3), "答" + str(i)) for i in range(40)] + [(100, "短", None), (101, None, "短"), (102, "。", None), (103, "", "。")]
    df = spark.createDataFrame(rows, "id long, query string, response string")
    whole = pairs(p2.near_duplicates(df)[0].select("a", "b"))
    monkeypatch.setattr(p2, "CELL", 4)
    monkeypatch.setattr(p2, "EVERY", 1)
    found, members = p2.near_duplicates(df)
    assert pairs(found.select("a", "b")) == whole and len(whole) > 100
    assert {tuple(r) for r in members.where("id >= 100").collect()} == {(100, 100), (101, 100)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 150)} == {100} and len(got) == 90
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


Q = "头晕已经三天了，口干明显。该怎么办？"
CASES = [
    (Q, None, "empty"),
    (Q, " ​\n", "empty"),
    (Q, "回答：", "empty"),
    (Q, "N/A", "empty"),
    (Q, "{}", "empty"),
    (Q, "问题：头晕已经三天了 口干明显 该怎么办", "copied_question"),
    (Q, Q + Q, "copied_question"),
    (Q, "您问的是：" + Q + "请先观察舌面颜色，留意睡眠。", None),
    (Q, "抱歉，我无法回答这个问题，还望理解。", "refusal"),
    (Q, "I'm sorry, but I am unable to answer this.", "refusal"),
    (Q, "不便直接判断病名，平时要观察睡眠，先看趋势再说。", None),
    (Q, "Drink warm water and rest well before the next visit.", "other_language"),
    (Q, "この症状はしばらく様子を見てください。", "other_language"),
    ("What should I do about a cough?", "请多喝温水，注意休息。", "other_language"),
    (Q, "Emvira 的说明请带来核对，过敏者避开。", None),
    (Q, "请观察睡眠。（原文：Drink small cup", "truncated"),
    (Q, "请观察睡眠。欢迎继续描述（原文：Drink small cups of water.）", None),
    (Q, "请观察睡眠，平时要注意肩颈保", "truncated"),
    (Q, "请观察饮食，", "truncated"),
    (Q, "1.请观察睡眠。2.注意饮食。3.", "truncated"),
    (Q, "请观察睡眠。希望对您有帮助", None),
    (Q, "手腕；鼻翼；后颈", None),
    ("3+7=?", "10", None),
    (None, "请观察睡眠。", None),
    (Q, unicodedata.normalize("NFD", "찬 음식은 당분간 피하세요. 식사 후 변화를 살펴보세요."), "other_language"),
    ("头疼", "头疼。", "copied_question"),
    ("头疼", "头疼可先休息。", None),
]


@pytest.mark.parametrize(("question", "answer", "kind"), CASES)
def test_defect_of_one_pair(question, answer, kind):
    assert p3.defect(question, answer) == kind


def test_a_wordy_refusal():
    assert p3.is_refusal("抱歉，我无法回答这个问题，还望理解。" * 24)
    assert not p3.is_refusal("抱歉，我无法回答这个问题，还望理解。" * 24 + "请先观察舌面颜色。")


def test_p3(spark, tables, t0):
    rows = [(i, "s", None, q, a, None, t0) for i, (q, a, _) in enumerate(CASES)]
    whole = "请先观察舌面颜色，留意睡眠，记录每晚入睡钟点，再看趋势"
    rows += [(100, "s", None, Q, whole + "。", None, t0), (101, "s", None, Q, whole, None, t0), (102, "s", None, Q, whole[:-4], None, t0)]
    d = tables(qa_records=rows + rows[:5])
    want = {("qa_records", i, k) for i, (_, _, k) in enumerate(CASES) if k} | {("qa_records", 102, "truncated")}
    assert pairs(p3.p3_found(spark, d)) == want
    judged = {r["row_id"]: r for r in p3.broken_pairs(p3.pairs(spark, d)).collect()}
    assert judged[102]["shortened"] and judged[102]["defect"] == "truncated"


def test_p3_finds_by_the_sort_what_the_rules_hold_for_whole(spark, tables, t0, monkeypatch):
    whole = "请先观察舌面颜色，留意睡眠，再看趋势。"
    long_list = "苍盘芝、朱岚芝、岭筋实、雪穗芝"
    cases = [(1, Q, whole), (2, Q, "请先观察舌"), (3, "别的问题是什么", "请先观察舌"), (4, "部位", "手腕；脚跟；舌尖"), (5, "部位", "手腕；脚"), (6, "部位", "手腕；脚跟"), (7, "药", long_list), (8, "另问", long_list[:-1]), (9, "另问二", long_list[:-4])]
    assert [p3.defect(q, a) for _, q, a in cases] == [None] * len(cases)
    d = tables(qa_records=[(i, "s", None, q, a, None, t0) for i, q, a in cases])
    want = {("qa_records", i, "truncated") for i in (2, 5, 8)}
    assert pairs(p3.p3_found(spark, d)) == want
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:  # a range for every text
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert pairs(p3.p3_found(spark, d)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_p3_of_answers_at_a_length_limit(spark, tables, t0):
    rng = random.Random(5)
    rows = [(i, "s", None, Q, text(rng, 20) + "。" + text(rng, 7) + "。" + text(rng, 20 + i % 9) + "。", None, t0) for i in range(90)]
    rows += [(100 + i, "s", None, Q, text(rng, 111) + "。希望对您有帮助", None, t0) for i in range(12)]
    rows += [(200 + i, "s", None, Q, text(rng, 30 + i) + "。希望对您有帮助", None, t0) for i in range(12)]
    assert pairs(p3.p3_found(spark, tables(qa_records=rows))) == {("qa_records", 100 + i, "truncated") for i in range(12)}


@given(st.lists(st.tuples(st.text("手腕；。", min_size=1, max_size=5), st.booleans()), max_size=30))
def test_continuations_of_one_range(items):
    texts = dict(items)
    df = pd.DataFrame(sorted((0, t, u) for t, u in texts.items()), columns=["scope", "text", "unclosed"])
    out = pd.concat(list(p3.follow(iter([df[:7], df[7:]]))))
    want = {}
    for t, u in texts.items():
        if u:
            want[t] = 0
            for other in texts:
                if other != t and other.startswith(t):
                    want[t] |= p3.goes_on(t, other)
    assert dict(zip(out["text"], out["seen"], strict=True)) == want


def test_p4(spark, tables, t0):
    qs = ["Ａ口干，", "A⼝干,", "A口干,", "a口干,", "A 口干,", None, "x", "x", "", "​"]
    api = [(100, "A口干,"), (101, "A​口干，"), (102, None)]
    d = tables(qa_records=[(i, "s", None, q, "r", None, t0) for i, q in enumerate(qs)], api_requests=api + api)
    same = [(0, "Ａ口干，"), (1, "A⼝干,"), (2, "A口干,"), (100, "A口干,"), (101, "A​口干，")]
    want = {(a, b) for a, x in same for b, y in same if a < b and x != y} | {(8, 9)}
    assert pairs(p4.p4_found(spark, d)) == want
    forms = {r["id"]: r["form"] for r in p4.p4_forms(spark, d).collect()}
    assert forms[0] == forms[101] and forms[5] is None and len(forms) == 13


def test_p5(spark, tables, t0):
    qa = [(5, "Q. A", "r1"), (3, "q a。", "R1"), (9, "qa", "r 1"), (4, "qa", None), (6, "qa", None), (7, "qa", "other"), (8, None, "r1"), (2, None, "r1")]
    raw = [(20, '{"query":"a","turns":4}'), (21, '{ "turns" : 4 , "query":"A。"}'), (22, '{"query":"a","turns":5}'), (23, "[1]"), (24, "[1]"), (25, "null"), (26, None), (27, '{"query":"a"'), (28, '{"query":"a"'), (29, '{"turns":-4,"query":"a"}')]
    rows = [(i, "s", None, q, r, None, t0.replace(year=2024 + i % 3)) for i, q, r in qa]
    d = tables(qa_records=rows + rows[:3], raw_records=[(i, p, t0) for i, p in raw])
    assert pairs(p5.p5_found(spark, d)) == {(3, 5), (3, 9), (2, 8), (20, 21)}
    copies = {r["id"]: r["copies"] for r in p5.p5_collapsed(spark, d).collect()}
    assert copies == {3: 3, 7: 1, 2: 2, 20: 2, 22: 1, 29: 1}


def test_p5_ledger_in_batches_equals_one(spark, tmp_path):
    rows = [(k % 5, k % 3, 100 - k) for k in range(40)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, id long")
    whole, parts = p5.Ledger(spark, str(tmp_path / "a"), 4), p5.Ledger(spark, str(tmp_path / "b"), 4)
    whole.update(df)
    for i in range(3):
        parts.update(df.where(f"id % 3 = {i}"))
    assert sorted(map(tuple, whole.read().collect())) == sorted(map(tuple, parts.read().collect()))
    parts.update(df.where("false"))
    assert p5.Ledger(spark, str(tmp_path / "c")).read().count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_p6(spark, tables, bits):
    rng = random.Random(9)
    items = [text(rng, 100) for _ in range(12)] + [text(rng, 59), None, ""]
    docs = [None, "", "短"]
    for i in range(40):
        t = text(rng, 300)
        if i % 3 == 0:
            t = t[:100] + items[i % 12][i % 30 : i % 30 + 55 + i % 11] + t[100:]
        if i % 5 == 0:
            t += "，".join(items[(i + 1) % 12])
        docs.append(t)
    prompts = [(900, "heldout", [("system", "x" * 80), ("user", items[0] + "尾")]), (901, "train", [("user", items[1])])]
    d = tables(documents=[(i, t, None) for i, t in enumerate(docs)], test_results=[(500 + i, "p", t, "g") for i, t in enumerate(items)], prompt_messages=prompts)
    want = set()
    for i, t in enumerate(docs):
        p = plain(t or "")
        for j, it in [*((500 + k, x) for k, x in enumerate(items)), (900, items[0] + "尾")]:
            q = plain(it or "")
            if any(q[k : k + 60] in p for k in range(len(q) - 59)):
                want.add((i, j))
    got = p6.leaks(p6.table(spark, d, "documents"), p6.test_items(spark, d), bits=bits)
    assert pairs(got.select("doc_id", "item_id")) == want and want
    assert {r["doc_id"] for r in p6.p6_clean(spark, d).collect()} == set(range(len(docs))) - {a for a, _ in want}
    cleaned = {r["doc_id"]: r for r in p6.p6_clean_spans(spark, d).collect()}
    assert set(cleaned) == set(range(len(docs)))
    held = [plain(x or "") for x in [*items, items[0] + "尾"]]
    for i, t in enumerate(docs):
        r, p = cleaned[i], plain(t or "")
        bad = [any(p[k : k + 60] in q for q in held) for k in range(len(p) - 59)]
        keep = [c for k, c in enumerate(p) if not any(bad[max(0, k - 59) : k + 1])]
        assert plain(r["text"] or "") == "".join(keep) and (r["removed"] > 0) == (i in {a for a, _ in want})
        assert (r["text"] is None) == (t is None) and r["removed"] == len(t or "") - len(r["text"] or "")


def test_spans_leave_the_text_around_them():
    t = "a é。" + "舌面  颜色，" * 3 + "e\u0301 尾"
    places = p6.plain_places(t)
    assert len(places) == len(plain(t)) and t[slice(*places[-2])] == "e\u0301"
    assert p6.without_spans(t, [2, 3], 10) == "a é。色，e\u0301 尾"
    assert p6.without_spans(t, [], 10) == t and p6.without_spans(t, [0, 8], 8) == "  "


def scanned(texts, threshold=0.6):
    """Pairs that the scan of the sparse array of [(kind, plain)] leaves to the comparison; rep is the place, all runs count as equally rare."""
    df = pd.DataFrame({"kind": [k for k, _ in texts], "rep": range(len(texts)), "plain": [t for _, t in texts]})
    counts, none = np.zeros(p1.BUCKETS, np.int64), np.zeros(0, np.int64)
    array = pd.concat(p1.rare_suffixes(SimpleNamespace(value=counts), none, (none, none), threshold)([df])).sort_values(["part", "k1", "cell", "kind"])
    return {(r.rep_eval, r.rep_train) for part in p1.shared_spans(threshold)([array[:1000], array[1000:]]) for r in part.itertuples()}


@pytest.mark.parametrize("dense", [0, 4096])
def test_p1_scan_leaves_few_unlike_pairs(monkeypatch, dense):
    """texts of 100 runs with 40 in common are a quarter alike; the copies with an edit are found in pairs and in rectangles."""
    monkeypatch.setattr(p1, "DENSE", dense, raising=False)
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    word = lambda n: "".join(letters[j] for j in rng.integers(0, 3000, n))
    head = word(42)
    train = [head + word(60) for _ in range(150)]
    texts = [(0, t) for t in train] + [(1, head + word(60)) for _ in range(150)] + [(1, t[:50] + "一" + t[51:]) for t in train[:40]] + [(1, train[0][:70])]
    met = scanned(texts)
    alike = {(i, j) for i, (a, x) in enumerate(texts) for j, (b, y) in enumerate(texts) if a and not b and jaccard(x, y) >= 0.6}
    assert alike <= met and len(alike) == 41
    assert len(met - alike) < 300


@pytest.mark.parametrize("query", [p1.p1_found, p1.p1_report, p2.p2_found, p2.p2_groups, p3.p3_found, p3.p3_report, p4.p4_found, p4.p4_forms, p5.p5_found, p5.p5_collapsed, p6.p6_found, p6.p6_clean, p6.p6_clean_spans])
def test_empty_tables(spark, tables, query):
    assert query(spark, tables()).count() == 0


def test_p1_with_a_stock_phrase(spark, tables, t0):
    """Half of all texts share a long phrase; pairs that depend on it alone are still found."""
    rng = random.Random(8)
    phrase = text(rng, 80)
    texts = [phrase + text(rng, 10 if i % 3 else 90) for i in range(60)] + [text(rng, 90) for _ in range(60)]
    rows = [(i, "s", "train" if i % 2 else "heldout", t, None, None, t0) for i, t in enumerate(texts)]
    want = {("qa_records", i, j) for i in range(120) for j in range(i + 1, 120) if (i + j) % 2 and jaccard(texts[i], texts[j]) >= 0.6}
    assert len(want) > 100
    assert pairs(p1.p1_found(spark, tables(qa_records=rows))) == want


def test_p1_with_few_stock_runs(spark, tables, t0):
    """Pairs whose only common runs of 10 are stock, and few of their entries, are found on small and large pools."""
    rng = random.Random(11)
    phrase = text(rng, 20)
    texts = []
    for n, marks in ((60, (20, 30, 40, 50)), (130, range(20, 130, 10))):
        for _ in range(6):
            base = phrase + text(rng, n - 20)
            texts += [base, "".join("丁" if k in marks else c for k, c in enumerate(base))]
    texts += [phrase + text(rng, 130) for _ in range(100)] + [phrase + text(rng, 70) for _ in range(4400)]
    for some in (texts[:124], texts):
        d = tables(qa_records=[(i, "s", "train" if i % 2 else "heldout", t, None, None, t0) for i, t in enumerate(some)])
        want = {("qa_records", i, i + 1) for i in range(0, 24, 2) if jaccard(texts[i], texts[i + 1]) >= 0.6}
        assert len(want) >= 6
        assert pairs(p1.p1_found(spark, d)) == want
