import json
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import dedup, evaluation, selection, simjoin
from corpusloom.sources import readers, writers
from corpusloom.streaming import sessions, slots


def grams(t, n=3):
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} if t else set()


def brute(texts, threshold):
    out = {}
    for (i, a), (j, b) in combinations(sorted(texts.items()), 2):
        x, y = grams(a), grams(b)
        if x and y and (s := len(x & y) / len(x | y)) >= threshold - 1e-12:
            out[i, j] = round(s, 9)
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abc", max_size=9), min_size=2, max_size=24), st.sampled_from([0.3, 0.6, 0.9]))
def test_jaccard_join_is_exact(spark, words, threshold):
    texts = dict(enumerate(words))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in simjoin.jaccard_join(df, None, threshold, 3).collect()}
    assert got == brute(texts, threshold)


def shuffled(spark, run):
    """Result of ``run`` and the bytes that its stages shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, quantiles, None)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)


def alike_in_part(count, head):
    """Texts that share their head only."""
    rng = np.random.default_rng(7)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    return [(i, head + "".join(letters[j] for j in rng.integers(0, 3000, 8))) for i in range(count)]


def test_candidates_are_decided_where_they_meet(spark):
    """600 texts of likeness 0.4 make 179,700 candidates, which are not shuffled."""
    df = spark.createDataFrame([*alike_in_part(600, "常与什么同放的药材"), (900, "甲乙丙丁"), (901, "甲乙丙丁")], "id long, text string")
    rows, size = shuffled(spark, lambda: simjoin.jaccard_join(df, None, 0.45, 3).collect())
    assert {(r["a"], r["b"]): round(r["score"], 9) for r in rows} == brute({r["id"]: r["text"] for r in df.collect()}, 0.45)
    assert size < 700_000  # 1,389,528 with shuffled candidates


def test_pairs_of_copies_are_counted_not_made(spark):
    """1,000 copies of two like texts have 1,999,000 pairs."""
    df = spark.createDataFrame([(i, "甲乙丙丁戊己" + "庚" * (i % 2)) for i in range(2000)], "id long, text string")
    (n, size) = shuffled(spark, lambda: simjoin.pair_summary(df, 0.5).first())
    assert (n["pairs"], n["best"]) == (1_999_000, 1.0) and size < 500_000
    best, size = shuffled(spark, lambda: simjoin.overall_best(simjoin.first_pairs(df, 0.5)).first())
    assert tuple(best) == (0, 2, 1.0) and size < 500_000


def test_large_intervals_are_cut_into_cells(monkeypatch):
    """Every pair of a gram in a grid of cells meets in one cell once, within a side and between sides."""
    monkeypatch.setattr(simjoin, "CELL", 10)
    gram, own = np.full(45, 7), np.arange(45)
    often = np.full(simjoin.BUCKETS, 45)
    for self_join in (True, False):
        side = np.zeros(45, np.int64) if self_join else own % 2
        at, cell, lot = simjoin.celled(gram, own, side, self_join, often)
        order = np.argsort(cell, kind="stable")
        at, cell, lot = at[order], cell[order], lot[order]
        assert len(np.unique(cell)) > 5
        got = [frozenset((int(at[i]), int(at[j]))) for x, y in simjoin.meetings(simjoin._numbered(cell), np.full(len(at), 4), np.zeros(len(at), np.int64), lot, side[at], self_join, 0.5) for i, j in zip(x, y, strict=True)]
        want = {frozenset(p) for p in combinations(range(45), 2) if self_join or sum(p) % 2}
        assert len(got) == len(want) and set(got) == want


def test_jaccard_join_nulls_and_empties(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, "abc"), (5, "abc")], "id long, text string")
    assert {tuple(r) for r in simjoin.jaccard_join(df, None, 0.5, 3).select("a", "b").collect()} == {(4, 5)}
    assert {tuple(r) for r in simjoin.jaccard_join(df, None, 0.5, 3, empty_pairs=True).select("a", "b").collect()} == {(2, 3), (4, 5)}
    assert simjoin.jaccard_join(df.where("false"), None, 0.5, 3).count() == 0


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "六味地黄丸与地黄"), (2, "黄"), (3, None), (4, "")], "id long, text string")
    names = spark.createDataFrame([("地黄",), ("六味地黄丸",), ("黄",), (None,)], "name string")
    found = simjoin.contains_join(texts, names)
    assert {tuple(r) for r in found.collect()} == {(1, "地黄"), (1, "六味地黄丸")}
    assert [r["name"] for r in simjoin.longest_mentions(found).collect()] == ["六味地黄丸"]
    assert [r["name"] for r in simjoin.maximal_mentions(found).collect()] == ["六味地黄丸"]


def test_keep_first_chain(spark):
    """A conflicts with B, B with C: A and C stay."""
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (3, 5)], "a long, b long")
    got = {r["id"]: (r["kept"], r["by"]) for r in dedup.independent_first(nodes, edges).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 3), 5: (False, 1)}


def test_greedy_quota(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", None), (4, "a", None), (5, "a", "old"), (6, "a", None), (7, "b", None)]
    c = spark.createDataFrame(rows, "id long, category string, rejected string")
    e = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    got = {r["id"]: (r["split"], r["decision"]) for r in selection.greedy_quota(c, e, [("train", "a", 1), ("train", "b", 1), ("dev", "a", 1)]).collect()}
    assert got == {1: ("train", "selected"), 2: got[2], 3: ("train", "selected"), 4: got[4], 5: (None, "old"), 6: ("dev", "selected"), 7: (None, "unused")}
    assert got[2][1] == got[4][1] == "conflict"
    with pytest.raises(ValueError, match="quota"):
        selection.greedy_quota(c, e, [("train", "b", 9)])


def test_greedy_quota_ends_with_its_target(spark, monkeypatch):
    """a chain of 400 conflicts takes no 400 rounds when 8 candidates are asked for."""
    tables = []
    for module in (dedup, selection):
        monkeypatch.setattr(module, "stored", lambda df, name, old=module.stored: tables.append(name) or old(df, name))
    c = spark.range(400).selectExpr("id", "'a' as category", "cast(null as string) as rejected")
    e = spark.range(399).selectExpr("id as a", "id + 1 as b")
    got = {r["id"]: r["decision"] for r in selection.greedy_quota(c, e, [("train", "a", 8)]).collect()}
    assert got == {i: "unused" if i > 14 else "conflict" if i % 2 else "selected" for i in range(400)}
    assert len(tables) < 20


def test_greedy_quota_in_windows_is_sequential(spark, monkeypatch):
    """windows that are decided in turn, on the driver or in rounds, give the sequential choice."""
    rng = np.random.default_rng(3)
    edges = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 400, (4000, 2)).tolist() if a != b} | {(0, i) for i in range(1, 300)}
    kept = []
    for i in range(400):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    target = len(kept)
    c = spark.range(400).selectExpr("id", "'a' as category", "cast(null as string) as rejected")
    e = spark.createDataFrame(sorted(edges), "a long, b long")
    for size in (1024, 0):
        monkeypatch.setattr(selection, "WINDOW", size)
        rows = selection.greedy_quota(c, e, [("train", "a", target)]).where("decision = 'selected'").collect()
        assert sorted(r["id"] for r in rows) == kept


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 0), (2, 1), (3, 1), (12, 2), (13, 3)])
def test_held_out_count(spark, n, want):
    assert spark.range(1).select(selection.held_out_count(F.lit(n).cast("long")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("when_zero", "want"), [(None, None), (0.0, 0.0), (1.0, 1.0)])
def test_rate_of_nothing(spark, when_zero, want):
    assert spark.range(1).select(evaluation.rate(F.lit(0), F.lit(0), when_zero).alias("x")).first()["x"] == want


def test_strict_reader(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n\n{"a":1,"a":2}\n{"a":1} y\n{bad\n', encoding="utf-8")
    got = {r["line"]: r["error"] for r in readers.strict_jsonl_errors(spark, str(p)).collect()}
    assert got == {2: "blank_row", 3: "duplicate_key", 4: "trailing_data", 5: "invalid_json"}
    tolerant = {r["line"]: (r["record"] and r["record"]["a"], r["error"]) for r in readers.tolerant_jsonl(spark, str(p), "a int").collect()}
    assert tolerant[1] == (1, None) and tolerant[5] == (None, "invalid_json") and 2 not in tolerant
    with pytest.raises(ValueError, match="line"):
        readers.strict_jsonl(spark, str(p), "a int")
    with pytest.raises(ValueError, match="jsonl"):
        readers.strict_jsonl(spark, str(tmp_path), "a int")


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1}, 2, "x"]', encoding="utf-8")
    assert [r["item"] for r in readers.json_array(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ['{"a":1}', "{}", "{}"]
    (tmp_path / "t.tsv").write_text("q\ta\nx\ty\n", encoding="utf-8")
    assert readers.delimited(spark, str(tmp_path / "t.tsv"), ["input", "output"]).count() == 2
    (tmp_path / "c.csv").write_text("step,loss\n1,0.5\n2,nan\n", encoding="utf-8")
    with pytest.raises(ValueError, match="finite"):
        readers.curve_csv(spark, str(tmp_path / "c.csv"), ["step", "loss"])
    (tmp_path / "deny.txt").write_text("A" * 64 + "\nshort\n", encoding="utf-8")
    assert [r["digest"] for r in readers.denylist(spark, str(tmp_path / "deny.txt")).collect()] == ["a" * 64]


def test_manifest_and_locks(tmp_path):
    d = tmp_path / "release"
    d.mkdir()
    (d / "b.txt").write_text("b")
    writers.write_json(d / "a.json", {"b": 1, "a": "中"})
    assert (d / "a.json").read_text("utf-8") == json.dumps({"a": "中", "b": 1}, ensure_ascii=False, indent=2) + "\n"
    writers.write_manifest(d)
    assert not any(writers.verify_manifest(d).values())
    writers.promote(d, tmp_path / "frozen")
    (d / "b.txt").write_text("c")
    assert writers.verify_manifest(d)["mismatched"] == ["b.txt"]
    writers.consume_once(tmp_path / "lock")
    with pytest.raises(FileExistsError):
        writers.consume_once(tmp_path / "lock")


def test_write_once(spark, tmp_path):
    writers.write_once(spark.range(3), str(tmp_path / "x"))
    with pytest.raises(Exception, match="exists"):
        writers.write_once(spark.range(3), str(tmp_path / "x"))


KEY = b"k"
MESSAGES = [("s", 1, "我口干。", False), ("s", 2, "已经三天了，每天两次。", False), ("s", 3, "请总结。", False), ("s", 4, "没有其他变化。", False), ("t", 1, " ", False), ("s", 5, "重新开始。", True)]


def test_session_replay(spark):
    df = spark.createDataFrame(MESSAGES, "session_id string, seq long, text string, new_session boolean")
    got = {(r["session_id"], r["seq"]): r for r in sessions.replay(df, KEY).collect()}
    assert got["s", 2]["turn_count"] == 2
    assert got["s", 4]["facts"] == ["我口干", "已经三天了，每天两次", "没有其他变化"]
    assert got["s", 5]["turn_count"] == 1 and got["s", 5]["facts"] == ["重新开始"]
    assert got["t", 1]["status"] == "blank"


def test_session_state_is_signed():
    state, _ = sessions.step(sessions.new_state("s"), "我口干。", False)
    signed = state | {"signature": sessions.sign(KEY, state)}
    assert sessions.restore(KEY, signed, "s") == (state, None)
    assert sessions.restore(KEY, signed | {"facts": ["x"]}, "s")[1] == "invalid_state"
    assert sessions.restore(KEY, signed | {"state_version": "0"}, "s")[1] == "legacy_state_reset"


def test_session_stream_equals_batch(spark, tmp_path):
    schema = "session_id string, seq long, text string, new_session boolean"
    spark.createDataFrame(MESSAGES, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions.stream(sessions.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), KEY)
    run = q.writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = sessions.replay(spark.createDataFrame(MESSAGES, schema), KEY)
    assert sorted(map(str, spark.table("turns").collect())) == sorted(map(str, batch.collect()))


def test_slots():
    s = slots.ask(slots.new_state("s"), ["sleep", "appetite", "stool", "urination"])
    s = slots.bind(slots.begin(s, "x"), "睡得一般，胃口还行，大便偏干，小便正常")
    assert s["facts"]["sleep"] == "睡得一般" and s["facts"]["urination"] == "小便正常" and not s["pending"]
    s = slots.bind(slots.ask(s, ["sweat"]), "不清楚")
    assert s["unknown"] == ["sweat"] and not slots.should_ask(s, "sweat")
    assert slots.snapshot(slots.summarized(s))["unknown"] == ["sweat"]


def test_cosine_blocks_agree(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)], "id long, vec array<double>")
    a = simjoin.cosine_nearest(v, v, 3, same=True, block=7).select("a", "b", "place").collect()
    b = simjoin.cosine_nearest(v, v, 3, same=True, block=1000).select("a", "b", "place").collect()
    assert sorted(a) == sorted(b)


def greedy(texts, threshold):
    kept, out = [], {}
    for i, t in sorted(texts.items()):
        by = next((k for k in kept if t and texts[k] and len(grams(t) & grams(texts[k])) / len(grams(t) | grams(texts[k])) >= threshold - 1e-12), None)
        out[i] = (by is None, by)
        if by is None:
            kept.append(i)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", min_size=1, max_size=7), min_size=2, max_size=20))
def test_near_dedup_texts_is_the_sequential_greedy(spark, words):
    texts = dict(enumerate(words))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert {r["id"]: (r["kept"], r["by"]) for r in dedup.near_dedup_texts(df, 0.5).collect()} == greedy(texts, 0.5)


def test_near_dedup_of_texts_alike_in_part(spark):
    """600 texts of likeness 0.4 make 179,700 candidates, which are not shuffled."""
    df = spark.createDataFrame([*alike_in_part(600, "常与什么同放的药材"), (900, "甲乙丙丁"), (901, "甲乙丙丁")], "id long, text string")
    rows, size = shuffled(spark, lambda: dedup.near_dedup_texts(df, 0.45).collect())
    assert {r["id"]: (r["kept"], r["by"]) for r in rows} == greedy({r["id"]: r["text"] for r in df.collect()}, 0.45)
    assert size < 700_000


def test_near_dedup_does_not_copy_texts_for_their_prefix_grams(spark, monkeypatch):
    """a text of 200 characters met others in all parts of its 80 prefix grams; blocks of texts are held against the table now."""
    rng = np.random.default_rng(3)
    texts = {i: "".join(map(chr, rng.integers(0x4E00, 0x9000, 200))) for i in range(400)}
    texts |= {1000 + i: texts[i][: 200 - i] + "甲乙丙" for i in range(0, 60, 3)} | {2000 + i: texts[i] for i in range(10)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    monkeypatch.setattr(simjoin, "HELD", 20_000)
    rows, size = shuffled(spark, lambda: dedup.near_dedup_texts(df, 0.6).collect())
    assert {r["id"]: (r["kept"], r["by"]) for r in rows} == greedy(texts, 0.6)
    counted = shuffled(spark, lambda: simjoin.gram_counts(df, 3, "whole"))[1]
    assert size - counted < 3 * sum(len(t.encode()) for t in texts.values())


@pytest.mark.parametrize(("held", "against"), [(15, 1), (10**6, 10**6)])
def test_distinct_pairs_over_blocks(spark, monkeypatch, held, against):
    """pairs within a block and across blocks, once each, short texts too."""
    texts = dict(enumerate(dict.fromkeys(["ab", "a", "b", "abcabc", "abcab", "abcabd", "xabcab", "abcdefgh", "abcdefghi", "bcdefghi", "zzzz", "zzzzz"])))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    monkeypatch.setattr(simjoin, "HELD", held)
    monkeypatch.setattr(simjoin, "AGAINST", against)
    for threshold in (0.3, 0.6):
        got = [(r["a"], r["b"]) for r in simjoin.distinct_pairs(df, threshold).collect()]
        assert sorted(got) == sorted(brute(texts, threshold))


def test_near_dedup_texts_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "abc"), (5, "abc")], "id long, text string")
    assert {r["id"]: (r["kept"], r["by"]) for r in dedup.near_dedup_texts(df, 0.5).collect()} == {1: (True, None), 2: (True, None), 3: (True, None), 4: (True, None), 5: (False, 4)}


def test_markdown_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc")], "id long, t string")
    assert writers.markdown_table(df) == "| id | t |\n|---|---|\n| 1 | a\\|b<br>c |\n"
    with pytest.raises(ValueError, match="aggregates"):
        writers.markdown_table(spark.range(5), most=4)
    writers.write_csv(df, str(tmp_path / "c"), ["t", "id"])
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).columns == ["t", "id"]


def test_documents_are_extracted(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("一\n\n二\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("# 题\n- [链](http://x) **粗**", encoding="utf-8")
    (tmp_path / "c.html").write_text("<p>x&amp;y</p><script>no()</script>", encoding="utf-8")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>段一</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>段二</w:t></w:r></w:p></w:body></w:document>')
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.extract_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "一\n二", "b.md": "题\n链 粗", "c.html": "x&y", "d.pdf": None, "e.docx": "段一\n段二"}
    assert readers.join_broken_lines(["一句", "话。", "尾"]) == ["一句话。", "尾"]


def test_numbered_lines_over_several_splits(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("".join(f"{i}\n" for i in range(1, 2001)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.numbered_lines(spark, str(p)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2000 and all(int(r["value"]) == r["line"] for r in rows)


def test_nearest_of_another_label_behind_many_of_its_own(spark, tmp_path):
    from corpusloom.plans import catalog

    rows = [(i, "hot", [1.0, i / 1000]) for i in range(300)] + [(300, "rare", [0.1, 0.0]), (301, None, [9.0, 9.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["a"]: r["b"] for r in catalog.queries()["agg_07_nearest"](spark, str(tmp_path)).collect()}
    assert got == {a: 300 for a in range(0, 300, 50)} | {300: 0}


def _leak_rows():
    answer = "请先观察舌面颜色留意睡眠记录每晚入睡钟点再看趋势平时注意饮食清淡少油少盐多走动"
    q = "头晕已经三天了口干明显该怎么办才好呢需要看医生吗"
    texts = [(q, "甲"), (q[:-1] + "乙", answer + answer), ("", answer), (None, answer), ("无关的问题", None), ("丙" + q[1:], "丁"), ("另一段很长的话与它们没有一点关系", answer), (q, answer)]
    return [(i, a, None if a is None or b is None else a + "␟" + b) for i, (a, b) in enumerate(texts)]


def _near(a, b, n, threshold):
    x, y = ({t[i : i + n] for i in range(max(1, len(t) - n + 1))} for t in (a or "", b or ""))
    return bool(a and b) and len(x & y) / len(x | y) >= threshold


def test_leaks_by_query_or_pair(spark):
    rows = _leak_rows()
    answer = rows[2][2][1:]
    left = [(100 + i, a, p) for i, a, p in rows] + [(200, "头痛已经三天", "头痛已经三天␟" + answer * 2), (201, "", "␟" + answer), (202, "", "␟别的")]
    right = rows + [(9, "头晕已经三天", "头晕已经三天␟" + answer * 2)]
    schema = "id long, query_norm string, pair_norm string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    hit = lambda x, y, n: (x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2] == y[2]) or _near(x[1], y[1], n, 0.9) or _near(x[2], y[2], n, 0.9)
    got = {r["id"] for r in dedup.leaked(a, b, 0.9, 0.9, 5).collect()}
    assert got == {x[0] for x in left if any(hit(x, y, 5) for y in right)} and 200 in got
    right = [r for r in right if r[1] != ""]  # an empty query, found by its pair only
    right.append((10, "x", "␟" + answer))
    got = {r["id"] for r in dedup.leaked(a, spark.createDataFrame(right, schema), 0.9, 0.9, 5).collect()}
    assert got == {x[0] for x in left if any(hit(x, y, 5) for y in right)} and 201 in got and 202 not in got


def test_overlap_counts_over_whole_texts(spark):
    rows = _leak_rows()
    long = rows[0][1] * 4
    right = [*rows, (20, long, long + "␟甲"), (21, long, long + "␟甲"), (22, long[:40] + "别" * 60, "x␟y")]
    left = [(100 + i, a, p) for i, a, p in rows] + [(120, "改" + long[1:], long + "␟甲"), (121, long[:30] + "末" * 90, "末␟末"), (122, "z", long + "␟甲"), (123, long + "改", "w␟w")]
    want = {"exact_query": 0, "exact_pair": 0, "near_query": 0, "near_pair": 0, "any_match": 0}
    for x in left:
        query = any(x[1] is not None and x[1] == y[1] for y in right)
        want["exact_query"] += query
        want["exact_pair"] += not query and any(x[2] is not None and x[2] == y[2] for y in right)
        for y in sorted(right):
            q, p = _near(x[1], y[1], 3, 0.95), _near(x[2], y[2], 3, 0.9)
            if q or p:
                want["near_query"] += q
                want["near_pair"] += p
                want["any_match"] += 1
                break
    schema = "id long, query_norm string, pair_norm string"
    got = dedup.overlap_counts(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.95, 0.9, 3).collect()
    assert [r.asDict() for r in got] == [want] and want["near_query"] and want["near_pair"] > want["near_query"] - want["any_match"]


def _long_rows(copies):
    """Two splits of rows of 300 characters each, and every row again."""
    rng = np.random.default_rng(11)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    texts = ["".join(letters[j] for j in rng.integers(0, 5000, 300)) for _ in range(400)]
    return [(i, t, t + "␟" + t[::-1]) for i, t in enumerate(texts)] * copies


def test_texts_without_a_like_one_are_not_shuffled(spark):
    """F3, F7, F8: texts of 400 rows, none like another; only prefix grams, hashes and candidates move (5.3 MB with texts and grams)."""
    schema = "id long, query_norm string, pair_norm string"
    rows = [*_long_rows(1), *_long_rows(1)[:5]]  # five rows are redelivered
    df = spark.createDataFrame(rows, schema).repartition(2).persist()
    df.count()
    a, b = df.where("id < 200"), df.where("id >= 200")
    got, size = shuffled(spark, lambda: dedup.leaked(a, b, 0.9, 0.9, 5).collect())
    assert got == [] and size < 4_000_000
    got, size = shuffled(spark, lambda: dedup.overlap_counts(a, b, 0.95, 0.9, 3).first())
    assert tuple(got) == (0, 0, 0, 0, 0) and size < 4_000_000
    got, size = shuffled(spark, lambda: dedup.exact_then_near(df, 0.95, 0.9, 3).collect())
    assert sorted((r["id"], r["kept"], r["by"]) for r in got) == [(i, True, None) for i in range(400)] and size < 4_000_000


def test_exact_then_near_is_the_sequential_greedy(spark):
    """first by query, of these first by pair, then keep-first by either likeness."""
    base = "头晕已经三天了，下午更明显，想问一下平时要注意哪些情况，还需要补充什么信息。" * 2
    answer = "请先记录发作的时间、持续多久、有没有别的不适，再到门诊详细说明。" * 3
    cut = lambda t, i, c: t[:i] + c + t[i + 1 :]
    rows = [(1, base, base + "␟" + answer), (2, base, "x␟y"), (3, cut(base, 0, "改"), "x␟y"), (4, "另一个问题", cut(base, 0, "改") + "␟" + answer), (5, "又一个问题", "又一个问题␟" + answer), (6, "再一个问题", "又一个问题␟" + answer), (7, "", "␟甲"), (8, "乙", "乙␟" + cut(answer, 3, "丙"))]
    seen_q, seen_p, once = set(), set(), []
    for r in rows:
        if r[1] not in seen_q:
            seen_q.add(r[1])
            once.append(r)
    once = [r for r in once if r[2] not in seen_p and not seen_p.add(r[2])]
    kept, want = [], {}
    for r in once:
        by = next((k[0] for k in kept if _near(r[1], k[1], 3, 0.95) or _near(r[2], k[2], 3, 0.9)), None)
        want[r[0]] = (by is None, by)
        if by is None:
            kept.append(r)
    df = spark.createDataFrame(rows + rows[:3], "id long, query_norm string, pair_norm string")
    assert {r["id"]: (r["kept"], r["by"]) for r in dedup.exact_then_near(df, 0.95, 0.9, 3).collect()} == want
    assert any(not k for k, _ in want.values())


def test_vector_index_on_clusters_and_without_rows(spark):
    from corpusloom.operators import index, simjoin

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    vectors = centers[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    made = index.build_index(df)
    assert made.rows.count() == 1500 and made.probes < len(made.centroids) / 2
    asked = df.where("id % 10 = 0")
    assert index.recall(index.search(made, asked, 5), simjoin.cosine_nearest(asked, df, 5, same=True)) >= 0.9
    every = index.search(made, asked, 5, len(made.centroids))
    assert index.recall(every, simjoin.cosine_nearest(asked, df, 5, same=True)) == 1.0
    empty = index.build_index(df.where("vec is null"))
    assert index.search(empty, asked, 5).count() == 0


def test_slot_machine_equals_the_fold(spark):
    from corpusloom.streaming import slots

    said = [("a", 1, "头晕"), ("a", 2, "睡得不好，胃口不清楚"), ("a", 3, "稍后"), ("a", 4, None), ("b", 2, "三天"), ("b", 1, ""), (None, 1, "x")]
    got = {(r["session_id"], r["seq"]): r for r in slots.replay(spark.createDataFrame(said, "session_id string, seq long, text string")).collect()}
    assert set(got) == {(s, n) for s, n, _ in said if s}
    for sid in "ab":
        state = slots.new_state(sid)
        for _, seq, text in sorted(x for x in said if x[0] == sid):
            state = slots.turn(state, text or "")
            r = got[(sid, seq)]
            assert (r["filled"], r["unknown"], r["deferred"], r["pending"]) == (sum(map(bool, state["facts"].values())), len(state["unknown"]), len(state["deferred"]), len(state["pending"]))


def test_slices_and_thresholds_by_rank(spark):
    from corpusloom.operators import selection
    from corpusloom.sources import readers

    df = spark.range(0, 997).select("id", (F.col("id") % 3).alias("kind"))
    for percent in (0, 0.05, 1, 37.5, 100):
        got = [r["id"] for r in readers.slice_percent(df, [F.desc("id")], percent).collect()]
        assert sorted(got, reverse=True) == list(range(996, 996 - int(997 * percent / 100), -1))
        part = selection.exact_validation(df, "id", percent)
        assert part.where("part = 'validation'").count() == -(-997 * percent // 100)
    split = selection.stratified_split(df.unionByName(spark.createDataFrame([(2000, None), (2001, None), (2002, 9)], "id long, kind long")), "kind", "id")
    counts = {(r["kind"], r["part"]): r["n"] for r in split.groupBy("kind", "part").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "heldout"): 67, (0, "train"): 266, (1, "heldout"): 66, (1, "train"): 266, (2, "heldout"): 66, (2, "train"): 266, (None, "heldout"): 1, (None, "train"): 1, (9, "train"): 1}
