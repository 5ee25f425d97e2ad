import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import conversation as C
from corpusloom.functions import hashing as H
from corpusloom.functions import jsonx as J
from corpusloom.functions import metrics as M
from corpusloom.functions import rules as R
from corpusloom.functions import similarity as S

TURNS = "t array<struct<`from`:string,value:string>>"


def one(spark, value, column, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "error"), [('{"a":1}', None), ('{"a":1,"a":2}', "duplicate_key"), ('{"a":{"b":1,"b":2}}', "duplicate_key"), ('{"a":1} x', "trailing_data"), ("{", "invalid_json"), ("", "invalid_json"), (None, "not_a_string")])
def test_strict(text, error):
    assert J.strict_error(text) == error


ASK = '{"action":"ask","stage":"initial","complete":false,"questions":["a"]}'
SUM = '{"action":"summarize","stage":"summary","complete":true,"key_findings":["x"],"syndrome_tendency":"t","need_more_info":[],"note":"n"}'


@pytest.mark.parametrize(
    ("text", "error"),
    [(ASK, None), (SUM, None), (ASK.replace("false", '"false"'), "complete"), (ASK.replace("false", "0"), "complete"), (ASK.replace('["a"]', "[]"), "questions"), (ASK.replace('["a"]', '["a","a"]'), "questions"), (ASK.replace('["a"]', '["a","b","c","d"]'), "questions"), (ASK.replace("}", ',"x":1}'), "fields"), (SUM.replace('"note":"n"', '"note":" "'), "note"), ("[]", "not_an_object"), (ASK.replace("initial", "x"), "label")],
)
def test_contract(text, error):
    assert J.contract_error(text) == error


@pytest.mark.parametrize(
    ("raw", "action"),
    [('{"action":"diagnose"}', None), ("这不是JSON", None), ('{"action":"summarize"}', "summarize"), ('说明文字 {"action":"summarize"}', None), ('{"action":"ask", broken', "ask")],
)
def test_closed_action(spark, raw, action):
    assert one(spark, raw, J.closed_action(F.col("t"))) == action


@pytest.mark.parametrize(
    ("user", "raw", "found"),
    [("口干，夜里容易醒。", '{"action":"summarize","key_findings":["口干","夜里容易醒","阴虚"]}', ["口干", "夜里容易醒"]), ("大便偏稀，最近频率增加。", '{"key_findings":["大便偏稀","大便偏稀","最近频率增加"]}', ["大便偏稀", "最近频率增加"]), ("我只写了这一段原文。", '{"key_findings":["别的"]}', ["我只写了这一段原文。"])],
)
def test_literal_findings(spark, user, raw, found):
    df = spark.createDataFrame([(user, raw)], "u string, r string")
    assert df.select(J.literal_findings(F.col("u"), F.col("r")).alias("x")).first()["x"] == found


def test_lenient():
    assert J.lenient_object('a ```json\n{"b":1}\n``` c') == '{"b":1}'
    assert J.lenient_object("none") is None


def test_questions():
    assert J.normalize_questions('[{"question":" a "},"b","",{"x":1},"c","d"]') == ["a", "b", "c"]
    assert J.normalize_questions("plain") == ["plain"]
    assert J.normalize_questions(None) == []


def test_hmac(spark):
    want = hmac.new(b"k", "消息".encode(), hashlib.sha256).hexdigest()
    assert one(spark, "消息", H.hmac_sha256(b"k", F.col("t"))) == want


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), ([], ["a"], 0.0), (["a"], ["a"], 1.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(S.jaccard(F.col("a"), F.col("b")).alias("x")).first()["x"] == pytest.approx(want)


def test_dialogs(spark):
    turns = [("system", "s"), ("human", "a"), ("human", "b"), ("gpt", "c"), ("odd", "x"), ("human", "d"), ("gpt", "e")]
    s = one(spark, turns, C.eval_sample(F.col("t")), TURNS)
    assert (s["system"], [h["value"] for h in s["history"]], s["target"]) == ("s", ["a", "c", "d"], "e")
    assert one(spark, [("human", "a"), ("gpt", "b"), ("odd", "x"), ("human", "c"), ("gpt", "d")], C.dialog_pairs(F.col("t")), TURNS) == ["a", "b"]
    assert one(spark, [("human", "a")], C.dialog_pairs(F.col("t")), TURNS) is None


def test_masked(spark):
    x = spark.createDataFrame([([1, 2, 3], [4, 5])], "s array<int>, t array<int>").select(C.masked_example(F.col("s"), F.col("t"), 10, 0).alias("x")).first()["x"]
    assert (x["input_ids"], x["labels"]) == ([1, 2, 3, 4, 5, 0], [-100, -100, -100, 4, 5, 0])


def test_blocks(spark):
    rows = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [4, 5]), (2, 1, [9])], "b int, o int, ids array<int>")
    got = {(r["b"], r["block"]): r["ids"] for r in C.pack_blocks(rows, "b", "o", "ids", 2).collect()}
    assert got == {(1, 0): [1, 2], (1, 1): [3, 4], (2, 0): [9]}


@pytest.mark.parametrize(
    ("text", "route"),
    [("胸前突然疼得很明显，呼吸也很费劲。", "urgent"), ("刚才突然呕出了一大口血。", "urgent"), ("现在呼吸极度困难，几乎喘不上来。", "urgent"), ("最近总心慌，同时容易眩晕。", "refer"), ("最近有点口干，但没有胸痛，也没有呼吸困难。", None), ("偶尔胃口不好，没有吐血，也没有便血。", None), (None, None)],
)
def test_warning_route(spark, text, route):
    assert one(spark, text, R.warning_route(R.concept_states(R.WARNING_CONCEPTS)("t"))) == route


def test_bleu():
    x = list("abcd")
    assert M.bleu(x, x, 4) == pytest.approx(1.0)
    assert M.bleu(x, list("xyz"), 1) == 0.0
    assert M.bleu(list("abcdef"), list("abc"), 1) == pytest.approx(2.718281828459045 ** (1 - 2))


def test_rouge_and_meteor():
    assert M.lcs(list("abcbdab"), list("bdcaba")) == 4
    assert M.rouge_l(list("ab"), list("abcd")) == pytest.approx(2 / 3)
    assert M.rouge_l(M.tokens("中文", "ascii"), M.tokens("中文", "ascii")) == 0.0
    assert M.meteor(list("abc"), list("abc")) == pytest.approx(1 - 0.5 / 27)
    assert M.meteor([], list("a")) == 0.0


def test_rewards():
    assert M.accuracy_reward("<answer> 1,000 </answer>", "1000") == 1.0
    assert M.accuracy_reward("x", "y") == 0.0
    assert M.accuracy_reward(None, None) == 0.0
