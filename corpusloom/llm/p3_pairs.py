"""Problem 3: broken prompt and response pairs, each with its type of defect.

The rules for empty, copied, refusing, foreign and broken-off answers are applied in that order in one
pass.  Then all answers are sorted by their text (skeleton without white space) over ranges, and every
answer that ends without a closing mark is compared with the texts that follow it: those it begins.

* If one of them goes on inside the word, the answer is a shortened version: truncated, also where
  the rules hold it for a list, a figure or a farewell.  Answers of under LONG characters are compared
  with answers to the same question only, since short texts begin others by chance.
* If one of them only adds closing marks, the answer is whole.
* Lengths at which most answers are unclosed, far more of them than at lengths nearby, are length
  limits: the unclosed answers of such a length are truncated.

Texts that an answer at the end of a range begins in later ranges are looked up in a second pass, so the
ranges change nothing.  No answer gets two types.  Null answers are empty; a null question has no
language and is copied by nothing.  Repeats of a record count once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.forms import plain, skeleton, to_codes
from corpusloom.llm.likeness import plain_texts
from corpusloom.llm.sketch import text_key
from corpusloom.llm.tables import stored, table

# Contents that stand for no answer, labels, farewells.
PLACEHOLDERS = frozenset("无 略 空 暂无 没有 待补充 待定 待填 待更新 未填写 未提供 暂缺 缺失 na nan null none nil undefined tbd todo empty br p div blank 答 回答 答复 回复 答案 解答 answer a response reply output 输出 助手 assistant".split())
LABELS = r"(?:您问的是|你问的是|您的问题是|重复问题|复述问题|原问题|问题是|问题|提问|问|question|q|回答|答案|答|answer|a)"
FAREWELLS = frozenset("如有变化随时补充 有不适及时就诊 以上供参考 请以面诊为准 欢迎继续描述 希望对您有帮助 愿您睡得安稳 祝您早日安好 祝您早日康复 祝您健康 祝好 谢谢 仅供参考 以上仅供参考 希望能帮到您 希望对你有帮助".split())

_SUBJECT = r"(?:(?:这个问题|这类话题|此类话题|该话题|这一请求|此请求|关于这个问题|对此|这)){0,2}(?:作为.{0,8}?(?:助手|模型)[，,]?)?(?:我|本助手|本人|小助手|恕我|恕)?"
_DECLINE = r"(?:暂时|现在|目前|实在)?(?:都)?(?:无法|不能|没有办法|没办法|没法|不便|不方便|只能拒绝|必须拒绝|拒绝|婉拒|不参与|不提供|不予|不做|不讨论|超出了?|爱莫能助|帮不上忙)"
_OBJECT = r"(?:.{0,4}(?:回答|作答|回应|解答|协助|提供|讨论|处理|请求|咨询|问题|话题|内容|继续|能力范围|帮助|忙|评论|置评).{0,8})?"
_REFUSAL = re.compile(rf"(?:但是?|不过|可是|然而)?{_SUBJECT}{_DECLINE}{_OBJECT}")
_SUBJECT_SAID = re.compile(r"我|本助手|本人|恕|这类|这个|此类|该话题|请求|话题|这超出|回答|作答|问题|协助")
_COURTESY = re.compile(r"(?:很|非常|十分|实在)?(?:抱歉|对不起|不好意思|遗憾|您好|你好|感谢|谢谢|见谅|谅解|理解)|(?:非常|很)?感谢.{0,6}|(?:还望|请您?|敬请|感谢您?的?|望您?)(?:多多)?(?:理解|谅解|见谅|包涵)|请?(?:您)?(?:换|改).{0,4}(?:话题|问题)|请(?:另寻|寻求).{0,4}帮助|就到这里吧|(?:请)?无法继续|我帮不上忙|谢谢.{0,6}|sorry")
_DECLINES = re.compile(rf"{_DECLINE}|unable|cannot|can't|can not|won't|not able|decline|not allowed|not permitted|refuse", re.I)
_EN_REFUSAL = re.compile(r"\b(?:unable to|cannot|can't|can not|won't be able to|not able to|must decline|have to decline|decline to|not allowed to|not permitted to|refuse to)\b", re.I)
_EN_POLITE = re.compile(r"(?:i'?m |i am |we are )?(?:very |so |really )?(?:sorry|apologies|apologise|apologize|thanks|thank you)\b.{0,40}", re.I)
_CLAUSE = re.compile(r"[。！？!?；;，,、\n\t…—:：]+|\.(?=\s|$)|(?<=[一-鿿]) +")
_SCRIPTS = (("han", re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")), ("kana", re.compile(r"[぀-ヿ]")), ("hangul", re.compile(r"[가-힣]")), ("cyrillic", re.compile(r"[Ѐ-ӿ]")), ("latin", re.compile(r"[A-Za-zÀ-ɏ]+")), ("arabic", re.compile(r"[؀-ۿ]")), ("thai", re.compile(r"[฀-๿]")), ("devanagari", re.compile(r"[ऀ-ॿ]")), ("greek", re.compile(r"[Ͱ-Ͽ]")))
_QUOTED = re.compile(r"[（(][^（）()]*[）)]?|[“\"「『][^”\"」』]*[”\"」』]?")
_CLOSED = re.compile(r"(?:[。！？!?…]|(?<!\d)\.|\.{2,}|[\U0001F300-\U0001FAFF♀-⛿✀-➿])$")
_LIST_NUMBER = re.compile(r"(?:^|[\s。；;！!？?，,.：:])[(（]?(?:\d{1,2}|[一二三四五六七八九十])\s*[.、．)）:：]$")
_OPEN_MARK = re.compile(r"[，,、；;：:（(「『“《〈【\[{\-–/+＋·�&]$")
_PAIRS = {"（": "）", "(": ")", "【": "】", "「": "」", "『": "』", "《": "》", "[": "]", "{": "}", "“": "”"}
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_ITEM = re.compile(r"[；;、，,]")


def language(text: str) -> str | None:
    """Written language of a text by its letters outside quotations; None with hardly a letter."""
    bare = _QUOTED.sub("", unicodedata.normalize("NFKC", text))
    n = {name: len(p.findall(bare)) for name, p in _SCRIPTS}
    if n["kana"] and n["kana"] * 6 >= n["han"]:
        return "ja"
    n["han"] += n.pop("kana")
    name = max(n, key=n.get)
    return name if n[name] >= (4 if name == "latin" else 2) else None


def is_empty(form: str) -> bool:
    return not form or form in PLACEHOLDERS


def is_copy(q: str, a: str) -> bool:
    """Of plain forms: only the question again, perhaps labelled, reformatted or repeated."""
    if not q or q not in a:
        return False
    rest = re.sub(LABELS, "", a.replace(q, ""))
    return len(rest) <= (2 if len(q) > 3 else 0) and not (rest and rest.isdigit())


def is_refusal(answer: str) -> bool:
    """Only declines, in clauses of courtesy and refusal and nothing else."""
    if not _DECLINES.search(answer):
        return False
    if len(re.findall(r"[A-Za-z]", answer)) > len(answer) // 2:
        declines = 0
        for s in re.split(r"[.!?;:]+\s*|,\s+", answer):
            s = s.strip()
            if not s:
                continue
            if _EN_REFUSAL.search(s) and len(s.split()) <= 16:
                declines += 1
            elif not (_EN_POLITE.fullmatch(s) or re.fullmatch(r"(?:but|however|as an? \w+(?: \w+)?|at this time|unfortunately|regrettably|hello|hi|please understand)[\w\s]{0,30}", s, re.I)):
                return False
        return declines > 0
    declines = 0
    for clause in _CLAUSE.split(_INVISIBLE.sub("", answer)):
        clause = clause.strip(" 　\"'“”（）()")
        if not clause:
            continue
        if _COURTESY.fullmatch(clause):
            declines += clause in ("我帮不上忙", "无法继续")
        elif _REFUSAL.fullmatch(clause) and _SUBJECT_SAID.search(clause):
            declines += 1
        else:
            return False
    return declines > 0


def is_foreign(question: str | None, answer: str) -> bool:
    asked, said = language(question or ""), language(answer)
    return asked is not None and said is not None and asked != said


def last_clause(answer: str) -> str:
    return _CLAUSE.split(_INVISIBLE.sub("", answer).strip())[-1].strip()


def is_bare(answer: str) -> bool:
    """A figure, or a list of short items without a clause."""
    if re.fullmatch(r"[\d\s.,:%/+\-]+", answer):
        return True
    items = _ITEM.split(answer)
    return all(0 < len(x.strip()) <= 6 for x in items) and not re.search(r"[。！？]", answer) and (len(items) > 1 or len(answer) <= 6)


def ends_open(answer: str) -> bool:
    """Ends without a closing mark, inside a bracket, or on an item number or a mark that goes on."""
    s = _INVISIBLE.sub("", answer).rstrip()
    if s[-1:] in "。！？!?":  # '' too
        return False
    if _LIST_NUMBER.search(s) and not re.fullmatch(r"[\d\s.,:%/+\-]+", s):
        return True
    if s.endswith("——") and s.count("——") > 2:
        return False
    open_ = [c for c in s if c in _PAIRS]
    if open_:
        depth = []
        for c in s:
            if c in _PAIRS:
                depth.append(_PAIRS[c])
            elif depth and c == depth[-1]:
                depth.pop()
        if depth and (s[-1] in _PAIRS or not _CLOSED.search(s)):
            return True
    s = s.rstrip("\"'”’」』）)】》*_` ")
    return bool(s) and not _CLOSED.search(s)


def is_cut(answer: str) -> bool:
    """Breaks off inside a sentence, clause, word, list or bracket."""
    if not ends_open(answer):
        return False
    s = _INVISIBLE.sub("", answer).strip()
    if _OPEN_MARK.search(s) or _LIST_NUMBER.search(s):
        return True
    stripped = s.rstrip("\"'”’」』）)】》*_` ")
    if is_bare(stripped) or is_bare(s):
        return False
    return last_clause(stripped) not in FAREWELLS


def defect_of(question: str | None, answer: str | None, q: str, a: str, same_script: bool) -> str | None:
    """empty, copied_question, refusal, other_language, truncated, or None; q and a are the plain forms."""
    if is_empty(a):
        return "empty"
    if is_copy(q, a):
        return "copied_question"
    if is_refusal(answer):
        return "refusal"
    if not same_script and is_foreign(question, answer):
        return "other_language"
    return "truncated" if is_cut(answer) else None


def defect(question: str | None, answer: str | None) -> str | None:
    return defect_of(question, answer, plain(question or ""), plain(answer or ""), False)


def mostly_han(texts: list[str | None]) -> np.ndarray:
    """Texts of which most characters are ideographs and none is kana."""
    codes, starts = to_codes([t or "" for t in texts])

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[starts[1:]] - total[starts[:-1]]

    han, kana = count((codes >= 0x4E00) & (codes <= 0x9FFF)), count((codes >= 0x3040) & (codes <= 0x30FF))
    return (han * 2 > np.diff(starts)) & (kana == 0)


def sorted_text(text: str | None) -> str:
    """The text in one encoding, in lower case, without white space; marks stay."""
    return "".join(skeleton(text or "").lower().split())


def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The one pass over all pairs: defect by the rules, whether the answer is unclosed, its text for the sort, and the question's key."""
    for df in batches:
        qs, answers = df["question"].tolist(), df["answer"].tolist()
        q_forms, a_forms = plain_texts(qs), plain_texts(answers)
        same = mostly_han(qs) & mostly_han(answers)
        found = [defect_of(*row) for row in zip(qs, answers, q_forms, a_forms, same, strict=True)]
        unclosed = [kind in (None, "truncated") and ends_open(a) for kind, a in zip(found, answers, strict=True)]
        codes, starts = to_codes(q_forms)
        yield pd.DataFrame({"tbl": df["tbl"], "row_id": df["row_id"], "defect": found, "unclosed": unclosed, "chars": [len(a or "") for a in answers], "asked": text_key(codes, starts, 3), "text": [sorted_text(a) for a in answers]})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_id, question, answer of the tables that hold answers."""
    names = (("qa_records", "record_id", "query", "response"), ("test_results", "item_id", "prompt", "generated"), ("rl_samples", "row_id", "question", "answer"))
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).alias("row_id"), F.col(q).alias("question"), F.col(a).alias("answer")) for t, k, q, a in names]
    return functools.reduce(DataFrame.unionByName, parts)


#: Answers of fewer characters are compared with answers to the same question only.
LONG = 12
_ENDS = re.compile(r"[。．.！？!?…\"'”’」』）)】》*_`~～]+")


def goes_on(begin: str, text: str) -> int:
    """How a text goes on after its begin: 1 inside a word or after a mark that goes on, 2 with closing marks only, 0 otherwise."""
    if (begin[-1:].isalnum() or _OPEN_MARK.search(begin)) and text[len(begin)].isalnum():
        return 1
    return 2 if _ENDS.fullmatch(text, len(begin)) else 0


def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over one sorted range of distinct (scope, text): of every unclosed text, how the texts that it begins go on.

    ``seen``: bits 1 and 2 of ``goes_on``; ``pending``: the range ended before the texts that it begins.
    """
    names = ["scope", "text", "seen", "pending"]
    begun: list[list] = []  # unclosed texts that begin the current one, shortest first: [scope, text, seen]
    for df in batches:
        out = []
        for scope, text, unclosed in zip(df["scope"], df["text"], df["unclosed"], strict=True):
            while begun and not (begun[-1][0] == scope and text.startswith(begun[-1][1])):
                out.append((*begun.pop(), False))
            for b in begun:
                b[2] |= goes_on(b[1], text)
            if unclosed:
                begun.append([scope, text, 0])
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame([(*b, True) for b in begun], columns=names)


def look_up(pending: list[tuple[int, str]]):
    """How texts go on after the pending ones that begin them."""
    wanted = set(pending)
    lengths = sorted({len(t) for _, t in pending})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(s, t[:n], goes_on(t[:n], t)) for s, t in zip(df["scope"], df["text"], strict=True) for n in lengths if n < len(t) and (s, t[:n]) in wanted]
            yield pd.DataFrame(out, columns=["scope", "text", "seen"])

    return look


def continuations(texts: DataFrame) -> DataFrame:
    """scope, text, seen of every unclosed one of distinct texts (scope, text, unclosed)."""
    ordered = texts.repartitionByRange("scope", "text").sortWithinPartitions("scope", "text")
    found = stored(ordered.mapInPandas(follow, "scope long, text string, seen int, pending boolean"), "p3-continuations")
    pending = [(r["scope"], r["text"]) for r in found.where("pending").select("scope", "text").collect()]  # those that begin the last text of a range
    if not pending:
        return found.select("scope", "text", "seen")
    later = texts.mapInPandas(look_up(pending), "scope long, text string, seen int")
    return found.select("scope", "text", "seen").unionByName(later).groupBy("scope", "text").agg(F.bit_or("seen").alias("seen"))


def length_limits(judged: DataFrame) -> DataFrame:
    """tbl, chars of the lengths at which at least 8 and most answers are unclosed, 6 times the mean of the 10 lengths on either side."""
    counts = judged.groupBy("tbl", "chars").agg(F.count_if("unclosed").alias("n"), F.count("*").alias("all"))
    near = Window.partitionBy("tbl").orderBy("chars").rangeBetween(-10, 10)  # one row for each length in use
    around = counts.withColumn("around", (F.sum("n").over(near) - F.col("n")) / 20)
    return around.where("n >= 8 and n * 2 > `all` and n > 6 * around").select("tbl", "chars", F.lit(True).alias("limit"))


def broken_pairs(answers: DataFrame) -> DataFrame:
    """tbl, row_id, defect, shortened (a sorted neighbour goes on inside its last word), at_limit (its length is a spike of unclosed lengths).

    ``answers``: tbl, row_id, question, answer.
    """
    columns = "tbl string, row_id long, defect string, unclosed boolean, chars int, asked long, text string"
    judged = stored(answers.select("tbl", "row_id", "question", "answer").mapInPandas(judge, columns), "p3-judged")
    scope = F.when(F.length("text") >= LONG, F.lit(0)).otherwise(F.col("asked"))
    open_ = judged.where("unclosed").withColumn("scope", scope)
    short = open_.where("scope <> 0").select("asked").distinct()
    usable = judged.where("text <> '' and coalesce(defect, 'truncated') = 'truncated'")
    everywhere = usable.select(F.lit(0).cast("long").alias("scope"), "text", "unclosed")
    within = usable.join(short, "asked", "left_semi").select(F.col("asked").alias("scope"), "text", "unclosed")
    texts = everywhere.unionByName(within).groupBy("scope", "text").agg(F.bool_or("unclosed").alias("unclosed"))
    known = open_.join(continuations(texts), ["scope", "text"], "left").join(length_limits(judged), ["tbl", "chars"], "left")
    inside, closed = (F.coalesce(F.col("seen").bitwiseAND(F.lit(bit)) > 0, F.lit(False)) for bit in (1, 2))
    limit = F.coalesce("limit", F.lit(False))
    by_rule = F.coalesce(F.col("defect") == "truncated", F.lit(False))
    cut = known.where(inside | limit | (by_rule & ~closed)).select("tbl", "row_id", F.lit("truncated").alias("defect"), inside.alias("shortened"), limit.alias("at_limit"))
    other = judged.where("defect <> 'truncated'").select("tbl", "row_id", "defect", F.lit(False).alias("shortened"), F.lit(False).alias("at_limit"))
    return other.unionByName(cut).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_id, defect: one row for each defective answer."""
    return broken_pairs(pairs(spark, sf_dir)).select("tbl", "row_id", "defect")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, defect, answers, shortened, at_limit: counts of defective answers and of the evidence for breaks."""
    return broken_pairs(pairs(spark, sf_dir)).groupBy("tbl", "defect").agg(F.count("*").alias("answers"), F.count_if("shortened").alias("shortened"), F.count_if("at_limit").alias("at_limit"))
