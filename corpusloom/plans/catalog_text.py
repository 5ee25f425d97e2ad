"""Queries of the normalizers and string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.registry import API, CHAT, QA, RL, SQL_WS, TESTS, drop_sql, nfkc_sql, once, query, quoted, squeeze_sql, table

QA_COLS = "record_id, query, response"


def _qa(spark, d):
    return once(spark, d, "qa_records", "record_id")


def _per_row(name: str, key: str, source: str, frame, column, sql_expr: str, out: str = "out"):
    """One output string per row."""

    @query(name, f"SELECT {key}, {sql_expr} AS {out} FROM {source}")
    def run(spark, d):
        return frame(spark, d).select(key, column().alias(out))

    return run


def _docs(spark, d):
    return table(spark, d, "documents")


def _tests(spark, d):
    return once(spark, d, "test_results", "item_id")


def _rl(spark, d):
    return once(spark, d, "rl_samples", "row_id")


def _api(spark, d):
    return once(spark, d, "api_requests", "req_no")


RET = SQL_WS + r"，。？！、；：,.!?;:"
CORPUS = SQL_WS + T.char_class(T.CORPUS_MARKS)
RERANK = SQL_WS + T.char_class(T.RERANKER_MARKS)

_per_row("nrm_01_compact", "record_id", QA, _qa, lambda: T.compact("query"), drop_sql(f"lower({nfkc_sql('query')})", SQL_WS + r"\p{P}"))
_per_row("nrm_02_normalize_text", "record_id", QA, _qa, lambda: T.normalize_text("query"), drop_sql(f"lower({nfkc_sql('query')})", CORPUS))
_per_row("nrm_03_retriever", "record_id", QA, _qa, lambda: T.retriever_normalize("response"), drop_sql("lower(coalesce(response, ''))", RET))
_per_row("nrm_04_reranker", "record_id", QA, _qa, lambda: T.reranker_norm(F.col("query"), F.col("response")), drop_sql("lower(concat_ws(' ', query, response))", RERANK))
_per_row("nrm_05_no_space", "req_no", API, _api, lambda: T.no_space("text"), drop_sql("text", SQL_WS))


def _chain_sql(expr: str, patterns, to: str) -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, {quoted(p)}, {quoted(to)}, 'g')"
    return expr


_per_row("nrm_06_rewrites", "record_id", QA, _qa, lambda: T.safety_normalize("query"), _chain_sql(drop_sql("coalesce(query, '')", SQL_WS), T.LOSS_REWRITES, T.UNWANTED_LOSS))
_per_row("nrm_07_clean_space", "record_id", QA, _qa, lambda: T.clean_space("query"), squeeze_sql(nfkc_sql("query")))
_per_row("nrm_08_phrase_compact", "req_no", API, _api, lambda: T.phrase_compact("text"), drop_sql(nfkc_sql("text"), SQL_WS))
_per_row("nrm_09_raw_query", "record_id", QA, _qa, lambda: T.clean_raw_query("query"), squeeze_sql("query"))


def _steps_sql(expr: str, steps) -> str:
    for p, to in steps:
        expr = f"regexp_replace({expr}, {quoted(p)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return expr


EDGE = quoted("".join(c for c in T.SPACES if c not in "\x1c\x1d\x1e\x1f"))


def _training_sql(expr: str) -> str:
    t = _steps_sql(f"coalesce({expr}, '')", T.TRAINING_STEPS)
    t = f"replace(replace({t}, '\\n', chr(10)), chr(13), chr(10))"
    return f"trim({_steps_sql(t, [(r'[`*_#]+', ' '), (r'[ \t]+', ' '), (r'\n{3,}', chr(10) * 2)])}, {EDGE})"


def _plain_sql(expr: str, keep: bool) -> str:
    t = _steps_sql(f"coalesce({expr}, '')", T.PLAIN_STEPS)
    t = f"regexp_replace(replace({t}, '|', ' '), '[`*_~]+', '', 'g')"
    t = f"replace(replace({t}, '\\n', chr(10)), chr(13), chr(10))"
    return f"trim({_steps_sql(t, [(r'[ \t]+', ' '), (r'\n{3,}', chr(10) * 2)])}, {EDGE})" if keep else squeeze_sql(t)


_per_row("nrm_10_training_clean", "doc_id", "documents", _docs, lambda: T.training_clean("text"), _training_sql("text"))
_per_row("nrm_11_markdown_plain", "doc_id", "documents", _docs, lambda: T.markdown_to_plain("text"), _plain_sql("text", True))
_per_row("nrm_11_markdown_line", "doc_id", "documents", _docs, lambda: T.markdown_to_plain("text", False), _plain_sql("text", False))


def _marked_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t0, {quoted('(?i)' + m)}) THEN regexp_replace(t0, {quoted('(?is)^.*?' + m)}, '')" for m in T.ANSWER_MARKERS) + " ELSE t0 END"


CJK_SQL = r"CASE WHEN regexp_matches({0}, '[\x{{4e00}}-\x{{9fff}}]') THEN regexp_replace({0}, '(?s)^[^\x{{4e00}}-\x{{9fff}}]*', '') ELSE {0} END"
FINAL_SQL = f"""
SELECT item_id, trim(CASE WHEN regexp_matches(t3, {quoted(T.ANALYSIS_ANYWHERE)}) THEN {CJK_SQL.format('t3')} ELSE t3 END, {EDGE}) AS out
FROM (SELECT *, CASE WHEN regexp_matches(t2, {quoted(T.ANALYSIS_START)}) THEN {CJK_SQL.format('t2')} ELSE t2 END AS t3
FROM (SELECT *, regexp_replace(t1, '(?is)^\\s*here(?:''| i|’)?s\\s+a\\s+thinking\\s+process[\\s\\S]{{0,200}}?:\\s*', ' ') AS t2
FROM (SELECT *, {_marked_sql()} AS t1
FROM (SELECT item_id, regexp_replace(coalesce(generated, ''), '(?is)^\\s*system\\b[\\s\\S]*?\\bassistant\\b[:：]?\\s*', ' ') AS t0 FROM {TESTS}))))"""


@query("str_14_final_answer", FINAL_SQL)
def final_answer(spark, d):
    return _tests(spark, d).select("item_id", T.final_answer("generated").alias("out"))


@query("nrm_12_metric", f"SELECT item_id, {squeeze_sql('regexp_replace(replace(' + _steps_sql('out', T.TRAINING_STEPS) + ', ' + quoted(chr(92) + 'n') + ', chr(32)), ' + quoted('[`*_#]+') + ', chr(32), ' + quoted('g') + ')')} AS out FROM ({FINAL_SQL})")
def metric_normalize(spark, d):
    return _tests(spark, d).select("item_id", T.metric_normalize("generated").alias("out"))


@query("nrm_13_keep_think", f"SELECT item_id, trim(replace(replace({_steps_sql('out', [(T._FENCE, ' '), (T._CONTROL, ' ')])}, '\\n', chr(10)), chr(13) || chr(10), chr(10)), {EDGE}) AS out FROM ({FINAL_SQL})")
def keep_think(spark, d):
    return _tests(spark, d).select("item_id", T.keep_think("generated").alias("out"))


_per_row("nrm_14_reward", "row_id", RL, _rl, lambda: T.reward_normalize("answer"), squeeze_sql("lower(coalesce(answer, ''))"))

#: Phrases of the test tables that carry no topic, shorter ones last; deletion is in this order.
BOILERPLATE = ("请问记录频率怎么写", "请说说可能的方向", "请帮忙看看", "医生您好", "请问", "您好", "请教一下", "好")


def _deleted_sql(expr: str) -> str:
    for p in BOILERPLATE:
        expr = f"replace({expr}, {quoted(p)}, '')"
    return expr


@query("nrm_15_embedding_clean", f"SELECT record_id, CASE WHEN length({drop_sql('lower(c)', RET)}) < 4 THEN query ELSE c END AS out FROM (SELECT record_id, query, {squeeze_sql(_deleted_sql('query'))} AS c FROM {QA})")
def embedding_clean(spark, d):
    return _qa(spark, d).select("record_id", T.embedding_clean("query", BOILERPLATE).alias("out"))


_per_row("nrm_16_lexical_clean", "record_id", QA, _qa, lambda: T.lexical_clean("query", BOILERPLATE), _deleted_sql(drop_sql("lower(coalesce(query, ''))", RET)))


def _list_row(name: str, key: str, source: str, frame, column, sql_list: str):
    """One list per row, shown joined by a bar with its size."""

    @query(name, f"SELECT {key}, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '|') AS items FROM (SELECT {key}, {sql_list} AS l FROM {source})")
    def run(spark, d):
        return frame(spark, d).select(key, column().alias("l")).select(key, F.when(F.col("l").isNotNull(), F.size("l")).alias("n"), F.array_join("l", "|").alias("items"))

    return run


def _clauses_sql(col: str, marks: str, edges: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({col}, {quoted('[' + marks + ']+')}), lambda c: trim(c, {quoted(edges)})), lambda c: c <> '')"


_list_row("str_01_clauses", "record_id", QA, _qa, lambda: T.split_clauses("response"), _clauses_sql("response", "。！？!?\n", " \t，,：:；;"))
_list_row("str_02_answer_clauses", "row_id", RL, _rl, lambda: T.split_answer_clauses("answer"), _clauses_sql("answer", "，,；;。！？!?\n", EDGE[1:-1]))

TERMS = ("头晕", "乏力", "口干", "入睡困难", "记性变差", "胃胀", "咳")
HITS_SQL = "list_filter([" + ", ".join(map(quoted, TERMS)) + "], lambda t: contains({0}, t))"


@query("str_03_contains_any", f"SELECT record_id, {' OR '.join(f'contains(query, {quoted(t)})' for t in TERMS)} AS hit FROM {QA}")
def contains_any(spark, d):
    return _qa(spark, d).select("record_id", T.contains_any(F.col("query"), TERMS).alias("hit"))


_list_row("str_04_hits", "record_id", QA, _qa, lambda: T.hits(F.col("query"), TERMS), HITS_SQL.format("query"))

PATTERNS = ("[0-9]+个(?:晚上|疗程|季度)", "用过每次 [0-9]+ ml", "编号 [A-Z]{2}-[0-9]{3}")
GROUPS = (("别人推荐", "用过"), ("没有.{1,6}，也没有", "还伴着.{1,6}和"))


@query("str_05_matches_any", f"SELECT record_id, {' OR '.join(f'regexp_matches(query, {quoted(p)})' for p in PATTERNS)} AS hit FROM {QA}")
def matches_any(spark, d):
    return _qa(spark, d).select("record_id", T.matches_any(F.col("query"), PATTERNS).alias("hit"))


@query("str_06_matches_all", f"SELECT record_id, {' AND '.join('(' + ' OR '.join(f'regexp_matches(query, {quoted(p)})' for p in g) + ')' for g in GROUPS)} AS hit FROM {QA}")
def matches_all(spark, d):
    return _qa(spark, d).select("record_id", T.matches_all(F.col("query"), GROUPS).alias("hit"))


def _shingles_sql(col: str, n: int, short: str) -> str:
    less = f"CASE WHEN length({col}) = 0 THEN [] ELSE [{col}] END" if short == "whole" else "[]"
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN length({col}) < {n} THEN {less} ELSE list_distinct(list_transform(range(1, CAST(length({col}) AS BIGINT) - {n - 2}), lambda i: substring({col}, i, {n}))) END"


def _gram_query(name: str, key: str, source: str, frame, col: str, n: int, short: str):
    inner = f"SELECT {key}, list_sort({_shingles_sql(col, n, short)}) AS l FROM {source}"

    @query(name, f"SELECT {key}, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '|') AS items FROM ({inner})")
    def run(spark, d):
        return frame(spark, d).select(key, F.array_sort(T.shingles(col, n, short)).alias("l")).select(key, F.when(F.col("l").isNotNull(), F.size("l")).alias("n"), F.array_join("l", "|").alias("items"))


_gram_query("str_07_shingles_whole", "record_id", QA, _qa, "query", 3, "whole")
_gram_query("str_08_trigrams_empty", "row_id", RL, _rl, "answer", 3, "empty")
_gram_query("str_09_bigrams", "row_id", RL, _rl, "question", 2, "empty")
_gram_query("str_10_ngrams", "row_id", RL, _rl, "answer", 4, "whole")

def _compact_sql(col: str) -> str:
    return drop_sql(f"lower({nfkc_sql(col)})", SQL_WS + r"\p{P}")


_per_row("str_11_pair_text", "record_id", QA, _qa, lambda: T.pair_text("query", "response"), f"{_compact_sql('query')} || '␟' || {_compact_sql('response')}")
_list_row("str_12_characters", "row_id", RL, _rl, lambda: T.characters("answer"), f"list_filter(string_split({drop_sql('answer', SQL_WS)}, ''), lambda c: c <> '')")


@query("str_13_chinese", rf"SELECT row_id, regexp_matches(answer, '[\x{{4e00}}-\x{{9fff}}]') AS has, regexp_matches(answer, '^[\x{{4e00}}-\x{{9fa5}}]*$') AS only FROM {RL}")
def chinese(spark, d):
    return _rl(spark, d).select("row_id", T.has_chinese("answer").alias("has"), T.all_chinese("answer").alias("only"))


TAGGED = f"(SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '<think>' || question || '</think><answer> ' || answer || '</answer>' WHEN row_id % 3 = 1 THEN '<answer>' || answer || '</answer> tail<|im_end|> <|endoftext|>' ELSE answer || '<|im_end|>' END AS c FROM {RL})"


def _tagged(spark, d):
    c = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("<think>"), "question", F.lit("</think><answer> "), "answer", F.lit("</answer>"))).when(F.col("row_id") % 3 == 1, F.concat(F.lit("<answer>"), "answer", F.lit("</answer> tail<|im_end|> <|endoftext|>"))).otherwise(F.concat("answer", F.lit("<|im_end|>")))
    return _rl(spark, d).select("row_id", c.alias("c"))


def _strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SQL_WS}]+|[{SQL_WS}]+$', '', 'g')"


_per_row("str_15_tagged_answer", "row_id", TAGGED, _tagged, lambda: T.tagged_answer("c"), _strip_sql("CASE WHEN regexp_matches(c, '(?s)<answer>.*?</answer>') THEN regexp_extract(c, '(?s)<answer>(.*?)</answer>', 1) ELSE c END"))


@query("str_16_boxed", f"SELECT row_id, CASE WHEN answer IS NOT NULL THEN '{{' || row_id || '}}' || answer END AS out FROM {RL} WHERE regexp_matches(coalesce(answer, 'x'), '^[^{{}}\\\\$]*$')")
def boxed(spark, d):
    rows = _rl(spark, d).where(F.coalesce("answer", F.lit("x")).rlike(r"^[^{}\\$]*$"))
    return rows.select("row_id", T.boxed(F.concat(F.lit("\\boxed{no} so \\boxed{{"), "row_id", F.lit("}"), "answer", F.lit("}."))).alias("out"))


@query("str_17_format", f"SELECT row_id, regexp_matches(c, '^<think>.*?</think><answer>.*?</answer>$') AS ok FROM {TAGGED}")
def follows_format(spark, d):
    return _tagged(spark, d).select("row_id", T.follows_format("c").alias("ok"))


_per_row("str_18_terminals", "row_id", TAGGED, _tagged, lambda: T.strip_terminals("c"), _strip_sql(f"regexp_replace(c, '(?:(?:<\\|im_end\\|>|<\\|endoftext\\|>)[{SQL_WS}]*)+$', '')"))
STOPS = ("。", "；", "\n")
_per_row("str_19_stop_words", "record_id", QA, _qa, lambda: T.trim_stop_words("response", STOPS), "string_split(string_split(string_split(response, '。')[1], '；')[1], chr(10))[1]")
SUFFIXES = ("汤", "丸", "散", "饮", "丹", "膏", "露", "煎")


@query("str_20_suffixes", f"SELECT row_id, regexp_matches(answer, '(?:{'|'.join(SUFFIXES)})$') AS ends, {' OR '.join(f'contains(question, {quoted(s)})' for s in SUFFIXES)} AS anywhere FROM {RL}")
def suffixes(spark, d):
    from corpusloom.functions.rules import suffix_entity

    return _rl(spark, d).select("row_id", suffix_entity(F.col("answer"), SUFFIXES, False).alias("ends"), suffix_entity(F.col("question"), SUFFIXES, True).alias("anywhere"))


DIRECT = ("(.+?)由哪些药组成？", "(.+?)常与什么同放\\?", "(.+?)是怎样处理的\\?", "(.+?)出产哪些药材？", "(.+?)时会记录哪些部位？")
_per_row("str_21_direct_candidate", "row_id", RL, _rl, lambda: T.first_full_match(F.col("question"), DIRECT), "CASE " + " ".join(f"WHEN regexp_matches(question, {quoted('^(?:' + p + ')$')}) THEN regexp_extract(question, {quoted('^(?:' + p + ')$')}, 1)" for p in DIRECT) + " END")
_per_row("str_22_named_entity", "record_id", QA, _qa, lambda: F.nullif(F.regexp_extract("query", "拿了[0-9]+包(.{2,20}?[汤丸散饮丹膏露煎])还", 1), F.lit("")), "nullif(regexp_extract(query, '拿了[0-9]+包(.{2,20}?[汤丸散饮丹膏露煎])还', 1), '')")


@query("str_23_features", f"SELECT record_id, array_to_string(list_filter(['酸','苦','甘','辛','咸','淡','涩'], lambda t: contains(query, t)), '|') AS tastes, array_to_string(list_filter(f, lambda t: NOT (t = '寒' AND (list_contains(f, '微寒') OR list_contains(f, '大寒'))) AND NOT (t = '温' AND list_contains(f, '微温'))), '|') AS temperatures FROM (SELECT record_id, query, list_filter(['大寒','大热','微寒','微温','寒','热','温','凉','平'], lambda t: contains(query, t)) AS f FROM {QA})")
def features(spark, d):
    return _qa(spark, d).select("record_id", F.array_join(T.tastes(F.col("query")), "|").alias("tastes"), F.array_join(T.temperatures(F.col("query")), "|").alias("temperatures"))


NUM_SQL = "CASE " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True)) + " END"


@query("str_24_small_numbers", f"SELECT record_id, w, CASE WHEN regexp_matches(w, '^[0-9]{{1,2}}$') THEN try_cast(w AS INTEGER) WHEN length(w) = 1 AND w = '十' THEN 10 WHEN length(w) = 1 THEN CASE w {NUM_SQL[5:]} WHEN regexp_matches(w, '^.?十.?$') THEN (CASE WHEN a = '' THEN 1 ELSE CASE a {NUM_SQL[5:]} END) * 10 + (CASE WHEN b = '' THEN 0 ELSE CASE b {NUM_SQL[5:]} END) END AS n FROM (SELECT record_id, w, regexp_extract(w, '^(.?)十(.?)$', 1) AS a, regexp_extract(w, '^(.?)十(.?)$', 2) AS b FROM (SELECT record_id, nullif(regexp_extract(query, '([0-9]{{1,2}}|[一二两三四五六七八九十]{{1,3}})个?(?:晚上|疗程|季度|周|年|天|月)', 1), '') AS w FROM {QA}))")
def small_numbers(spark, d):
    w = F.nullif(F.regexp_extract("query", "([0-9]{1,2}|[一二两三四五六七八九十]{1,3})个?(?:晚上|疗程|季度|周|年|天|月)", 1), F.lit(""))
    return _qa(spark, d).select("record_id", w.alias("w")).select("record_id", "w", T.small_chinese_number(F.col("w")).alias("n"))


_SCOPE_SQL = f"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[。！？；.!?;\\n]+'), lambda c: regexp_replace(rtrim(regexp_replace(trim(c, {EDGE}), '(?s)(?:{T.REQUEST_WORDS}).*$', '')), '[，,：: \\t]+$', '')), lambda c: c <> ''), '。')"
_per_row("str_26_scope", "req_no", API, _api, lambda: T.information_scope("text"), _SCOPE_SQL)


@query("str_25_duration_frequency", f"SELECT req_no, {' OR '.join(f'regexp_matches(s, {quoted(p)})' for p in T.DURATION)} AS duration, {' OR '.join(f'regexp_matches(s, {quoted(p)})' for p in T.FREQUENCY)} AS frequency FROM (SELECT req_no, {_SCOPE_SQL} AS s FROM {API})")
def duration_frequency(spark, d):
    return _api(spark, d).select("req_no", T.has_duration("text").alias("duration"), T.has_frequency("text").alias("frequency"))


@query("str_27_literal_facts")
def literal_facts(spark, d):
    return _api(spark, d).select("req_no", T.literal_facts("text").alias("l")).select("req_no", F.size("l").alias("n"), F.array_join("l", "|").alias("items"))


_per_row("str_28_without_negated", "record_id", QA, _qa, lambda: T.without_negated("query"), f"regexp_replace(query, {quoted(T.NEGATED)}, '', 'g')")
_per_row("str_29_markdown_cell", "record_id", QA, _qa, lambda: T.markdown_cell("response"), "replace(replace(response, '|', '\\|'), chr(10), '<br>')")


@query("str_30_sources", f"SELECT sample_id, left(array_to_string(list_transform(l, lambda x, i: '[' || i || ']' || chr(9) || ' \"' || x || '\"'), chr(10)), greatest(200 - length(id), 0)) AS out FROM (SELECT sample_id, id, list_transform(coalesce(conversations, []), lambda t: coalesce(t.value, '')) AS l FROM {CHAT})")
def sources(spark, d):
    chat = once(spark, d, "chat_samples", "sample_id")
    items = F.transform(F.coalesce("conversations", F.filter(F.array(F.struct(F.lit("").alias("from"), F.lit("").alias("value"))), lambda t: F.lit(False))), lambda t: F.coalesce(t["value"], F.lit("")))
    return chat.select("sample_id", T.truncated_context(items, F.col("id"), 200).alias("out"))


_per_row("str_31_list_number", "row_id", RL, _rl, lambda: T.strip_list_number("answer"), "CASE WHEN contains(answer, '.') THEN regexp_replace(answer, '(?s)^[^.]*\\.', '') ELSE substring(answer, 2) END")


@query("str_32_pack_sentences")
def pack_sentences(spark, d):
    en = _docs(spark, d).where(~T.has_chinese("text") & F.col("text").isNotNull())
    return en.select("doc_id", T.pack_sentences("text", 250).alias("l")).select("doc_id", F.posexplode("l").alias("chunk", "text"))


@query("str_33_pack_chinese")
def pack_chinese(spark, d):
    zh = _docs(spark, d).where(T.has_chinese("text"))
    return zh.select("doc_id", F.posexplode(T.pack_chinese("text", 250)).alias("chunk", "text"))


@query("str_34_chunk_overlap", f"SELECT record_id, pos, CASE WHEN nxt IS NULL THEN c ELSE trim(c || ' ' || left(nxt, 5), {EDGE}) END AS out FROM (SELECT record_id, pos, l[pos] AS c, CASE WHEN pos < len(l) THEN l[pos + 1] END AS nxt FROM (SELECT record_id, l, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos FROM (SELECT record_id, {_clauses_sql('response', '。！？!?' + chr(10), ' ' + chr(9) + '，,：:；;')} AS l FROM {QA} WHERE response IS NOT NULL)))")
def chunk_overlap(spark, d):
    rows = _qa(spark, d).where("response is not null").select("record_id", T.chunk_overlap(T.split_clauses("response"), 5).alias("l"))
    return rows.select("record_id", F.posexplode("l").alias("pos", "out")).select("record_id", (F.col("pos") + 1).alias("pos"), "out")
