"""Queries of rule classification; the lexicons are settings for the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import conversation as C
from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.plans.catalog_text import _SCOPE_SQL, EDGE, _clauses_sql
from corpusloom.plans.registry import API, CHAT, QA, RL, TESTS, once, query, quoted

CLAUSES = _clauses_sql("response", "。！？!?\n", " \t，,：:；;")
REQUEST = ("请", "怎么", "要不要", "能不能", "可以", "该")
CONTEXT = ("头晕", "胃胀", "口干", "乏力", "咳", "疼", "痛")
DOCUMENT = ("检查单", "编号", "记录")
ACTION = ("喝", "吃", "敷")
LIMIT = ("不便", "不能", "无法", "不给出")
TARGET = ("判断", "诊断", "剂量", "开方")
CARE = ("请带来", "观察", "留意", "记录", "建议", "不妨", "最好", "近期", "可以", "宜", "需要", "平时")
ASKING = ("吗", "还是", "有没有", "是否", "哪", "几", "多不多", "怎样", "有无", "会不会")
BLOCKED = ("核对", "用量", "剂量")


def _any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(t)})" for t in terms) + ")"


def _qa(spark, d):
    return once(spark, d, "qa_records", "record_id")


def _q():
    return F.col("query")


def _a():
    return F.col("response")


@query("cls_01_length", f"SELECT record_id, coalesce(length(query) BETWEEN 4 AND 200 AND length(response) BETWEEN 15 AND 650, false) AS ok FROM {QA}")
def lengths(spark, d):
    return _qa(spark, d).select("record_id", F.coalesce(F.length("query").between(4, 200) & F.length("response").between(15, 650), F.lit(False)).alias("ok"))


@query("cls_02_documentary", f"SELECT record_id, {_any('query', DOCUMENT)} AND NOT {_any('query', ACTION)} AS hit FROM {QA}")
def documentary(spark, d):
    return _qa(spark, d).select("record_id", R.topical(_q(), DOCUMENT, ACTION).alias("hit"))


@query("cls_03_request", f"SELECT record_id, NOT ({_any('query', DOCUMENT)} AND NOT {_any('query', ACTION)}) AND ({_any('query', REQUEST)} OR {_any('query', CONTEXT)}) AS hit FROM {QA}")
def request(spark, d):
    return _qa(spark, d).select("record_id", (~R.topical(_q(), DOCUMENT, ACTION) & (T.contains_any(_q(), REQUEST) | T.contains_any(_q(), CONTEXT))).alias("hit"))


@query("cls_04_refusal_clause", f"SELECT record_id, len(list_filter({CLAUSES}, lambda c: {_any('c', LIMIT)} AND {_any('c', TARGET)})) > 0 AS hit FROM {QA}")
def refusal_clause(spark, d):
    return _qa(spark, d).select("record_id", R.one_clause_has_both(_a(), LIMIT, TARGET).alias("hit"))


def _gone(col: str, terms) -> str:
    for t in terms:
        col = f"replace({col}, {quoted(t)}, '')"
    return col


@query("cls_05_residual", f"SELECT record_id, CASE WHEN {_any('response', LIMIT)} THEN {_gone('response', LIMIT)} ELSE response END AS rest FROM {QA}")
def residual(spark, d):
    return _qa(spark, d).select("record_id", R.residual(_a(), [(T.contains_any(_a(), LIMIT), LIMIT)]).alias("rest"))


@query("cls_06_roles", f"SELECT record_id, len({CLAUSES}) > 0 AND len(list_filter({CLAUSES}, lambda c: NOT (({_any('c', LIMIT)} OR {_any('c', CARE)} OR {_any('c', ASKING)}) AND NOT {_any('CASE WHEN ' + _any('c', LIMIT) + ' THEN replace(c, ' + quoted('剂量') + ', ' + quoted('') + ') ELSE c END', BLOCKED)}))) = 0 AS ok FROM {QA}")
def roles(spark, d):
    return _qa(spark, d).select("record_id", R.only_roles(_a(), {"limit": LIMIT, "care": CARE, "ask": ASKING}, BLOCKED, {"limit": ("剂量",)}).alias("ok"))


_REASONS = [("empty", f"coalesce(trim(response, {EDGE}), '') = ''"), ("query_length", "NOT coalesce(length(query) BETWEEN 30 AND 150, false)"), ("response_length", "NOT coalesce(length(response) BETWEEN 40 AND 200, false)"), ("dose", "regexp_matches(coalesce(response, ''), '[0-9]+ ?(?:ml|克|毫克)')"), ("names_product", "regexp_matches(coalesce(response, ''), '[A-Za-z]{4,} 的说明')")]


def reason_codes():
    return R.reasons([("empty", F.btrim(F.coalesce(_a(), F.lit("")), F.lit(T.SPACES)) == ""), ("query_length", ~F.coalesce(F.length(_q()).between(30, 150), F.lit(False))), ("response_length", ~F.coalesce(F.length(_a()).between(40, 200), F.lit(False))), ("dose", F.coalesce(_a(), F.lit("")).rlike("[0-9]+ ?(?:ml|克|毫克)")), ("names_product", F.coalesce(_a(), F.lit("")).rlike("[A-Za-z]{4,} 的说明"))])


REASONS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _REASONS) + "], lambda x: x IS NOT NULL)"


@query("cls_07_priority", f"SELECT record_id, {REASONS_SQL}[1] AS reason FROM {QA}")
def priority(spark, d):
    return _qa(spark, d).select("record_id", R.primary(reason_codes()).alias("reason"))


@query("cls_08_reasons", f"SELECT record_id, array_to_string({REASONS_SQL}, '|') AS codes, {REASONS_SQL}[1] AS first_code FROM {QA}")
def all_reasons(spark, d):
    codes = reason_codes()
    return _qa(spark, d).select("record_id", F.array_join(codes, "|").alias("codes"), R.primary(codes).alias("first_code"))


_CATS = {"dose": "[0-9]+ ml", "bypass": "先别下结论", "timing": "多久|什么时候", "food": "吃|喝|忌口", "sleep": "熬夜|枕头|失眠"}
_CAT_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(query, {quoted(p)}) THEN '{n}' END" for n, p in _CATS.items()) + "], lambda x: x IS NOT NULL)"


@query("cls_09_category", f"SELECT record_id, CASE WHEN list_contains(m, 'dose') THEN 'dose' WHEN list_contains(m, 'bypass') THEN 'bypass' WHEN len(m) > 0 THEN m[CAST(CAST('0x' || left(sha256(query), 8) AS BIGINT) % len(m) AS INTEGER) + 1] END AS category FROM (SELECT record_id, query, {_CAT_LIST} AS m FROM {QA})")
def category(spark, d):
    m = R.pattern_names(_q(), _CATS)
    n = F.greatest(F.size(m), F.lit(1))
    at = F.pmod(F.conv(F.left(F.sha2(_q(), 256), F.lit(8)), 16, 10).cast("long"), n.cast("long")).cast("int")
    return _qa(spark, d).select("record_id", F.when(F.array_contains(m, "dose"), "dose").when(F.array_contains(m, "bypass"), "bypass").when(F.size(m) > 0, F.get(m, at)).alias("category"))


@query("cls_10_concepts")
def concepts(spark, d):
    return once(spark, d, "api_requests", "req_no").select("req_no", R.concept_states(R.WARNING_CONCEPTS)("text").alias("s")).select("req_no", "s.*")


@query("cls_12_warning_route")
def warning_route(spark, d):
    rows = once(spark, d, "api_requests", "req_no").select("req_no", R.concept_states(R.WARNING_CONCEPTS)("text").alias("s"))
    return rows.select("req_no", R.warning_route(F.col("s")).alias("route"))


@query("cls_13_router", f"SELECT req_no, CASE WHEN trim(text) = '' THEN 'consultation' WHEN regexp_matches(text, '由哪些药组成|是什么|出产哪些') THEN 'knowledge' WHEN regexp_matches(text, '我') AND {_any('text', CONTEXT)} THEN 'consultation' WHEN regexp_matches(text, '怎么|要不要|能不能') THEN 'consultation' WHEN regexp_matches(text, '(?:汤|丸|散|饮|丹|膏)$') THEN 'knowledge' ELSE 'other' END AS intent FROM {API}")
def router(spark, d):
    t = F.col("text")
    rules = [("consultation", F.trim(t) == ""), ("knowledge", t.rlike("由哪些药组成|是什么|出产哪些")), ("consultation", t.rlike("我") & T.contains_any(t, CONTEXT)), ("consultation", t.rlike("怎么|要不要|能不能")), ("knowledge", R.suffix_entity(t, ("汤", "丸", "散", "饮", "丹", "膏"), False))]
    return once(spark, d, "api_requests", "req_no").select("req_no", R.priority(rules, "other").alias("intent"))


@query("cls_14_query_type", "SELECT row_id, CASE WHEN regexp_matches(question, '^.{2,8}(?:由哪些药组成|常与什么同放|是怎样处理的|出产哪些药材)') THEN 'entity' WHEN regexp_matches(question, '区别|相比|不同') THEN 'comparison' WHEN regexp_matches(question, '时会记录') THEN 'description' ELSE 'free' END AS kind FROM (SELECT * FROM rl_samples QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY row_id) = 1)")
def query_type(spark, d):
    q = F.col("question")
    rules = [("entity", q.rlike("^.{2,8}(?:由哪些药组成|常与什么同放|是怎样处理的|出产哪些药材)")), ("comparison", q.rlike("区别|相比|不同")), ("description", q.rlike("时会记录"))]
    return once(spark, d, "rl_samples", "row_id").select("row_id", R.priority(rules, "free").alias("kind"))


@query("cls_15_category_by_lexicon", f"SELECT record_id, CASE WHEN {_any('query', ('汤', '丸', '膏'))} THEN 'formula' WHEN {_any('query', ('参', '芝', '菇'))} THEN 'herb' WHEN regexp_matches(query, '归.{{1,25}}经') THEN 'meridian' END AS category FROM {QA}")
def category_by_lexicon(spark, d):
    rules = [("formula", T.contains_any(_q(), ("汤", "丸", "膏"))), ("herb", T.contains_any(_q(), ("参", "芝", "菇"))), ("meridian", _q().rlike("归.{1,25}经"))]
    return _qa(spark, d).select("record_id", R.priority(rules).alias("category"))


@query("cls_16_closed_set", f"SELECT row_id, row_id % 20 > 11 AS beyond FROM {RL}")
def closed_set(spark, d):
    return once(spark, d, "rl_samples", "row_id").select("row_id", R.beyond_closed_set(F.concat(F.lit("第"), (F.col("row_id") % 20).cast("string"), F.lit("个脏腑")), {"脏腑": 11}).alias("beyond"))


@query("cls_17_action", f"SELECT req_no, CASE WHEN regexp_matches(text, '诊断|处方|开方|剂量') THEN 'ask' WHEN regexp_matches(text, '(?:请|帮我).{{0,24}}(?:总结|整理|归纳|概括)') THEN 'summarize' ELSE 'ask' END AS action FROM {API}")
def action(spark, d):
    t = F.col("text")
    return once(spark, d, "api_requests", "req_no").select("req_no", R.priority([("ask", t.rlike("诊断|处方|开方|剂量")), ("summarize", t.rlike("(?:请|帮我).{0,24}(?:总结|整理|归纳|概括)"))], "ask").alias("action"))


@query("cls_18_follow_up", f"SELECT req_no, CASE WHEN NOT d AND NOT f THEN 'both' WHEN NOT d THEN 'duration' WHEN NOT f THEN 'frequency' ELSE 'trend' END AS ask FROM (SELECT req_no, {' OR '.join(f'regexp_matches(s, {quoted(p)})' for p in T.DURATION)} AS d, {' OR '.join(f'regexp_matches(s, {quoted(p)})' for p in T.FREQUENCY)} AS f FROM (SELECT req_no, {_SCOPE_SQL} AS s FROM {API}))")
def follow_up(spark, d):
    du, fr = T.has_duration("text"), T.has_frequency("text")
    return once(spark, d, "api_requests", "req_no").select("req_no", R.priority([("both", ~du & ~fr), ("duration", ~du), ("frequency", ~fr)], "trend").alias("ask"))


_SLOTS = {"sleep": ("入睡", "早醒", "多梦"), "stool": ("大便",), "urine": ("小便",), "mouth": ("口干", "口苦", "口淡")}


@query("cls_19_slots", f"SELECT req_no, array_to_string(s, '|') AS slots, CASE WHEN len(list_filter(s, lambda x: x IN ('sleep', 'stool'))) = 1 THEN list_filter(s, lambda x: x IN ('sleep', 'stool'))[1] END AS bound FROM (SELECT req_no, list_filter([" + ", ".join(f"CASE WHEN {_any('text', v)} THEN '{k}' END" for k, v in _SLOTS.items()) + f"], lambda x: x IS NOT NULL) AS s FROM {API})")
def slots(spark, d):
    t = F.col("text")
    return once(spark, d, "api_requests", "req_no").select("req_no", F.array_join(R.slots_of(t, _SLOTS), "|").alias("slots"), R.bind_slot(t, _SLOTS, F.array(F.lit("sleep"), F.lit("stool"))).alias("bound"))


@query("cls_20_unknown", f"SELECT req_no, {_any('text', R.UNKNOWN_ANSWERS)} AS unknown FROM {API}")
def unknown(spark, d):
    return once(spark, d, "api_requests", "req_no").select("req_no", R.unknown_answer(F.col("text")).alias("unknown"))


_RISKS = (r"[0-9]+(?:\.[0-9]+)?\s*(?:克|毫克|mg|ml|片|丸|袋|粒|支|滴|毫升)", "怎么治|治疗方案|吃什么药|开方|处方|用药", "汤|丸|散|膏")


@query("cls_21_risk", f"SELECT req_no, {' OR '.join(f'regexp_matches(text, {quoted(p)})' for p in _RISKS)} AS risk FROM {API}")
def risk(spark, d):
    return once(spark, d, "api_requests", "req_no").select("req_no", R.any_risk(F.col("text"), _RISKS).alias("risk"))


@query("cls_22_payload_scan")
def payload_scan(spark, d):
    v = C.first_value(F.col("conversations"), "gpt")
    codes = R.reasons([("dose", v.rlike(_RISKS[0])), ("treatment", v.rlike(_RISKS[1])), ("asserts", v.rlike("(?<!不)(?:诊断为|属于.{0,8}证)")), ("no_boundary", (F.col("category").endswith("refusal")) & ~F.contains(v, F.lit("不能")))])
    return once(spark, d, "chat_samples", "sample_id").select("sample_id", F.array_join(codes, "|").alias("codes"))


_GRAMMAR = {"double_mark": "[。，；]{2,}", "space_before_mark": " [。，；]", "latin_word": "[A-Za-z]{3,}", "repeat": "没有没有|也没有没有", "ends_open": "[，；]$", "digits": "[0-9]{2,}"}


@query("cls_23_grammar", "SELECT record_id, " + ", ".join(f"regexp_matches(query, {quoted(p)}) AS {n}" for n, p in _GRAMMAR.items()) + f" FROM {QA}")
def grammar(spark, d):
    return _qa(spark, d).select("record_id", *[_q().rlike(p).alias(n) for n, p in _GRAMMAR.items()])


@query("cls_25_policy")
def policy(spark, d):
    from corpusloom.functions.jsonx import salvaged_findings

    chat = once(spark, d, "chat_samples", "sample_id").select("sample_id", C.first_value(F.col("conversations"), "human").alias("h"), C.first_value(F.col("conversations"), "gpt").alias("v"))
    found = salvaged_findings(F.col("v"))
    codes = R.reasons([("finding_not_literal", F.exists(found, lambda f: ~F.contains(F.col("h"), f))), ("needs_more", F.get_json_object("v", "$.need_more_info") != "[]"), ("dose", F.array_join(found, " ").rlike(_RISKS[0]))])
    return chat.select("sample_id", F.array_join(F.array_sort(codes), "|").alias("codes"))


@query("cls_27_cues", f"SELECT item_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(generated, {quoted(p)}) THEN '{n}' END" for n, p in (("limit", "不便|不能|无法"), ("advice", "建议|不妨|最好"), ("question", "吗|还是|有没有"))) + f"], lambda x: x IS NOT NULL), '|') AS cues FROM {TESTS}")
def cues(spark, d):
    names = R.pattern_names(F.col("generated"), {"limit": "不便|不能|无法", "advice": "建议|不妨|最好", "question": "吗|还是|有没有"})
    return once(spark, d, "test_results", "item_id").select("item_id", F.array_join(names, "|").alias("cues"))


@query("cls_28_valid", f"SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS invalid FROM (SELECT coalesce(len(conversations) > 0 AND len(list_filter(conversations, lambda t: NOT (t.\"from\" IN ('system','human','gpt') AND t.value IS NOT NULL))) = 0, false) AS ok FROM {CHAT})")
def valid(spark, d):
    ok = C.valid_turns(F.col("conversations"))
    return once(spark, d, "chat_samples", "sample_id").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("cls_29_assessment", f"SELECT item_id, coalesce(generated = reference, false) AS same, coalesce(length(generated) > 0, false) AS filled, coalesce(length(generated) <= 200, false) AS short, coalesce(contains(generated, left(prompt, 8)), false) AS echoes, coalesce(regexp_matches(generated, '[。！？]$'), false) AS closed FROM {TESTS}")
def assessment(spark, d):
    g, no = F.col("generated"), F.lit(False)
    return once(spark, d, "test_results", "item_id").select("item_id", F.coalesce(g == F.col("reference"), no).alias("same"), F.coalesce(F.length(g) > 0, no).alias("filled"), F.coalesce(F.length(g) <= 200, no).alias("short"), F.coalesce(F.contains(g, F.left("prompt", F.lit(8))), no).alias("echoes"), F.coalesce(g.rlike("[。！？]$"), no).alias("closed"))


@query("cls_30_filters", f"SELECT item_id FROM {TESTS} WHERE length(prompt || generated) > 0 AND length(prompt || generated) <= 300 AND length(prompt || reference) <= 300")
def filters(spark, d):
    return once(spark, d, "test_results", "item_id").where("length(concat(prompt, generated)) between 1 and 300 and length(concat(prompt, reference)) <= 300").select("item_id")


@query("cls_31_request_errors", f"SELECT req_no, CASE WHEN trim(coalesce(text, ''), {EDGE}) = '' THEN 'blank_text' WHEN length(text) > 120 THEN 'text_too_long' WHEN request_id IS NOT NULL AND NOT regexp_matches(request_id, '^[A-Za-z0-9._:-]{{1,128}}$') THEN 'bad_request_id' WHEN state.turn_count >= 10 THEN 'too_many_turns' END AS error FROM {API}")
def request_errors(spark, d):
    rows = once(spark, d, "api_requests", "req_no")
    return rows.select("req_no", R.request_error(F.col("text"), F.col("request_id"), F.octet_length(F.to_json("state")), F.col("state.turn_count"), longest=120, most_turns=10).alias("error"))


@query("cls_32_level", "SELECT line_id, nullif(lower(trim(coalesce(json_extract_string(p, '$.category'), CASE WHEN NOT regexp_matches(p, '^\\s*[\\[{]') THEN p END))), '') AS level FROM (SELECT line_id, CASE WHEN json_valid(payload) OR NOT regexp_matches(payload, '^\\s*[\\[{]') THEN payload END AS p FROM raw_records)")
def level(spark, d):
    p = F.when(F.try_parse_json("payload").isNotNull() | ~F.col("payload").rlike(r"^\s*[\[{]"), F.col("payload"))
    rows = once(spark, d, "raw_records", "line_id").select("line_id", p.alias("p"))
    return rows.select("line_id", R.normalized_level(F.col("p"), ("category",)).alias("level"))
