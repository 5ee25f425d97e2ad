"""Queries of hash, JSON, array, conversation and map functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import conversation as C
from corpusloom.functions import hashing as H
from corpusloom.functions import jsonx as J
from corpusloom.functions import similarity as S
from corpusloom.functions import text as T
from corpusloom.plans.catalog_text import EDGE, TERMS, _shingles_sql
from corpusloom.plans.registry import API, CHAT, QA, RL, TESTS, once, query, quoted, table


def _qa(spark, d):
    return once(spark, d, "qa_records", "record_id")


def _chat(spark, d):
    return once(spark, d, "chat_samples", "sample_id")


# --- hashes ------------------------------------------------------------------------------------


@query("hsh_01_text_hash", f"SELECT record_id, sha256(query) AS digest FROM {QA}")
def text_hash(spark, d):
    return _qa(spark, d).select("record_id", H.text_hash(F.col("query")).alias("digest"))


@query("hsh_03_stable_id", f"SELECT sample_id, 'v-' || left(sha256(category || chr(10) || coalesce(split, '')), 20) AS id FROM {CHAT}")
def stable_id(spark, d):
    return _chat(spark, d).select("sample_id", H.stable_id("v-", F.col("category"), F.coalesce("split", F.lit(""))).alias("id"))


@query("hsh_04_bucket", f"SELECT record_id, CAST(CAST('0x' || left(sha256(query), 8) AS BIGINT) % 97 AS BIGINT) AS bucket FROM {QA}")
def bucket(spark, d):
    return _qa(spark, d).select("record_id", H.hash_bucket(F.col("query"), 97).alias("bucket"))


@query("hsh_05_pick", f"SELECT record_id, ['a','b','c','d','e'][CAST((record_id * 7 + 3) % 5 AS INTEGER) + 1] AS pick FROM {QA}")
def pick(spark, d):
    return _qa(spark, d).select("record_id", H.stable_pick("abcde", F.col("record_id"), 7, 3).alias("pick"))


_KEY = b"loom"
_IN, _OUT = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))


@query("hsh_06_hmac", f"SELECT req_no, sha256(unhex('{_OUT.hex()}') || unhex(sha256(unhex('{_IN.hex()}') || encode(text)))) AS mac FROM {API}")
def hmac(spark, d):
    return once(spark, d, "api_requests", "req_no").select("req_no", H.hmac_sha256(_KEY, F.col("text")).alias("mac"))


# --- JSON --------------------------------------------------------------------------------------

GPT = f"(SELECT sample_id, list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'gpt')[1].value AS v FROM {CHAT})"


def _gpt(spark, d):
    return _chat(spark, d).select("sample_id", C.first_value(F.col("conversations"), "gpt").alias("v"))


def _json_sql(name: str, expr: str) -> str:
    return f"SELECT sample_id, {expr} AS {name} FROM (SELECT sample_id, CASE WHEN json_valid(v) AND json_type(v) = 'OBJECT' THEN v END AS v FROM {GPT})"


@query("jsn_01_object", "SELECT sample_id, json_extract_string(v, '$.action') AS action, json_extract_string(v, '$.note') AS note FROM (" + _json_sql("v", "v") + ")")
def parse_object(spark, d):
    o = J.parse_object(F.col("v"))
    return _gpt(spark, d).select("sample_id", o["action"].alias("action"), o["note"].alias("note"))


@query("jsn_02_strict")
def strict(spark, d):
    return table(spark, d, "raw_records").select("line_id", J.strict_json_error("payload").alias("error"))


@query("jsn_03_extract", f"SELECT sample_id, json_extract_string(v, '$.stage') AS stage FROM {GPT} WHERE v IS NULL OR json_valid(v)")
def extract(spark, d):
    fenced = F.concat(F.lit("here:\n```json\n"), F.col("v"), F.lit("\n```"))
    rows = _gpt(spark, d).where(F.col("v").isNull() | F.try_parse_json("v").isNotNull())
    return rows.select("sample_id", F.get_json_object(J.extract_object(fenced), "$.stage").alias("stage"))


@query("jsn_04_types", "SELECT line_id, CASE WHEN NOT json_valid(payload) THEN NULL ELSE CASE json_type(payload) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind FROM raw_records WHERE payload IS NOT NULL AND regexp_matches(payload, '^\\s*[\\[{\"0-9tfn-]') AND (NOT contains(payload, '}') OR regexp_matches(payload, '\\}\\s*$'))")
def types(spark, d):
    rows = table(spark, d, "raw_records").where(r"payload is not null and payload rlike '^\\s*[\\[{\"0-9tfn-]' and (not contains(payload, '}') or payload rlike '\\}\\s*$')")
    return rows.select("line_id", J.json_type(F.col("payload")).alias("kind"))


_ASK = ", ".join(map(quoted, J.ASK_FIELDS))


@query("jsn_05_key_set", f"SELECT sample_id, array_to_string(list_sort(list_concat(list_filter(k, lambda x: NOT list_contains([{_ASK}], x)), list_filter([{_ASK}], lambda x: NOT list_contains(k, x)))), '|') AS difference FROM (SELECT sample_id, list_distinct(json_keys(v)) AS k FROM {GPT} WHERE json_valid(v) AND json_type(v) = 'OBJECT')")
def key_set(spark, d):
    rows = _gpt(spark, d).where("try_parse_json(v) is not null and v rlike '^\\\\s*\\\\{'")
    return rows.select("sample_id", F.array_join(J.key_difference(F.col("v"), J.ASK_FIELDS), "|").alias("difference"))


@query("jsn_06_salvage", f"SELECT sample_id, json_extract_string(v, '$.action') AS action, CASE WHEN json_extract(v, '$.key_findings') IS NULL THEN '' ELSE array_to_string(CAST(json_extract(v, '$.key_findings') AS VARCHAR[]), '|') END AS findings FROM {GPT} WHERE json_valid(v) AND json_type(v) = 'OBJECT'")
def salvage(spark, d):
    rows = _gpt(spark, d).where("try_parse_json(v) is not null and v rlike '^\\\\s*\\\\{'")
    broken = F.regexp_replace("v", r"\}\s*$", "")
    return rows.select("sample_id", J.closed_action(broken).alias("action"), F.array_join(J.salvaged_findings(broken), "|").alias("findings"))


@query("jsn_07_answer", f"SELECT sample_id, coalesce(nullif(json_extract_string(v, '$.note'), ''), v) AS answer FROM (SELECT sample_id, v FROM {GPT} WHERE v IS NULL OR json_valid(v))")
def answer(spark, d):
    rows = _gpt(spark, d).where(F.col("v").isNull() | F.try_parse_json("v").isNotNull())
    return rows.select("sample_id", J.pick_answer(F.replace("v", F.lit('"note"'), F.lit('"answer"'))).alias("a"), "v").select("sample_id", F.when(F.col("a") == F.replace("v", F.lit('"note"'), F.lit('"answer"')), F.col("v")).otherwise(F.col("a")).alias("answer"))


@query("jsn_08_questions", f"SELECT sample_id, CASE WHEN json_extract(v, '$.questions') IS NULL THEN '' ELSE array_to_string(list_slice(list_filter(list_transform(CAST(json_extract(v, '$.questions') AS VARCHAR[]), lambda q: trim(q)), lambda q: q <> ''), 1, 3), '|') END AS questions FROM {GPT} WHERE json_valid(v) AND json_type(v) = 'OBJECT'")
def questions(spark, d):
    rows = _gpt(spark, d).where("try_parse_json(v) is not null and v rlike '^\\\\s*\\\\{'")
    return rows.select("sample_id", F.array_join(J.questions_column(F.get_json_object("v", "$.questions")), "|").alias("questions"))


@query("jsn_09_payload", f"""SELECT sample_id, '{{"action":"ask","stage":"initial","complete":false,"questions":["' || category || '"]}}' AS payload FROM {CHAT}""")
def payload(spark, d):
    return _chat(spark, d).select("sample_id", J.ask_payload(F.array("category")).alias("payload"))


@query("cls_24_contract")
def contract(spark, d):
    return _gpt(spark, d).select("sample_id", J.contract_error_column("v").alias("error"))


# --- arrays ------------------------------------------------------------------------------------

_GA, _GB = _shingles_sql("question", 2, "empty"), _shingles_sql("answer", 2, "empty")
_INTER = "len(list_filter(a, lambda x: list_contains(b, x)))"
_PAIRS = f"(SELECT row_id, coalesce({_GA}, []) AS a, coalesce({_GB}, []) AS b FROM {RL})"


def _gram_pairs(spark, d):
    none = F.array().cast("array<string>")
    return once(spark, d, "rl_samples", "row_id").select("row_id", "question", F.coalesce(T.shingles("question", 2, "empty"), none).alias("a"), F.coalesce(T.shingles("answer", 2, "empty"), none).alias("b"))


@query("arr_01_jaccard", f"SELECT row_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE {_INTER} / (len(a) + len(b) - {_INTER}) END, 9) AS score FROM {_PAIRS}")
def jaccard_one(spark, d):
    return _gram_pairs(spark, d).select("row_id", F.round(S.jaccard(F.col("a"), F.col("b"), 1.0), 9).alias("score"))


@query("arr_02_jaccard_zero", f"SELECT row_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE {_INTER} / (len(a) + len(b) - {_INTER}) END, 9) AS score FROM {_PAIRS}")
def jaccard_zero(spark, d):
    return _gram_pairs(spark, d).select("row_id", F.round(S.jaccard(F.col("a"), F.col("b"), 0.0), 9).alias("score"))


@query("arr_03_jaccard_union", f"SELECT row_id, round(CASE WHEN len(a) + len(b) - {_INTER} = 0 THEN 1.0 ELSE {_INTER} / (len(a) + len(b) - {_INTER}) END, 9) AS score FROM {_PAIRS}")
def jaccard_union(spark, d):
    return _gram_pairs(spark, d).select("row_id", F.round(S.jaccard(F.col("a"), F.col("b")), 9).alias("score"))


@query("arr_04_coverage", f"SELECT row_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE {_INTER} / len(a) END, 9) AS score FROM {_PAIRS}")
def coverage(spark, d):
    return _gram_pairs(spark, d).select("row_id", F.round(S.coverage(F.col("a"), F.col("b")), 9).alias("score"))


_TERM_LIST = "[" + ", ".join(map(quoted, TERMS)) + "]"


@query("arr_05_set_match", f"SELECT record_id, CASE WHEN len(f) > 0 THEN round(len(list_filter(f, lambda x: contains(response, x))) / len(f), 9) END AS score FROM (SELECT record_id, coalesce(response, '') AS response, list_filter({_TERM_LIST}, lambda t: contains(query, t)) AS f FROM {QA})")
def set_match(spark, d):
    return _qa(spark, d).select("record_id", F.round(S.set_match(T.hits(F.col("query"), TERMS), F.coalesce("response", F.lit(""))), 9).alias("score"))


@query("arr_06_stable_unique", f"SELECT req_no, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '|') AS facts FROM (SELECT req_no, list_concat(state.facts, state.facts, ['a', 'b', 'a']) AS f FROM {API} WHERE state.facts IS NOT NULL)")
def stable_unique(spark, d):
    rows = once(spark, d, "api_requests", "req_no").where("state.facts is not null")
    return rows.select("req_no", F.array_join(F.array_distinct(F.concat("state.facts", "state.facts", F.array(F.lit("a"), F.lit("b"), F.lit("a")))), "|").alias("facts"))


@query("arr_07_dot", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: p[1] * p[2])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("other")), 6).alias("score"))


_H = "list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'human')"
_G = "list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'gpt')"


@query("arr_08_first_values", f"SELECT sample_id, {_H}[1].value AS human, {_G}[1].value AS gpt FROM {CHAT}")
def first_values(spark, d):
    t = F.col("conversations")
    return _chat(spark, d).select("sample_id", C.first_value(t, "human").alias("human"), C.first_value(t, "gpt").alias("gpt"))


@query("arr_09_first_last", f"SELECT sample_id, {_H}[1].value AS human, {_G}[-1].value AS gpt FROM {CHAT}")
def first_last(spark, d):
    t = F.col("conversations")
    return _chat(spark, d).select("sample_id", C.first_value(t, "human").alias("human"), C.last_value(t, "gpt").alias("gpt"))


@query("arr_10_human_text", f"SELECT sample_id, coalesce(array_to_string(list_transform({_H}, lambda t: t.value), ' [下一轮] '), '') AS text FROM {CHAT} WHERE conversations IS NOT NULL")
def human_text(spark, d):
    return _chat(spark, d).where("conversations is not null").select("sample_id", C.human_text(F.col("conversations")).alias("text"))


_NORM = f"list_transform(list_filter(coalesce(conversations, []), lambda t: t.\"from\" IN ('system','human','gpt') AND trim(coalesce(t.value, ''), {EDGE}) <> ''), lambda t: {{'from': t.\"from\", 'value': trim(t.value, {EDGE})}})"


@query("arr_11_normalized", f"SELECT sample_id, CAST(len({_NORM}) AS INTEGER) AS turns, array_to_string(list_transform({_NORM}, lambda t: t.\"from\" || ':' || t.value), '|') AS text FROM {CHAT} WHERE conversations IS NOT NULL")
def normalized(spark, d):
    t = C.normalize_turns(F.col("conversations"))
    return _chat(spark, d).where("conversations is not null").select("sample_id", F.size(t).alias("turns"), F.array_join(F.transform(t, lambda x: F.concat_ws(":", x["from"], x["value"])), "|").alias("text"))


_ALTERNATE = f"""
WITH RECURSIVE n AS (SELECT sample_id, {_NORM} AS t FROM {CHAT}),
walk AS (
  SELECT sample_id, t, 0 AS i, 'human' AS want, CAST([] AS VARCHAR[]) AS out FROM n
  UNION ALL
  SELECT sample_id, t, i + 1, CASE WHEN t[i + 1]."from" = want THEN CASE want WHEN 'human' THEN 'gpt' ELSE 'human' END ELSE want END,
         CASE WHEN t[i + 1]."from" = want THEN list_append(out, t[i + 1].value) ELSE out END
  FROM walk WHERE i < len(t))
SELECT sample_id, CASE WHEN t[1]."from" = 'system' THEN t[1].value END AS system, CAST(len(out) - 1 AS INTEGER) AS history, out[-1] AS target
FROM walk WHERE i = len(t) AND len(out) >= 2 AND len(out) % 2 = 0"""


@query("arr_12_eval_sample", _ALTERNATE)
def eval_sample(spark, d):
    s = _chat(spark, d).select("sample_id", C.eval_sample(F.col("conversations")).alias("s")).where("s is not null")
    return s.select("sample_id", F.col("s.system").alias("system"), F.size("s.history").alias("history"), F.col("s.target").alias("target"))


_DIALOG = f"""SELECT sample_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '|') AS dialog FROM (
SELECT sample_id, turns, list_transform(list_filter(list_zip(r, v, range(1, len(r) + 1)), lambda x: x[1] = CASE WHEN x[3] % 2 = 1 THEN 'human' ELSE 'gpt' END AND x[3] < stop), lambda x: x[2]) AS l FROM (
SELECT *, coalesce(list_position(list_transform(r, lambda x: x IN ('human', 'gpt')), false), len(r) + 1) AS stop FROM (
SELECT sample_id, len(conversations) AS turns, list_transform(b, lambda t: coalesce(t."from", 'none')) AS r, list_transform(b, lambda t: t.value) AS v FROM (
SELECT sample_id, conversations, CASE WHEN conversations[1]."from" = 'system' THEN conversations[2:] ELSE conversations END AS b FROM {CHAT} WHERE conversations IS NOT NULL))))
WHERE turns >= 2 AND len(l) >= 2 AND len(l) % 2 = 0"""


@query("arr_13_dialog", _DIALOG)
def dialog(spark, d):
    s = _chat(spark, d).select("sample_id", C.dialog_pairs(F.col("conversations")).alias("l")).where("l is not null")
    return s.select("sample_id", F.size("l").alias("n"), F.array_join("l", "|").alias("dialog"))


@query("arr_14_last_pair", f"SELECT sample_id, {_H}[-1].value AS human, {_G}[-1].value AS gpt FROM {CHAT} WHERE len({_H}) > 0 AND len({_G}) > 0")
def last_pair(spark, d):
    t = F.col("conversations")
    out = _chat(spark, d).select("sample_id", C.last_value(t, "human").alias("human"), C.last_value(t, "gpt").alias("gpt"), F.size(C.values_of(t, "human")).alias("h"), F.size(C.values_of(t, "gpt")).alias("g"))
    return out.where("h > 0 and g > 0").select("sample_id", "human", "gpt")


@query("arr_15_carried_pairs", f"""SELECT session_id, req_no, last_value(CASE WHEN new_session THEN text END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY sent_at, req_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opening FROM {API}""")
def carried(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("sent_at", "req_no").rowsBetween(Window.unboundedPreceding, 0)
    return once(spark, d, "api_requests", "req_no").select("session_id", "req_no", F.last(F.when(F.col("new_session"), F.col("text")), ignorenulls=True).over(w).alias("opening"))


_VALUES = "list_transform(coalesce(conversations, []), lambda t: t.value)"


@query("arr_16_prompt", f"SELECT sample_id, array_to_string(list_transform({_VALUES}, lambda v, i: CASE WHEN i % 2 = 1 THEN '### Instruction:' || chr(10) || v || chr(10) || chr(10) || '### Response:' || chr(10) ELSE v || chr(10) || chr(10) END), '') AS prompt FROM {CHAT} WHERE len({_VALUES}) = 2 AND len(list_filter({_VALUES}, lambda v: v IS NULL)) = 0")
def prompt(spark, d):
    rows = _chat(spark, d).where("size(conversations) = 2 and not exists(conversations, t -> t.value is null)")
    return rows.select("sample_id", C.render(F.transform("conversations", lambda t: t["value"]), "alpaca", F.lit("")).alias("prompt"))


@query("arr_17_alpaca", f"SELECT record_id, CASE WHEN trim(coalesce(source, ''), {EDGE}) <> '' THEN query || chr(10) || chr(10) || source ELSE query END AS human, response AS gpt FROM {QA}")
def alpaca(spark, d):
    c = C.alpaca_conversation(F.col("query"), F.col("source"), F.col("response"))
    return _qa(spark, d).select("record_id", c[0]["value"].alias("human"), c[1]["value"].alias("gpt"))


@query("arr_18_preference", f"SELECT item_id, 'USER: ' || 'hi' || ' ASSISTANT:' || 'yes' || '</s>' || 'USER: ' || prompt || ' ASSISTANT:' AS prompt, reference AS chosen, generated AS rejected FROM {TESTS}")
def preference(spark, d):
    history = F.array(F.array(F.lit("hi"), F.lit("yes")))
    p = C.preference_row(F.lit(""), history, F.col("prompt"), F.col("reference"), F.col("generated"))
    return once(spark, d, "test_results", "item_id").select("item_id", p["prompt"].alias("prompt"), p["chosen"].alias("chosen"), p["rejected"].alias("rejected"))


@query("arr_19_rl_prompt", f"SELECT row_id, 'system:be brief|user:' || question AS messages FROM {RL}")
def rl_prompt(spark, d):
    m = C.rl_prompt("be brief", F.col("question"))
    return once(spark, d, "rl_samples", "row_id").select("row_id", F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("messages"))


@query("arr_20_blanked", f"SELECT sample_id, array_to_string(list_transform(conversations, lambda t, i: t.\"from\" || ':' || CASE WHEN i = len(conversations) THEN '' ELSE coalesce(t.value, '') END), '|') AS turns FROM {CHAT} WHERE len(conversations) > 0")
def blanked(spark, d):
    t = C.blanked_history(F.col("conversations"))
    return _chat(spark, d).where("size(conversations) > 0").select("sample_id", F.array_join(F.transform(t, lambda x: F.concat(x["from"], F.lit(":"), F.coalesce(x["value"], F.lit("")))), "|").alias("turns"))


def _codes(c: str):
    return F.transform(F.split(F.col(c), "(?<!^)(?!$)"), lambda x: F.ascii(x))


@query("arr_21_masked", f"SELECT row_id, CAST(least(length(question), s) + least(length(answer), t - 1) + 1 AS INTEGER) AS n, CAST(least(length(question), s) AS INTEGER) AS ignored FROM (SELECT row_id, question, answer, floor(64 * length(question) / (length(question) + length(answer))) AS s, floor(64 * length(answer) / (length(question) + length(answer))) AS t FROM {RL} WHERE length(answer) > 4 AND length(question) > 0)")
def masked(spark, d):
    rows = once(spark, d, "rl_samples", "row_id").where("length(answer) > 4 and length(question) > 0")
    m = C.masked_example(_codes("question"), _codes("answer"), 64, 0)
    return rows.select("row_id", m.alias("m")).select("row_id", F.size("m.input_ids").alias("n"), F.size(F.filter("m.labels", lambda x: x == -100)).alias("ignored"))


@query("arr_22_padded", f"SELECT row_id, CAST(max(length(question)) OVER (PARTITION BY row_id % 16) AS INTEGER) AS width FROM {RL}")
def padded(spark, d):
    from pyspark.sql import Window

    rows = once(spark, d, "rl_samples", "row_id").select("row_id", _codes("question").alias("ids"))
    width = F.max(F.size("ids")).over(Window.partitionBy(F.col("row_id") % 16))
    return rows.select("row_id", F.size(C.pad_right(F.col("ids"), width, 0)).alias("width"))


_BLOCK = 50


@query("arr_23_blocks", f"""WITH c AS (SELECT row_id % 8 AS batch, row_id, CAST(length(question) AS BIGINT) AS n FROM {RL} WHERE length(question) > 0), t AS (SELECT batch, sum(n) AS total FROM c GROUP BY 1)
SELECT batch, CAST(b AS BIGINT) AS block, CAST(CASE WHEN total < {_BLOCK} THEN total ELSE {_BLOCK} END AS INTEGER) AS n FROM (SELECT batch, total, unnest(range(0, CAST(CASE WHEN total < {_BLOCK} THEN 1 ELSE total // {_BLOCK} END AS BIGINT))) AS b FROM t)""")
def blocks(spark, d):
    rows = once(spark, d, "rl_samples", "row_id").where("length(question) > 0").select((F.col("row_id") % 8).alias("batch"), "row_id", _codes("question").alias("ids"))
    return C.pack_blocks(rows, "batch", "row_id", "ids", _BLOCK).select("batch", "block", F.size("ids").alias("n"))


_BLANK = "trim(coalesce(conversations[{0}].value, ''), " + EDGE + ") = ''"


@query("arr_24_turn_errors", f"SELECT sample_id, CASE WHEN conversations IS NULL THEN 'missing' WHEN len(conversations) <> 2 THEN 'count' WHEN conversations[1].\"from\" <> 'human' OR conversations[2].\"from\" <> 'gpt' THEN 'roles' WHEN {_BLANK.format(1)} OR {_BLANK.format(2)} THEN 'blank' END AS error FROM {CHAT}")
def turn_errors(spark, d):
    return _chat(spark, d).select("sample_id", C.turn_error(F.col("conversations")).alias("error"))


@query("map_01_defaults", f"SELECT req_no, coalesce(state.state_version, 'v5.4') AS state_version, coalesce(state.turn_count, 0) AS turn_count, coalesce(array_to_string(state.facts, '|'), '') AS facts FROM {API}")
def defaults(spark, d):
    rows = once(spark, d, "api_requests", "req_no")
    return rows.select("req_no", F.coalesce("state.state_version", F.lit("v5.4")).alias("state_version"), F.coalesce("state.turn_count", F.lit(0)).alias("turn_count"), F.coalesce(F.array_join("state.facts", "|"), F.lit("")).alias("facts"))


@query("map_02_counters", f"SELECT req_no, CAST(1 + CASE WHEN contains(text, '口干') THEN 1 ELSE 0 END AS INTEGER) AS dry_mouth, CAST(CASE WHEN contains(text, '头晕') THEN 1 ELSE 0 END AS INTEGER) AS dizzy FROM {API}")
def counters(spark, d):
    known = F.create_map(F.lit("口干"), F.lit(1), F.lit("头晕"), F.lit(0))
    hits = T.hits(F.col("text"), ("口干", "头晕", "乏力"))
    added = F.map_filter(F.map_from_arrays(hits, F.transform(hits, lambda _: F.lit(1))), lambda k, v: F.map_contains_key(known, k))
    m = F.map_zip_with(known, added, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return once(spark, d, "api_requests", "req_no").select("req_no", m["口干"].alias("dry_mouth"), m["头晕"].alias("dizzy"))
