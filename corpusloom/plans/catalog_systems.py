"""Queries of retrieval, evaluation, streaming, sources and sinks, and the curation pipeline."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.functions import conversation as C
from corpusloom.functions import metrics as M
from corpusloom.functions import text as T
from corpusloom.functions.jsonx import contract_error_column
from corpusloom.functions.similarity import normalized
from corpusloom.operators import evaluation as V
from corpusloom.operators import index as I
from corpusloom.operators import retrieval as R
from corpusloom.operators import simjoin as J
from corpusloom.plans.catalog_relational import _SIM, NORM, QA, TAX, TAX_V, VEC, _labelled, _vectors
from corpusloom.plans.catalog_rules import REASONS_SQL, reason_codes
from corpusloom.plans.catalog_text import TAGGED, _tagged, _training_sql
from corpusloom.plans.registry import CHAT, RL, TESTS, once, query, table
from corpusloom.session import shared_dir, stored
from corpusloom.sources import readers, writers
from corpusloom.streaming import sessions


def _tests(spark, d):
    return once(spark, d, "test_results", "item_id")


# --- retrieval ---------------------------------------------------------------------------------


@query("src_11_index_sizes", "SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS matched FROM embeddings")
def index_sizes(spark, d):
    e = table(spark, d, "embeddings")
    return readers.indexed_vectors(e.select("vec_id"), e.select("vec_id", "label"), "vec_id")


@query("vec_01_normalized", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)")
def unit(spark, d):
    from corpusloom.functions.similarity import dot

    v = table(spark, d, "embeddings").select("vec_id", normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


TOP = f"(SELECT x.id AS a, x.label AS la, y.id AS b, y.label AS lb, {_SIM} AS score, row_number() OVER (PARTITION BY x.id ORDER BY {_SIM} DESC, y.id) AS place FROM {VEC} x JOIN {VEC} y ON x.id % 50 = 0 AND x.id <> y.id)"


def _top(spark, d, k):
    v = _vectors(spark, d)
    t = J.cosine_nearest(v.where("id % 50 = 0"), v, k, same=True)
    labels = v.select("id", "label")
    return t.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")


@query("vec_03_top_k", f"SELECT a, b, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM {TOP} WHERE place <= 10")
def top_k(spark, d):
    return _top(spark, d, 10).select("a", "b", F.round("score", 6).alias("score"), "place")


@query("vec_05_hybrid", f"SELECT a, b, round(CASE WHEN la % 2 = 0 THEN 0.75 * score + 0.25 * (CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) ELSE score END, 6) AS score FROM {TOP} WHERE place <= 10")
def hybrid(spark, d):
    lexical = F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0)
    return _top(spark, d, 10).select("a", "b", F.round(R.hybrid_score(F.col("score"), lexical, F.when(F.col("la") % 2 == 0, F.col("la"))), 6).alias("score"))


GATED = f"(SELECT a, b, score, score - coalesce(nxt, 0.0) AS margin FROM (SELECT *, lead(score) OVER (PARTITION BY a ORDER BY place) AS nxt FROM {TOP} WHERE place <= 10) WHERE place = 1)"


def _gated(spark, d):
    from corpusloom.operators.selection import margin

    return margin(_top(spark, d, 10).select("a", "b", "score"), "a", "score", "b")


@query("vec_07_thresholds", f"SELECT a, b, score >= 0.65 AND margin >= 0.08 AS accepted, score >= 0.30 AND margin >= 0.03 AS lenient FROM {GATED}")
def thresholds(spark, d):
    s, m = F.col("score"), F.col("margin")
    return _gated(spark, d).select("a", "b", R.accepted(F.lit(None).cast("string"), s, m).alias("accepted"), R.accepted(F.lit("x"), s, m, {"": (0.65, 0.08), "x": (0.30, 0.03)}).alias("lenient"))


@query("vec_08_override", f"SELECT a, score >= 0.54 AND margin >= 0.08 AS herb, score >= 0.55 AND margin >= 0.05 AS other FROM {GATED}")
def override(spark, d):
    return _gated(spark, d).select("a", R.lexical_override(F.lit("herb"), F.col("score"), F.col("margin")).alias("herb"), R.lexical_override(F.lit("theory"), F.col("score"), F.col("margin")).alias("other"))


@query("vec_09_states", f"SELECT a, CASE WHEN a % 350 = 0 THEN 'structural_not_found' WHEN a % 450 = 0 THEN 'high' WHEN score >= 0.75 AND margin >= 0.03 THEN 'high' WHEN score >= 0.3 AND margin >= 0.03 THEN 'medium' WHEN margin < 0.005 THEN 'ambiguous' ELSE 'low' END AS confidence FROM {GATED}")
def states(spark, d):
    s, m = F.col("score"), F.col("margin")
    state = R.result_state(F.col("a") % 350 == 0, F.col("a") % 450 == 0, F.lit(False), s, (s >= 0.3) & (m >= 0.03), F.lit(False), m < 0.005)
    return _gated(spark, d).select("a", state["confidence"].alias("confidence"))


@query("vec_10_rescue")
def rescue(spark, d):
    g = _gated(spark, d)
    results = g.select(F.col("a").alias("query_id"), F.col("b").alias("doc_id"), (F.col("score") > 0.5).alias("found"), F.lit("low").alias("confidence"), F.lit("none").alias("method"), (F.col("a") % 100 == 0).alias("description"))
    evidence = _top(spark, d, 10).select(F.col("a").alias("query_id"), F.col("b").alias("doc_id"), (F.col("score") + 0.3).alias("evidence"))
    return R.rescue(results, evidence, 0.7, 0.02)


@query("vec_11_context")
def context(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.pack_chinese("text", 250)).alias("chunk", "text"))
    near = docs.where(F.contains("text", F.lit("用量"))).select("doc_id", "chunk", "text")
    from corpusloom.operators.selection import first_n

    top = first_n(near, ["doc_id"], [F.col("chunk")], 3).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("l"))  # three chunks
    return top.select("doc_id", T.truncated_context(F.transform("l", lambda x: x["text"]), F.lit("q"), 600).alias("context"))


# --- evaluation --------------------------------------------------------------------------------


def _measured(spark, d):
    return _tests(spark, d).where("length(reference) > 0 and length(generated) > 0").select("item_id", "model_tag", M.text_metrics("reference", "generated").alias("m")).select("item_id", "model_tag", "m.*")


@query("evl_01_text_metrics")
def text_metrics(spark, d):
    return _measured(spark, d)


@query("evl_05_metric_table")
def metric_table(spark, d):
    return _measured(spark, d).groupBy("model_tag").agg(*[V.rounded(F.avg(c)).alias(c) for c in M.FIELDS], F.count("*").alias("n"))


_LAB = f"(SELECT sample_id, v, json_extract_string(v, '$.action') || '/' || json_extract_string(v, '$.stage') AS label FROM {TAX_V} WHERE json_valid(v) AND json_type(v) = 'OBJECT')"
_OK = f"""(SELECT l.sample_id, l.label, coalesce(g.good = n.need, false) AS valid FROM {_LAB} l LEFT JOIN (SELECT label, count(*) AS need FROM {TAX} GROUP BY 1) n ON l.label = n.label
LEFT JOIN (SELECT f.sample_id, count(*) AS good FROM (SELECT sample_id, label, v, unnest(json_keys(v)) AS field FROM {_LAB}) f JOIN {TAX} t ON t.label = f.label AND t.field = f.field WHERE NOT regexp_matches(CAST(json_extract(f.v, '$.' || f.field) AS VARCHAR), '^(?:\\[\\]|"\\s*")$') GROUP BY 1) g ON l.sample_id = g.sample_id)"""


@query("cls_26_structure", f"SELECT sample_id, valid FROM {_OK}")
def structure(spark, d):
    rows = _labelled(spark, d)
    return V.structure_ok(rows, V.taxonomy(rows, "label", "v"), "sample_id", "label", "v")


@query("evl_06_structure_rates", f"SELECT label, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (WHERE valid) / count(*), 9) AS valid_rate FROM {_OK} GROUP BY 1")
def structure_rates(spark, d):
    rows = _labelled(spark, d)
    ok = V.structure_ok(rows, V.taxonomy(rows, "label", "v"), "sample_id", "label", "v").join(rows.select("sample_id", "label"), "sample_id")
    return ok.groupBy("label").agg(F.count("*").alias("n"), F.round(V.rate(F.count_if("valid"), F.count("*")), 9).alias("valid_rate"))


@query("evl_07_gate", f"SELECT split, CASE WHEN NOT bool_and(ok) THEN 'FAIL' WHEN bool_or(category LIKE 'summary%') THEN 'PENDING_MANUAL_REVIEW' ELSE 'PASS' END AS verdict FROM (SELECT split, category, coalesce(json_valid(list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'gpt')[1].value), true) AS ok FROM {CHAT}) GROUP BY 1")
def gate(spark, d):
    v = C.first_value(F.col("conversations"), "gpt")
    rows = once(spark, d, "chat_samples", "sample_id").select("split", "category", (v.isNull() | F.try_parse_json(v).isNotNull()).alias("ok"))
    return rows.groupBy("split").agg(V.gate([F.col("ok")], F.startswith("category", F.lit("summary"))).alias("verdict"))


@query("evl_08_worksheet", f"SELECT item_id AS index, sha256(prompt) AS query_sha256, sha256(generated) AS prediction_sha256, left(generated, 40) AS excerpt FROM {TESTS} ORDER BY item_id LIMIT 40")
def worksheet(spark, d):
    return _tests(spark, d).orderBy("item_id").limit(40).select(F.col("item_id").alias("index"), F.sha2("prompt", 256).alias("query_sha256"), F.sha2("generated", 256).alias("prediction_sha256"), F.left("generated", F.lit(40)).alias("excerpt"))


@query("evl_09_reason_summary", f"SELECT code, CAST(count(*) AS BIGINT) AS n, round(count(*) / any_value(total), 9) AS share FROM (SELECT unnest(codes) AS code, total FROM (SELECT {REASONS_SQL} AS codes, count(*) OVER () AS total FROM {QA})) GROUP BY 1")
def reason_summary(spark, d):
    rows = once(spark, d, "qa_records", "record_id").select(reason_codes().alias("codes"))
    total = rows.agg(F.count("*").alias("total"))
    n = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("code", "n", F.round(V.rate(F.col("n"), F.col("total")), 9).alias("share"))  # one row


@query("evl_10_dual", f"SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS passed FROM (SELECT 'raw' AS kind, length(generated) > 100 AS v FROM {TESTS} UNION ALL SELECT 'adapted', length(reference) > 100 FROM {TESTS}) GROUP BY 1")
def dual(spark, d):
    rows = _tests(spark, d).select((F.length("generated") > 100).alias("raw"), (F.length("reference") > 100).alias("adapted"))
    return rows.select(F.expr("stack(2, 'raw', raw, 'adapted', adapted) as (kind, v)")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("v").alias("passed"))


@query("evl_11_replay", f"SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differing, CAST(sum(length({_training_sql('generated')})) AS BIGINT) AS chars FROM {TESTS}")
def replay(spark, d):
    rows = _tests(spark, d)
    once_ = stored(rows.select("item_id", T.training_clean("generated").alias("clean")), "replay")
    return V.replayed(rows, "item_id", T.training_clean("generated"), once_, "clean")


@query("evl_12_prompt_parity", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE h = user_text_sha256) AS BIGINT) AS same FROM (SELECT user_text_sha256, sha256(list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'human')[1].value) AS h FROM {CHAT})")
def parity(spark, d):
    rows = once(spark, d, "chat_samples", "sample_id").select("user_text_sha256", F.sha2(C.first_value(F.col("conversations"), "human"), 256).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("h = user_text_sha256")).alias("same"))


@query("evl_13_format_reward", f"SELECT row_id, CASE WHEN c IS NULL THEN NULL WHEN regexp_matches(c, '^<think>.*?</think><answer>.*?</answer>$') THEN 1.0 ELSE 0.0 END AS reward FROM {TAGGED}")
def format_reward(spark, d):
    ok = T.follows_format("c")
    return _tagged(spark, d).select("row_id", F.when(ok, 1.0).when(~ok, 0.0).alias("reward"))


@query("evl_13_accuracy_reward", f"SELECT row_id, CAST(CASE WHEN regexp_matches(answer, '^[0-9]+$') AND CAST(a AS BIGINT) + CAST(b AS BIGINT) = TRY_CAST(answer AS BIGINT) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward FROM (SELECT row_id, answer, regexp_extract(question, '^([0-9]+)[+]([0-9]+)=', 1) AS a, regexp_extract(question, '^([0-9]+)[+]([0-9]+)=', 2) AS b FROM {RL} WHERE regexp_matches(question, '^[0-9]+[+][0-9]+='))")
def accuracy_reward(spark, d):
    q = once(spark, d, "rl_samples", "row_id").where("question rlike '^[0-9]+[+][0-9]+='")
    want = (F.regexp_extract("question", "^([0-9]+)", 1).cast("long") + F.regexp_extract("question", "[+]([0-9]+)=", 1).cast("long")).cast("string")
    return q.select("row_id", M.accuracy_rewards("answer", want).alias("reward"))


@query("evl_15_step_plan", "SELECT c_custkey, ceil(ceil(n / 4) / 8) AS updates, ceil(ceil(n / 4) / 8) * 3 AS total FROM (SELECT c_custkey, CAST(c_acctbal + 1000 AS BIGINT) AS n FROM customer WHERE c_acctbal = floor(c_acctbal) OR true)".replace("CAST(c_acctbal + 1000 AS BIGINT)", "CAST(c_custkey * 37 AS BIGINT)"))
def step_plan(spark, d):
    p = V.step_plan(F.col("c_custkey") * 37, 4, 8, 3)
    return table(spark, d, "customer").select("c_custkey", p["updates_per_epoch"].cast("double").alias("updates"), p["total"].cast("double").alias("total"))


@query("orc_05_contract_audit")
def contract_audit(spark, d):
    v = C.first_value(F.col("conversations"), "gpt")
    rows = once(spark, d, "chat_samples", "sample_id").select("category", contract_error_column(v).alias("error"))
    return rows.groupBy("category", "error").agg(F.count("*").alias("n"))


# --- state and streams -------------------------------------------------------------------------

KEY = b"test-key"


def _messages(rows):
    return rows.select("session_id", F.col("req_no").alias("seq"), "text", "new_session")


@query("stm_01_session_states")
def session_states(spark, d):
    return sessions.replay(_messages(once(spark, d, "api_requests", "req_no")), KEY).select("session_id", "seq", "status", "turn_count", F.size("facts").alias("facts"))


@query("stm_06_stream_counts", "SELECT split, CAST(count(*) AS BIGINT) AS n FROM qa_records GROUP BY 1")
def stream_counts(spark, d):
    src = table(spark, d, "qa_records")
    folder = str(Path(f"{d}/qa_records.parquet").parent)
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false")
    path = f"{d}/qa_records.parquet"
    one = stream.parquet(path) if Path(path).is_dir() else spark.readStream.schema(src.schema).option("pathGlobFilter", "qa_records.parquet").parquet(folder)
    out = f"{shared_dir(spark)}/stream-{id(one)}-{Path(tempfile.mktemp()).name}"
    one.select("split").writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("split").agg(F.count("*").alias("n"))


@query("add_01_session_windows", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e) SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1")
def windows(spark, d):
    w = sessions.session_windows(table(spark, d, "events"))
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


# --- sources and sinks -------------------------------------------------------------------------


@query("src_01_jsonl_round_trip", "SELECT line_id, payload IS NOT NULL AS there FROM raw_records WHERE payload IS NOT NULL AND trim(payload) <> '' AND NOT contains(payload, chr(10))")
def round_trip(spark, d):
    rows = table(spark, d, "raw_records").where("payload is not null and trim(payload) <> '' and not contains(payload, '\\n')").select("line_id", "payload")
    out = f"{shared_dir(spark)}/jsonl-{Path(tempfile.mktemp()).name}"
    writers.write_jsonl(rows, out, [F.col("line_id")])
    back = readers.tolerant_jsonl(spark, out, "line_id long, payload string")
    return back.select("record.line_id", F.col("record.payload").isNotNull().alias("there"))


@query("src_12_markup_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}。，；：？！、.,;:?!()（）\\s-]', '', 'g') AS text FROM documents WHERE text IS NOT NULL AND lang = 'zh') WHERE trim(text) <> ''")
def markup_text(spark, d):
    """Every Chinese document written as a page with markup to a file each, extracted again."""
    docs = table(spark, d, "documents").where("text is not null and lang = 'zh'").select("doc_id", F.regexp_replace("text", r"[^\p{L}\p{N}。，；：？！、.,;:?!()（）\s-]", "").alias("text")).where(F.trim("text") != "")
    page = F.concat(F.lit("<html><style>b{}</style><script>no()</script><p id=d>"), "doc_id", F.lit("</p>&nbsp;<body>"), F.regexp_replace("text", r"[\r\n\u0085\u2028\u2029]", "<br/> "), F.lit("</body></html>"))
    out = f"{shared_dir(spark)}/pages-{Path(tempfile.mktemp()).name}"
    docs.select(page.alias("page")).write.text(out)
    read = spark.read.text(out).select(F.regexp_extract("value", "<p id=d>([0-9]+)</p>", 1).cast("long").alias("doc_id"), F.regexp_extract("value", "(?s)<body>(.*)</body>", 1).alias("body"))
    return read.select("doc_id", readers.html_text(F.concat(F.lit("<b>"), "body", F.lit("</b>"))).alias("text"))


@query("ded_02_accepted")
def accepted_near(spark, d):
    """Greedy near deduplication of the rows that the curation accepts."""
    from corpusloom.plans.curation import near_free

    return near_free(once(spark, d, "qa_records", "record_id"))


# --- pipeline ----------------------------------------------------------------------------------


@query("pipe_01_curation", f"""WITH n AS (SELECT record_id, source, {REASONS_SQL} AS codes, {NORM} AS norm FROM {QA}),
f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY record_id) AS k FROM n WHERE len(codes) = 0),
s AS (SELECT record_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || record_id)) AS place, count(*) OVER (PARTITION BY source) AS total FROM f WHERE k = 1),
o AS (SELECT n.record_id, CASE WHEN len(n.codes) > 0 THEN n.codes[1] WHEN f.k > 1 THEN 'duplicate' WHEN s.place <= (CASE WHEN total <= 1 THEN 0 ELSE least(greatest(CAST(round_even(total * 0.2, 0) AS BIGINT), 1), total - 1) END) THEN 'heldout' ELSE 'train' END AS outcome FROM n LEFT JOIN f USING (record_id) LEFT JOIN s USING (record_id))
SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1""")
def curation(spark, d):
    """Normalize, judge with reason codes, drop duplicates, split by source, count outcomes."""
    from corpusloom.plans.curation import outcomes

    return outcomes(once(spark, d, "qa_records", "record_id")).groupBy("outcome").agg(F.count("*").alias("n"))




@query("vec_12_index_recall", f"SELECT CAST(count(*) AS BIGINT) AS queries, true AS enough FROM ({VEC}) WHERE id % 50 = 0")
def index_recall(spark, d):
    """Every vector indexed; the 10 nearest of every 50th against the whole product: a recall of 0.9 or more."""
    vectors = _vectors(spark, d)
    asked = vectors.where("id % 50 = 0")
    found = stored(I.search(I.build_index(vectors), asked, 10), "index-found")
    truth = J.cosine_nearest(asked, vectors, 10, same=True)
    share = I.recall(found, truth)
    return found.select("a").distinct().agg(F.count("*").alias("queries")).withColumn("enough", F.lit(share >= 0.9))
