"""Queries that write to the shared folder and read again, and the remaining operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import conversation as C
from corpusloom.functions import extensions as X
from corpusloom.functions import hashing as H
from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.operators import retrieval as V
from corpusloom.operators import selection as L
from corpusloom.operators import simjoin as J
from corpusloom.operators import vocabulary as W
from corpusloom.plans.catalog_relational import _norm_rl
from corpusloom.plans.catalog_systems import TOP, _measured, _top
from corpusloom.plans.catalog_text import RET, _shingles_sql
from corpusloom.plans.registry import API, QA, RL, TESTS, drop_sql, once, query, quoted, table
from corpusloom.session import shared_dir, stored
from corpusloom.sources import readers, writers
from corpusloom.streaming import slots


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nation(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


@query("src_02_failfast", NATION)
def failfast(spark, d):
    p = _place(spark, "jsonl")
    writers.write_jsonl(_nation(spark, d), p, [F.col("n_nationkey")])
    return readers.failfast_jsonl(spark, p, NATION_SCHEMA)


@query("src_03_strict_errors", "SELECT line_id, CASE WHEN payload IS NULL THEN 'not_a_string' WHEN NOT json_valid(payload) THEN 'invalid' END AS error FROM raw_records")
def strict_errors(spark, d):
    """Strict parse of every line of the pool; the codes of broken text are one here, tests tell them apart."""
    from corpusloom.functions.jsonx import strict_json_error

    error = strict_json_error(F.col("payload"))
    return table(spark, d, "raw_records").select("line_id", error.alias("e")).select("line_id", F.when(F.col("e").isin("invalid_json", "trailing_data"), "invalid").otherwise(F.col("e")).alias("error"))


@query("src_04_tree", NATION)
def tree(spark, d):
    p = _place(spark, "tree")
    _nation(spark, d).withColumn("part", F.col("n_regionkey")).write.partitionBy("part").json(p)
    return readers.json_tree(spark, p, NATION_SCHEMA, "*.json")


@query("src_05_text_corpus", f"SELECT DISTINCT question AS text FROM {RL} WHERE trim(question) <> '' AND NOT regexp_matches(question, '[\\r\\n]')")
def text_corpus(spark, d):
    p = _place(spark, "text")
    rows = once(spark, d, "rl_samples", "row_id").where(r"trim(question) <> '' and not question rlike '[\\r\\n]'")
    rows.select("question").distinct().write.text(p)
    return readers.text_corpus(spark, p)


@query("src_06_tsv", "SELECT CAST(n_nationkey AS VARCHAR) AS input, n_name AS output FROM nation")
def tsv(spark, d):
    p = _place(spark, "tsv")
    _nation(spark, d).select("n_nationkey", "n_name").write.csv(p, sep="\t", header=False)
    return readers.delimited(spark, p, ["input", "output"])


CURVE = f"SELECT CAST(item_id AS DOUBLE) AS step, bleu1 AS loss FROM {TESTS} WHERE bleu1 IS NOT NULL"


@query("src_07_curve_csv", CURVE)
def curve_csv(spark, d):
    p = _place(spark, "csv")
    rows = once(spark, d, "test_results", "item_id").where("bleu1 is not null").select(F.col("item_id").alias("step"), F.col("bleu1").alias("loss"))
    writers.write_csv(rows, p, ["step", "loss"])
    return readers.curve_csv(spark, p, ["step", "loss"])


@query("src_08_json_array", "SELECT CAST(n_nationkey AS INTEGER) AS pos, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS name FROM nation")
def json_array(spark, d):
    p = _place(spark, "array")
    item = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.struct("n_name"))).otherwise(F.to_json(F.array("n_name")))
    one = _nation(spark, d).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("i")))), lambda x: x["i"]), ",").alias("v"))  # 25 nations by the schema
    one.select(F.concat(F.lit("["), "v", F.lit("]")).alias("value")).write.text(p)
    return readers.json_array(spark, p).select("pos", F.get_json_object("item", "$.n_name").alias("name"))


@query("src_09_slice", f"SELECT record_id FROM {QA} ORDER BY record_id LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM {QA})")
def slice_percent(spark, d):
    return readers.slice_percent(once(spark, d, "qa_records", "record_id").select("record_id"), [F.col("record_id")], 5)


@query("src_14_denylist", f"SELECT DISTINCT sha256(text) AS digest FROM {API} WHERE text IS NOT NULL")
def denylist(spark, d):
    p = _place(spark, "deny")
    digests = once(spark, d, "api_requests", "req_no").where("text is not null").select(F.upper(F.sha2("text", 256)).alias("value"))
    digests.unionAll(spark.range(1).select(F.lit("# no digest"))).write.text(p)
    return readers.denylist(spark, p)


@query("snk_02_jsonl", NATION)
def jsonl(spark, d):
    p = _place(spark, "release")
    writers.write_jsonl(_nation(spark, d), p, [F.col("n_nationkey")], single=True)
    lines = readers.numbered_lines(spark, p)
    return lines.where(F.col("line") == F.get_json_object("value", "$.n_nationkey").cast("long") + 1).select(F.from_json("value", NATION_SCHEMA).alias("r")).select("r.*")


@query("snk_03_write_once", NATION)
def write_once(spark, d):
    p = _place(spark, "once")
    writers.write_once(_nation(spark, d), p)
    return spark.read.parquet(p)


@query("snk_04_manifest", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, sha256(n_name || chr(10)) AS digest FROM nation")
def manifest(spark, d):
    """One file for each nation; digests of the files as written."""
    p = _place(spark, "parts")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("part"), "n_name").repartition("part").write.partitionBy("part").text(p)
    files = writers.digests(spark, p).where(F.col("path").contains("/part="))
    return files.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("n_nationkey"), "digest")


@query("snk_08_head_digest", f"SELECT row_id, md5(left(answer, 4)) AS digest FROM {RL} WHERE regexp_matches(answer, '^[ -~]+$')")
def head_digest(spark, d):
    rows = once(spark, d, "rl_samples", "row_id").where("answer rlike '^[ -~]+$'")
    return rows.select("row_id", H.head_digest(F.encode("answer", "utf-8"), 4).alias("digest"))


@query("hsh_02_file_digest", "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation")
def file_digest(spark, d):
    p = _place(spark, "digest")
    table(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(p)
    return writers.digests(spark, p).where(F.col("path").endswith(".txt")).select("digest")


@query("udf_03_batches", f"SELECT row_id, CAST(length(question) AS BIGINT) AS n FROM {RL} WHERE question IS NOT NULL")
def batches(spark, d):
    rows = once(spark, d, "rl_samples", "row_id").where("question is not null").select("row_id", "question")
    return readers.batches(rows, lambda b: {"row_id": b["row_id"], "n": [len(q) for q in b["question"]]}, "row_id long, n long")


@query("udf_01_generator", f"SELECT row_id, '答：' || left(question, 5) AS prediction FROM {RL} WHERE question IS NOT NULL")
def generator(spark, d):
    rows = once(spark, d, "rl_samples", "row_id").where("question is not null").select("row_id", "question")
    return X.generated(rows, "question", lambda qs: ["答：" + q[:5] for q in qs]).select("row_id", "prediction")


@query("udf_04_rewards", f"SELECT row_id, CASE WHEN answer IS NULL THEN NULL ELSE 0.0 END AS reward_format FROM {RL}")
def reward_list(spark, d):
    return X.rewards(once(spark, d, "rl_samples", "row_id"), ["format"], "answer", "question").select("row_id", "reward_format")


@query("udf_05_template", f"SELECT row_id, 'Q:' || question || chr(10) || 'A:' AS prompt FROM {RL}")
def template(spark, d):
    C.register_template("qa", "Q:{query}\nA:", "\n")
    return once(spark, d, "rl_samples", "row_id").select("row_id", C.render(F.array("question"), "qa").alias("prompt"))


@query("evl_02_rouge")
def rouge(spark, d):
    return _measured(spark, d).select("item_id", "rouge_l", "rouge_l_char")


@query("evl_03_meteor")
def meteor(spark, d):
    return _measured(spark, d).select("item_id", "meteor")


@query("evl_14_convergence", f"SELECT last_median <= first_median AS converged FROM (SELECT median(CASE WHEN a <= 5 THEN loss END) AS first_median, median(CASE WHEN z <= 5 THEN loss END) AS last_median FROM (SELECT *, row_number() OVER (ORDER BY step) AS a, row_number() OVER (ORDER BY step DESC) AS z FROM ({CURVE})))")
def convergence(spark, d):
    from corpusloom.operators.evaluation import curve_summary

    rows = once(spark, d, "test_results", "item_id").where("bleu1 is not null").select(F.col("item_id").cast("double").alias("step"), F.col("bleu1").alias("loss"))
    return curve_summary(rows).select((F.col("last_median") <= F.col("first_median")).alias("converged"))


@query("agg_20_merged_vocabulary", f"SELECT term, CAST(min(source) AS INTEGER) AS source FROM (SELECT DISTINCT unnest(string_split({drop_sql('question', RET)}, '')) AS term, 0 AS source FROM {RL} UNION ALL SELECT DISTINCT unnest(string_split({drop_sql('answer', RET)}, '')), 1 FROM {RL}) WHERE term <> '' GROUP BY 1")
def merged(spark, d):
    rows = once(spark, d, "rl_samples", "row_id")

    def terms(c):
        return rows.select(F.explode(F.split(T.drop(F.col(c), RET), "")).alias("term")).where("term <> ''").distinct().withColumn("pos", F.xxhash64("term"))

    return W.merged([terms("question"), terms("answer")]).select("term", "source")


@query("vec_06_evidence", f"SELECT row_id, round(0.8 * (0.7 * cov + 0.3 * jac) + 0.2 * jac, 6) AS score FROM (SELECT row_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS cov, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS jac FROM (SELECT row_id, {_shingles_sql('question', 2, 'empty')} AS a, coalesce({_shingles_sql('answer', 2, 'empty')}, []) AS b FROM {RL} WHERE question IS NOT NULL))")
def evidence(spark, d):
    none = F.array().cast("array<string>")
    rows = once(spark, d, "rl_samples", "row_id").where("question is not null").select("row_id", T.shingles("question", 2, "empty").alias("a"), F.coalesce(T.shingles("answer", 2, "empty"), none).alias("b"))
    unasked = {k: F.lit(None).cast("double") for k in ("taste", "temperature", "meridian", "composition", "function")}
    return rows.select("row_id", F.round(V.evidence_score(F.lit("other"), unasked, F.col("a"), F.col("b")), 6).alias("score"))


@query("vec_04_probe", f"SELECT a AS query_id, CAST(lb AS VARCHAR) AS category, max(score) AS score FROM {TOP} WHERE place <= 20 GROUP BY 1, 2 HAVING max(score) >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY max(score) DESC, CAST(lb AS VARCHAR)) = 1")
def probe(spark, d):
    hits = _top(spark, d, 20).select(F.col("a").alias("query_id"), F.col("lb").cast("string").alias("category"), "score")
    return V.category_probe(hits, 0.3)


@query("sel_02_tighter_quota")
def tighter(spark, d):
    rows = stored(_norm_rl(spark, d).where("text <> ''"), "sel-02")
    edges = J.jaccard_join(rows, None, 0.8, 3)
    c = rows.select("id", F.lit("all").alias("category"), F.lit(None).cast("string").alias("rejected"))
    return L.greedy_quota(c, edges, [("train", "all", 10), ("heldout", "all", 5)])


@query("stm_02_slots", f"SELECT req_no, contains(text, '入睡') OR contains(text, '早醒') AS sleep, contains(text, '大便') AS stool FROM {API}")
def slot_flags(spark, d):
    s = R.slots_of(F.col("text"), {"sleep": ("入睡", "早醒"), "stool": ("大便",)})
    return once(spark, d, "api_requests", "req_no").select("req_no", F.array_contains(s, "sleep").alias("sleep"), F.array_contains(s, "stool").alias("stool"))


@query("stm_03_precedence", f"SELECT req_no, CASE WHEN regexp_matches(text, '便血') THEN 'urgent' WHEN state.state_version <> 'v5.4' THEN 'reset' ELSE 'ok' END AS status FROM {API}")
def precedence(spark, d):
    rules = [("urgent", F.col("text").rlike("便血")), ("reset", F.col("state.state_version") != "v5.4")]
    return once(spark, d, "api_requests", "req_no").select("req_no", R.priority(rules, "ok").alias("status"))


@query("orc_04_recount", f"SELECT model_tag, CAST(count(*) + 1 AS BIGINT) AS stated, CAST(count(*) AS BIGINT) AS actual FROM {TESTS} WHERE model_tag IS NOT NULL GROUP BY 1")
def recount(spark, d):
    rows = once(spark, d, "test_results", "item_id").where("model_tag is not null")
    return W.recount(rows, rows.groupBy("model_tag").agg((F.count("*") + 1).alias("n")), ["model_tag"])


@query("cls_11_concept_counts")
def concept_counts(spark, d):
    rows = once(spark, d, "api_requests", "req_no").select(R.concept_states(R.WARNING_CONCEPTS)("text").alias("s")).select("s.*")
    stacked = rows.select(F.expr(f"stack({len(R.WARNING_CONCEPTS)}, " + ", ".join(f"{quoted(c)}, {c}" for c in R.WARNING_CONCEPTS) + ") as (concept, state)"))
    return stacked.groupBy("concept", "state").agg(F.count("*").alias("n"))


@query("evl_05_micro", f"SELECT CAST(count(*) AS BIGINT) AS pairs FROM {TESTS} WHERE length(reference) > 0 AND length(generated) > 0")
def micro(spark, d):
    return _measured(spark, d).agg(F.count("*").alias("pairs"))


# --- sinks and sources by themselves -----------------------------------------------------------


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@query("snk_01_json", """SELECT '{' || chr(10) || string_agg('  "' || r_name || '": ' || r_regionkey, ',' || chr(10) ORDER BY r_name) || chr(10) || '}' || chr(10) AS text FROM region""")
def json_file(spark, d):
    p = _place(spark, "report") + ".json"
    writers.write_json(_local(p), {r["r_name"]: r["r_regionkey"] for r in table(spark, d, "region").collect()})  # a report
    return spark.read.text(p, wholetext=True).select(F.col("value").alias("text"))


@query("snk_05_csv", "SELECT n_name, n_nationkey FROM nation")
def csv_file(spark, d):
    p = _place(spark, "csv")
    writers.write_csv(_nation(spark, d), p, ["n_name", "n_nationkey"])
    return spark.read.csv(p, header=True, schema="n_name string, n_nationkey int")


@query("snk_06_markdown", f"SELECT '| split | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || split || ' | ' || n || ' |', chr(10) ORDER BY split) || chr(10) AS text FROM (SELECT split, count(*) AS n FROM {QA} WHERE split IS NOT NULL GROUP BY 1)")
def markdown_report(spark, d):
    counts = once(spark, d, "qa_records", "record_id").where("split is not null").groupBy("split").agg(F.count("*").alias("n")).orderBy("split")
    return spark.createDataFrame([(writers.markdown_table(counts),)], "text string")


@query("snk_07_checkpoints", f"SELECT item_id AS step FROM (SELECT item_id FROM {TESTS} WHERE bleu1 IS NOT NULL ORDER BY bleu1 DESC, item_id DESC LIMIT 2) UNION SELECT min(item_id) FROM {TESTS}")
def checkpoints(spark, d):
    h = once(spark, d, "test_results", "item_id").select(F.col("item_id").alias("step"), "bleu1")
    return L.retained_checkpoints(h, ["bleu1"], 2, current=h.agg(F.min("step")).first()[0])


@query("src_10_lazy", NATION)
def lazy_scan(spark, d):
    p = _place(spark, "lazy")
    writers.write_jsonl(_nation(spark, d), f"{p}/in", [F.col("n_nationkey")])
    stream = readers.lazy_files(spark, f"{p}/in", NATION_SCHEMA)
    stream.writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{p}/out")


@query("stm_02_slot_machine")
def slot_machine(spark, d):
    """Slot filling over every session, message by message."""
    return slots.replay(once(spark, d, "api_requests", "req_no").select("session_id", F.col("req_no").alias("seq"), "text"))


@query("udf_02_handlers", f"SELECT req_no, CAST(length(text) AS BIGINT) AS plain, CAST(length(text) + coalesce(state.turn_count, 0) AS BIGINT) AS stateful FROM {API} WHERE text IS NOT NULL")
def handlers(spark, d):
    rows = once(spark, d, "api_requests", "req_no").where("text is not null").select("req_no", "text", F.struct("state.turn_count").alias("s"), F.struct("state.turn_count").alias("t"))
    plain = X.handled(rows, lambda text: len(text), "text", "s", "plain")
    return X.handled(plain, lambda text, state: len(text) + int(state["turn_count"] or 0), "text", "t", "stateful").drop("text")
