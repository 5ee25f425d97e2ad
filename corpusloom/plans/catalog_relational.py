"""Queries of joins, aggregates, windows, samples, set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.similarity import dot
from corpusloom.operators import dedup as D
from corpusloom.operators import evaluation as V
from corpusloom.operators import selection as L
from corpusloom.operators import simjoin as J
from corpusloom.plans.catalog_rules import REASONS_SQL, reason_codes
from corpusloom.plans.catalog_text import CORPUS, RET, _shingles_sql
from corpusloom.plans.registry import API, CHAT, QA, RL, TESTS, drop_sql, nfkc_sql, once, query, quoted, table


def _qa(spark, d):
    return once(spark, d, "qa_records", "record_id")


def _chat(spark, d):
    return once(spark, d, "chat_samples", "sample_id")


def _rl(spark, d):
    return once(spark, d, "rl_samples", "row_id")


def _tests(spark, d):
    return once(spark, d, "test_results", "item_id")


NORM = drop_sql(f"lower({nfkc_sql('query')})", CORPUS)
PAIR = drop_sql("lower(coalesce(query, ''))", RET) + " || '␟' || " + drop_sql("lower(coalesce(response, ''))", RET)


def _normed(spark, d):
    return _normal_forms(_qa(spark, d))


def _normal_forms(qa):
    pair = F.concat(T.retriever_normalize("query"), F.lit("␟"), T.retriever_normalize("response"))
    return qa.select("record_id", "split", "source", "query", "response", T.normalize_text("query").alias("query_norm"), pair.alias("pair_norm"))


def _redelivered(spark, d):
    """id, split, query_norm, pair_norm with redelivered rows, for operators that count a key once."""
    return _normal_forms(table(spark, d, "qa_records")).select(F.col("record_id").alias("id"), "split", "query_norm", "pair_norm")


N = f"(SELECT record_id, split, source, query, response, {NORM} AS query_norm, {PAIR} AS pair_norm FROM {QA})"

# --- joins -------------------------------------------------------------------------------------

REF = f"(SELECT record_id AS line, query_norm, pair_norm FROM {N} WHERE split = 'train')"


@query("join_01_first_reference", f"SELECT n.record_id AS id, coalesce(q.line, p.line) AS ref_line, CASE WHEN q.line IS NOT NULL THEN 'query' WHEN p.line IS NOT NULL THEN 'pair' END AS matched FROM {N} n LEFT JOIN (SELECT query_norm, min(line) AS line FROM {REF} GROUP BY 1) q USING (query_norm) LEFT JOIN (SELECT pair_norm, min(line) AS line FROM {REF} GROUP BY 1) p USING (pair_norm) WHERE n.split IN ('development', 'heldout')")
def first_reference(spark, d):
    n = _normed(spark, d)
    ref = n.where("split = 'train'").select(F.col("record_id").alias("line"), "query_norm", "pair_norm")
    return D.exact_reference(n.where("split in ('development', 'heldout')").select(F.col("record_id").alias("id"), "query_norm", "pair_norm"), ref)


@query("join_02_anti", f"SELECT record_id FROM {N} WHERE split = 'train' AND query_norm NOT IN (SELECT query_norm FROM {N} WHERE split IN ('development', 'heldout') AND query_norm IS NOT NULL)")
def anti(spark, d):
    n = _normed(spark, d)
    return D.not_in(n.where("split = 'train'"), n.where("split in ('development', 'heldout')"), "query_norm").select("record_id")


@query("join_03_overlap", f"SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT DISTINCT query_norm FROM {N} WHERE split = 'train' INTERSECT SELECT query_norm FROM {N} WHERE split = 'heldout')")
def overlap(spark, d):
    n = _normed(spark, d)
    return D.overlap(n.where("split = 'train'"), n.where("split = 'heldout'"), "query_norm")


def _norm_rl(spark, d):
    return _rl(spark, d).select(F.col("row_id").alias("id"), T.retriever_normalize("question").alias("text"))


RLN = f"(SELECT row_id AS id, {drop_sql(chr(108) + 'ower(coalesce(question, ' + quoted('') + '))', RET)} AS text FROM {RL})"
RLG = f"(SELECT id, text, {_shingles_sql('text', 3, 'whole')} AS g FROM {RLN})"
RL_EDGES = f"(SELECT a, b, i / (na + nb - i) AS score FROM (SELECT x.id AS a, y.id AS b, len(x.g) AS na, len(y.g) AS nb, len(list_intersect(x.g, y.g)) AS i FROM {RLG} x JOIN {RLG} y ON x.id < y.id WHERE len(x.g) > 0 AND len(y.g) > 0))"


@query("join_04_jaccard", f"SELECT a, b, round(score, 9) AS score FROM {RL_EDGES} WHERE score >= 0.6")
def jaccard(spark, d):
    return J.jaccard_join(_norm_rl(spark, d), None, 0.6, 3).select("a", "b", F.round("score", 9).alias("score"))


@query("join_04_jaccard_references", f"SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 9) AS score FROM (SELECT * FROM {RLG} WHERE id % 2 = 0) x JOIN (SELECT * FROM {RLG} WHERE id % 2 = 1) y ON len(list_intersect(x.g, y.g)) >= 0.7 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) - 1e-9 WHERE len(x.g) > 0 AND len(y.g) > 0")
def jaccard_references(spark, d):
    n = _norm_rl(spark, d)
    return J.jaccard_join(n.where("id % 2 = 0"), n.where("id % 2 = 1"), 0.7, 3).select("a", "b", F.round("score", 9).alias("score"))


@query("join_05_nearest_reference", f"SELECT x.id AS a, arg_max({{'b': y.id}}, (round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 12), -y.id)).b AS b, round(max(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))), 9) AS score FROM (SELECT * FROM {RLG} WHERE id % 2 = 0) x JOIN (SELECT * FROM {RLG} WHERE id % 2 = 1) y ON len(list_intersect(x.g, y.g)) > 0 GROUP BY 1")
def nearest_reference(spark, d):
    n = _norm_rl(spark, d)
    return J.nearest(J.shared_grams(n.where("id % 2 = 0"), n.where("id % 2 = 1"), 3)).withColumn("score", F.round("score", 9))


PARTS_SQL = "(SELECT DISTINCT regexp_extract(question, '^(.{2,8}?)(?:由哪些药组成|常与什么同放|是怎样处理的|时会记录)', 1) AS name FROM rl_samples WHERE length(regexp_extract(question, '^(.{2,8}?)(?:由哪些药组成|常与什么同放|是怎样处理的|时会记录)', 1)) >= 2)"


def _names(spark, d):
    return table(spark, d, "rl_samples").select(F.regexp_extract("question", "^(.{2,8}?)(?:由哪些药组成|常与什么同放|是怎样处理的|时会记录)", 1).alias("name"))


def _mentions(spark, d):
    return J.contains_join(_qa(spark, d).select(F.col("record_id").alias("id"), F.col("query").alias("text")), _names(spark, d))


MENTIONS = f"(SELECT record_id AS id, name FROM {QA} JOIN {PARTS_SQL} ON contains(query, name))"


@query("join_06_mentions", f"SELECT id, name FROM {MENTIONS}")
def mentions(spark, d):
    return _mentions(spark, d)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


VEC = "(SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_SIM = "list_inner_product(x.vec, y.vec)"


@query("join_07_cosine", f"SELECT a, b, round(score, 6) AS score FROM (SELECT x.id AS a, y.id AS b, {_SIM} AS score FROM {VEC} x JOIN {VEC} y ON x.id % 50 = 0 AND x.id <> y.id) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1")
def cosine(spark, d):
    v = _vectors(spark, d)
    return J.cosine_nearest(v.where("id % 50 = 0"), v, 1, same=True).select("a", "b", F.round("score", 6).alias("score"))


@query("join_08_aligned", f"SELECT coalesce(r.i, p.i) AS index, CASE WHEN r.i IS NULL THEN 'no_reference' WHEN p.i IS NULL THEN 'no_prediction' ELSE 'matched' END AS bound FROM (SELECT item_id AS i FROM {TESTS} WHERE length(reference) > 100) r FULL JOIN (SELECT item_id AS i FROM {TESTS} WHERE length(generated) > 100) p ON r.i = p.i")
def aligned(spark, d):
    t = _tests(spark, d)
    return V.aligned(t.where("length(reference) > 100").select(F.col("item_id").alias("index"), "reference"), t.where("length(generated) > 100").select(F.col("item_id").alias("index"), "generated")).select("index", "bound")


@query("join_09_bound_reviews", f"SELECT item_id AS index, CASE WHEN item_id % 5 = 0 THEN 'query_changed' WHEN item_id % 7 = 0 THEN 'no_verdict' END AS error FROM {TESTS} WHERE generated IS NOT NULL")
def bound_reviews(spark, d):
    t = _tests(spark, d).where("generated is not null")
    cases = t.select(F.col("item_id").alias("index"), F.col("prompt").alias("query"), F.col("generated").alias("prediction"), F.col("model_tag").alias("label"))
    reviews = t.select(F.col("item_id").alias("index"), F.sha2(F.when(F.col("item_id") % 5 == 0, F.concat("prompt", F.lit("x"))).otherwise(F.col("prompt")), 256).alias("query_sha256"), F.sha2("generated", 256).alias("prediction_sha256"), F.col("model_tag").alias("label"), F.when(F.col("item_id") % 7 == 0, "").otherwise("ok").alias("verdict"), F.array(F.left("generated", F.lit(5))).alias("evidence"))
    return V.bind_reviews(cases, reviews)


@query("join_10_manifest", f"SELECT CAST(coalesce(e.k, a.k) AS VARCHAR) AS path, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN e.d <> a.d THEN 'mismatched' ELSE 'same' END AS status FROM (SELECT sample_id AS k, user_text_sha256 AS d FROM {CHAT} WHERE user_text_sha256 IS NOT NULL) e FULL JOIN (SELECT sample_id AS k, sha256(list_filter(conversations, lambda t: t.\"from\" = 'human')[1].value) AS d FROM {CHAT} WHERE list_filter(conversations, lambda t: t.\"from\" = 'human')[1].value IS NOT NULL) a ON e.k = a.k")
def manifest(spark, d):
    from corpusloom.functions.conversation import first_value

    c = _chat(spark, d)
    e = c.where("user_text_sha256 is not null").select(F.col("sample_id").cast("string").alias("path"), F.col("user_text_sha256").alias("digest"))
    a = c.select(F.col("sample_id").cast("string").alias("path"), F.sha2(first_value(F.col("conversations"), "human"), 256).alias("digest")).where("digest is not null")
    return V.manifest_diff(e, a)


@query("join_11_trace", f"WITH r AS (SELECT split, sample_id, category, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS n FROM {CHAT} WHERE split IS NOT NULL) SELECT a.split, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE a.category = b.category) AS BIGINT) AS same_category FROM r a JOIN r b ON a.split = b.split AND a.n = b.n - 1 GROUP BY 1")
def trace(spark, d):
    w = Window.partitionBy("split").orderBy("sample_id")
    r = _chat(spark, d).where("split is not null").select("split", "category", F.row_number().over(w).alias("n"))
    nxt = r.select("split", (F.col("n") - 1).alias("n"), F.col("category").alias("other"))
    return r.join(nxt, ["split", "n"]).groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.expr("category = other")).alias("same_category"))


@query("join_12_dimension", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    dims = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return c.join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")  # 25 nations by the schema


@query("join_13_upper_triangle", f"SELECT count(*) AS pairs, round(max(score), 9) AS best FROM {RL_EDGES} WHERE score >= 0.5")
def upper_triangle(spark, d):
    return J.pair_summary(_norm_rl(spark, d), 0.5, 3).select("pairs", F.round("best", 9).alias("best"))


# --- aggregates --------------------------------------------------------------------------------


@query("agg_01_counts", f"SELECT split, category, CAST(count(*) AS BIGINT) AS n FROM {CHAT} GROUP BY ROLLUP (split, category)")
def counts(spark, d):
    return _chat(spark, d).rollup("split", "category").agg(F.count("*").alias("n"))


@query("agg_02_reason_counts", f"SELECT code, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE code = codes[1]) AS BIGINT) AS primary_n FROM (SELECT codes, unnest(codes) AS code FROM (SELECT {REASONS_SQL} AS codes FROM {QA})) GROUP BY 1")
def reason_counts(spark, d):
    c = _qa(spark, d).select(reason_codes().alias("codes")).select("codes", F.explode("codes").alias("code"))
    return c.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("code") == F.col("codes")[0]).alias("primary_n"))


@query("agg_03_rates", f"SELECT split, CASE WHEN n = 0 THEN NULL ELSE round(h / n, 9) END AS null_rate, CASE WHEN n = 0 THEN 0.0 ELSE round(h / n, 9) END AS zero_rate, CASE WHEN n = 0 THEN 1.0 ELSE round(h / n, 9) END AS one_rate FROM (SELECT split, count(*) FILTER (WHERE length(response) > 100) AS h, count(*) FILTER (WHERE source = 'pool_ward_001') AS n FROM {QA} GROUP BY 1)")
def rates(spark, d):
    g = _qa(spark, d).groupBy("split").agg(F.count_if(F.expr("length(response) > 100")).alias("h"), F.count_if(F.expr("source = 'pool_ward_001'")).alias("n"))
    h, n = F.col("h"), F.col("n")
    return g.select("split", F.round(V.rate(h, n), 9).alias("null_rate"), F.round(V.rate(h, n, 0.0), 9).alias("zero_rate"), F.round(V.rate(h, n, 1.0), 9).alias("one_rate"))


@query("agg_04_conditional", f"SELECT source, CAST(count(*) FILTER (WHERE contains(query, '没有')) AS BIGINT) AS negated, CAST(count(*) FILTER (WHERE response IS NULL) AS BIGINT) AS unanswered FROM {QA} GROUP BY 1")
def conditional(spark, d):
    return _qa(spark, d).groupBy("source").agg(F.count_if(F.contains("query", F.lit("没有"))).alias("negated"), F.count_if(F.expr("response is null")).alias("unanswered"))


@query("agg_05_gate", f"SELECT split, bool_and(length(query) > 10) AS every_long, bool_or(response IS NULL) AS any_null FROM {QA} GROUP BY 1")
def gate(spark, d):
    return _qa(spark, d).groupBy("split").agg(F.bool_and(F.length("query") > 10).alias("every_long"), F.bool_or(F.col("response").isNull()).alias("any_null"))


@query("agg_06_overall_best", f"SELECT a, b, round(score, 9) AS score FROM (SELECT a, b, round(score, 12) AS score FROM {RL_EDGES}) WHERE score >= 0.6 ORDER BY score DESC, a, b LIMIT 1")
def overall_best(spark, d):
    e = J.first_pairs(_norm_rl(spark, d), 0.6, 3).withColumn("score", F.round("score", 12))
    return J.overall_best(e).withColumn("score", F.round("score", 9))


@query("agg_07_nearest", f"SELECT x.id AS a, arg_max(y.id, {_SIM}) AS b, round(max({_SIM}), 6) AS score FROM {VEC} x JOIN {VEC} y ON x.id % 50 = 0 AND y.label <> x.label GROUP BY 1")
def nearest(spark, d):
    v = _vectors(spark, d)
    return J.cosine_nearest(v.where("id % 50 = 0"), v, 1, other="label").select("a", "b", F.round("score", 6).alias("score"))


@query("agg_08_near_pairs", f"SELECT CAST(count(*) AS BIGINT) AS near FROM {RL_EDGES} WHERE score >= 0.8")
def near_pairs(spark, d):
    return J.jaccard_join(_norm_rl(spark, d), None, 0.8, 3).agg(F.count("*").alias("near"))


@query("agg_09_distinct", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT query_norm) AS BIGINT) AS distinct_n, CAST(count(query_norm) - count(DISTINCT query_norm) AS BIGINT) AS duplicates FROM {N}")
def distinct(spark, d):
    per = _normed(spark, d).groupBy("query_norm").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count("query_norm").alias("distinct_n"), F.sum(F.when(F.col("query_norm").isNotNull(), F.col("c") - 1)).alias("duplicates"))


@query("agg_10_mean", f"SELECT model_tag, round_even(avg(CAST(bleu1 AS DECIMAL(18, 9))), 4) AS bleu1, CAST(count(bleu1) AS BIGINT) AS n FROM {TESTS} GROUP BY 1")
def mean(spark, d):
    return _tests(spark, d).groupBy("model_tag").agg(V.rounded(F.avg("bleu1")).alias("bleu1"), F.count("bleu1").alias("n"))


CURVE = f"(SELECT item_id AS step, bleu1 AS loss FROM {TESTS} WHERE bleu1 IS NOT NULL)"


@query("agg_11_curve", f"SELECT round(median(CASE WHEN a <= 5 THEN loss END), 9) AS first_median, round(median(CASE WHEN z <= 5 THEN loss END), 9) AS last_median, min(loss) AS min_loss, arg_min(step, (loss, step)) AS min_step, round(100 * (median(CASE WHEN z <= 5 THEN loss END) - median(CASE WHEN a <= 5 THEN loss END)) / median(CASE WHEN a <= 5 THEN loss END), 6) AS change_percent FROM (SELECT *, row_number() OVER (ORDER BY step) AS a, row_number() OVER (ORDER BY step DESC) AS z FROM {CURVE})")
def curve(spark, d):
    c = _tests(spark, d).where("bleu1 is not null").select(F.col("item_id").alias("step"), F.col("bleu1").alias("loss"))
    s = V.curve_summary(c)
    return s.select(F.round("first_median", 9).alias("first_median"), F.round("last_median", 9).alias("last_median"), "min_loss", "min_step", F.round("change_percent", 6).alias("change_percent"))


TAX_V = f"(SELECT sample_id, list_filter(coalesce(conversations, []), lambda t: t.\"from\" = 'gpt')[1].value AS v FROM {CHAT})"
_KIND = "CASE json_type(json_extract(v, '$.' || f)) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
TAX = f"""(SELECT label, f AS field, min(kind) AS type, CAST(any_value(samples) AS BIGINT) AS samples FROM (SELECT label, f, {_KIND} AS kind, samples FROM (SELECT *, unnest(json_keys(v)) AS f FROM (SELECT v, json_extract_string(v, '$.action') || '/' || json_extract_string(v, '$.stage') AS label, count(*) OVER (PARTITION BY json_extract_string(v, '$.action') || '/' || json_extract_string(v, '$.stage')) AS samples FROM {TAX_V} WHERE json_valid(v) AND json_type(v) = 'OBJECT') WHERE label IS NOT NULL)) GROUP BY 1, 2 HAVING count(*) = any_value(samples) AND min(kind) = max(kind))"""


def _labelled(spark, d):
    from corpusloom.functions.conversation import first_value

    v = _chat(spark, d).select("sample_id", first_value(F.col("conversations"), "gpt").alias("v")).where("try_parse_json(v) is not null and v rlike '^\\\\s*\\\\{'")
    return v.select("sample_id", "v", F.concat(F.get_json_object("v", "$.action"), F.lit("/"), F.get_json_object("v", "$.stage")).alias("label"))


@query("agg_12_taxonomy", f"SELECT label, field, type, samples FROM {TAX}")
def taxonomy(spark, d):
    return V.taxonomy(_labelled(spark, d), "label", "v")


@query("agg_13_probe", f"SELECT a AS query_id, CAST(label AS BIGINT) AS category, round(score, 6) AS score FROM (SELECT a, label, max(score) AS score FROM (SELECT x.id AS a, y.id AS b, y.label, {_SIM} AS score FROM {VEC} x JOIN {VEC} y ON x.id % 50 = 0 AND x.id <> y.id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {_SIM} DESC, y.id) <= 10) GROUP BY 1, 2) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, label) = 1")
def probe(spark, d):
    from corpusloom.operators.retrieval import category_probe

    v = _vectors(spark, d)
    hits = J.cosine_nearest(v.where("id % 50 = 0"), v, 10, same=True).join(v.select(F.col("id").alias("b"), F.col("label").cast("long").alias("category")), "b").select(F.col("a").alias("query_id"), "category", "score")
    return category_probe(hits, 0.3).select("query_id", "category", F.round("score", 6).alias("score"))


@query("agg_14_perplexity", f"SELECT model_tag, round(exp(avg(bleu1)), 6) AS perplexity FROM {TESTS} GROUP BY 1")
def perplexity(spark, d):
    return _tests(spark, d).groupBy("model_tag").agg(F.round(V.perplexity(F.col("bleu1")), 6).alias("perplexity"))


@query("agg_15_errors", "SELECT l_returnflag, round(avg(pow(l_discount - l_tax, 2)), 9) AS mse, round(avg(abs(l_discount - l_tax)), 9) AS mae FROM lineitem GROUP BY 1")
def errors(spark, d):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(e * e), 9).alias("mse"), F.round(F.avg(F.abs(e)), 9).alias("mae"))


@query("agg_16_token_accuracy", f"SELECT round(avg(CASE WHEN p = l THEN 1.0 ELSE 0.0 END), 9) AS accuracy, CAST(count(*) AS BIGINT) AS tokens FROM (SELECT unnest(string_split(left(g, n - 1), '')) AS p, unnest(string_split(right(r, n - 1), '')) AS l FROM (SELECT left(generated, CAST(least(length(generated), length(reference)) AS BIGINT)) AS g, left(reference, CAST(least(length(generated), length(reference)) AS BIGINT)) AS r, CAST(least(length(generated), length(reference)) AS BIGINT) AS n FROM {TESTS} WHERE length(generated) > 1 AND length(reference) > 1)) WHERE l <> '，'")
def token_accuracy(spark, d):
    rows = _tests(spark, d).where("length(generated) > 1 and length(reference) > 1")
    n = F.least(F.length("generated"), F.length("reference"))

    def codes(c):
        return F.transform(F.split(F.left(c, n), "(?<!^)(?!$)"), lambda x: F.when(x == "，", F.lit(-100)).otherwise(F.ascii(x)))

    raw = rows.select(F.transform(F.split(F.left("generated", n), "(?<!^)(?!$)"), lambda x: F.ascii(x)).alias("p"), codes("reference").alias("l"))
    return V.token_accuracy(raw, "p", "l").withColumn("accuracy", F.round("accuracy", 9))


@query("agg_17_lengths", f"SELECT round(median(length(query)), 6) AS median_length, round(quantile_cont(length(query), 0.95), 6) AS p95, CAST(count(*) FILTER (WHERE length(query) > 240) AS BIGINT) AS too_long FROM {QA}")
def lengths(spark, d):
    n = F.length("query")
    return _qa(spark, d).agg(F.round(F.median(n), 6).alias("median_length"), F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95"), F.count_if(n > 240).alias("too_long"))


@query("agg_18_accounting", f"""SELECT count(*) FILTER (split = 'train') AS source_rows, count(*) FILTER (split = 'train' AND response IS NULL AND query_norm IS NOT NULL) AS missing, count(*) FILTER (response IS NOT NULL AND query_norm IS NULL) AS repeated, count(*) FILTER (coalesce(split, '') <> 'train' AND (response IS NOT NULL OR query_norm IS NULL)) AS "foreign" FROM {QA}""")
def accounting(spark, d):
    """Accepted: with a response; rejected: without a normalized query, wherever they stand; the source is the train split."""
    r = _qa(spark, d)
    return L.accounting(r.where("split = 'train'"), r.where("response is not null"), r.where("query_norm is null"), "record_id")


QUOTAS = [("train", "dose_refusal", 10), ("heldout", "dose_refusal", 1), ("development", "diagnosis_refusal", 2)]


@query("agg_19_quota_check", f"SELECT q.split, q.category, CAST(q.expected AS BIGINT) AS expected, CAST(coalesce(n, 0) AS BIGINT) AS actual FROM (VALUES {', '.join(str(x) for x in QUOTAS)}) q(split, category, expected) LEFT JOIN (SELECT split, category, count(*) AS n FROM {CHAT} GROUP BY 1, 2) USING (split, category)")
def quota_check(spark, d):
    q = spark.createDataFrame(QUOTAS, "split string, category string, expected long")
    n = _chat(spark, d).groupBy("split", "category").agg(F.count("*").alias("actual"))
    return q.join(n, ["split", "category"], "left").select("split", "category", "expected", F.coalesce("actual", F.lit(0)).alias("actual"))


@query("agg_20_vocabulary", f"SELECT w AS term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split({drop_sql('question', chr(92) + 'p{P}0-9a-zA-Z ')}, '')) AS w FROM {RL}) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def vocabulary(spark, d):
    w = _rl(spark, d).select(F.explode(F.split(T.drop(F.col("question"), r"\p{P}0-9a-zA-Z "), "(?<!^)(?!$)")).alias("term")).where("term <> ''")
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


# --- windows, samples, sets --------------------------------------------------------------------


@query("win_01_keep_first", f"SELECT record_id FROM {N} QUALIFY row_number() OVER (PARTITION BY query_norm ORDER BY record_id) = 1")
def keep_first(spark, d):
    return D.keep_first(_normed(spark, d), F.col("query_norm"), [F.col("record_id")]).select("record_id")


@query("win_02_longest_mention", f"SELECT id, name FROM {MENTIONS} QUALIFY rank() OVER (PARTITION BY id ORDER BY length(name) DESC) = 1")
def longest_mention(spark, d):
    return J.longest_mentions(_mentions(spark, d))


@query("win_03_maximal_mention", f"SELECT id, name FROM {MENTIONS} a WHERE NOT EXISTS (SELECT 1 FROM {MENTIONS} b WHERE a.id = b.id AND a.name <> b.name AND contains(b.name, a.name))")
def maximal_mention(spark, d):
    return J.maximal_mentions(_mentions(spark, d))


@query("win_04_margin", "SELECT o_custkey, o_orderkey, o_totalprice, second, round(o_totalprice - second, 6) AS margin FROM (SELECT *, coalesce(lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 0.0) AS second, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def margin(spark, d):
    return L.margin(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").withColumn("margin", F.round("margin", 6))


@query("win_05_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def top_k(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return L.top_k(li, ["l_suppkey"], "l_extendedprice", "pos", 3).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("win_06_hash_order", f"SELECT sample_id, CAST(row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || category || ':' || sample_id)) AS INTEGER) AS place FROM {CHAT}")
def hash_order(spark, d):
    from corpusloom.functions.hashing import hash_order as order

    w = Window.partitionBy("category").orderBy(order(42, F.col("category"), F.col("sample_id")))
    return _chat(spark, d).select("sample_id", F.row_number().over(w).alias("place"))


@query("win_07_audit_sample", f"SELECT split, sample_id FROM {CHAT} QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256('7:' || coalesce(split || ':', '') || sample_id)) <= 5")
def audit_sample(spark, d):
    return L.hash_sample(_chat(spark, d).select("split", "sample_id"), ["split"], 7, "sample_id", 5)


@query("win_08_capped", f"SELECT category, sample_id FROM {CHAT} QUALIFY row_number() OVER (PARTITION BY category ORDER BY sample_id) <= 25")
def capped(spark, d):
    return L.first_n(_chat(spark, d).select("category", "sample_id"), ["category"], [F.col("sample_id")], 25)


@query("win_09_evenly_spaced", f"SELECT split, sample_id FROM (SELECT split, sample_id, row_number() OVER (PARTITION BY split ORDER BY sample_id) - 1 AS p, count(*) OVER (PARTITION BY split) AS s FROM {CHAT}) WHERE list_contains(list_transform(range(0, 16), lambda i: i * s // 16), p)")
def evenly_spaced(spark, d):
    return L.evenly_spaced(_chat(spark, d).select("split", "sample_id"), "split", [F.col("sample_id")])


@query("win_10_slice", f"SELECT record_id FROM {QA} ORDER BY record_id LIMIT 50 OFFSET 100")
def slice_rows(spark, d):
    return L.slice_rows(_qa(spark, d).select("record_id"), [F.col("record_id")], 100, 150)


@query("win_11_running_offset", f"SELECT sample_id, CAST(coalesce(sum(length(id)) OVER (PARTITION BY category ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {CHAT}")
def running_offset(spark, d):
    w = Window.partitionBy("category").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1)
    return _chat(spark, d).select("sample_id", F.coalesce(F.sum(F.length("id")).over(w), F.lit(0)).cast("long").alias("before"))


@query("win_12_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"))


@query("win_13_next_chunk", f"SELECT record_id, left(lead(query) OVER (PARTITION BY source ORDER BY record_id), 5) AS nxt FROM {QA}")
def next_chunk(spark, d):
    return _qa(spark, d).select("record_id", F.left(F.lead("query").over(Window.partitionBy("source").orderBy("record_id")), F.lit(5)).alias("nxt"))


RETAIN = f"(SELECT CAST(item_id AS BIGINT) AS step, bleu1, CAST(length(generated) AS DOUBLE) AS chars FROM {TESTS})"


@query("win_14_retained", f"SELECT step FROM (SELECT step FROM {RETAIN} WHERE bleu1 IS NOT NULL ORDER BY bleu1 DESC, step DESC LIMIT 3) UNION SELECT step FROM (SELECT step FROM {RETAIN} WHERE chars IS NOT NULL ORDER BY chars DESC, step DESC LIMIT 3)")
def retained(spark, d):
    h = _tests(spark, d).select(F.col("item_id").alias("step"), "bleu1", F.length("generated").cast("double").alias("chars"))
    return L.retained_checkpoints(h, ["bleu1", "chars"], 3)


@query("smp_01_stratified", f"SELECT sample_id, CASE WHEN place <= (CASE WHEN total <= 1 THEN 0 ELSE least(greatest(CAST(round_even(total * 0.2, 0) AS BIGINT), 1), total - 1) END) THEN 'heldout' ELSE 'train' END AS part FROM (SELECT sample_id, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || sample_id)) AS place, count(*) OVER (PARTITION BY category) AS total FROM {CHAT})")
def stratified(spark, d):
    return L.stratified_split(_chat(spark, d).select("sample_id", "category"), "category", "sample_id").select("sample_id", "part")


@query("smp_02_audit", f"SELECT code, record_id FROM (SELECT unnest({REASONS_SQL}) AS code, record_id FROM {QA}) QUALIFY row_number() OVER (PARTITION BY code ORDER BY sha256('3:' || code || ':' || record_id)) <= 3")
def reason_audit(spark, d):
    return L.hash_sample(_qa(spark, d).select(F.explode(reason_codes()).alias("code"), "record_id"), ["code"], 3, "record_id", 3)


@query("smp_03_three_way", f"SELECT record_id, CASE WHEN b < 500 THEN 'validation' WHEN b < 1500 THEN 'test' ELSE 'train' END AS part FROM (SELECT record_id, CAST('0x' || left(sha256('42:' || record_id), 8) AS BIGINT) % 10000 AS b FROM {QA})")
def three_way(spark, d):
    return L.three_way_split(_qa(spark, d).select("record_id"), "record_id", 42, 5.0, 10.0)


@query("smp_04_validation", f"SELECT row_id, CASE WHEN place <= ceil(total * 7 / 100.0) THEN 'validation' ELSE 'train' END AS part FROM (SELECT row_id, row_number() OVER (ORDER BY sha256('42:' || row_id)) AS place, count(*) OVER () AS total FROM {RL})")
def validation(spark, d):
    return L.exact_validation(_rl(spark, d).select("row_id"), "row_id", 7.0)


@query("smp_05_ninety_ten", f"SELECT CASE WHEN CAST('0x' || left(sha256('42:' || row_id), 8) AS BIGINT) % 10000 < 1000 THEN 'validation' ELSE 'train' END AS part, CAST(count(*) AS BIGINT) AS n FROM {RL} GROUP BY 1")
def ninety_ten(spark, d):
    return L.three_way_split(_rl(spark, d).select("row_id"), "row_id", 42, 10.0, 0.0).groupBy("part").agg(F.count("*").alias("n"))


@query("smp_06_shuffle", f"SELECT row_id, sha256('42:' || row_id) AS place FROM {RL}")
def shuffle(spark, d):
    from corpusloom.functions.hashing import hash_order as order

    return _rl(spark, d).select("row_id", order(42, F.col("row_id")).alias("place")).orderBy("place")


@query("smp_07_seeds", f"SELECT row_id FROM {RL} ORDER BY sha256('5:' || row_id) LIMIT 5")
def seeds(spark, d):
    from corpusloom.functions.hashing import hash_order as order

    return _rl(spark, d).orderBy(order(5, F.col("row_id"))).limit(5).select("row_id")


@query("sel_01_greedy_quota")
def greedy(spark, d):
    rows = _rl(spark, d).where("question is not null").select(F.col("row_id").alias("id"), T.retriever_normalize("question").alias("text"), F.when(F.col("answer").isNull(), "no_answer").alias("rejected"), F.when(F.contains("question", F.lit("药")), "herb").otherwise("other").alias("category"))
    edges = J.jaccard_join(rows.select("id", "text"), None, 0.6, 3)
    return L.greedy_quota(rows.select("id", "category", "rejected"), edges, [("train", "herb", 8), ("train", "other", 8), ("heldout", "herb", 4)])


@query("sel_03_greedy_near_dedup")
def greedy_near(spark, d):
    return D.near_dedup_texts(_norm_rl(spark, d), 0.6, 3)


@query("set_01_union_first", f"SELECT text, arg_min(src, ord) AS src FROM (SELECT query AS text, 'qa' AS src, 1 AS ord FROM {QA} UNION ALL SELECT text, 'api', 2 FROM {API}) WHERE text IS NOT NULL GROUP BY 1")
def union_first(spark, d):
    u = _qa(spark, d).select(F.col("query").alias("text"), F.lit("qa").alias("src"), F.lit(1).alias("ord")).unionByName(once(spark, d, "api_requests", "req_no").select("text", F.lit("api").alias("src"), F.lit(2).alias("ord")))
    return u.where("text is not null").groupBy("text").agg(F.min_by("src", "ord").alias("src"))


@query("set_02_intersect", f"SELECT query AS text FROM {QA} INTERSECT SELECT text FROM {API}")
def intersect(spark, d):
    return _qa(spark, d).select(F.col("query").alias("text")).intersect(once(spark, d, "api_requests", "req_no").select("text"))


@query("set_03_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def difference(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("set_04_append", f"SELECT digest, CAST(count(*) AS BIGINT) AS n FROM (SELECT sha256(query) AS digest FROM {QA} UNION ALL SELECT sha256(text) FROM {API}) GROUP BY 1 HAVING count(*) > 1")
def append(spark, d):
    u = _qa(spark, d).select(F.sha2("query", 256).alias("digest")).unionAll(once(spark, d, "api_requests", "req_no").select(F.sha2("text", 256)))
    return u.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")


@query("set_05_greatest", f"SELECT x.id, round(greatest({_SIM}, 0.5), 6) AS score FROM {VEC} x JOIN {VEC} y ON y.id = x.id + 1")
def greatest(spark, d):
    v = _vectors(spark, d)
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id").select("id", F.round(F.greatest(dot(F.col("vec"), F.col("other")), F.lit(0.5)), 6).alias("score"))


@query("srt_01_multi_key", f"SELECT split, source, record_id FROM {QA} ORDER BY split NULLS FIRST, source NULLS FIRST, record_id")
def multi_key(spark, d):
    return _qa(spark, d).select("split", "source", "record_id").orderBy(F.asc_nulls_first("split"), F.asc_nulls_first("source"), "record_id")


# --- deduplication -----------------------------------------------------------------------------


@query("ded_01_exact", f"SELECT record_id FROM (SELECT * FROM {N} QUALIFY row_number() OVER (PARTITION BY query_norm ORDER BY record_id) = 1) QUALIFY row_number() OVER (PARTITION BY pair_norm ORDER BY record_id) = 1")
def exact(spark, d):
    return D.exact_dedup(_normed(spark, d), "query_norm", "pair_norm", "record_id").select("record_id")


@query("ded_02_near")
def near(spark, d):
    """Exact duplicates go first (by query, then by pair), so near edges are between different texts only."""
    near = D.exact_then_near(_redelivered(spark, d).where("query_norm is not null"), 0.95, 0.90, 3)
    return near.withColumnRenamed("id", "record_id")


DG = f"(SELECT record_id AS id, split, {_shingles_sql('query_norm', 5, 'whole')} AS g FROM {N} WHERE query_norm <> '')"


@query("ded_03_leakage", f"SELECT DISTINCT x.id FROM (SELECT * FROM {DG} WHERE split IN ('development', 'heldout')) x JOIN (SELECT * FROM {DG} WHERE split = 'train') y ON len(y.g) BETWEEN 0.9 * len(x.g) - 1e-9 AND len(x.g) / 0.9 + 1e-9 AND (x.g[1] = y.g[1] OR x.g[-1] = y.g[-1] OR list_has_any(x.g, y.g)) WHERE len(list_intersect(x.g, y.g)) >= 0.9 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) - 1e-9")
def leakage(spark, d):
    n = _normed(spark, d).where("query_norm <> ''")
    side = n.select(F.col("record_id").alias("id"), "split", F.col("query_norm").alias("text"))
    e = J.jaccard_join(side.where("split in ('development', 'heldout')").select("id", "text"), side.where("split = 'train'").select("id", "text"), 0.9, 5)
    return e.select(F.col("a").alias("id")).distinct()


@query("ded_03_leakage_any")
def leakage_any(spark, d):
    """Leaks by query or pair, exact or near; ded_03_leakage has the near queries alone, as its SQL."""
    n = _redelivered(spark, d)
    return D.leaked(n.where("split in ('development', 'heldout')"), n.where("split = 'train'"), 0.9, 0.9, 5)


@query("ded_04_semantic", f"SELECT a, b, round(score, 6) AS score FROM (SELECT x.id AS a, y.id AS b, {_SIM} AS score FROM {VEC} x JOIN {VEC} y ON x.id % 50 = 0 AND x.id <> y.id) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1 AND score >= 0.4")
def semantic(spark, d):
    v = _vectors(spark, d)
    return J.cosine_nearest(v.where("id % 50 = 0"), v, 1, same=True, floor=0.4).select("a", "b", F.round("score", 6).alias("score"))


@query("ded_05_split_overlaps", f"SELECT a.split AS left_split, b.split AS right_split, CAST(count(*) AS BIGINT) AS shared FROM (SELECT DISTINCT split, query_norm FROM {N} WHERE split IS NOT NULL AND query_norm IS NOT NULL) a JOIN (SELECT DISTINCT split, query_norm FROM {N} WHERE split IS NOT NULL) b ON a.query_norm = b.query_norm AND a.split < b.split GROUP BY 1, 2")
def split_overlaps(spark, d):
    return D.split_overlaps(_normed(spark, d), "split", "query_norm")


@query("ded_06_first_match", f"""SELECT CAST(count(*) FILTER (WHERE q) AS BIGINT) AS exact_query, CAST(count(*) FILTER (WHERE p AND NOT q) AS BIGINT) AS exact_pair, CAST(count(*) FILTER (WHERE n) AS BIGINT) AS semantic, CAST(count(*) AS BIGINT) AS any_match FROM (
SELECT a.record_id, a.query_norm = b.query_norm AS q, a.pair_norm = b.pair_norm AS p, left(a.query_norm, 30) = left(b.query_norm, 30) AS n FROM (SELECT * FROM {N} WHERE split = 'heldout') a JOIN (SELECT * FROM {N} WHERE split = 'train') b ON left(a.query_norm, 30) = left(b.query_norm, 30) QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY b.record_id) = 1)""")
def first_match(spark, d):
    n = _normed(spark, d).withColumn("head", F.left("query_norm", F.lit(30)))
    a, b = n.where("split = 'heldout'").alias("a"), n.where("split = 'train'").alias("b")
    pairs = a.join(b, F.col("a.head") == F.col("b.head")).select(F.col("a.record_id").alias("a"), F.col("b.record_id").alias("order"), (F.col("a.query_norm") == F.col("b.query_norm")).alias("query_equal"), (F.col("a.pair_norm") == F.col("b.pair_norm")).alias("pair_equal"), F.lit(True).alias("near"))
    return D.first_match_flags(pairs)


@query("ded_06_overlap_counts")
def overlap_counts(spark, d):
    """Counts over whole texts; ded_06_first_match compares the first 30 characters, as its SQL."""
    n = _redelivered(spark, d)
    return D.overlap_counts(n.where("split = 'heldout'"), n.where("split = 'train'"), 0.95, 0.9, 3)
