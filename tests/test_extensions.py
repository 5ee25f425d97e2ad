import pytest
from pyspark.sql import functions as F

from corpusloom.functions import extensions as X
from corpusloom.operators import evaluation, retrieval, vocabulary


def test_rewards(spark):
    df = spark.createDataFrame([("<think>t</think><answer>3</answer>", "3"), ("4", "3")], "c string, a string")
    X.register_reward("short", lambda c, a: (F.length(c) < 5).cast("double"))
    got = [tuple(r)[2:] for r in X.rewards(df, ["accuracy", "format", "short"], "c", "a").collect()]
    assert got == [(1.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_generator(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    got = {r["id"]: r["prediction"] for r in X.generated(df, "t", lambda ts: [f"<{t}>" for t in ts]).collect()}
    assert got == {1: "<x>", 2: "<None>"}


def test_handlers():
    assert X.call_handler(lambda text: text, "a", {}) == "a"
    assert X.call_handler(lambda text, state: (text, state), "a", 1) == ("a", 1)
    assert X.call_handler(lambda text, s: (text, s), "a", 1) == ("a", 1)
    assert X.call_handler(lambda text, **kw: kw["state"], "a", 1) == 1


def test_vocabularies(spark):
    a, b = (spark.createDataFrame(x, "term string, pos long") for x in ([("x", 0), ("y", 1)], [("y", 0), ("z", 1)]))
    got = {tuple(r) for r in vocabulary.merged([a, b]).collect()}
    assert got == {("x", 0, 0), ("y", 0, 1), ("z", 1, 1)}


def test_recount(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "g string")
    stated = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "g string, n long")
    assert {r["g"] for r in vocabulary.recount(rows, stated, ["g"]).collect()} == {"b", "c"}


@pytest.mark.parametrize(
    ("guard", "exact", "unknown", "score", "ok", "override", "close", "want"),
    [(True, True, False, 0.9, True, False, False, ("structural_not_found", "structure_guard")), (False, True, False, 0.9, True, False, False, ("high", "exact")), (False, False, True, 0.9, True, False, False, ("entity_not_in_kb", "exact_guard")), (False, False, False, 0.9, True, False, False, ("high", "vector")), (False, False, False, 0.7, True, False, False, ("medium", "vector")), (False, False, False, 0.2, False, True, False, ("medium", "vector")), (False, False, False, 0.2, False, False, True, ("ambiguous", "none")), (False, False, False, 0.2, False, False, False, ("low", "none")), (False, False, False, None, False, False, False, ("none", "none"))],
)
def test_result_states(spark, guard, exact, unknown, score, ok, override, close, want):
    s = retrieval.result_state(*map(F.lit, (guard, exact, unknown)), F.lit(score).cast("double"), *map(F.lit, (ok, override, close)))
    r = spark.range(1).select(s.alias("s")).first()["s"]
    assert (r["confidence"], r["method"]) == want


def test_evidence_renormalizes(spark):
    part = retrieval.weighted([(0.5, F.lit(1.0)), (0.25, F.lit(None).cast("double")), (0.25, F.lit(0.0))])
    none = retrieval.weighted([(0.5, F.lit(None).cast("double"))])
    r = spark.range(1).select(part.alias("a"), none.alias("b")).first()
    assert r["a"] == pytest.approx(2 / 3) and r["b"] is None


def test_entities(spark):
    docs = spark.createDataFrame([(1, "六味 地黄丸", ["地黄丸"]), (2, "四物汤", None)], "doc_id long, title string, aliases array<string>")
    queries = spark.createDataFrame([(9, "六味地黄丸"), (8, "无")], "query_id long, name_norm string")
    assert [tuple(r) for r in retrieval.resolve_entities(queries, retrieval.entity_index(docs)).collect()] == [(9, 1)]


def test_aligned_and_curves(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "index long, reference string"), spark.createDataFrame([(2, "p"), (3, "q")], "index long, prediction string")
    got = {r["index"]: r["bound"] for r in evaluation.aligned(a, b).collect()}
    assert got == {1: "no_prediction", 2: "matched", 3: "no_reference"}
    curve = spark.createDataFrame([(i, float(10 - i)) for i in range(10)], "step long, loss double")
    r = evaluation.curve_summary(curve).first()
    assert (r["first_median"], r["last_median"], r["min_step"], r["change_percent"]) == (8.0, 3.0, 9, -62.5)
