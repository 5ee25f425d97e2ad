"""Hybrid retrieval for batches of queries: exact entities, vectors, lexical rerank, evidence, gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.similarity import coverage, jaccard
from corpusloom.operators.simjoin import cosine_nearest


def entity_index(documents: DataFrame) -> DataFrame:
    """(name_norm, doc_id) from normalized titles and aliases, each once per document."""
    from corpusloom.functions.text import retriever_normalize

    names = documents.select("doc_id", F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.select(retriever_normalize("name").alias("name_norm"), "doc_id").where("name_norm <> ''").distinct()


def resolve_entities(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id) of queries whose candidate name is an entity."""
    return queries.join(index, queries["name_norm"] == index["name_norm"]).select("query_id", "doc_id")


def vector_search(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(a, b, score, place): k nearest documents (id, vec) of each query (id, vec), against all of them."""
    return cosine_nearest(queries, documents, k)


def lexical_score(asked: Column, content: Column) -> Column:
    """Coverage of the query's grams by the document's."""
    return coverage(asked, content)


def hybrid_score(vector: Column, lexical: Column, category: Column) -> Column:
    """Three quarters vector, one quarter lexical where a category is set; else the vector's."""
    return F.when(category.isNotNull(), 0.75 * vector + 0.25 * lexical).otherwise(vector)


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the parts that are not null, weights renormalized; null without one."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        total, weight = total + F.coalesce(c * w, F.lit(0.0)), weight + F.when(c.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def evidence_score(category: Column, fields: Mapping[str, Column], asked: Column, content: Column) -> Column:
    """Field evidence by category: herb by its features, formula and theory by fixed weights, others by text.

    ``fields``: taste, temperature, meridian, composition, function (null where not asked).
    """
    generic = 0.7 * coverage(asked, content) + 0.3 * jaccard(asked, content, 0.0)
    herb = weighted([(0.25, fields["taste"]), (0.15, fields["temperature"]), (0.20, fields["meridian"]), (0.40, generic)])
    formula = F.when(fields["composition"].isNotNull(), 0.40 * fields["composition"] + 0.45 * F.coalesce(fields["function"], generic) + 0.15 * generic).otherwise(0.75 * F.coalesce(fields["function"], generic) + 0.25 * generic)
    theory = 0.55 * F.coalesce(fields["function"], generic) + 0.45 * generic
    return F.when(category == "herb", herb).when(category == "formula", formula).when(category == "theory", theory).otherwise(0.80 * generic + 0.20 * jaccard(asked, content, 0.0))


#: Least score and least margin of an accepted answer, by category ("" without one).
THRESHOLDS = {"herb": (0.60, 0.03), "formula": (0.60, 0.03), "syndrome": (0.60, 0.03), "theory": (0.50, 0.03), "": (0.65, 0.08)}


def _by_category(category: Column, which: int, thresholds: Mapping[str, tuple[float, float]]) -> Column:
    out = F.lit(thresholds[""][which])
    for name, pair in thresholds.items():
        if name:
            out = F.when(category == name, pair[which]).otherwise(out)
    return out


def accepted(category: Column, score: Column, margin: Column, thresholds: Mapping[str, tuple[float, float]] = THRESHOLDS) -> Column:
    return (score >= _by_category(category, 0, thresholds)) & (margin >= _by_category(category, 1, thresholds))


def lexical_override(category: Column, lexical: Column, gap: Column) -> Column:
    """Strong lexical evidence that accepts a weak vector match."""
    return F.when(category == "herb", (lexical >= 0.54) & (gap >= 0.08)).otherwise((lexical >= 0.55) & (gap >= 0.05))


def result_state(guard: Column, exact: Column, unknown_entity: Column, score: Column, ok: Column, override: Column, close: Column) -> Column:
    """(found, confidence, method) by the first case that applies."""

    def case(found: bool, confidence: str, method: str) -> Column:
        return F.struct(F.lit(found).alias("found"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    return (
        F.when(guard, case(False, "structural_not_found", "structure_guard"))
        .when(exact, case(True, "high", "exact"))
        .when(unknown_entity, case(False, "entity_not_in_kb", "exact_guard"))
        .when(ok & (score >= 0.75), case(True, "high", "vector"))
        .when(ok, case(True, "medium", "vector"))
        .when(override, case(True, "medium", "vector"))
        .when(close, case(False, "ambiguous", "none"))
        .when(score.isNull(), case(False, "none", "none"))
        .otherwise(case(False, "low", "none"))
    )


def rescue(results: DataFrame, evidence: DataFrame, least: float = 0.72, gap: float = 0.12) -> DataFrame:
    """Results with a second pass on failures only: found by field evidence that is strong and alone.

    ``results``: query_id, doc_id, found, confidence, method, description (a description query);
    ``evidence``: query_id, doc_id, evidence.  Successes, guards and other queries stay as they are.
    """
    open_ = (~F.col("found")) & F.col("description") & ~F.col("method").isin("structure_guard", "exact_guard")
    w = Window.partitionBy("query_id").orderBy(F.desc("evidence"), F.asc("doc_id"))
    failed = results.where(open_).select("query_id")
    ranked = evidence.join(failed, "query_id", "left_semi").withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("evidence").over(w), F.lit(0.0))})
    best = ranked.where((F.col("_n") == 1) & (F.col("evidence") >= least) & (F.col("evidence") - F.col("_next") >= gap)).select("query_id", F.col("doc_id").alias("_doc"))
    both = results.join(best, "query_id", "left")
    hit = F.col("_doc").isNotNull()
    return both.select("query_id", F.when(hit, F.col("_doc")).otherwise(F.col("doc_id")).alias("doc_id"), (F.col("found") | hit).alias("found"), F.when(hit, "medium").otherwise(F.col("confidence")).alias("confidence"), F.when(hit, "field_rescue").otherwise(F.col("method")).alias("method"))


def category_probe(hits: DataFrame, floor: float = 0.45) -> DataFrame:
    """(query_id, category, score): category of the best hit per category, at or above the floor; ties by name."""
    per = hits.groupBy("query_id", "category").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("category"))
    return per.where(F.col("score") >= floor).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
