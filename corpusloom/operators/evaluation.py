"""Evaluation of predictions: positional joins, structure, rates, gates, reviews, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(hits: Column, total: Column, when_zero: float | None = None) -> Column:
    """A share, with the value for an empty denominator chosen by the caller (null, 0.0 or 1.0)."""
    return F.when(total == 0, F.lit(when_zero).cast("double")).otherwise(hits / total)


def rounded(value: Column, places: int = 4) -> Column:
    """Half-even rounding of the double's shortest decimal form."""
    return F.bround(value.cast("decimal(38,18)"), places).cast("double")


def aligned(references: DataFrame, predictions: DataFrame, key: str = "index") -> DataFrame:
    """Full outer join by position with ``bound``: matched, no_prediction or no_reference."""
    r, p = references.alias("r"), predictions.alias("p")
    both = r.join(p, F.col(f"r.{key}") == F.col(f"p.{key}"), "full_outer")
    state = F.when(F.col(f"r.{key}").isNull(), "no_reference").when(F.col(f"p.{key}").isNull(), "no_prediction").otherwise("matched")
    extra = [F.col(f"p.{c}") for c in predictions.columns if c != key]
    return both.select(F.coalesce(f"r.{key}", f"p.{key}").alias(key), *[F.col(f"r.{c}") for c in references.columns if c != key], *extra, state.alias("bound"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status): missing, extra, mismatched or same, over (path, digest) tables."""
    e, a = expected.alias("e"), actual.alias("a")
    state = F.when(F.col("a.path").isNull(), "missing").when(F.col("e.path").isNull(), "extra").when(F.lower("e.digest") != F.lower("a.digest"), "mismatched").otherwise("same")
    return e.join(a, F.col("e.path") == F.col("a.path"), "full_outer").select(F.coalesce("e.path", "a.path").alias("path"), state.alias("status"))


def taxonomy(objects: DataFrame, label: str, payload: str) -> DataFrame:
    """(label, field, type, samples): fields that every payload of a label has, with one type throughout."""
    from corpusloom.functions.jsonx import json_type

    known = objects.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(payload).alias("payload"))
    totals = known.groupBy("label").agg(F.count("*").alias("samples"))
    variant = F.try_parse_json("payload")
    pairs = known.select("label", F.explode(F.map_entries(F.try_variant_get(variant, "$", "map<string,variant>"))).alias("e"))
    typed = pairs.select("label", F.col("e.key").alias("field"), json_type(F.to_json("e.value")).alias("type"))
    per = typed.groupBy("label", "field").agg(F.count("*").alias("n"), F.min("type").alias("type"), F.max("type").alias("type_max"))
    return per.join(totals, "label").where("n = samples and type = type_max").select("label", "field", "type", "samples")


def structure_ok(predictions: DataFrame, taxonomy_: DataFrame, key: str, label: str, payload: str) -> DataFrame:
    """(key, valid): the label is known and every required field is there with its type, not empty."""
    from corpusloom.functions.jsonx import json_type

    entries = predictions.select(key, F.col(label).alias("label"), F.explode(F.map_entries(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>"))).alias("e"))
    text = F.to_json("e.value")
    have = entries.select(key, "label", F.col("e.key").alias("field"), json_type(text).alias("type"), (~text.isin('""', "[]") & ~text.rlike(r'^"\s*"$')).alias("filled"))
    fine = have.join(taxonomy_, ["label", "field", "type"]).where("filled").groupBy(key).agg(F.count("*").alias("good"))
    need = taxonomy_.groupBy("label").agg(F.count("*").alias("need"))
    out = predictions.select(key, F.col(label).alias("label")).join(need, "label", "left").join(fine, key, "left")
    return out.select(key, F.coalesce(F.col("good") == F.col("need"), F.lit(False)).alias("valid"))


def gate(all_of: list[Column], pending: Column | None = None) -> Column:
    """PASS if all hold (as aggregates), PENDING_MANUAL_REVIEW if a review is due, else FAIL."""
    ok = F.bool_and(all_of[0])
    for c in all_of[1:]:
        ok = ok & F.bool_and(c)
    out = F.when(~ok, "FAIL")
    if pending is not None:
        out = out.when(F.bool_or(pending), "PENDING_MANUAL_REVIEW")
    return out.otherwise("PASS")


def bind_reviews(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """(index, error): first reason why a review does not belong to its case; null if it does.

    cases: index, query, prediction, label; reviews: index, query_sha256, prediction_sha256,
    label, verdict, evidence (array).
    """
    c, r = cases.alias("c"), reviews.alias("r")
    both = c.join(r, F.col("c.index") == F.col("r.index"), "full_outer")
    error = (
        F.when(F.col("r.index").isNull(), "unreviewed")
        .when(F.col("c.index").isNull(), "no_case")
        .when(F.sha2("c.query", 256) != F.col("r.query_sha256"), "query_changed")
        .when(F.sha2("c.prediction", 256) != F.col("r.prediction_sha256"), "prediction_changed")
        .when(~F.col("c.label").eqNullSafe(F.col("r.label")), "label_changed")
        .when(F.coalesce("r.verdict", F.lit("")) == "", "no_verdict")
        .when(F.exists("r.evidence", lambda e: ~F.contains(F.col("c.prediction"), e)), "evidence_not_in_prediction")
    )
    return both.select(F.coalesce("c.index", "r.index").alias("index"), error.alias("error"))


def curve_summary(curve: DataFrame, step: str = "step", loss: str = "loss", edge: int = 5) -> DataFrame:
    """Median of the first and last points, percent change, minimum with its first step."""
    known = curve.where(F.col(loss).isNotNull() & ~F.isnan(loss))
    ends = [known.orderBy(o).limit(edge).agg(F.median(loss).alias(name)) for o, name in ((F.asc(step), "first_median"), (F.desc(step), "last_median"))]
    least = known.agg(F.min(loss).alias("min_loss"), F.min_by(step, F.struct(loss, step)).alias("min_step"))
    out = ends[0].crossJoin(ends[1]).crossJoin(least)  # one row each
    return out.withColumn("change_percent", rate(100 * (F.col("last_median") - F.col("first_median")), F.col("first_median")))


def step_plan(rows: Column, batch: int, accumulation: int, epochs: int, evaluations: int = 10) -> Column:
    """(updates_per_epoch, total, eval_every) of a training run."""
    per = F.ceil(F.ceil(rows / batch) / accumulation)
    total = per * epochs
    return F.struct(per.alias("updates_per_epoch"), total.alias("total"), F.greatest(F.lit(1), F.ceil(total / evaluations)).alias("eval_every"))


def perplexity(loss: Column) -> Column:
    """exp of the mean loss; infinite on overflow."""
    return F.exp(F.avg(loss))


def token_accuracy(rows: DataFrame, predicted: str, labels: str, ignore: int = -100) -> DataFrame:
    """Share of right tokens among labels that count; the prediction at i is for the label at i + 1."""
    n = F.size(labels)
    pairs = rows.select(F.explode(F.arrays_zip(F.slice(predicted, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("p"), F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("l"))).alias("t"))
    counted = pairs.where(F.col("t.l") != ignore)
    return counted.agg(F.avg((F.col("t.p") == F.col("t.l")).cast("double")).alias("accuracy"), F.count("*").alias("tokens"))


def replayed(rows: DataFrame, key: str, once: Column, stored_once: DataFrame, name: str) -> DataFrame:
    """One row: keys, those whose stored output (key, ``name``) a new evaluation does not repeat, and the characters of all outputs."""
    both = rows.select(key, once.alias("_again")).join(stored_once.select(key, name), key, "full_outer")
    return both.agg(F.count("*").alias("compared"), F.count_if(~F.col("_again").eqNullSafe(F.col(name))).alias("differing"), F.sum(F.length("_again")).alias("chars"))
