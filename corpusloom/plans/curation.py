"""Corpus curation end to end: judge, deduplicate, split; every source row has exactly one outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.rules import primary
from corpusloom.operators.dedup import near_dedup_texts
from corpusloom.operators.selection import stratified_split
from corpusloom.plans.catalog_rules import reason_codes


def judged(rows: DataFrame) -> DataFrame:
    """record_id, source, norm, codes (reasons of rejection, in order)."""
    return rows.select("record_id", "source", T.normalize_text("query").alias("norm"), reason_codes().alias("codes"))


def outcomes(rows: DataFrame) -> DataFrame:
    """record_id, outcome: first reason code, duplicate, heldout or train.

    First ids per norm are an aggregate joined back, so a norm that a third of the rows share is one
    partial aggregate and a skew join, not a window over one partition.
    """
    j = judged(rows)
    firsts = j.where("size(codes) = 0").groupBy("norm").agg(F.min("record_id").alias("keep"), F.min_by("source", "record_id").alias("source"))
    parts = stratified_split(firsts.select(F.col("keep").alias("record_id"), "source"), "source", "record_id")
    kept = j.join(parts.select("record_id", "part"), "record_id", "left")
    return kept.select("record_id", F.coalesce(primary(F.col("codes")), F.col("part"), F.lit("duplicate")).alias("outcome"))


def near_free(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """id, kept, by: greedy keep-first over near duplicates of the accepted rows."""
    ok = judged(rows).where("size(codes) = 0").select(F.col("record_id").alias("id"), F.col("norm").alias("text"))
    return near_dedup_texts(ok, threshold)
