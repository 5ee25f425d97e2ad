"""Vocabularies by frequency and their ordered union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_frequency(terms: DataFrame, n: int) -> DataFrame:
    """(term, n): the n most frequent terms, ties by term."""
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def merged(vocabularies: list[DataFrame]) -> DataFrame:
    """(term, source, pos): every term once, from the first vocabulary (term, pos) that has it."""
    out = None
    for i, v in enumerate(vocabularies):
        one = v.select("term", F.lit(i).alias("source"), "pos")
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("term").agg(F.min(F.struct("source", "pos")).alias("m"))
    return best.select("term", "m.source", "m.pos")


def recount(rows: DataFrame, stated: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose stated number (by, n) differs from that of the written rows: repaired counts of a report."""
    actual = rows.groupBy(*by).agg(F.count("*").alias("actual"))
    both = stated.select(*by, F.col("n").alias("stated")).join(actual, by, "full_outer")
    return both.where(~F.col("stated").eqNullSafe(F.col("actual")))
