"""Problem 4: visually identical text with different characters, by a confusables skeleton.

Every text is read and decomposed once, each character is replaced by its prototype from the look-alike table,
and the result is decomposed again (``forms.skeleton``).  Texts are grouped by equal skeletons; the
shuffle carries two 64-bit keys of the skeleton and one of the text, never the text.

A null text has a null form and is in no pair.  Exact repeats of a text are no pair; copies of any
number are collapsed per (skeleton, text) before groups are judged; different texts of a skeleton are
paired first, and only such pairs are expanded to records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm.forms import skeleton
from corpusloom.llm.tables import stored, table


@F.pandas_udf(StringType())
def skeleton_column(text: pd.Series) -> pd.Series:
    return text.map(skeleton, na_action="ignore")


def confusable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, text of the tables whose texts are brought to one form."""
    qa = table(spark, sf_dir, "qa_records").select(F.lit("qa_records").alias("tbl"), F.col("record_id").alias("id"), F.col("query").alias("text"))
    api = table(spark, sf_dir, "api_requests").select(F.lit("api_requests").alias("tbl"), F.col("req_no").alias("id"), "text")
    return qa.unionByName(api)


def unify(texts: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """The rows with one consistent form of their text in column ``form``; its old content, if any, is replaced."""
    return texts.withColumn(form, skeleton_column(F.col(text)))


def look_alike_members(texts: DataFrame) -> DataFrame:
    """id, s1, s2 (skeleton keys), t (text key) of records whose skeleton stands for two different texts or more."""
    keyed = texts.where("text is not null").select("id", F.xxhash64("text").alias("t"), skeleton_column("text").alias("form"))
    keyed = keyed.select("id", "t", F.xxhash64("form").alias("s1"), F.xxhash64(F.lit(29), "form").alias("s2"))
    keyed = stored(keyed.distinct(), "p4-keys")
    mixed = keyed.groupBy("s1", "s2").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("s1", "s2")
    return keyed.join(mixed, ["s1", "s2"], "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a < id_b: two records whose texts differ in code points and look the same."""
    m = stored(look_alike_members(confusable_texts(spark, sf_dir)), "p4-members")
    texts = m.select("s1", "s2", "t").distinct()
    x, y = texts.select("s1", "s2", F.col("t").alias("x")), texts.select("s1", "s2", F.col("t").alias("y"))
    both = x.join(y, ["s1", "s2"]).where("x < y")
    left, right = m.select("s1", "s2", F.col("t").alias("x"), F.col("id").alias("a")), m.select("s1", "s2", F.col("t").alias("y"), F.col("id").alias("b"))
    out = both.join(left, ["s1", "s2", "x"]).join(right, ["s1", "s2", "y"])
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, form: the consistent form of every text, redelivered records once."""
    return unify(confusable_texts(spark, sf_dir)).select("tbl", "id", "form").distinct()
