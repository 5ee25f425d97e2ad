"""Problem 5: duplicates hidden by formatting differences, by an incremental ledger.

The canonical form of a field drops white space, punctuation and letter case; a record's key is two
64-bit hashes of its canonical fields in fixed (or, for JSON objects, sorted) order.  Keys are made in
one pass over the input and stored by batch of first arrival; everything after reads these rows only.

The ledger keeps one row per key -- copies, smallest id -- in buckets of the key, whose number follows
from the records expected.  A batch is aggregated first, then full-outer-joined to the buckets it
touches; counts are added and the smaller id stays.  Untouched buckets are neither read nor written.  A
manifest beside the buckets holds the newest version of each, so a later run opens the ledger and
pays for its own batch and the buckets of it.

Null responses do not count, neither do payloads that are no JSON object.  Redelivered records
count in the batch of their first arrival only; a null arrival is the last.  A group of any size is
one ledger row, made by partial aggregation.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm.tables import scratch, table

#: Buckets at least, and records for each of them.
BUCKETS, PER_BUCKET = 16, 2_000_000
_DROPPED = r"(?U)[\s\p{P}\p{Z}]+"


def canonical(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _DROPPED, ""))


def canonical_text(text: str) -> str:
    return "".join(c for c in text if not c.isspace() and unicodedata.category(c)[0] not in "PZ").lower()


_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")


def canonical_payload(payload: str | None) -> str | None:
    """Canonical fields of a JSON object in key order; None for anything else, or without a response."""
    if payload is None:
        return None
    try:
        fields = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    if not isinstance(fields, dict) or fields.get("response", "") is None:
        return None
    out = []
    for name in sorted(fields):
        value = fields[name]
        if not isinstance(value, str):
            value = json.dumps(value, sort_keys=True, ensure_ascii=False)
        out.append(f"{name}\x1f{value if _NUMBER.fullmatch(value) else canonical_text(value)}")
    return "\x1e".join(out)


@F.pandas_udf(StringType())
def payload_column(payload: pd.Series) -> pd.Series:
    return payload.map(canonical_payload, na_action="ignore")


def keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, k1, k2, arrived: one row per delivery of every record that counts."""
    qa = table(spark, sf_dir, "qa_records").where("response is not null")
    qa = qa.select(F.lit("qa_records").alias("tbl"), F.col("record_id").alias("id"), F.concat_ws("\x1e", F.coalesce(canonical(F.col("query")), F.lit("\x1d")), canonical(F.col("response"))).alias("form"), F.col("ingested_at").alias("arrived"))
    raw = table(spark, sf_dir, "raw_records").select(F.lit("raw_records").alias("tbl"), F.col("line_id").alias("id"), payload_column("payload").alias("form"), F.col("received_at").alias("arrived"))
    rows = qa.unionByName(raw.where("form is not null"))
    return rows.select("tbl", "id", F.xxhash64("tbl", "form").alias("k1"), F.xxhash64(F.lit(43), "tbl", "form").alias("k2"), "arrived")


class Ledger:
    """Canonical-key counts in buckets under one folder; every update writes new versions of the touched buckets.

    A folder that holds a ledger already is opened with its number of buckets.
    """

    schema = "k1 long, k2 long, copies long, first_id long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.versions: dict[int, int] = {}
        self.version = 0
        self._open()

    def _open(self) -> None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest").collect()  # one row for each bucket and update
        except AnalysisException:
            return
        for r in sorted(rows, key=lambda r: r["version"]):
            self.versions[r["bucket"]] = self.version = r["version"]
            self.buckets = r["buckets"]

    def bucket(self, k1: str = "k1") -> Column:
        return F.pmod(k1, F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        wanted = [b for b in (self.versions if buckets is None else buckets) if b in self.versions]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        by_version: dict[int, list[int]] = {}
        for b in wanted:
            by_version.setdefault(self.versions[b], []).append(b)
        parts = [self.spark.read.schema(self.schema + ", bucket int").option("basePath", f"{self.path}/v{v}").parquet(*[f"{self.path}/v{v}/bucket={b}" for b in bs]) for v, bs in by_version.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("k1", "k2", "copies", "first_id")

    def update(self, batch: DataFrame) -> None:
        """Add a batch (k1, k2, id; one row per record)."""
        touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` rows
        if not touched:
            return
        counted = batch.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        known = self.read(touched)
        merged = counted.join(known, ["k1", "k2"], "full_outer").select("k1", "k2", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_id", "low").alias("first_id"), self.bucket().alias("bucket"))
        version = self.version + 1
        merged.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/v{version}")
        rows = [(b, version, self.buckets) for b in touched]
        self.spark.createDataFrame(rows, "bucket int, version int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version = version
        self.versions.update(dict.fromkeys(touched, version))


def first_deliveries(records: DataFrame) -> DataFrame:
    """tbl, id, k1, k2, batch of every record's first arrival, stored by batch (the year of the arrival)."""
    at = F.coalesce(F.unix_micros(F.col("arrived").cast("timestamp")), F.lit(2**63 - 1))
    first = records.withColumn("at", at).groupBy("tbl", "id").agg(F.min("at").alias("at"), F.min_by("k1", "at").alias("k1"), F.min_by("k2", "at").alias("k2"))
    batch = F.when(F.col("at") < 2**63 - 1, F.year(F.timestamp_micros("at"))).otherwise(F.lit(9999)).alias("batch")
    path = scratch(records.sparkSession, "p5-keys")
    first.select("tbl", "id", "k1", "k2", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return records.sparkSession.read.schema("tbl string, id long, k1 long, k2 long, batch int").parquet(path)


def build_ledger(spark: SparkSession, records: DataFrame) -> Ledger:
    """The ledger of stored first deliveries, fed one batch after another."""
    sizes = {r[0]: r[1] for r in records.groupBy("batch").count().collect()}
    ledger = Ledger(spark, scratch(spark, "p5-ledger"), max(BUCKETS, -(-sum(sizes.values()) // PER_BUCKET)))
    for batch in sorted(sizes):
        own = records.where(F.col("batch") == batch).select("k1", "k2", "id")
        ledger.update(own)
    return ledger


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_id, copy_id: the smallest key of each group of equal records, and each other key."""
    records = first_deliveries(keyed_records(spark, sf_dir))
    groups = build_ledger(spark, records).read().where("copies > 1").select("k1", "k2", F.col("first_id").alias("keep_id"))
    return records.join(groups, ["k1", "k2"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, copies: one record for each canonical key, with its number of copies."""
    return build_ledger(spark, first_deliveries(keyed_records(spark, sf_dir))).read().select(F.col("first_id").alias("id"), "copies")
