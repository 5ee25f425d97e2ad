"""Sources: JSON lines (tolerant, fail-fast, strict), text, CSV and TSV, arrays, documents, digests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corpusloom.functions.jsonx import strict_json_error
from corpusloom.functions.text import markdown_to_plain
from corpusloom.session import stored


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (1-based, in file order), value.

    A file is numbered in two passes: lines per input split, then offsets of splits; no file is
    gathered into one task.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_seq"), "value")
    within = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_seq"))
    counts = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "_block", before.alias("_before"))
    return lines.withColumn("_w", within).join(offsets, ["file", "_block"]).select("file", (F.col("_w") + F.col("_before")).alias("line"), "value")


def tolerant_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """line, record, error: a bad line is a row with an error and a null record; blank lines are left out."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    error = strict_json_error("value")
    error = F.when(error == "duplicate_key", None).otherwise(error)
    return lines.select("file", "line", F.from_json("value", schema).alias("record"), error.alias("error")).withColumn("record", F.when(F.col("error").isNull(), F.col("record")))


def failfast_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records; blank lines are skipped, any other line that does not parse ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, line, error of every line that a strict reader refuses: blank, duplicate key, trailing data, no JSON."""
    lines = numbered_lines(spark, path)
    error = F.when(F.trim("value") == "", "blank_row").otherwise(strict_json_error("value"))
    return lines.select("file", "line", error.alias("error")).where("error is not null")


def strict_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a .jsonl file without one strict error and with at least one row, else ValueError."""
    if not path.endswith(".jsonl"):
        raise ValueError(f"{path} is no .jsonl file")
    first = strict_jsonl_errors(spark, path).limit(1).collect()
    if first:
        raise ValueError(f"line {first[0]['line']}: {first[0]['error']}")
    out = spark.read.schema(schema).json(path)
    if out.isEmpty():
        raise ValueError(f"{path} has no rows")
    return out


def json_tree(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.{json,jsonl}") -> DataFrame:
    """Records of all files below a directory that match."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """text: nonblank lines of text files."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.trim("text") != "")


def delimited(spark: SparkSession, path: str, names: list[str], sep: str = "\t", header: bool = False) -> DataFrame:
    """String columns of the given names."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, sep=sep, header=header, quote='"', escape='"')


def curve_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A curve as doubles; a missing column or a number that is not finite raises."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    out = raw.select(*[F.col(c).try_cast("double").alias(c) for c in required])
    bad = None
    for c in required:
        one = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        bad = one if bad is None else bad | one
    if not out.where(bad).isEmpty():
        raise ValueError("a value is not a finite number")
    return out


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """pos (0-based), item (JSON text) of each array file; items that are no object become {}."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "array<string>").alias("items"))
    out = whole.select("file", F.posexplode("items").alias("pos", "item"))
    return out.select("file", "pos", F.when(F.col("item").rlike(r"^\s*\{"), F.col("item")).otherwise(F.lit("{}")).alias("item"))


def denylist(spark: SparkSession, path: str) -> DataFrame:
    """digest: lines of 64 hex digits, lower."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("digest")).where(F.col("digest").rlike("^[0-9a-f]{64}$")).distinct()


def slice_percent(rows: DataFrame, order: list, percent: float) -> DataFrame:
    """The first percent of rows in a total order.

    Rows are sorted over ranges and stored with their place in the range, so no task sees them all.
    """
    at = F.monotonically_increasing_id()
    ordered = stored(rows.orderBy(*order).withColumn("_at", at), "slice")
    ranges = sorted(ordered.groupBy(F.shiftright("_at", 33).alias("range")).count().collect())  # one row for each range
    left = int(sum(r["count"] for r in ranges) * percent / 100)
    for r in ranges:
        if left <= r["count"]:
            return ordered.where(F.col("_at") < (r["range"] << 33) + left).drop("_at")
        left -= r["count"]
    return ordered.limit(0).drop("_at")


def lazy_files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1) -> DataFrame:
    """A stream over the JSON files of a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def indexed_vectors(vectors: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """vectors, documents, matched: the sizes that must agree before an index may be searched."""
    both = vectors.select(F.col(key).alias("v")).join(documents.select(F.col(key).alias("d")), F.col("v") == F.col("d"), "full_outer")
    return both.agg(F.count("v").alias("vectors"), F.count("d").alias("documents"), F.count_if(F.expr("v = d")).alias("matched"))


def html_text(html) -> object:
    """Text of markup: scripts and tags dropped, common entities decoded, space squeezed."""
    from corpusloom.functions.text import squeeze

    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)


_TERMINAL = re.compile(r"[。！？.!?…]$")


def join_broken_lines(lines: list[str]) -> list[str]:
    """Paragraphs of an extracted page: lines are joined until one ends with terminal punctuation."""
    out, open_ = [], ""
    for line in lines:
        open_ += line.strip()
        if _TERMINAL.search(open_):
            out.append(open_)
            open_ = ""
    return [*out, open_] if open_ else out


@F.pandas_udf(StringType())
def _docx_text(content: pd.Series) -> pd.Series:
    import io
    import zipfile
    from xml.etree import ElementTree

    def text(data: bytes) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except Exception:
            return None
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join(t for p in root.iter(f"{w}p") if (t := "".join(x.text or "" for x in p.iter(f"{w}t"))).strip())

    return content.map(text)


def extract_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of txt, md, html and docx files; other kinds have a null text (no parser is here)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kind, raw = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)), F.decode("content", "utf-8")
    lines = F.array_join(F.filter(F.split(raw, r"\r?\n"), lambda x: F.trim(x) != ""), "\n")
    text = F.when(kind == "txt", lines).when(kind == "md", markdown_to_plain(raw)).when(kind.isin("html", "htm"), html_text(raw)).when(kind == "docx", _docx_text("content"))
    return files.select("path", text.alias("text"))


def batches(rows: DataFrame, function, schema: StructType | str) -> DataFrame:
    """A batch function (column dict to column dict) over Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame(function({c: p[c].tolist() for c in p.columns}))

    return rows.mapInPandas(run, schema)
