"""Problem 6: evaluation texts leaking into training text, by hashed test n-grams.

A leak is a run of RUN characters of an item's plain form inside a document's plain form.  Of every
run of RUN characters, the anchor is the smallest hash of its GRAM-character grams: equal runs have
equal anchors, and an item has about 2 / (RUN - GRAM) anchors per character.  The hash set of all item
anchors is broadcast as a table of BITS bits, whose size does not depend on the items: the scan of a
document tests its running minimum against it and hashes whole runs only where it hits.  With more
anchors the table lets more runs pass that are none, and drops no leak.  Run hashes are then joined
to the items' runs, which is exact up to a 64-bit collision.

``p6_clean`` removes whole documents, ``p6_clean_spans`` the leaked spans of them: the characters from
the first to the last of every leaked run, and the marks and spaces between.

Nulls, empty texts and items under RUN plain characters leak nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.forms import plain, plain_codes, window_hashes
from corpusloom.llm.tables import stored, table

RUN, GRAM = 60, 20
#: Bits of the broadcast table (8 MB); a million anchors let 1.5 % of other runs pass.
BITS = 1 << 26


def running_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def runs_of(texts: list[str | None], run: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of a batch of texts: the text's number (-1 across texts) and the anchor; codes and starts of the texts."""
    codes, starts = plain_codes(texts)
    if len(codes) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), codes, starts
    anchors = running_minimum(window_hashes(codes, gram), run - gram + 1)
    row = np.searchsorted(starts, np.arange(len(anchors)), "right") - 1
    inside = np.arange(len(anchors)) + run <= starts[row + 1]
    return np.where(inside, row, -1), anchors, codes, starts


def item_runs(run: int, gram: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            row, anchor, codes, _ = runs_of(df["text"].tolist(), run, gram)
            if (row < 0).all():
                continue
            ok = row >= 0
            yield pd.DataFrame({"item_id": df["item_id"].to_numpy()[row[ok]], "anchor": anchor[ok].view(np.int64), "run": window_hashes(codes, run)[ok].view(np.int64)})

    return make


def document_hits(run: int, gram: int, bits):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = bits.value
        known = np.uint64(len(words) * 64)
        for df in batches:
            row, anchor, codes, starts = runs_of(df["text"].tolist(), run, gram)
            if not len(row):
                continue
            changed = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            each = anchor[changed] % known
            each = (words[(each >> np.uint64(6)).astype(np.int64)] >> (each & np.uint64(63))) & np.uint64(1)
            hit = np.repeat(each == 1, np.diff(np.r_[changed, len(anchor)])) & (row >= 0)
            where = np.flatnonzero(hit)
            if where.size:
                yield pd.DataFrame({"doc_id": df["doc_id"].to_numpy()[row[where]], "at": where - starts[row[where]], "run": window_hashes(codes, run)[where].view(np.int64)})

    return make


def hash_table(anchors: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits (a power of two) with those of all anchors set; one row for each word of 64 in use comes to the driver."""
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    got = anchors.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return words


def leaked_runs(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """doc_id, at, item_id, run of every run of a document (doc_id, text), at its plain characters, that an item (item_id, text) holds."""
    known = stored(items.select("item_id", "text").mapInPandas(item_runs(run, gram), "item_id long, anchor long, run long"), "p6-runs")
    table_of_bits = documents.sparkSession.sparkContext.broadcast(hash_table(known.select("anchor"), bits))
    hits = documents.select("doc_id", "text").mapInPandas(document_hits(run, gram, table_of_bits), "doc_id long, at long, run long")
    return hits.join(known.select("item_id", "run").distinct(), "run")


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """doc_id, item_id, runs (shared runs) for documents (doc_id, text) and items (item_id, text)."""
    return leaked_runs(documents, items, run, gram, bits).select("doc_id", "item_id", "run").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("runs"))


def plain_places(text: str) -> list[tuple[int, int]]:
    """Of every plain character, the part of the text that gives it: a base character with the marks that combine with it."""
    starts = [i for i, c in enumerate(text) if i == 0 or not (unicodedata.combining(c) or 0x1160 <= ord(c) < 0x1200)]
    out = [(a, b) for a, b in zip(starts, [*starts[1:], len(text)], strict=True) for _ in plain(text[a:b])]
    return out if len(out) == len(plain(text)) else [(0, len(text))] * len(plain(text))


def without_spans(text: str, runs: list[int], run: int) -> str:
    """The text without its runs of ``run`` plain characters at the given places."""
    places = plain_places(text)
    out, done, stop = [], 0, -1
    for at in sorted(runs):
        a, b = places[at][0], places[min(at + run, len(places)) - 1][1]
        if a > stop:
            out.append(text[done:a] if stop < 0 else text[stop:a])
        stop = max(stop, b)
    return "".join([*out, text[max(stop, 0) :]])


def clean_spans(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, text, removed of every document (doc_id, text): the text without leaked spans, and the number of characters removed."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([t if a is None or t is None else without_spans(t, list(a), run) for t, a in zip(text, at, strict=True)], dtype=object)

    places = leaked_runs(documents, items, run).select("doc_id", "at").distinct().groupBy("doc_id").agg(F.collect_list("at").alias("at"))  # the places in one text
    both = documents.select("doc_id", "text").join(places, "doc_id", "left").select("doc_id", cut("text", "at").alias("text"), F.length("text").alias("before"))
    return both.select("doc_id", "text", F.coalesce(F.col("before") - F.length("text"), F.lit(0)).alias("removed"))


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text: references of tests, and each user content of prompts outside train."""
    refs = table(spark, sf_dir, "test_results").select("item_id", F.col("reference").alias("text"))
    prompts = table(spark, sf_dir, "prompt_messages").where("split in ('development', 'heldout')")
    users = prompts.select("item_id", F.explode(F.filter("messages", lambda m: m["role"] == "user")).alias("m")).select("item_id", F.col("m.content").alias("text"))
    return refs.unionByName(users)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: the document holds at least 60 consecutive plain characters of the item."""
    return leaks(table(spark, sf_dir, "documents"), test_items(spark, sf_dir)).select("doc_id", "item_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars of the documents that leak nothing."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(leaks(documents, test_items(spark, sf_dir)), "doc_id", "left_anti").select("doc_id", "n_chars")


def p6_clean_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, removed: every document without the spans that it leaks."""
    return clean_spans(table(spark, sf_dir, "documents"), test_items(spark, sf_dir))
