"""Problem 2: near-duplicate records with small edits, by anchor-point covering.

Fingerprint of a text: BLOCKS * WIDTH minhash symbols over the distinct runs of three characters of
its plain form.  Two texts of likeness s agree in each symbol with probability s, so likeness is a
Hamming similarity of fingerprints.  The anchors of a block are the words of its WIDTH symbols with
one free place: they cover the block's words with radius 0, and words at distance 1 share one, so this
is banded minhash with bands of WIDTH - 1 symbols out of blocks.  Each fingerprint is replicated to
every anchor at distance 0 in some block, WIDTH in each.  Fingerprints
that differ in fewer than 2 * BLOCKS of the symbols share an anchor for certain (some block then
differs in one symbol at most), others with probability 1 - (1 - s**4 - 4 * s**3 * (1 - s))**BLOCKS:
0.9998 at a likeness of 0.7, 0.994 at 0.6.  Fingerprints are compared per anchor, by four bits of 32
symbols in two longs, inside the join (at a likeness of 0.6, AGREEING keeps 0.9964, so that 0.991
are found together; at 0.65 0.998, from 0.7 on 0.9998); the few pairs that pass are compared exactly
by their texts.  ``exact`` finds every pair instead, by the sparse suffix array of problem 1.

Anchors of more than about CELL fingerprints (boilerplate) are cut into a grid of cells, so that no task
holds them all; no anchor is capped.  Equal plain forms are collapsed to a representative first.  A
plain form of one or two characters has no run of three and is like its equals only; records without
a letter or digit match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.forms import plain_codes
from corpusloom.llm.likeness import likeness_of_plain, plain_column
from corpusloom.llm.p1_cross_split import cross_split_pairs
from corpusloom.llm.sketch import agreeing, block_anchors, four_bit_marks, minhash_symbols, text_key
from corpusloom.llm.tables import stored, table

BLOCKS, WIDTH = 8, 4
LIKENESS = 0.6
#: Of 32 four-bit symbols, so many agree at least: a likeness of 0.6 gives 20 +- 2.8.
AGREEING = 13
#: Fingerprints of an anchor that one task compares, on each side; anchors of more are looked for among those of every EVERY-th text.
CELL, EVERY = 20_000, 64


def fingerprints(blocks: int, width: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            codes, starts = plain_codes([x for row in zip(df["query"], df["response"], strict=True) for x in row])
            starts = starts[::2]  # query and response of a record follow one another
            sizes = np.diff(starts)
            some = np.flatnonzero(sizes > 0)
            if not len(some):
                continue
            out = pd.DataFrame({"id": df["id"].to_numpy()[some], "h": text_key(codes, starts, 1)[some], "g": text_key(codes, starts, 2)[some], "m1": 0, "m2": 0})
            anchors = [np.zeros(0, np.int64)] * len(some)
            whole = sizes >= 3
            if whole.any():
                codes = codes[np.repeat(whole, sizes)]
                symbols = minhash_symbols(codes, np.concatenate([[0], np.cumsum(sizes[whole])]), blocks * width)
                at = np.flatnonzero(whole[some])
                out.loc[at, "m1"], out.loc[at, "m2"] = four_bit_marks(symbols[:16]), four_bit_marks(symbols[16:32])
                for i, row in zip(at, block_anchors(symbols, blocks, width), strict=True):
                    anchors[i] = row
            yield out.assign(anchors=anchors)

    return make


def cells_of(placed: DataFrame, left: bool) -> DataFrame:
    """Rows (anchor, rep, width, ...) once for each cell of their row (left) or column of the anchor's grid."""
    own = F.pmod(F.xxhash64("rep"), F.col("width"))
    others = F.sequence(F.lit(0).cast("long"), F.col("width") - 1)
    cells = F.transform(others, lambda j: own * F.col("width") + j if left else j * F.col("width") + own)
    return placed.withColumn("cell", F.explode(F.when(F.col("width") > 1, cells).otherwise(F.array(F.lit(0).cast("long")))))


def met_at_anchors(reps: DataFrame) -> DataFrame:
    """a < b of representatives (rep, m1, m2, anchors) that share an anchor and agree in AGREEING marks."""
    placed = reps.select(F.explode("anchors").alias("anchor"), "rep", "m1", "m2")
    sample = placed.where(F.pmod(F.xxhash64("rep"), F.lit(EVERY)) == 0)
    large = stored(sample.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * EVERY >= CELL).select("anchor", (F.ceil(F.col("n") * EVERY / CELL) + 1).cast("long").alias("width")), "p2-large")
    sides = [placed.withColumn("cell", F.lit(0).cast("long"))] * 2
    if not large.isEmpty():
        wide = placed.join(large, "anchor", "left").withColumn("width", F.coalesce("width", F.lit(1).cast("long")))
        sides = [cells_of(wide, left) for left in (True, False)]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    met = (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.rep") < F.col("b.rep")) & (agreeing(F.col("a.m1"), F.col("b.m1")) + agreeing(F.col("a.m2"), F.col("b.m2")) >= AGREEING)
    return a.join(b, met).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def near_duplicates(records: DataFrame, threshold: float = LIKENESS, blocks: int = BLOCKS, width: int = WIDTH, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (a < b, likeness) and membership (id, rep) of id, query, response records.

    ``exact`` finds the pairs by the sparse suffix array, which loses none and costs more.
    """
    records = records.select("id", "query", "response")
    prints = stored(records.mapInPandas(fingerprints(blocks, width), "id long, h long, g long, m1 long, m2 long, anchors array<long>"), "p2-fingerprints")
    reps = prints.groupBy("h", "g").agg(F.min("id").alias("rep"), F.first("m1").alias("m1"), F.first("m2").alias("m2"), F.first("anchors").alias("anchors"))
    members = prints.select("id", "h", "g").distinct().join(reps.select("h", "g", "rep"), ["h", "g"]).select("id", "rep")
    if exact:
        plain = records.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").groupBy("id").agg(F.first("query").alias("query"), F.first("response").alias("response"))
        plain = plain.select(F.lit("").alias("tbl"), F.col("id").alias("rep"), F.concat(plain_column("query"), plain_column("response")).alias("plain"))
        both = stored(plain.select("tbl", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("kind"), "rep", "plain"), "p2-exact")
        pairs = cross_split_pairs(both, threshold).where("rep_eval < rep_train")
        return pairs.select(F.col("rep_eval").alias("a"), F.col("rep_train").alias("b"), "likeness"), members
    candidates = stored(met_at_anchors(reps), "p2-candidates")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = records.join(ids, "id").groupBy("id").agg(F.first("query").alias("query"), F.first("response").alias("response"))
    texts = stored(texts.select("id", F.concat(plain_column("query"), plain_column("response")).alias("plain")), "p2-texts")
    read = candidates.join(texts.select(F.col("id").alias("a"), F.col("plain").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("plain").alias("y")), "b")
    pairs = read.select("a", "b", likeness_of_plain("x", "y").alias("likeness")).where(F.col("likeness") >= threshold)
    return pairs, members


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa_records").select(F.col("record_id").alias("id"), "query", "response")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a < id_b: every pair of records with a likeness of at least 0.6, equal ones included."""
    pairs, members = near_duplicates(qa_records(spark, sf_dir))
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    other = pairs.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = members.where("id <> rep").select("rep").distinct()
    m = members.join(copies, "rep", "left_semi")
    equal = m.alias("m").join(m.alias("n"), (F.col("m.rep") == F.col("n.rep")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("id_a"), F.col("n.id").alias("id_b"))
    return other.unionByName(equal)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record in a group of two or more: id, group_id (smallest id of the group), links (near-duplicate texts of its text)."""
    pairs, members = near_duplicates(qa_records(spark, sf_dir))
    pairs = stored(pairs.select("a", "b"), "p2-pairs")
    groups = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    known = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left").join(sizes, "rep")
    grouped = known.where("links is not null or copies > 1")
    return grouped.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
