"""Exact, near and greedy deduplication, leakage against references, overlap reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored


def keep_first(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """First row per key in a total order; rows with a null key form one group like any other.

    The filter on the rank becomes a group limit before the shuffle, so a hot key sends one row per task.
    """
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def exact_dedup(rows: DataFrame, query_key: str, pair_key: str, order: str) -> DataFrame:
    """Rows that are first by query key, and of these first by pair key."""
    once = keep_first(rows, F.col(query_key), [F.col(order)])
    return keep_first(once, F.col(pair_key), [F.col(order)])


def independent_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept, by): keep-first over a conflict graph, by rounds.

    ``nodes``: id (its order); ``edges``: a < b in conflict.  A node is kept if no kept earlier node
    conflicts with it; ``by`` is the earliest kept one otherwise.  Each round decides every node all of
    whose earlier neighbours are decided, so rounds are bounded by the longest chain.  Nodes that are
    decided, and their edges, leave the next round; what is left is stored.
    """
    edges = stored(edges.select("a", "b", F.lit(False).alias("a_kept")).where("a < b").distinct(), "mis-edges")
    open_nodes = nodes.select("id")
    decided: list[DataFrame] = []
    while True:
        seen = edges.groupBy(F.col("b").alias("id")).agg(F.count_if(~F.col("a_kept")).alias("undecided"), F.min(F.when(F.col("a_kept"), F.col("a"))).alias("by"))
        judged = stored(open_nodes.join(seen, "id", "left").select("id", (F.coalesce("undecided", F.lit(0)) == 0).alias("decided"), "by"), "mis-state")
        new = judged.where("decided").select("id", F.col("by").isNull().alias("kept"), "by")
        decided.append(new)
        open_nodes = judged.where("not decided").select("id")
        if open_nodes.isEmpty():
            return functools.reduce(DataFrame.unionByName, decided)
        fate = new.select(F.col("id").alias("a"), F.col("kept").alias("new_kept"))
        rest = edges.join(open_nodes.select(F.col("id").alias("b")), "b", "left_semi").join(fate, "a", "left").where("new_kept is null or new_kept")
        edges = stored(rest.select("a", "b", (F.col("a_kept") | F.col("new_kept").isNotNull()).alias("a_kept")), "mis-edges")


def near_dedup(rows: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """Rows kept by greedy keep-first, with the earliest kept match of the dropped ones."""
    return rows.join(independent_first(rows.select(F.col(order).alias("id")), edges), F.col(order) == F.col("id")).drop("id")


def near_dedup_texts(rows: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """(id, kept, by) of greedy keep-first over texts (id, text) with a Jaccard of n-grams >= threshold.

    Equal texts are one node: their first id stands for them, and its fate decides theirs (the first
    is the earliest kept match of its copies, or their earliest kept match is its own).  A group of
    copies of any size gives no edge.  Null texts are kept.  Copies are told by 128 bits of hashes.
    """
    from corpusloom.operators.simjoin import distinct_pairs

    hashes = F.xxhash64("text").alias("h"), F.xxhash64(F.lit(5), "text").alias("g")
    rows = stored(rows.select("id", "text"), "near-rows")
    there = rows.where("text is not null and text <> ''")
    nodes = stored(there.groupBy("text").agg(F.min("id").alias("id")).select("id", "text"), "near-firsts")
    state = independent_first(nodes.select("id"), distinct_pairs(nodes, threshold, n))
    fate = nodes.select(F.col("id").alias("first"), *hashes).join(state.select(F.col("id").alias("first"), F.col("kept").alias("_kept"), F.col("by").alias("_by")), "first")
    both = there.select("id", *hashes).join(fate, ["h", "g"])
    alone = F.col("first") == F.col("id")
    judged = both.select("id", F.when(alone, F.col("_kept")).otherwise(False).alias("kept"), F.when(alone, F.col("_by")).otherwise(F.coalesce("_by", "first")).alias("by"))
    bare = rows.where("text is null or text = ''")
    return judged.unionByName(bare.select("id", F.lit(True).alias("kept"), F.lit(None).cast(rows.schema["id"].dataType).alias("by")))


def not_in(rows: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the reference; a null key is in nothing."""
    return rows.join(reference.select(on).distinct(), on, "left_anti")


def exact_reference(rows: DataFrame, references: DataFrame) -> DataFrame:
    """First reference by query norm, else by pair norm: ref_line and how it matched.

    ``rows``: id, query_norm, pair_norm; ``references``: line, query_norm, pair_norm.
    """
    by_query = references.groupBy("query_norm").agg(F.min("line").alias("q_line"))
    by_pair = references.groupBy("pair_norm").agg(F.min("line").alias("p_line"))
    both = rows.join(by_query, "query_norm", "left").join(by_pair, "pair_norm", "left")
    how = F.when(F.col("q_line").isNotNull(), "query").when(F.col("p_line").isNotNull(), "pair")
    return both.select("id", F.coalesce("q_line", "p_line").alias("ref_line"), how.alias("matched"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys on both sides."""
    return left.select(key).where(F.col(key).isNotNull()).intersect(right.select(key)).agg(F.count("*").alias("shared"))


def split_overlaps(rows: DataFrame, split: str, key: str) -> DataFrame:
    """(left_split, right_split, shared): distinct keys that two splits share, every pair with one."""
    once = rows.select(split, key).where(F.col(key).isNotNull() & F.col(split).isNotNull()).distinct()
    a, b = once.alias("a"), once.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{split}") < F.col(f"b.{split}")))
    return both.groupBy(F.col(f"a.{split}").alias("left_split"), F.col(f"b.{split}").alias("right_split")).agg(F.count("*").alias("shared"))


def _keyed(rows: DataFrame) -> DataFrame:
    """id and 128-bit hashes of query_norm and pair_norm (null for null), every key once: equality without the texts."""
    both = [F.when(F.col(k).isNotNull(), F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(5), k).alias("g"))).alias(k) for k in ("query_norm", "pair_norm")]
    return rows.select("id", *both).distinct()


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(f"{key} <> ''").select("id", F.col(key).alias("text"))


def _near_ids(rows: DataFrame, references: DataFrame, key: str, threshold: float, n: int) -> DataFrame:
    """(a, b): rows and references (id, key) with a Jaccard of n-grams >= threshold; equal references count as their first."""
    from corpusloom.operators.simjoin import text_pairs

    left = _texts(rows, key)
    pairs = text_pairs(left, _texts(references, key), threshold, n).select("x", F.col("y").alias("b"))
    hashed = left.select("id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(5), "text").alias("g")).distinct()
    first = hashed.groupBy("h", "g").agg(F.min("id").alias("x"))
    return pairs.join(hashed.join(first, ["h", "g"]).select("x", F.col("id").alias("a")), "x").select("a", "b")


def exact_then_near(rows: DataFrame, query_threshold: float, pair_threshold: float, n: int) -> DataFrame:
    """(id, kept, by) of greedy keep-first by near queries or pairs, over the rows (id, query_norm, pair_norm) that ``exact_dedup`` keeps.

    A query stands in the dedup under its first id or not at all, a pair under one id at most, so near texts are
    sought over all rows and renamed; only hashes are shuffled for the exact part.  Rows may hold a key several
    times; they are read several times.
    """
    from corpusloom.operators.simjoin import text_pairs

    keys = stored(_keyed(rows), "near-keys")
    kept = stored(exact_dedup(keys, "query_norm", "pair_norm", "id"), "near-kept")
    named = keys.groupBy("pair_norm").agg(F.min("id").alias("rep")).join(kept, "pair_norm").select("rep", "id")
    edges = []
    for key, threshold, names in (("query_norm", query_threshold, kept.select(F.col("id").alias("rep"), "id")), ("pair_norm", pair_threshold, named)):
        pairs = text_pairs(_texts(rows, key), None, threshold, n).select("x", "y")
        both = pairs.join(names.toDF("x", "a"), "x").join(names.toDF("y", "b"), "y")
        edges.append(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return independent_first(kept.select("id"), edges[0].union(edges[1]).distinct())


def leaked(rows: DataFrame, references: DataFrame, query_threshold: float, pair_threshold: float, n: int) -> DataFrame:
    """Ids of the rows (id, query_norm, pair_norm) that any reference equals or is near to, by query or by pair; a null is like nothing.

    Both may hold a key several times; they are read several times, and texts are shuffled for candidates only.
    """
    left, right = stored(_keyed(rows), "leak-rows"), stored(_keyed(references), "leak-references")
    out = left.join(right.select("query_norm").distinct(), "query_norm", "left_semi").select("id")
    out = out.union(left.join(right.select("pair_norm").distinct(), "pair_norm", "left_semi").select("id"))
    for key, threshold in (("query_norm", query_threshold), ("pair_norm", pair_threshold)):
        out = out.union(_near_ids(rows, references, key, threshold, n).select("a"))
    return out.distinct()


def overlap_counts(left: DataFrame, right: DataFrame, query_threshold: float, pair_threshold: float, n: int) -> DataFrame:
    """One row of counts of left rows (id, query_norm, pair_norm) that meet the right.

    exact_query, exact_pair (without the former): over all right rows.  near_query, near_pair: of the
    first right row that is near by either; any_match: rows with one.  Empty texts are near to nothing.
    Both may hold a key several times; they are read several times, and texts are shuffled for candidates only.
    """
    q = _near_ids(left, right, "query_norm", query_threshold, n).select("a", "b", F.lit(True).alias("q"), F.lit(False).alias("p"))
    p = _near_ids(left, right, "pair_norm", pair_threshold, n).select("a", "b", F.lit(False).alias("q"), F.lit(True).alias("p"))
    met = q.unionByName(p).groupBy("a", "b").agg(F.bool_or("q").alias("q"), F.bool_or("p").alias("p"))
    first = met.groupBy("a").agg(F.min_by(F.struct("q", "p"), "b").alias("m"))
    near = first.agg(F.count_if("m.q").alias("near_query"), F.count_if("m.p").alias("near_pair"), F.count("*").alias("any_match"))
    mine, theirs = stored(_keyed(left), "overlap-left"), stored(_keyed(right), "overlap-right")
    by_query = mine.join(theirs.select("query_norm").distinct(), "query_norm", "left_semi")
    by_pair = mine.join(theirs.select("pair_norm").distinct(), "pair_norm", "left_semi").join(by_query.select("id"), "id", "left_anti")
    return by_query.agg(F.count("*").alias("exact_query")).crossJoin(by_pair.agg(F.count("*").alias("exact_pair"))).crossJoin(near)


def first_match_flags(pairs: DataFrame) -> DataFrame:
    """Per left row the first right row (by ``order``) with any flag, and the counts of that row's flags only."""
    any_flag = F.col("query_equal") | F.col("pair_equal") | F.col("near")
    first = pairs.where(any_flag).groupBy("a").agg(F.min_by(F.struct("query_equal", "pair_equal", "near"), F.col("order")).alias("m"))
    pair_only = F.col("m.pair_equal") & ~F.col("m.query_equal")
    return first.agg(F.count_if("m.query_equal").alias("exact_query"), F.count_if(pair_only).alias("exact_pair"), F.count_if("m.near").alias("semantic"), F.count("*").alias("any_match"))
