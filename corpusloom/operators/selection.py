"""Deterministic samples, splits, quotas, top-k and slices.

A shuffle of another language's generator cannot be repeated; every sample here is by hash order, so
its counts are the same and its members are those of any engine with SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hash_order
from corpusloom.operators.dedup import independent_first
from corpusloom.session import stored


def first_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def hash_sample(rows: DataFrame, by: list[str], seed: int, key: str, n: int) -> DataFrame:
    return first_n(rows, by, [hash_order(seed, *map(F.col, [*by, key]))], n)


def held_out_count(total: Column, share: float = 0.2) -> Column:
    """Half-even share, at least 1 and at most total - 1; 0 for a class of at most one."""
    return F.when(total <= 1, 0).otherwise(F.least(F.greatest(F.bround(total * share).cast("long"), F.lit(1)), total - 1))


def _digits(h: Column) -> Column:
    """The first 16 bits of a hex digest."""
    return F.conv(F.left(h, F.lit(4)), 16, 10).cast("int")


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = 42, share: float = 0.2) -> DataFrame:
    """Rows with part: heldout or train, per stratum by hash order.

    Hashes are counted by their first 16 bits; only rows of the bucket in which the count of a stratum is
    reached are ranked, so a stratum of any size stays spread.
    """
    hashed = rows.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_d", _digits(F.col("_h")))
    counts = hashed.groupBy(F.col(stratum).alias("_s"), "_d").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_s")  # 65,536 rows at most
    running = counts.select("_s", "_d", held_out_count(F.sum("n").over(w), share).alias("want"), F.sum("n").over(w.orderBy("_d")).alias("upto"), "n")
    border = running.where(F.col("upto") >= F.col("want")).groupBy("_s").agg(F.min_by("_d", "_d").alias("_edge"), F.min_by(F.col("want") - F.col("upto") + F.col("n"), "_d").alias("_rest"))
    marked = hashed.join(border, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    inner = marked.where("_d = _edge").withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy("_h")))
    outer = marked.where("_d <> _edge").withColumn("_place", F.lit(None).cast("int"))
    held = F.when(F.col("_place").isNull(), F.col("_d") < F.col("_edge")).otherwise(F.col("_place") <= F.col("_rest"))
    return inner.unionByName(outer).withColumn("part", F.when(held, "heldout").otherwise("train")).drop("_h", "_d", "_edge", "_rest", "_place")


def three_way_split(rows: DataFrame, key: str, seed: int = 42, validation: float = 1.0, test: float = 1.0) -> DataFrame:
    """Rows with part by hash bucket of 10,000: validation and test percent first, the rest train.

    A bucket test needs no global rank, so no shuffle; shares hold in expectation.
    """
    bucket = F.pmod(F.conv(F.left(hash_order(seed, F.col(key)), F.lit(8)), 16, 10).cast("long"), F.lit(10_000))
    v, t = round(validation * 100), round(test * 100)
    return rows.withColumn("part", F.when(bucket < v, "validation").when(bucket < v + t, "test").otherwise("train"))


def exact_validation(rows: DataFrame, key: str, percent: float, seed: int = 42) -> DataFrame:
    """Rows with part; ceil(n * percent / 100) of them are validation, by hash order.

    The threshold is the hash of that rank: counts by the first 16 bits name its bucket, and only the
    bucket is sorted.
    """
    hashes = rows.select(hash_order(seed, F.col(key)).alias("_h")).withColumn("_d", _digits(F.col("_h")))
    counts = sorted(hashes.groupBy("_d").count().collect())  # 65,536 rows at most
    most = math.ceil(round(sum(c["count"] for c in counts) * percent / 100, 9))
    limit = None
    for c in counts:
        if 0 < most <= c["count"]:
            limit = hashes.where(F.col("_d") == c["_d"]).orderBy("_h").limit(most).agg(F.max("_h").alias("h")).first()["h"]
            break
        most -= c["count"]
    return rows.withColumn("part", F.when(hash_order(seed, F.col(key)) <= F.lit(limit), "validation").otherwise("train"))


def evenly_spaced(rows: DataFrame, by: str, order: list[Column], n: int = 16) -> DataFrame:
    """Rows at positions floor(i * size / n) of each group."""
    w = Window.partitionBy(by)
    at = rows.withColumns({"_p": F.row_number().over(w.orderBy(*order)) - 1, "_s": F.count("*").over(w)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_s") / n))
    return at.where(F.array_contains(spots, F.col("_p").cast("long"))).drop("_p", "_s")


def slice_rows(rows: DataFrame, order: list[Column], start: int, stop: int) -> DataFrame:
    """Rows start..stop of a total order; an ordered offset and limit, so no single-partition rank."""
    return rows.orderBy(*order).offset(start).limit(max(0, stop - start))


def margin(rows: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """Best row per group with its score, the runner-up's (0.0 without one) and their difference."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    ranked = rows.withColumns({"_n": F.row_number().over(w), "second": F.coalesce(F.lead(score).over(w), F.lit(0.0))})
    return ranked.where("_n = 1").drop("_n").withColumn("margin", F.col(score) - F.col("second"))


def top_k(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """k best rows per group with their place; ties by position."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def retained_checkpoints(history: DataFrame, metrics: list[str], k: int, step: str = "step", current: int | None = None) -> DataFrame:
    """Union over metrics of the k best steps (larger step on ties), and the current one."""
    out = None
    for m in metrics:
        one = history.where(F.col(m).isNotNull()).orderBy(F.desc(m), F.desc(step)).limit(k).select(step)
        out = one if out is None else out.union(one)
    if current is not None:
        out = out.union(history.where(F.col(step) == current).select(step))
    return out.distinct()


def greedy_quota(candidates: DataFrame, conflicts: DataFrame, quotas: list[tuple[str, str, int]]) -> DataFrame:
    """(id, split, category, decision) of greedy selection in a fixed order.

    ``candidates``: id (its order), category, rejected (a reason or null, found beforehand in
    parallel); ``conflicts``: a, b; ``quotas``: (split, category, target) in their order, a list of
    settings.  Each step takes the first ``target`` candidates of its category that conflict with
    nothing selected before them.  A candidate passed over is used up ("conflict"), one behind the
    last selected stays for later steps; in the end it is "unused".  A step is keep-first over the
    conflict graph of the first candidates that are left, and of four times as many more that conflict with
    nothing kept until the target is reached, so it is exact and its rounds end with the target; a quota that
    is not met raises.
    """
    conflicts = stored(conflicts.select("a", "b"), "quota-conflicts")
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    state = stored(candidates.select("id", "category", F.lit(None).cast("string").alias("split"), F.col("rejected").alias("decision")), "quota")
    for split, category, target in quotas:
        left = state.where((F.col("category") == category) & F.col("decision").isNull())
        chosen = state.where("decision = 'selected'").select(F.col("id").alias("b"))
        blocked = both.join(chosen, "b", "left_semi").select(F.col("a").alias("id")).distinct()
        free = stored(left.join(blocked, "id", "left_anti").select("id"), "quota-free")
        taken = _first_independent(free, both, target)
        n, last = taken.agg(F.count("*"), F.max("id")).first()
        if n < target:
            raise ValueError(f"quota of {split}/{category} is {target}, {n} candidates are left")
        passed = left.where(F.col("id") <= last).select("id").join(taken, "id", "left_anti").withColumn("new", F.lit("conflict"))
        marks = taken.withColumn("new", F.lit("selected")).unionByName(passed)
        state = stored(state.join(marks, "id", "left").select("id", "category", F.when(F.col("new") == "selected", F.lit(split)).otherwise(F.col("split")).alias("split"), F.coalesce("new", "decision").alias("decision")), "quota")
    return state.select("id", "split", "category", F.coalesce("decision", F.lit("unused")).alias("decision"))


#: Candidates of a window that is decided on the driver; larger windows are decided in rounds.
WINDOW = 1024


def _kept_of(window: DataFrame, inner: DataFrame, size: int) -> DataFrame:
    """Ids of keep-first over the conflicts a < b of a window of at most ``size`` ids."""
    if size > WINDOW:
        return independent_first(window, inner).where("kept").select("id")
    earlier: dict = {}
    for a, b in inner.select("a", "b").distinct().collect():  # WINDOW * WINDOW / 2 rows at most
        earlier.setdefault(b, set()).add(a)
    kept: set = set()
    for (i,) in sorted(window.collect()):
        if kept.isdisjoint(earlier.get(i, ())):
            kept.add(i)
    return window.sparkSession.createDataFrame([(i,) for i in kept], window.schema)


def _first_independent(nodes: DataFrame, both: DataFrame, target: int) -> DataFrame:
    """The first ``target`` ids of keep-first over the conflicts (a, b, in both directions) of the nodes, in windows that grow fourfold."""
    kept, size = None, max(64, 4 * target)
    while True:
        window = stored(nodes.orderBy("id").limit(size), "quota-window")
        inner = both.join(window.select(F.col("id").alias("a")), "a", "left_semi").join(window.select(F.col("id").alias("b")), "b", "left_semi").where("a < b")
        new = stored(_kept_of(window, inner, size), "quota-kept")
        kept = new if kept is None else kept.union(new)
        n, last = window.agg(F.count("*"), F.max("id")).first()
        if n < size or kept.count() >= target:
            return stored(kept.orderBy("id").limit(target), "quota-taken")
        met = both.join(new.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        nodes = stored(nodes.where(F.col("id") > last).join(met, "id", "left_anti"), "quota-rest")
        size *= 4


def accounting(source: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """One row: source rows, and those that are missing, repeated or foreign among accepted and rejected."""
    used = accepted.select(key).unionAll(rejected.select(key)).groupBy(key).agg(F.count("*").alias("n"))
    both = source.select(key, F.lit(1).alias("there")).join(used, key, "full_outer")
    return both.agg(F.count("there").alias("source_rows"), F.count_if(F.expr("n is null")).alias("missing"), F.count_if(F.expr("n > 1")).alias("repeated"), F.count_if(F.expr("there is null")).alias("foreign"))
