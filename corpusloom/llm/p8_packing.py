"""Problem 8: filling fixed-capacity containers, by pattern packing with non-negative least squares.

Sizes are cut into at most GRID classes, counted (a histogram of at most GRID numbers goes to the
driver), and all patterns of up to PARTS classes that fill a container to the last class are listed.
Non-negative least squares fits repeat counts of the patterns to the histogram; they are rounded
down, and what is left is packed largest first, on counts: every step fills one container pattern
from the largest class down and repeats it until a class runs out.  Items are numbered within their
class (salted, so that a class of any size stays spread) and find their container from the plan by
arithmetic.

A text larger than the capacity gives full pieces, each a container of its own, and a rest that is
packed like a text; no other text is split.  Null and empty texts have size 0 and take no room: they
are assigned to container 'p0'.  Equal sizes are interchangeable, ties are broken by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import DEFAULT_RANKS, encoder
from corpusloom.llm.tables import stored, table

GRID, PARTS = 128, 3
#: Parts of a size class that are numbered on their own: at least SALTS, and one for so many items.
SALTS, ITEMS_PER_SALT = 32, 1_000_000


def count_batches(path: str):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoder(path).count
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "tokens": np.fromiter((count(t) if t else 0 for t in df["text"]), np.int64, len(df))})

    return make


def token_counts(documents: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    return documents.select("doc_id", "text").mapInPandas(count_batches(path), "doc_id long, tokens long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by active sets, on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = np.where(active, -1.0, target - gram @ x)
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(target).max())):
            break
        active[best] = True
        while active.any():
            at = np.flatnonzero(active)
            s = np.zeros_like(x)
            s[at] = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), target[at])
            if (s[at] > 0).all():
                x = s
                break
            low = active & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def full_patterns(grid: int, parts: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``parts`` classes whose sum is the grid."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, top: int, so_far: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(so_far)
        elif len(so_far) < parts:
            for k in range(min(rest, top), 0, -1):
                if k * (parts - len(so_far)) < rest:
                    break
                grow(rest - k, k, (*so_far, k))

    grow(grid, grid, ())
    return out


def plan_patterns(histogram: np.ndarray, grid: int, parts: int = PARTS) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: count} with their repeats that use up the histogram (index = class) exactly."""
    left, plan = histogram.astype(np.int64).copy(), []
    left[0] = 0
    if left.sum():
        present = np.flatnonzero(left)
        patterns = [p for p in full_patterns(grid, parts) if all(left[k] for k in p)]
        if patterns:
            row = {k: i for i, k in enumerate(present)}
            a = np.zeros((len(present), len(patterns)))
            for j, p in enumerate(patterns):
                for k in p:
                    a[row[k], j] += 1
            repeats = np.floor(nnls(a, left[present].astype(float)) + 1e-6).astype(np.int64)
            for j in np.argsort(-repeats, kind="stable"):
                need = {k: patterns[j].count(k) for k in set(patterns[j])}
                n = min(int(repeats[j]), *(int(left[k] // c) for k, c in need.items()))
                if n > 0:
                    for k, c in need.items():
                        left[k] -= n * c
                    plan.append((need, n))
        while left.any():
            need, room = {}, grid
            k = int(np.flatnonzero(left)[-1])
            while room and k:
                take = min(room // k, int(left[k]))
                if take:
                    need[k] = take
                    room -= take * k
                lower = np.flatnonzero(left[: min(k, room + 1)])
                k = int(lower[-1]) if lower.size else 0
            n = min(int(left[k] // c) for k, c in need.items())
            for k, c in need.items():
                left[k] -= n * c
            plan.append((need, n))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each class, ranges of item numbers: items low.. of a class go to containers first.., ``per`` to each."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for need, n in plan:
        for k, per in need.items():
            rows.append((k, used.get(k, 0), per, first))
            used[k] = used.get(k, 0) + n * per
        first += n
    return pd.DataFrame(rows, columns=["size_class", "low", "per", "first"])


def find_containers(ranges: pd.DataFrame):
    by_class = {k: (g["low"].to_numpy(), g["per"].to_numpy(), g["first"].to_numpy()) for k, g in ranges.sort_values("low", kind="stable").groupby("size_class")}

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = np.zeros(len(df), np.int64)
            for k, rows in df.groupby("size_class").indices.items():
                if k:
                    low, per, first = by_class[k]
                    rank = df["rank"].to_numpy()[rows]
                    at = np.searchsorted(low, rank, "right") - 1
                    out[rows] = first[at] + (rank - low[at]) // per[at]
            yield pd.DataFrame({"doc_id": df["doc_id"], "piece": df["piece"], "start": df["start"], "tokens": df["tokens"], "container": "p" + pd.Series(out, index=df.index).astype(str)})

    return make


def pack(sizes: DataFrame, capacity: int, salts: int = SALTS, grid: int = GRID) -> DataFrame:
    """doc_id, piece, start (first token), tokens, container for sizes (doc_id, tokens)."""
    grid = min(grid, capacity)
    large = F.col("tokens") > capacity
    full = sizes.where(large).select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("tokens") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("tokens"), F.concat(F.lit("f"), "doc_id", F.lit("-"), "piece").alias("container"))
    rest = sizes.where(~large | (F.col("tokens") % capacity > 0)).select(
        "doc_id",
        F.when(large, F.floor(F.col("tokens") / capacity)).otherwise(0).cast("int").alias("piece"),
        F.when(large, F.col("tokens") - F.col("tokens") % capacity).otherwise(0).cast("long").alias("start"),
        F.when(large, F.col("tokens") % capacity).otherwise(F.col("tokens")).alias("tokens"),
    )
    rest = rest.withColumns({"size_class": F.ceil(F.col("tokens") * grid / capacity).cast("int"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
    counts = rest.groupBy("size_class", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size_class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.withColumn("before", before), "p8-offsets")
    histogram = np.zeros(grid + 1, np.int64)
    for k, n in offsets.groupBy("size_class").agg(F.sum("n")).collect():  # at most grid + 1 rows
        histogram[k] = n
    numbered = rest.withColumn("local", F.row_number().over(Window.partitionBy("size_class", "salt").orderBy("doc_id")))
    numbered = numbered.join(offsets.select("size_class", "salt", "before"), ["size_class", "salt"])
    ranked = numbered.select("doc_id", "piece", "start", "tokens", "size_class", (F.col("before") + F.col("local") - 1).alias("rank"))
    packed = ranked.mapInPandas(find_containers(slots(plan_patterns(histogram, grid))), "doc_id long, piece int, start long, tokens long, container string")
    return packed.unionByName(full)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, capacity, doc_id, piece, start, tokens, container: every document under every capacity of token_limits."""
    sizes = stored(token_counts(table(spark, sf_dir, "documents")), "p8-sizes")
    salts = max(SALTS, sizes.count() // ITEMS_PER_SALT)
    out = None
    for r in table(spark, sf_dir, "token_limits").orderBy("limit_id").collect():  # a fixed table of settings
        one = pack(sizes, r["capacity"], salts).select(F.lit(r["limit_id"]).cast("long").alias("limit_id"), F.lit(r["capacity"]).cast("int").alias("capacity"), "doc_id", "piece", "start", "tokens", "container")
        out = one if out is None else out.unionByName(one)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, containers, tokens, fill (share of the room used)."""
    per = p8_containers(spark, sf_dir).groupBy("limit_id", "capacity", "container").agg(F.sum("tokens").alias("used")).where("used > 0")
    return per.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / F.sum("capacity"), 6).alias("fill"))
