"""A partitioned index for nearest neighbours: rows by the nearest of some centroids, searched in a few cells.

Centroids are fitted on a sample of at most ``SAMPLE`` rows, in hash order, and so is the number of
cells that a search must read for a recall of TARGET; every row is indexed.  Cells and the centroids
that tasks get are bounded by ``CELLS``.  A cell of any size is searched in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

#: Rows of the sample, cells, and rows of a block at most.
SAMPLE, CELLS, BLOCK = 20_000, 4096, 8192
#: Share of the nearest neighbours of TRIED rows of the sample that lie in the cells searched.
TARGET, TRIED, NEAREST = 0.96, 256, 10


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, id, vec of every row with a vector; centroids: cells x dimensions, of unit length; probes: cells of a search."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def fitted_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; a cell without rows keeps its centroid."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    at = np.linspace(0, len(unit) - 1, cells).astype(int)
    centroids = unit[at].copy()
    for _ in range(rounds):
        own = np.argmax(unit @ centroids.T, axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centroids)
    return centroids


def fitted_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """So many nearest cells of a row hold TARGET of its neighbours in the sample."""
    own = np.argmax(sample @ centroids.T, axis=1)
    at = np.arange(min(TRIED, len(sample)))
    scores = sample[at] @ sample.T
    scores[at, at] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(NEAREST, len(sample) - 1)]
    if not near.size:
        return 1
    place = np.argsort(np.argsort(-(sample[at] @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), TARGET, method="higher")) + 1


def nearest_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows (id, vec) with each of their ``probes`` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # CELLS x dimensions at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                scores = np.stack(df["vec"].to_numpy()) @ shared.value.T
                some = min(probes, scores.shape[1])
                best = np.argpartition(-scores, some - 1, axis=1)[:, :some]
                at = np.repeat(np.arange(len(df)), some)
                yield pd.DataFrame({"cell": best.ravel(), "id": df["id"].to_numpy()[at], "vec": df["vec"].to_numpy()[at]})

    return rows.mapInPandas(assign, "cell int, id long, vec array<double>")


def build_index(vectors: DataFrame, cells: int | None = None) -> VectorIndex:
    """Index of vectors (id, vec); null vectors are left out.  Cells default to the root of the number of rows."""
    rows = vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()  # SAMPLE rows at most
    if sample.empty:
        return VectorIndex(rows.select(F.lit(0).alias("cell"), "id", "vec"), np.zeros((1, 1)), 1)
    cells = min(cells or max(1, round(math.sqrt(rows.count()))), CELLS, len(sample))
    known = np.stack(sample["vec"].to_numpy())
    centroids = fitted_centroids(known, cells)
    return VectorIndex(stored(nearest_cells(rows, centroids, 1), "vector-index"), centroids, fitted_probes(known, centroids))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(a, b, score, place): the k rows b with the highest inner product in the ``probes`` nearest cells of each query a (id, vec).

    Without ``probes``, as many as were fitted.  A query is not compared with a row of its
    own id.  Ties go to the smaller id.
    """
    probes = probes or index.probes
    asked = queries.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    groups = max(1, math.ceil(asked.count() / BLOCK))
    parts = index.rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # one row for each cell
    rows = index.rows.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "vec")
    seek = nearest_cells(asked, index.centroids, probes).join(F.broadcast(parts), "cell")
    seek = seek.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), "id", "vec")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "score": []})
        y = y.sort_values("id")
        ids = y["id"].to_numpy()
        scores = np.stack(x["vec"].to_numpy()) @ np.stack(y["vec"].to_numpy()).T
        scores[x["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(x)), top.shape[1])
        out = pd.DataFrame({"a": x["id"].to_numpy()[at], "b": ids[top.ravel()], "score": scores[at, top.ravel()]})
        return out[np.isfinite(out["score"])]

    keys = ("cell", "part", "group")
    found = seek.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, "a long, b long, score double")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.asc("b")))  # k rows for each block searched
    return found.withColumn("place", place).where(F.col("place") <= k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (a, b) that were found."""
    hit, total = truth.select("a", "b").join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("hit"), F.count("*")).first()
    return hit / total if total else 1.0
