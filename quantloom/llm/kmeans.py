"""Centroid clustering of integer vectors with Hamerly's bounds.

A vector keeps an upper bound on its distance to its centroid and one lower bound on its distance to the second nearest.
When centroids move, the upper bound grows by the drift of its centroid and the lower one shrinks by the largest drift
of the others. While the upper one is below the lower one the vector can't change its cluster; else its own distance is
computed, and if that doesn't decide, all distances are, exactly, in integers. Rounds are written tables of vectors with
their bounds; sums of clusters come from the same pass, a row for each cluster and component of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ship import ship_package
from quantloom.llm.common import forget, materialise, tidy
from quantloom.llm.vectors import matrix, products, usable, whole_numbers

#: Bounds are loosened by this share and this length, far above what floating point loses.
SHARE, LENGTH = 1e-12, 1e-6
STATE = "kind int, id long, vec array<int>, cluster int, upper double, lower double, distance long, totals array<long>"
VECTOR, TOTAL = 0, 1


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of rows of integers."""
    square = lambda m: np.einsum("ij,ij->i", m, m)
    return square(x)[:, None] + square(c)[None, :] - 2 * products(x, c)


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), upper bound and second-nearest lower bound by full scans."""
    d = squared_distances(x, centroids)
    nearest = d.argmin(axis=1)
    first = np.sqrt(d[np.arange(len(x)), nearest].astype(np.float64)) * (1 + SHARE) + LENGTH
    if len(centroids) == 1:
        return nearest, first, np.full(len(x), np.inf)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SHARE) - LENGTH
    return nearest, first, second


def moved(
    x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment and bounds after centroids drifted, and how many vectors needed a full scan."""
    order = np.argsort(-drift)
    others = np.where(cluster == order[0], drift[order[1]] if len(drift) > 1 else 0.0, drift[order[0]])
    cluster, upper, lower = cluster.copy(), upper + drift[cluster], lower - others
    open_ = np.flatnonzero(upper >= lower)
    own = x[open_].astype(np.int64) - centroids[cluster[open_]]
    upper[open_] = np.sqrt(np.einsum("ij,ij->i", own, own).astype(np.float64)) * (1 + SHARE) + LENGTH
    open_ = open_[upper[open_] >= lower[open_]]
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = assigned(x[open_], centroids)
    return cluster, upper, lower, len(open_)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    d = after - before
    return np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + SHARE) + np.where((d != 0).any(axis=1), LENGTH, 0.0)


def one_round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """``state`` after one more assignment, and rows of the kind TOTAL with what each task found of a cluster: the sum of
    each component, then the count."""
    columns = STATE.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), np.int64)
            if drift is None:
                cluster, upper, lower = assigned(x, centroids)
            else:
                kept = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                cluster, upper, lower, _ = moved(x, *kept, centroids, drift)
            own = x - centroids[cluster]
            distance = np.einsum("ij,ij->i", own, own) if last else None
            for k in np.unique(cluster):
                of = x[cluster == k]
                totals[k, :-1] += of.sum(axis=0)
                totals[k, -1] += len(of)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, VECTOR), pa.int32()),
                    batch.column("id"),
                    batch.column("vec"),
                    pa.array(cluster, pa.int32()),
                    pa.array(upper),
                    pa.array(lower),
                    pa.nulls(n, pa.int64()) if distance is None else pa.array(distance),
                    pa.nulls(n, pa.list_(pa.int64())),
                ],
                [c.split()[0] for c in columns],
            )
        there = np.flatnonzero(totals[:, -1])
        if len(there):
            n = len(there)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, TOTAL), pa.int32()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.list_(pa.int32())),
                    pa.array(there, pa.int32()),
                    pa.nulls(n, pa.float64()),
                    pa.nulls(n, pa.float64()),
                    pa.nulls(n, pa.int64()),
                    pa.array(totals[there].tolist(), pa.list_(pa.int64())),
                ],
                [c.split()[0] for c in columns],
            )

    return state.mapInArrow(tidy(run), STATE)


def updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise exact floor(sum / count) of every cluster that has vectors; others stay."""
    each = state.where(F.col("kind") == TOTAL).select("cluster", F.posexplode("totals").alias("k", "total"))
    summed = each.groupBy("cluster", "k").agg(F.sum("total").alias("total")).collect()
    totals = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for r in summed:
        totals[r["cluster"], r["k"]] = r["total"]
    after, there = centroids.copy(), totals[:, -1] > 0
    after[there] = totals[there, :-1] // totals[there, -1:]
    return after


def clusters(
    vectors: DataFrame,
    n_clusters: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: str = "2:",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly ``dim``
    components, none of them null or non-finite; others take no part.

    Centroids begin as the vectors with the smallest SHA-256 of ``seed`` and their id. Defined results: vectors with a null
    id are assigned, but begin a centroid only where there are fewer others than centroids, and rows that repeat an id
    are vectors like any others, taken in order of their components; fewer vectors than centroids make fewer centroids;
    an empty table gives an empty one; a component beyond 2**24 / ``scale`` is an error, as its squares don't fit in a
    long. Other columns don't matter, whatever their names. The driver holds the centroids and their sums, no vectors."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    fit = usable(F.col("vec")) & (F.size("vec") == dim)
    rows = rows.where(F.coalesce(fit, F.lit(False))).select("id", whole_numbers(F.col("vec"), scale).alias("vec"))
    state = materialise(rows, "vectors")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = state.orderBy(hashed.asc_nulls_last(), "vec").limit(n_clusters).collect()
    if not first:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, drift = np.array([r["vec"] for r in first], np.int64), None
    for n in range(rounds + 1):
        before, last = state, n == rounds
        state = materialise(one_round(state.where(F.col("kind") == VECTOR) if n else state, centroids, drift, last), f"round{n}")
        forget(before)
        if not last:
            after = updated(state, centroids)
            drift, centroids = drifts(centroids, after), after
    return described(state.where(F.col("kind") == VECTOR), centroids, id_col)


def described(state: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """Distances summed over each cluster and over all, and the hash of each centroid."""
    spark = state.sparkSession
    names = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())], "cluster int, components string")
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(names, "cluster")
    each = inertia.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # as many rows as centroids
    return state.join(F.broadcast(each), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256")
    )
