"""Centroid clustering with Drake's adaptive bounds, in whole numbers, so that every run gives the same rows.

A vector keeps, besides its cluster, lower bounds for the distances to its next-nearest centroids, in order, and one bound
for all the rest. A round moves the bounds by what the centroids have moved. Where the exact distance to the own centroid
is below all bounds, nothing else is computed. Else the distances to the listed centroids are computed, and where the
nearest of them is below the bound of the rest it is certified; only where that fails too, all centroids are scanned again.
The number of listed centroids adapts: after each round it is what the vectors needed, at least an eighth of all centroids.

State goes through a written table each round; sums come from Spark's own partial aggregation, so a cluster of any size
costs each task one row. The driver holds only centroids, counts and sums: ``k`` rows of ``dims`` numbers.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinite component are left out, as are
those with a scaled component beyond 2**27, whose squared distances would not fit a long. Null ids are kept as ids of their
own (seed text ``null``). Repeated rows are clustered each; of repeated ids with different vectors the first starting one is
the one with the smaller vector. With fewer vectors than ``k`` each starts a centroid; equal centroids leave the later ones
empty, and they stay. An empty table gives an empty result. Columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import materialize

#: Largest scaled component, so that a squared distance over up to 64 components is below 2**62.
MOST = 1 << 27
#: Relative slack of bounds, which are doubles: what is closer than this is computed exactly.
SLACK = 1e-9
#: Below this, products and their sums over the components are exact in doubles.
EXACT = 1 << 20

STATE = [("cluster", pa.int32()), ("distance", pa.int64()), ("near", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())), ("rest", pa.float64()), ("used", pa.int32()), ("n_distances", pa.int64())]


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) <= EXACT else np.int64
    a, b = x.astype(kind), centers.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)


def full_scan(x: np.ndarray, centers: np.ndarray, n_near: int) -> tuple[np.ndarray, ...]:
    """(cluster, distance, near, lower, rest) from all distances; ties go to the smaller number."""
    d = squared_distances(x, centers)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1)) * (1 - SLACK)
    rest = root[:, n_near + 1] if n_near + 1 < len(centers) else np.full(len(x), np.inf)
    return order[:, 0], np.take_along_axis(d, order[:, :1], 1)[:, 0], order[:, 1 : n_near + 1], root[:, 1 : n_near + 1], rest


def reassign(x: np.ndarray, centers: np.ndarray, moved: np.ndarray, cluster: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, n_near: int) -> tuple[np.ndarray, ...]:
    """One round: (cluster, distance, near, lower, rest, used, n_distances); ``used`` is how many listed bounds a vector needed."""
    n = len(x)
    slack = moved * (1 + SLACK)
    lower = lower - slack[near]
    listed = np.zeros((n, len(centers)), dtype=bool)
    np.put_along_axis(listed, np.concatenate([cluster[:, None], near], axis=1).astype(np.int64), True, axis=1)
    rest = rest - np.where(listed, 0.0, slack).max(1)
    if n_near < near.shape[1]:  # bounds that are listed no more join the rest
        rest = np.minimum(rest, lower[:, n_near:].min(1))
        near, lower = near[:, :n_near], lower[:, :n_near]
    own = x - centers[cluster]
    distance = (own * own).sum(1)
    upper = np.sqrt(distance) * (1 + SLACK)
    used, n_distances = np.zeros(n, dtype=np.int32), np.ones(n, dtype=np.int64)
    cluster, near, lower, rest = cluster.copy(), near.copy(), lower.copy(), rest.copy()
    below = np.minimum(lower.min(1, initial=np.inf), rest)
    open_ = np.flatnonzero(~(upper < below))
    if len(open_) and n_near:
        held = np.concatenate([cluster[open_, None], near[open_]], axis=1)
        gaps = x[open_, None, :] - centers[held]
        d = (gaps * gaps).sum(2)
        order = np.lexsort((held, d), axis=1)
        d, held = np.take_along_axis(d, order, 1), np.take_along_axis(held, order, 1)
        n_distances[open_] += n_near
        used[open_] = 1 + (lower[open_] <= upper[open_, None]).sum(1)
        sure = np.sqrt(d[:, 0]) * (1 + SLACK) < rest[open_]
        at = open_[sure]
        cluster[at], distance[at], near[at] = held[sure, 0], d[sure, 0], held[sure, 1:]
        lower[at] = np.sqrt(d[sure, 1:]) * (1 - SLACK)
        open_ = open_[~sure]
    if len(open_):
        told = full_scan(x[open_], centers, n_near)
        for whole, part in zip((cluster, distance, near, lower, rest), told, strict=True):
            whole[open_] = part
        used[open_] = n_near
        n_distances[open_] += len(centers) - 1
    return cluster, distance, near, lower, rest, np.minimum(used, n_near), n_distances


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.empty((0, 0), dtype=kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(values.ravel(), kind))


def _assigned(rows: DataFrame, centers: np.ndarray, moved: np.ndarray | None, n_near: int) -> DataFrame:
    """``vec_id, v`` with the state of this round; ``moved`` is None in the first."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("v"), n, np.int64)
            if moved is None:
                told = (*full_scan(x, centers, n_near), np.full(n, n_near), np.full(n, len(centers)))
            else:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
                near, lower = _matrix(batch.column("near"), n, np.int64), _matrix(batch.column("lower"), n, np.float64)
                told = reassign(x, centers, moved, cluster, near, lower, batch.column("rest").to_numpy(zero_copy_only=False), n_near)
            state = [_lists(t, kind.value_type) if pa.types.is_list(kind) else pa.array(t, kind) for t, (_, kind) in zip(told, STATE, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *state], ["vec_id", "v", *(name for name, _ in STATE)])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"vec_id {id_type}, v array<int>, cluster int, distance long, near array<int>, lower array<double>, rest double, used int, n_distances long")


def scaled_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, v``: the vectors that are kept, each component ``x`` as ``floor(scale * x)``."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.size(x) == dims, F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))).alias("scaled"))
    fits = F.forall("scaled", lambda c: F.coalesce(c.between(float(-MOST), float(MOST)), F.lit(False)))  # NaN is above all numbers
    return rows.where(F.col("scaled").isNotNull() & fits).select("vec_id", F.transform("scaled", lambda c: F.floor(c).cast("int")).alias("v"))


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, n_near: int | None = None, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """(state of each vector after the last assignment, final centroids, figures of each assignment).

    ``n_near`` lower bounds are listed at first, a quarter of ``k`` unless given. Figures are the rows, the number of
    bounds listed and the distances computed, of ``rows * k`` without bounds.
    """
    rows = scaled_vectors(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    started = rows.orderBy(F.sha2(text, 256), "v").limit(k).collect()
    if not started:
        return _assigned(rows, np.zeros((1, dims), dtype=np.int64), None, 0), np.zeros((0, dims), dtype=np.int64), []
    centers = np.array([r["v"] for r in started], dtype=np.int64)
    n_near = min(len(centers) - 1, max(1, k // 4) if n_near is None else n_near)
    state, moved, figures = rows, None, []
    for turn in range(rounds + 1):
        state = materialize(_assigned(state, centers, moved, n_near), f"clusters-{turn}")
        sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)] if turn < rounds else []
        told = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), F.sum("n_distances").alias("n_distances"), *sums).collect()
        figures.append({"rows": sum(r["n"] for r in told), "listed": n_near, "distances": sum(r["n_distances"] for r in told)})
        if turn == rounds:
            break
        old, centers = centers, centers.copy()
        for r in told:
            centers[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        gaps = (centers - old).astype(np.float64)
        moved = np.sqrt((gaps * gaps).sum(1))
        if turn:
            n_near = min(n_near, max(-(-len(centers) // 8), *(r["used"] for r in told)))
    return state, centers, figures


def digest(state: DataFrame, centers: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``; sums and centroids are one row for each cluster."""
    spark = state.sparkSession
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()} if len(centers) else {}
    by_cluster = spark.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), ",".join(map(str, v))) for c, v in enumerate(centers.tolist())], "of int, cluster_inertia long, inertia long, components string")
    named = by_cluster.select("of", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return state.join(F.broadcast(named), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
