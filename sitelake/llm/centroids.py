"""Centroid clustering of integer vectors with a LAESA pivot table: exact assignments, most distances never computed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import stored


@dataclass(frozen=True)
class Clustering:
    dims: int = 64
    scale: int = 256  # a component x becomes floor(scale * x)
    clusters: int = 40
    rounds: int = 5
    seed: str = "2"  # the first centroids have the smallest sha256 of "<seed>:<id>"
    pivots: int = 16
    pivot_sample: int = 1024  # rows that pivots are chosen from; they change the speed only, never a result


# Distances of components up to this size fit a long, and so do sums of 2**35 of them.
LARGEST = 2**27
BATCH = 4096
KEPT = "{c} is not null and size({c}) = {n} and not exists({c}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), kind))


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from a point."""
    step = rows.astype(np.int64) - point
    return np.einsum("ij,ij->i", step, step)


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Pivots far from each other: each next one has the largest sum of distances to those before it."""
    chosen, far = [], np.zeros(len(sample))
    for _ in range(min(wanted, len(sample))):
        chosen.append(sample[int(far.argmax())])
        far += np.sqrt(squared(sample, chosen[-1]))
    return np.array(chosen, dtype=np.int64).reshape(len(chosen), sample.shape[1])


def assign_rows(rows: np.ndarray, to_pivots: np.ndarray, centers: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, distances computed) of integer rows, ties to the smaller number.

    By the triangle inequality |d(row, pivot) - d(centroid, pivot)| is no more than d(row, centroid), for every pivot. The centroid with the
    least bound is measured first; after that only centroids whose bound isn't above the best distance so far are, in integers.
    Bounds are lowered by more than the square roots' rounding, so no centroid as near as the nearest is ever left out.
    """
    low = np.zeros((len(rows), len(centers)))
    for p, pivot in enumerate(pivots):
        a, b = np.sqrt(to_pivots[:, p])[:, None], np.sqrt(squared(centers, pivot))[None, :]
        np.maximum(low, np.abs(a - b) - 1e-12 * (a + b), out=low)
    first = low.argmin(axis=1)
    own, best = first.copy(), squared(rows, centers[first])
    reach, measured = np.sqrt(best) * (1 + 1e-12), len(rows)
    for k, center in enumerate(centers):
        near = np.flatnonzero((low[:, k] <= reach) & (first != k))
        measured += len(near)
        d = squared(rows[near], center)
        closer = (d < best[near]) | ((d == best[near]) & (k < own[near]))
        near, d = near[closer], d[closer]
        own[near], best[near], reach[near] = k, d, np.sqrt(d) * (1 + 1e-12)
    return own, best, measured


def _batches(batches: Iterator[pa.RecordBatch], dims: int, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            part = batch.slice(a, BATCH)
            yield part.column(0), _matrix(part.column(1), dims), _matrix(part.column(2), pivots)


def pivot_table(kept: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, point, to_pivots): the squared distances of every vector to the pivots, written once and read by every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), dims)
            distances = np.stack([squared(points, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(distances, pa.int64())], names=["vec_id", "point", "to_pivots"])

    return stored(kept.mapInArrow(run, "vec_id bigint, point array<int>, to_pivots array<bigint>"), "pivot-table")


def moved(table: DataFrame, centers: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: every task adds up its vectors by centroid, so it sends at most a row per centroid."""
    dims = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centers.shape, dtype=np.int64), np.zeros(len(centers), dtype=np.int64)
        for _, points, distances in _batches(batches, dims, len(pivots)):
            own, _, _ = assign_rows(points, distances, centers, pivots)
            counts += np.bincount(own, minlength=len(centers))
            for k in np.unique(own):
                sums[k] += points[own == k].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), _lists(sums[used], pa.int64())], names=["cluster", "n", "sums"])

    parts = table.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    out = centers.copy()
    for row in total.collect():  # at most one row per centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def cluster(embeddings: DataFrame, how: Clustering = Clustering(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or non-finite. Centroids and bounds are a few kilobytes and travel with the tasks;
    a round reads the stored pivot table and sends one row per task and centroid.

    A null id counts as an empty text where the first centroids are chosen. Repeated rows are vectors each; of equal hashes the vector that sorts first comes first.
    With fewer vectors than ``clusters`` every vector begins a centroid; without any there are no rows. Components above 2**27 after scaling
    raise an error, since their distances need not fit a long. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(float(how.scale)) * x))
    rows = embeddings.where(KEPT.format(c=vector_col, n=how.dims)).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("point"))
    fits = F.forall("point", lambda x: F.abs(x) <= LARGEST)
    rows = rows.select("vec_id", F.when(fits, F.col("point")).otherwise(F.raise_error(F.lit("a component is too large for distances in longs"))).cast("array<int>").alias("point"))
    order = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("order", order).orderBy("order", "point").limit(max(how.clusters, how.pivot_sample)).select("point").collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    sample = np.array([r["point"] for r in first], dtype=np.int64).reshape(len(first), how.dims)
    centers, pivots = sample[: how.clusters], choose_pivots(sample, how.pivots)
    table = pivot_table(rows, pivots, how.dims)
    for _ in range(how.rounds):
        centers = moved(table, centers, pivots)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, distances in _batches(batches, how.dims, len(pivots)):
            own, best, _ = assign_rows(points, distances, centers, pivots)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = stored(table.mapInArrow(last, "vec_id bigint, cluster int, distance bigint"), "clusters")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most one row per centroid
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    of_cluster = spark.createDataFrame([(k, s, sum(sums.values()), prints[k]) for k, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(how: Clustering = Clustering()) -> str:
    """The whole clustering in SQL, a pair of steps a round."""
    steps = [f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({how.scale} * cast(x as double)) as bigint)) as q,
  sha256('{how.seed}:' || coalesce(cast(vec_id as varchar), '')) as h from embeddings
  where len(embedding) = {how.dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {how.dims}),
c0 as materialized (select cast(row_number() over (order by h, q) - 1 as int) as k, q from v order by h, q limit {how.clusters})"""]
    for i in range(how.rounds + 1):
        steps.append(f"""a{i} as materialized (select r, min(struct_pack(d := d, k := k)) as best from (select v.r, c.k,
  cast(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v, c{i} c) group by r)""")
        if i < how.rounds:
            steps.append(f"""m{i} as (select k, i, cast(sum(x) as bigint) as s, count(*) as n from (select a.best.k as k, unnest(range(1, {how.dims + 1})) as i, unnest(v.q) as x from a{i} a join v using (r)) group by k, i),
c{i + 1} as materialized (select c.k, coalesce(m.q, c.q) as q from c{i} c left join (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as q from m{i} group by k) m using (k))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, a.best.k as cluster, a.best.d as distance, cast(sum(a.best.d) over (partition by a.best.k) as bigint) as cluster_inertia,
  cast(sum(a.best.d) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from v join a{how.rounds} a using (r) join c{how.rounds} c on c.k = a.best.k"""
