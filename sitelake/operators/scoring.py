"""Vectors against a sparse dictionary: encode, decode, normalise.

Codes are long and sparse: (id, position, latent, value), zeros not stored. A dictionary within the broadcast
limit is shipped once per executor and multiplied per Arrow batch; a larger one is cut into blocks that meet
slices of the vectors in a block-wise product."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import exprs
from sitelake.session import BROADCAST_LIMIT_BYTES

ROW = ["pid", "position"]
CODE_SCHEMA = "pid bigint, position bigint, latent bigint, value double"


@dataclass
class Encoder:
    """Parameters of ``(x * scale - b_dec) @ W + b``; ``latents`` has latent, w and optional per-latent columns."""

    latents: DataFrame
    b_dec: list[float] | None = None
    scale: float = 1.0

    def size_bytes(self) -> int:
        row = self.latents.agg(F.count("*").alias("n"), F.max(F.size("w")).alias("d")).first()
        return int(row["n"] or 0) * int(row["d"] or 0) * 8


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: r["latent"])
    ids = np.array([r["latent"] for r in rows], dtype="int64")
    weights = np.array([r["w"] for r in rows], dtype="float64")
    return ids, weights, np.array([r["b"] for r in rows], dtype="float64")


def _codes(pdf: pd.DataFrame, ids, weights, bias, b_dec, scale, top: int | None, positive: bool) -> pd.DataFrame:
    x = np.vstack(pdf["vec"].to_numpy()).astype("float64") * scale - b_dec
    scores = x @ weights.T + bias
    keep = scores > 0 if positive else np.ones(scores.shape, bool)
    if top is not None and top < scores.shape[1]:
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :top]
        chosen = np.zeros(scores.shape, bool)
        np.put_along_axis(chosen, order, True, axis=1)
        keep &= chosen
    row, column = np.nonzero(keep)
    return pd.DataFrame({"pid": pdf["pid"].to_numpy()[row], "position": pdf["position"].to_numpy()[row], "latent": ids[column], "value": scores[row, column]})


def encode(vectors: DataFrame, encoder: Encoder, top: int | None = None, positive: bool = True, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Sparse scores. ``top`` keeps the k largest per row (smaller latent on ties), ``positive`` drops values <= 0."""
    latents = encoder.latents if "b" in encoder.latents.columns else encoder.latents.withColumn("b", F.lit(0.0))
    rows = vectors.select("pid", "position", "vec")
    b_dec = np.zeros(1) if encoder.b_dec is None else np.array(encoder.b_dec)
    scale = encoder.scale
    if encoder.size_bytes() <= limit_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(_matrix(latents.select("latent", "w", "b").collect()))

        def apply(batches):
            for pdf in batches:
                if len(pdf):
                    yield _codes(pdf, *shared.value, b_dec, scale, top, positive)

        return rows.mapInPandas(apply, CODE_SCHEMA)
    return _encode_blocks(rows, latents.select("latent", "w", "b"), b_dec, scale, top, positive, limit_bytes, encoder.size_bytes())


def _encode_blocks(rows, latents, b_dec, scale, top, positive, limit_bytes, total_bytes, slice_rows: int = 20_000) -> DataFrame:
    blocks = max(1, math.ceil(total_bytes / max(1, limit_bytes)))
    slices = max(1, math.ceil(rows.count() / slice_rows))
    left = rows.withColumn("slice", F.pmod(F.xxhash64(*ROW), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    right = latents.withColumn("block", F.pmod(F.xxhash64("latent"), F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))

    def product(vecs: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(vecs) or not len(part):
            return pd.DataFrame({"pid": [], "position": [], "latent": [], "value": []})
        return _codes(vecs, *_matrix(part.to_dict("records")), b_dec, scale, top, positive)

    out = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(product, CODE_SCHEMA)
    return out if top is None else top_per_row(out, top, positive)


def top_per_row(codes: DataFrame, k: int, positive: bool = True) -> DataFrame:
    """The k largest values of each row, of the positive ones unless told otherwise; smaller latent on ties."""
    w = Window.partitionBy(*ROW).orderBy(F.desc("value"), "latent")
    return (codes.where("value > 0") if positive else codes).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def top_per_batch(codes: DataFrame, batch_sizes: DataFrame, k: int) -> DataFrame:
    """One budget of k * rows per batch. ``codes`` and ``batch_sizes`` (batch, rows) carry ``batch``."""
    w = Window.partitionBy("batch").orderBy(F.desc("value"), *ROW, "latent")
    ranked = codes.where("value > 0").withColumn("rn", F.row_number().over(w)).join(batch_sizes, "batch")
    return ranked.where(F.col("rn") <= F.col("rows") * k).drop("rn", "rows")


def above_threshold(codes: DataFrame, threshold: float) -> DataFrame:
    return codes.where((F.col("value") > 0) & (F.col("value") > threshold))


def jump(codes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Keep values above exp(log_threshold) of their latent; thresholds are one row per latent."""
    return codes.join(thresholds.select("latent", "log_threshold"), "latent").where(
        F.col("value") > F.exp("log_threshold")).select(*ROW, "latent", "value")


def gated(raw: DataFrame, gates: DataFrame) -> DataFrame:
    """``raw`` holds the plain directions (x * scale - b_dec) @ W without bias; gate and magnitude share it."""
    joined = raw.join(gates.select("latent", "b_gate", "r_mag", "b_mag"), "latent")
    magnitude = F.col("value") * F.exp("r_mag") + F.col("b_mag")
    return joined.where((F.col("value") + F.col("b_gate") > 0) & (magnitude > 0)).select(*ROW, "latent", magnitude.alias("value"))


def decode(codes: DataFrame, dictionary: DataFrame, b_dec: list[float] | None = None, scale: float = 1.0) -> DataFrame:
    """(pid, position, dim, value) in long form: contributions are pre-summed per (row, dim)."""
    spread = codes.join(dictionary.select("latent", "w"), "latent").select(*ROW, "value", F.posexplode("w").alias("dim", "w"))
    sums = spread.groupBy(*ROW, "dim").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    bias = F.lit(0.0) if b_dec is None else F.get(F.array(*[F.lit(float(b)) for b in b_dec]), F.col("dim"))
    return sums.select(*ROW, F.col("dim").cast("bigint").alias("dim"), ((F.col("value") + bias) / F.lit(scale)).alias("value"))


def unit_rows(dictionary: DataFrame) -> DataFrame:
    norm = F.greatest(F.sqrt(exprs.sum_squares("w")), F.lit(1e-8))
    return dictionary.withColumn("norm", norm).select("latent", F.transform("w", lambda x: x / F.col("norm")).alias("w"))


def activation_scale(vectors: DataFrame) -> DataFrame:
    return vectors.agg((1.0 / F.sqrt(F.avg(exprs.sum_squares("vec")))).alias("scale"))


def partition_sums(frame: DataFrame, fold, size: int, columns: list[str]) -> np.ndarray:
    """Sum ``fold(pdf) -> array(size)`` over the frame. Every task adds up its rows to one array; the arrays are added on the executors in two levels,
    about as many per task as there are tasks in the next level, and one array reaches the driver. No array is cut into rows."""

    def run(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += fold(pdf)
        yield pd.DataFrame({"v": [total]})

    def add(batches):
        total, seen = np.zeros(size), False
        for pdf in batches:
            for part in pdf["v"]:
                total, seen = total + part, True
        if seen:
            yield pd.DataFrame({"v": [total]})

    parts = frame.select(*columns).mapInPandas(run, "v array<double>")
    middle = math.isqrt(max(1, frame.rdd.getNumPartitions()))
    if middle > 3:
        parts = parts.repartition(middle).mapInPandas(add, "v array<double>")
    rows = parts.repartition(1).mapInPandas(add, "v array<double>").collect()  # one row
    return np.array(rows[0]["v"]) if rows else np.zeros(size)


def mean_vector(vectors: DataFrame, dim: int) -> list[float]:
    sums = partition_sums(vectors, lambda pdf: np.append(np.vstack(pdf["vec"].to_numpy()).astype("float64").sum(axis=0), len(pdf)), dim + 1, ["vec"])
    return (sums[:-1] / sums[-1]).tolist()


def geometric_median(vectors: DataFrame, dim: int, rounds: int = 20) -> list[float]:
    """Weiszfeld from the mean with distances clamped at 1e-6."""
    centre = np.array(mean_vector(vectors, dim))
    for _ in range(rounds):
        def fold(pdf, c=centre):
            x = np.vstack(pdf["vec"].to_numpy()).astype("float64")
            w = 1 / np.maximum(np.sqrt(((x - c) ** 2).sum(axis=1)), 1e-6)
            return np.append((x * w[:, None]).sum(axis=0), w.sum())

        sums = partition_sums(vectors, fold, dim + 1, ["vec"])
        centre = sums[:-1] / sums[-1]
    return centre.tolist()
