"""Feature extraction: a user model turns sequences into one vector per position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.operators.vector_store import VectorStore
from sitelake.session import stored

Model = Callable[[list[str]], list[np.ndarray]]


def hashed_kmers(k: int = 3, dim: int = 16, seed: int = 0) -> Model:
    """A small stand-in model: the k letters around a position pick a fixed random vector."""
    table = np.random.default_rng(seed).standard_normal((997, dim)).astype("float32")

    def run(sequences: list[str]) -> list[np.ndarray]:
        out = []
        for sequence in sequences:
            letters = np.frombuffer(sequence.encode("ascii", "replace"), dtype="uint8").astype("int64")
            padded = np.pad(letters, (k // 2, k - 1 - k // 2))
            codes = sum(padded[i:i + len(letters)] * (131 ** i) for i in range(k))
            out.append(table[codes % len(table)])
        return out

    return run


def neighbour_codes(sequences: list[str]) -> list[np.ndarray]:
    """A stand-in model of whole numbers: the places in the alphabet of a letter and its two neighbours (0 beyond the ends) and a number mixed from them."""
    out = []
    for sequence in sequences:
        codes = np.pad(np.frombuffer(sequence.encode("ascii"), dtype="uint8").astype("int64") - 64, 1)
        codes[[0, -1]] = 0
        left, own, right = codes[:-2], codes[1:-1], codes[2:]
        out.append(np.stack([own, left, right, (31 * left + 7 * own + right) % 101], axis=1).astype("float32"))
    return out


def extract(proteins: DataFrame, model: Model, committed: DataFrame | None = None, rows_per_batch: int = 50_000) -> DataFrame:
    """(pid, position, vec) for ``proteins`` (pid, sequence) that are not committed yet. A batch that runs out
    of memory is repeated one sequence at a time; output leaves in bounded pieces."""
    todo = proteins.select("pid", "sequence")
    if committed is not None:
        todo = todo.join(committed.select("pid").distinct(), "pid", "left_anti")

    def vectors_of(sequences: list[str]) -> list[np.ndarray]:
        try:
            return model(sequences)
        except MemoryError:
            return [model([sequence])[0] for sequence in sequences]

    def run(batches):
        for batch in batches:
            pids, sequences = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield from vector_batches(pids, vectors_of(sequences), rows_per_batch)

    return todo.select(F.col("pid").cast("bigint"), "sequence").mapInArrow(run, "pid bigint, position bigint, vec array<float>")


NUMBERS = 4_000_000  # that a batch holds, at most about


def vector_batches(pids: list, matrices: list[np.ndarray], rows_per_batch: int) -> Iterator[pa.RecordBatch]:
    """(pid, position, vec) of many ids in batches of ``rows_per_batch`` rows at most: short sequences share a batch, a long one is cut. The numbers go out as
    one array, not as an object per row."""
    held, size = [], 0

    def sent():
        numbers = np.concatenate([part for _, _, part in held]).astype("float32", copy=False)
        sizes = np.array([len(part) for _, _, part in held])
        pid = pa.array([pid for pid, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        position = np.concatenate([np.arange(start + 1, start + len(part) + 1) for _, start, part in held])
        ends = np.arange(0, numbers.size + 1, numbers.shape[1], dtype="int32")
        vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.ravel()))
        return pa.RecordBatch.from_arrays([pid, pa.array(position), vec], names=["pid", "position", "vec"])

    for pid, matrix in zip(pids, matrices):
        start, most = 0, max(1, min(rows_per_batch, NUMBERS // max(1, matrix.shape[-1])))
        while start < len(matrix):
            part = matrix[start:start + max(1, most - size)]
            held.append((pid, start, part))
            start, size = start + len(part), size + len(part)
            if size >= most:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def extract_into(store: VectorStore, proteins: DataFrame, model: Model, rows_per_batch: int = 50_000) -> int | None:
    """Commit the vectors and mean vectors of the ``proteins`` (pid, sequence, length, partition) that ``store`` does not hold. Returns the version,
    or None if it holds them all. The model runs once per new id: its rows are written before they are laid out in shards and
    averaged. A run that fails before the commit leaves the store as it was."""
    held = store.index().select(F.col("id").alias("pid"))
    rows = stored(extract(proteins, model, held, rows_per_batch), "extracted")
    return store.commit(proteins.select("partition", F.col("pid").alias("seq"), F.col("pid").alias("id"), "length"), rows)
