"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm import text as tx
from sitelake.llm.common import stored
from sitelake.llm.tokens import encoder, vocabulary_path

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
RUNS = "length bigint, first_rank bigint, last_rank bigint, first_sequence bigint, per_sequence bigint, first_offset bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; of a cut document only the first piece may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for first, some in tx.chunks(texts):
                ids, begin = encoder(path).encode(some)
                raw, end = memoryview(ids.astype("<u4").tobytes()), end_id.to_bytes(4, "little")
                for i in range(len(some)):
                    a, b = int(begin[i]), int(begin[i + 1])
                    for k, (start, length) in enumerate(cut(b - a + 1, capacity)):
                        stop = min(a + start + length, b)
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * stop])
                        if start + length > b - a:
                            crc = zlib.crc32(end, crc)
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc_ids[first + i], k, start, length, crc, part, nth))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first rank, last rank, first sequence, pieces per sequence, first offset).

    Sequences of equal free space and consecutive numbers are one group, so the work depends on the number of
    lengths and not of pieces. The longest lengths go first, each to the groups with the least free space that
    holds it, as often as it fits; what is left opens new sequences.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first sequence, how many)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, space = counts[length], 0, length
        while left:
            while space < capacity and not free[space]:
                space += 1
            fit = space // length
            if free[space]:
                first, many = free[space].pop()
            else:
                first, many = opened, -(-left // fit)
                opened += many
            full = min(many, left // fit)
            for sequences, per in ((full, fit), (min(1, many - full), left - full * fit if full < many else 0)):
                if sequences and per:
                    runs.append((length, rank, rank + sequences * per - 1, first, per, capacity - space))
                    if rest := space - per * length:
                        free[rest].append((first, sequences))
                    rank, left, first, many = rank + sequences * per, left - sequences * per, first + sequences, many - sequences
            if many:
                free[space].append((first, many))
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end_id``; longer ones than ``capacity`` are cut. The histogram of lengths (at most
    ``capacity`` numbers) is planned on the driver; each planned run takes a range of ranks of its length, and pieces join
    it by their rank within their length. A rank is the number of equal lengths in the partitions before, plus the
    place within the piece's own partition, which was written with the piece; so no length is gathered in one task. The plan has at most
    a run per length and free space (under ``capacity`` squared), whatever the number of documents.

    Null text: one piece that is ``end_id`` alone. Repeated rows are packed each. Null ids stay null. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path("byte_bpe_50k.json")
    pieces = stored(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_pieces(path, end_id, capacity), PIECES), "pack-pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), RUNS)
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as before")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    place = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.floor(place / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + place % F.col("per_sequence") * ranked["length"]).cast("bigint").alias("offset"))
