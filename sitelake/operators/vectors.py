"""Vector storage: shard plan and offsets, index lookups, pooling, sampling, epoch order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


ENTRY = "partition string, range bigint, seq bigint, id bigint, length bigint"


def shard_plan(entries: DataFrame, capacity: int, range_size: int = 1_000_000) -> DataFrame:
    """Next-fit packing per partition: a shard closes before the entry that would overflow it. ``entries``:
    partition, seq (order), id, length. The result doesn't depend on ``range_size``, the span of the order that one task works on.

    Each range first says how it ends for every entry that may open its first shard; those lie within its first ``capacity``
    of length, so its map is small. The maps are chained in order, which gives the shard and fill every range begins
    with, and the ranges are then packed side by side."""

    def ends(pdf):
        length = pdf.sort_values("seq")["length"].to_numpy("int64")
        after = np.cumsum(length)
        before = after - length
        following = np.maximum(np.searchsorted(after, before + capacity, side="right"), np.searchsorted(before, before, side="right"))
        used, closed = after[-1] - before, np.zeros(len(length), dtype="int64")
        for i in range(len(length) - 1, -1, -1):
            j = following[i]
            if j < len(length):
                used[i], closed[i] = used[j], closed[j] + 1
        first = np.flatnonzero((before <= capacity) & ((length > 0) | (np.arange(len(length)) == 0)))
        row = [pdf["partition"].iloc[0], pdf["range"].iloc[0], *[x[first].tolist() for x in (before, length, used, closed)], int(after[-1])]
        return pd.DataFrame([row], columns=["partition", "range", "before", "length", "used", "closed", "total"])

    def chain(batches):
        current, shard, used = None, 0, 0
        for pdf in batches:
            begins = []
            for row in pdf.itertuples(index=False):
                if row.partition != current:
                    current, shard, used = row.partition, 0, 0
                begins.append((row.partition, row.range, shard, used))
                over = np.flatnonzero(used + row.before + row.length > capacity) if used else np.zeros(1, dtype="int64")
                if len(over):
                    shard, used = shard + int(used > 0) + int(row.closed[over[0]]), int(row.used[over[0]])
                else:
                    used += row.total
            yield pd.DataFrame(begins, columns=["partition", "range", "first_shard", "first_used"])

    def fold(pdf):
        pdf = pdf.sort_values("seq")
        shard, used = int(pdf["first_shard"].iloc[0]), int(pdf["first_used"].iloc[0])
        shards, starts = [], []
        for length in pdf["length"].tolist():
            if used and used + length > capacity:
                shard, used = shard + 1, 0
            shards.append(shard)
            starts.append(used)
            used += length
        return pdf.drop(columns=["first_shard", "first_used"]).assign(shard=shards, start_offset=starts)

    kinds = dict(c.split() for c in ENTRY.split(", "))
    ranged = entries.withColumn("range", F.floor(F.col("seq") / range_size)).select(*[F.col(c).cast(t) for c, t in kinds.items()])
    many = "before array<bigint>, length array<bigint>, used array<bigint>, closed array<bigint>, total bigint"
    maps = ranged.groupBy("partition", "range").applyInPandas(ends, f"partition string, range bigint, {many}")
    begins = maps.repartition("partition").sortWithinPartitions("partition", "range").mapInPandas(chain, "partition string, range bigint, first_shard bigint, first_used bigint")
    # A grouping, and no repartition before a map: the planner may drop that one and deal a range to several tasks.
    packed = ranged.join(begins, ["partition", "range"]).groupBy("partition", "range").applyInPandas(fold, f"{ENTRY}, shard bigint, start_offset bigint")
    return packed.drop("range").withColumn("end_offset", F.col("start_offset") + F.col("length"))


def vector_sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, s, q): rows, sums and sums of squares per dimension of each key's vectors in each task. One pass over the
    vectors as whole matrices; a vector is never a row per dimension."""

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
            table = pa.table(batch.columns[: len(keys)], names=keys).to_pandas()
            codes, groups = (np.zeros(len(x), dtype="int64"), [()]) if not keys else _codes(table)
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            s, q = np.add.reduceat(x[order], first, axis=0), np.add.reduceat(x[order] ** 2, first, axis=0)
            n = np.diff(np.r_[first, len(x)])
            for i, k in enumerate(codes[order][first]):
                old = held.get(groups[k])
                held[groups[k]] = [n[i], s[i], q[i]] if old is None else [old[0] + n[i], old[1] + s[i], old[2] + q[i]]
            if len(held) > SUMS_HELD:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    kinds = [vectors.schema[k].dataType for k in keys]
    many = [to_arrow_type(t) for t in kinds]

    def packed(held):
        columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(many)]
        columns += [pa.array([v[0] for v in held.values()], pa.int64())] + [pa.array([v[j].tolist() for v in held.values()], pa.list_(pa.float64())) for j in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "s", "q"])

    schema = ", ".join([f"{k} {t.simpleString()}" for k, t in zip(keys, kinds)] + ["n bigint", "s array<double>", "q array<double>"])
    return vectors.select(*keys, "vec").mapInArrow(run, schema)


SUMS_HELD = 4096  # keys whose sums a task holds before it sends them on


def _codes(table: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """A number per row for its combination of key values, and the combinations."""
    rows = list(table.astype(object).where(table.notna(), None).itertuples(index=False, name=None))
    numbers = {row: i for i, row in enumerate(dict.fromkeys(rows))}
    return np.array([numbers[row] for row in rows], dtype="int64"), list(numbers)


def dimension_sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dim, n, s, q) for few keys: what the tasks added up, by dimension."""
    parts = vector_sums(vectors, keys).select(*keys, "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "x"))
    return parts.groupBy(*keys, "dim").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """(pid, mean_vec): every task adds up its rows of an id, so only whole sums are shuffled."""
    parts = vector_sums(vectors, ["pid"]).groupBy("pid").agg(F.sum("n").alias("n"), F.collect_list("s").alias("parts"))  # one entry per task that holds the id
    total = F.reduce(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return parts.select("pid", F.transform(total, lambda x: x / F.col("n")).alias("mean_vec"))


def pooled(index: DataFrame, stored: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored mean where there is one, otherwise computed from the rows of the ids that lack it."""
    missing = index.select(F.col("id").alias("pid")).join(stored.select("pid"), "pid", "left_anti")
    computed = mean_vectors(vectors.join(missing, "pid", "left_semi"))
    return stored.select("pid", "mean_vec").unionByName(computed)


def lookup(requests: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Point reads (id, position): 'unknown_id', 'out_of_range' or 'ok' with the vector."""
    known = requests.join(index.select("id", "length"), "id", "left")
    status = F.when(F.col("length").isNull(), "unknown_id").when(~F.col("position").between(1, F.col("length")), "out_of_range").otherwise("ok")
    return known.withColumn("status", status).join(vectors.select(F.col("pid").alias("id"), "position", "vec"), ["id", "position"], "left").drop("length")


def coverage(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids wanted and covered, tokens and shards needed."""
    rows = wanted.select("id").distinct().join(index, "id", "left")
    return rows.agg(F.count("*").alias("n_wanted"), F.count("shard").alias("n_covered"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))


def require_coverage(index: DataFrame, wanted: DataFrame, min_coverage: float = 0.95) -> float:
    row = coverage(index, wanted).first()
    if not row["n_covered"]:
        raise ValueError("no wanted id has vectors")
    share = row["n_covered"] / row["n_wanted"]
    if share < min_coverage:
        raise ValueError(f"vectors cover {share:.1%} of the ids, below {min_coverage:.0%}")
    return share


def needed_shards(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return index.join(wanted.select("id"), "id", "left_semi").select("partition", "shard").distinct()


def reached(sequences: DataFrame, vectors: DataFrame) -> DataFrame:
    """The head of each sequence (pid, sequence, ...) that its vectors reach; sequences without vectors fall away. Letters
    beyond it have no vector, so they needn't be rows."""
    most = vectors.groupBy("pid").agg(F.max("position").cast("int").alias("most"))
    return sequences.join(most, "pid").withColumn("sequence", F.expr("left(sequence, most)")).drop("most")


def aligned(vectors: DataFrame, residues: DataFrame) -> DataFrame:
    """Vectors with their residue: positions without a counterpart fall away (the shorter side decides)."""
    return vectors.join(residues, ["pid", "position"])


def epoch_order(shards: DataFrame, seed: int, epoch: int, workers: int) -> DataFrame:
    """Shards of an epoch in seeded hash order with the worker that reads them. One row per shard."""
    order = Window.orderBy(F.xxhash64("partition", "shard", F.lit(seed + epoch)), "partition", "shard")
    ranked = shards.withColumn("place", F.row_number().over(order) - 1)
    return ranked.withColumn("worker", F.col("place") % workers)


def shuffled_batches(rows: DataFrame, key: list[str], seed: int, epoch: int, batch: int) -> DataFrame:
    """Every row once, in seeded hash order, with its batch number. Row numbers come from slot counts plus
    the rank within a slot of the hash order."""
    hashed = rows.withColumn("order_hash", F.xxhash64(*key, F.lit(seed), F.lit(epoch))).withColumn("slot", F.shiftright("order_hash", 52))
    counts = hashed.groupBy("slot").agg(F.count("*").alias("c"))
    ahead = counts.select("slot", F.coalesce(F.sum("c").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("slot").orderBy("order_hash", *key)
    place = F.row_number().over(inner) - 1 + F.col("ahead")
    return hashed.join(F.broadcast(ahead), "slot").withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch)).drop("slot", "ahead", "order_hash")


def strided_sample(batches: DataFrame, total_rows: int, batch: int, wanted: int) -> DataFrame:
    """Every stride-th batch until ``wanted`` are taken."""
    stride = max(1, total_rows // batch // wanted)
    return batches.where((F.col("batch") % stride == 0) & (F.col("batch") < stride * wanted))


def budgeted_sample(index: DataFrame, budget: int) -> DataFrame:
    """Ids in order per shard until the token budget is reached (the last one may overshoot)."""
    w = Window.partitionBy("partition", "shard").orderBy("start_offset").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("before", F.coalesce(F.sum("length").over(w), F.lit(0))).where(F.col("before") < budget).drop("before")


def seeded_order(seed: int, *columns: str) -> list:
    """A shuffled order that any engine can repeat: the hash of seed and key, then the key."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *columns)), *columns]


def seeded_sample(index: DataFrame, tokens: int, shards: int, seed: int) -> DataFrame:
    """partition, shard, id, length, before: ids of ``shards`` shards drawn by seed, which share the token budget equally. In each shard ids
    come in an order shuffled by seed until its share is reached (the last one may overshoot); ``before`` counts the tokens ahead of an id."""
    drawn = index.select("partition", "shard").distinct().orderBy(*seeded_order(seed, "partition", "shard")).limit(shards)
    share = tokens // max(1, min(shards, drawn.count()))
    w = Window.partitionBy("partition", "shard").orderBy(*seeded_order(seed, "id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = index.join(F.broadcast(drawn), ["partition", "shard"])  # as many rows as shards are asked for
    return rows.withColumn("before", F.coalesce(F.sum("length").over(w), F.lit(0))).where(F.col("before") < share).select("partition", "shard", "id", "length", "before")
