"""Approximate nearest neighbours: inverted lists scanned by column blocks with early abandonment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import stored


@dataclass(frozen=True)
class Search:
    k: int = 5
    sample: int = 80_000  # rows that centroids, probes and first thresholds are fitted on
    sample_bytes: int = 64 << 20  # of them at most, as doubles
    share: float = 0.125  # of the vectors that the sample holds at most
    most_lists: int = 4096
    few_lists: int = 4  # built at least, as far as the sample has so many rows
    recall: float = 0.97  # aimed at when the number of probed lists is chosen on the sample
    block_rows: int = 4096  # vectors, and queries, of one block of a list
    columns: int = 16  # of a step of the scan
    epsilon: float = 2.1  # of the test: higher abandons later
    spare: int = 3  # neighbours kept beyond k until the exact scores
    seed: int = 5


VALID = ("{c} is not null and size({c}) > 0 and not exists({c}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({c}, x -> x <> 0)")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow and no underflow to zero
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit_lists(sample: np.ndarray, lists: int, search: Search) -> np.ndarray:
    """Centroids of unit vectors by a few rounds of spherical k-means."""
    rng = np.random.default_rng(search.seed)
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(8):
        own = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centers)
    return centers


def choose_probes(sample: np.ndarray, centers: np.ndarray, search: Search) -> int:
    """The fewest probed lists with which sample rows find their nearest sample rows as often as ``recall`` asks; all lists, if there are too few rows to ask."""
    if len(sample) <= search.k + 1:
        return len(centers)
    some = sample[:: max(1, len(sample) // 300)]
    scores = some @ sample.T
    scores[np.arange(len(some)), np.arange(0, len(sample), max(1, len(sample) // 300))] = -2
    near = np.argpartition(-scores, search.k, axis=1)[:, : search.k]
    order = np.argsort(np.argsort(-(some @ centers.T), axis=1), axis=1)
    own = (sample @ centers.T).argmax(axis=1)
    depth = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(search.recall * len(depth))))]) + 1


def scan_block(query: np.ndarray, limit: float, block: np.ndarray, search: Search, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances) of the vectors of a rotated block within ``limit``, the nearest ``keep``.

    Distances grow by ``columns`` coordinates at a time. After d of D coordinates of randomly rotated vectors, the partial squared
    distance times D/d estimates the whole; a candidate whose estimate exceeds the limit by (1 + epsilon / sqrt(d)) squared is abandoned.
    After the first step the ``keep`` candidates nearest so far are measured whole: the farthest of them is a limit for all others.
    """
    dims = block.shape[1]
    alive, partial = np.arange(len(block)), np.zeros(len(block))
    for a in range(0, dims, search.columns):
        b = min(dims, a + search.columns)
        step = block[alive, a:b] - query[a:b]
        partial = partial + np.einsum("ij,ij->i", step, step)
        if a == 0 and b < dims and len(alive) > keep:
            whole = block[alive[np.argpartition(partial, keep - 1)[:keep]]] - query
            limit = min(limit, float(np.einsum("ij,ij->i", whole, whole).max()) * (1 + 1e-6) + 1e-9)
        bound = limit if b == dims else limit * b / dims * (1 + search.epsilon / np.sqrt(b)) ** 2
        good = partial <= bound
        alive, partial = alive[good], partial[good]
        if not len(alive):
            break
    if len(alive) > keep:
        near = np.argpartition(partial, keep - 1)[:keep]
        alive, partial = alive[near], partial[near]
    return alive, partial


def _scan(search: Search, keep: int):
    names, kinds = ("query", "found", "distance"), (pa.int64(), pa.int64(), pa.float64())

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            block, ids = _matrix(vectors["rotated"].combine_chunks()), vectors["class"].to_numpy()
            wanted = _matrix(queries["rotated"].combine_chunks())
            for q, limit, query in zip(queries["class"].to_numpy(), queries["limit"].to_numpy(), wanted):
                rows, distances = scan_block(query, limit, block, search, keep)
                for column, more in zip(out, (np.full(len(rows), q), ids[rows], distances)):
                    column.append(more)
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)], names=names)

    return run


def nearest(embeddings: DataFrame, queries: str, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``search.k`` nearest found of every row that the SQL condition ``queries`` on vec_id selects.

    Nearness is the largest cosine; ties go to the smaller id; a query's own row is no candidate. Equal vectors are one class, of which the k + 1 smallest ids
    can be neighbours; classes are searched, then replaced by those ids. Centroids, probes and each query's first limit come from a
    bounded sample of the classes, a small share of them, and nothing else does: every class is assigned to a list, and only the scan of lists finds neighbours, at every size of the table. Lists are cut into blocks of ``block_rows`` and so are the queries that probe them,
    so no task holds a whole hot list. The final scores are computed from the original vectors in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor those of another length than most have (of equally frequent ones the longer).
    Null ids take no part. Repeated rows of one id count once. With few candidates all are returned; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    k, keep = search.k, search.k + 1 + search.spare
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null").where(VALID.format(c="vector"))
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not lengths:
        return empty
    dims = lengths[0]["dims"]
    # -0.0 and 0.0 are one number; so are vectors that differ in them alone.
    rows = rows.where(F.size("vector") == dims).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    # Two shuffles of vectors: one that groups equal ones, one that tells every row its class; from there on ids and classes are enough.
    leaders = stored(rows.groupBy("vector").agg(F.min("vec_id").alias("class")).select("class", "vector"), "ann-classes")
    ids = stored(rows.join(leaders, "vector").select("vec_id", "class").distinct(), "ann-ids")
    members = ids.withColumn("place", F.expr("row_number() over (partition by class order by vec_id)")).where(f"place <= {k + 1}").select("vec_id", "class")
    count = leaders.count()
    asked = stored(ids.where(queries).select(F.col("vec_id").alias("query_id"), "class"), "ann-queries")

    sample_rows = leaders.orderBy(F.xxhash64("class"), "class").limit(min(search.sample, search.sample_bytes // (8 * dims), max(1, int(count * search.share)))).collect()
    sample = _unit(np.array([r["vector"] for r in sample_rows]))
    tried = np.arange(len(sample)) % 4 == 3  # the lists aren't fitted on them, so they show how deep other rows lie
    lists = min(int((~tried).sum()), max(search.few_lists, int(min(search.most_lists, np.sqrt(count), len(sample) // 20))))
    rng = np.random.default_rng(search.seed)
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    centers = fit_lists(sample[~tried], lists, search)
    probes = choose_probes(sample[tried], centers, search)
    fitted = spark.sparkContext.broadcast((rotation, centers, sample, np.array([r["class"] for r in sample_rows])))

    def assign(batches):
        turn, middle, _, _ = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1)))
            turned = (unit @ turn).astype(np.float32)
            own = (unit @ middle.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(list(turned), pa.list_(pa.float32()))], names=["class", "list", "rotated"])

    assigned = stored(leaders.mapInArrow(assign, "class bigint, list int, rotated array<float>"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in assigned.groupBy("list").count().collect()}  # at most most_lists rows

    def prepare(batches):
        """Lists to probe, nearest first, and the limit: the squared distance of the k-th nearest sample row of another class."""
        turn, middle, near, near_ids = fitted.value
        held = np.array([sizes.get(i, 0) for i in range(len(middle))])
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, dims))
            for a in range(0, len(ids), 512):
                unit, own = vectors[a : a + 512], ids[a : a + 512]
                by_list = np.argsort(-(unit @ middle.T), axis=1)
                enough = (np.cumsum(held[by_list], axis=1) < 16 * (k + 1)).sum(axis=1) + 1
                probed = [row[: max(probes, n)].astype(np.int32) for row, n in zip(by_list, enough)]
                scores = np.where(own[:, None] == near_ids[None, :], -2.0, unit @ near.T)
                best = min(k, scores.shape[1])
                top = np.argpartition(-scores, best - 1, axis=1)[:, :best]
                kth = np.take_along_axis(scores, top, axis=1).min(axis=1)
                limit = np.where((kth > -2) & (scores.shape[1] > k), 2 - 2 * kth + 1e-5, 5.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(probed, pa.list_(pa.int32())), pa.array(limit), pa.array(list((unit @ turn).astype(np.float32)), pa.list_(pa.float32()))],
                    names=["class", "lists", "limit", "rotated"])

    wanted = leaders.join(asked.select("class").distinct(), "class", "left_semi").select("class", "vector")
    prepared = stored(wanted.mapInArrow(prepare, "class bigint, lists array<int>, limit double, rotated array<float>"), "ann-prepared")

    found = _probe(spark, assigned, prepared, sizes, search, keep)
    pairs = found.unionByName(prepared.select(F.col("class").alias("query"), F.col("class").alias("found"))).distinct()
    vector = lambda name: leaders.select(F.col("class").alias(name), F.col("vector").alias(f"{name}_vector"))
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    exact = pairs.join(vector("query"), "query").join(vector("found"), "found")
    score = F.expr(f"{dot('query_vector', 'found_vector')} / (sqrt({dot('query_vector', 'query_vector')}) * sqrt({dot('found_vector', 'found_vector')}))")
    best = stored(exact.select("query", "found", score.alias("score")).withColumn("place", F.expr("row_number() over (partition by query order by score desc, found)")).where(f"place <= {keep}"), "ann-scores")
    offered = best.join(members.select("vec_id", F.col("class").alias("found")), "found")
    # Of a query class: the k + 1 nearest rows, so that k are left for each of its queries.
    order = "over (partition by query order by score desc, vec_id)"
    offered = stored(offered.selectExpr("query", "vec_id", "score", f"row_number() {order} as place").where(f"place <= {k + 1}"), "ann-offered")
    answers = asked.join(offered.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")), F.col("class") == F.col("query"))
    ranked = answers.select("query_id", F.posexplode(F.expr(f"slice(filter(near, n -> n.vec_id <> query_id), 1, {k})")).alias("rank", "n"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "n.vec_id", "n.score")


def _probe(spark: SparkSession, assigned: DataFrame, prepared: DataFrame, sizes: dict[int, int], search: Search, keep: int) -> DataFrame:
    """(query, found): the nearest found in the probed lists. A list of n vectors that m queries probe is cut into ceil(n / block_rows) blocks and its
    queries into ceil(m / block_rows) slices: vectors go to the slices of their own list only, so a list that few queries probe is sent once."""
    lists = max(sizes, default=0) + 1
    asked = prepared.select("class", "limit", "rotated", F.explode("lists").alias("list"))
    probed = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # at most most_lists rows
    parts = lambda counts: F.element_at(F.array(*[F.lit(-(-counts.get(i, 0) // search.block_rows) or 1) for i in range(lists)]), F.col("list") + 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    slot = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    vectors = assigned.withColumn("block", slot(parts(sizes))).withColumn("slice", spread(parts(probed)))
    queries = asked.withColumn("slice", slot(parts(probed))).withColumn("block", spread(parts(sizes)))
    keys = ["list", "block", "slice"]
    hits = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_scan(search, keep), "query bigint, found bigint, distance double")
    place = F.expr("row_number() over (partition by query order by distance, found)")
    return hits.withColumn("place", place).where(f"place <= {keep}").select("query", "found")
