"""Committed vector versions, hot shingles, exact quantiles and bounded choices, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.operators import quantiles, sampling, similarity, vectors
from sitelake.operators.vector_store import VectorStore


@pytest.fixture
def rows(spark):
    out = [(i, p, [float(i), float(p), 1.0]) for i in range(30) for p in range(1, 4 + i % 5)]
    return spark.createDataFrame(out, "pid long, position long, vec array<float>").repartition(4)


def entries_of(rows):
    return rows.groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("length")).selectExpr("if(id % 3 = 0, 'a', 'b') as partition", "id as seq", "id", "length")


def content(store):
    return sorted((r["pid"], r["position"], tuple(r["vec"])) for r in store.vectors().collect()), sorted((r["pid"], tuple(r["mean_vec"])) for r in store.means().collect())


@pytest.mark.parametrize("stage", ["vectors", "means", "publish"])
def test_a_retry_after_any_write_changes_nothing(spark, rows, tmp_path, monkeypatch, stage):
    from sitelake.operators import vector_store

    plain = VectorStore(spark, str(tmp_path / "plain"), 10)
    plain.commit(entries_of(rows), rows)
    store = VectorStore(spark, str(tmp_path / "failing"), 10)
    store.commit(entries_of(rows).where("id < 10"), rows)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if stage == "publish":
            m.setattr(vector_store, "publish", fail)
        else:
            m.setattr(vector_store, "mean_vectors", fail) if stage == "vectors" else m.setattr(VectorStore, "_write", lambda self, *a, write=VectorStore._write: (write(self, *a), fail()))
        before = content(store)
        with pytest.raises(OSError):
            store.commit(entries_of(rows), rows)
        assert content(store) == before and store.versions() == [1]
    assert store.commit(entries_of(rows), rows) == 2
    assert content(store) == content(plain)
    assert store.commit(entries_of(rows), rows) is None and store.versions() == [1, 2]


def test_shards_go_on_behind_those_of_earlier_versions(spark, rows, tmp_path):
    store = VectorStore(spark, str(tmp_path), 10)
    for limit in (10, 30):
        store.commit(entries_of(rows).where(f"id < {limit}"), rows)
    index = store.index().collect()
    assert sorted(r["id"] for r in index) == list(range(30))
    last = {p: max(r["shard"] for r in index if r["partition"] == p and r["version"] == 1) for p in "ab"}
    assert all((r["shard"] > last[r["partition"]]) == (r["version"] == 2) for r in index)


def test_reads_open_the_needed_shards_only(spark, rows, tmp_path):
    store = VectorStore(spark, str(tmp_path), 10)
    store.commit(entries_of(rows), rows)
    wanted = spark.createDataFrame([(4,), (7,), (99,)], "id long")
    found = store.read(wanted)
    assert sorted({r["pid"] for r in found.collect()}) == [4, 7] and found.count() == rows.where("pid in (4, 7)").count()
    # Files of all other shards could hold anything: they aren't opened.
    needed = {(r["partition"], r["shard"]) for r in store.index().where("id in (4, 7)").select("partition", "shard").distinct().collect()}
    spoiled = 0
    for path in tmp_path.glob("vectors/attempt=*/partition=*/shard=*/*.parquet"):
        if (path.parent.parent.name.split("=")[1], int(path.parent.name.split("=")[1])) not in needed:
            path.write_bytes(b"not a parquet file")
            spoiled += 1
    assert spoiled > len(needed)
    again = store.read(wanted)
    assert sorted({r["pid"] for r in again.collect()}) == [4, 7]
    with pytest.raises(Exception):
        store.vectors().count()


def test_two_writers_do_not_overwrite(spark, rows, tmp_path):
    from sitelake.session import publish

    store = VectorStore(spark, str(tmp_path), 10)
    store.commit(entries_of(rows).where("id < 5"), rows)
    rows.limit(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(Exception):
        publish(spark, str(tmp_path / "other"), f"{tmp_path}/index/version=1")
    assert store.index().count() == 5


def test_vector_sums_equal_numpy(spark, rows):
    data = rows.collect()
    got = {r["pid"]: r["mean_vec"] for r in vectors.mean_vectors(rows).collect()}
    for i in range(30):
        assert np.allclose(got[i], np.mean([r["vec"] for r in data if r["pid"] == i], axis=0))
    cells = {(r["g"], r["dim"]): (r["n"], r["s"], r["q"]) for r in vectors.dimension_sums(rows.withColumn("g", F.when(F.col("pid") % 4 > 0, F.col("pid") % 4)), ["g"]).collect()}
    for g in (None, 1, 2, 3):
        x = np.array([r["vec"] for r in data if (r["pid"] % 4 or None) == g])
        assert all(np.allclose(cells[g, d], (len(x), x[:, d].sum(), (x[:, d] ** 2).sum())) for d in range(3))
    assert vectors.mean_vectors(rows.limit(0)).count() == 0


def test_an_unmarked_hot_shingle_joins_nothing(spark):
    """300 queries and 300 references hold one shingle that none marks."""
    side = lambda name, marked: spark.range(300).selectExpr(f"id as {name}", "7L as s", "20 as n", f"{marked} as marked", "300L as df")
    assert similarity.marked_joins(side("query", "false"), side("reference", "false")).count() == 0
    assert similarity.marked_joins(side("query", "id < 3"), side("reference", "false"), heavy=10).count() == 900
    larger = side("query", "false").withColumn("n", F.lit(30))
    assert similarity.marked_joins(larger, side("reference", "id < 2"), heavy=10).count() == 600


def test_heavy_shingles_are_dealt_to_many_tasks(spark):
    side = lambda name: spark.range(400).selectExpr(f"id as {name}", "id % 2 as s", "20 as n", "true as marked", "if(id % 2 = 0, 200L, 5L) as df")
    plain = similarity.marked_joins(side("query"), side("reference"))
    split = similarity.marked_joins(side("query"), side("reference"), heavy=16)
    key = lambda f: sorted((r["query"], r["reference"]) for r in f.collect())
    assert key(plain) == key(split) == sorted((a, b) for a in range(400) for b in range(400) if a % 2 == b % 2)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_equal_sorting(spark, accuracy):
    rng = np.random.default_rng(3)
    data = [("x", float(v)) for v in rng.normal(size=5000)] + [("y", float(v)) for v in rng.integers(0, 4, 3000)] + [(None, 1.5), (None, None), ("z", None), ("w", 2.0), ("w", 4.0)]
    frame = spark.createDataFrame(data, "g string, x double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in quantiles.exact_quantiles(frame, "x", shares, ["g"], accuracy).collect()}
    for g in ("x", "y", "w", None):
        own = [v for k, v in data if k == g and v is not None]
        assert np.allclose([got[g, p] for p in shares], np.quantile(own, shares), atol=1e-12)
    assert len(got) == 4 * len(shares)
    whole = {r["share"]: r["value"] for r in quantiles.exact_quantiles(frame, "x", [0.5]).collect()}
    assert np.isclose(whole[0.5], np.quantile([v for _, v in data if v is not None], 0.5))
    assert quantiles.exact_quantiles(frame.limit(0), "x", [0.5]).select("value").where("value is not null").count() == 0


def test_bottom_k_equals_sorting(spark):
    rng = random.Random(2)
    data = [(rng.choice("abc"), rng.randrange(10**6), i) for i in range(3000)] + [("hot", i % 7, i) for i in range(2000)]
    frame = spark.createDataFrame(data, "g string, x long, i long").repartition(16)
    for fans in ((4096, 64), (3,)):
        got = sorted(tuple(r) for r in sampling.bottom_k(frame, ["g"], ["x", "i"], 5, fans).collect())
        assert got == sorted(r for g in ("a", "b", "c", "hot") for r in sorted((r for r in data if r[0] == g), key=lambda r: r[1:])[:5])


def test_seeded_sample(spark):
    index = spark.createDataFrame([("p", s, 100 * s + i, 10 + i) for s in range(9) for i in range(20)], "partition string, shard long, id long, length long")
    draw = lambda seed, **k: sorted(tuple(r) for r in vectors.seeded_sample(index.repartition(k.pop("parts", 3)), 300, 3, seed).collect())
    one = draw(1)
    assert one == draw(1, parts=7) and one != draw(2)
    shards = {r[1] for r in one}
    assert len(shards) == 3
    for s in shards:
        own = sorted((r[4], r[3]) for r in one if r[1] == s)
        assert own[0][0] == 0 and all(b == a + n for (a, n), (b, _) in zip(own, own[1:]))
        assert own[-1][0] < 100 <= own[-1][0] + own[-1][1]  # within one id of the share
    assert len(vectors.seeded_sample(index.where("shard < 2"), 300, 3, 1).select("shard").distinct().collect()) == 2


def test_sparse_bases_equal_numpy(spark):
    from sitelake.operators import statistics

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 5
    label = rng.integers(0, 3, 400)
    frame = spark.createDataFrame([(i, 1, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, label))], "pid long, position long, vec array<double>, label long").repartition(20)
    by_k, by_class = statistics.sparse_bases(frame, 12, [1, 4, 12], "label", class_k=4)
    e = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    turned, total = e @ basis, (e**2).sum()
    top = lambda m, k: np.sort(m**2, axis=1)[:, ::-1][:, :k].sum(axis=1)
    for row in by_k.collect():
        k = row["k"]
        assert np.allclose([row["pca_dense"], row["pca_sparse"], row["raw_sparse"]], [values[::-1][:k].sum() / values.sum(), top(turned, k).sum() / total, top(e, k).sum() / total], atol=2e-6)
    for row in by_class.collect():
        own = label == row["label"]
        kept, whole = top(turned, 4), (e**2).sum(axis=1)
        assert np.allclose([row["explained"], row["share_of_unexplained"]], [kept[own].sum() / whole[own].sum(), (whole - kept)[own].sum() / (whole - kept).sum()], atol=2e-6)


@pytest.mark.parametrize("k,threshold", [(10, 0.75), (5, 0.5), (3, 1.0)])
def test_exact_chance(spark, k, threshold):
    """Against counting every sequence of draws on a small case, and against random draws."""
    import itertools

    from sitelake.operators import statistics

    n = [3, 1, 6]
    counts = spark.createDataFrame([(i, v) for i, v in enumerate([*n, 0])], "code int, n long")
    got = statistics.exact_chance(counts, k, threshold).first()["chance"]
    if k <= 5:
        want = sum(np.prod([n[c] / 10 for c in draw]) for draw in itertools.product(range(3), repeat=k) if max(draw.count(c) for c in range(3)) / k >= threshold - 1e-6)
        assert np.isclose(got, want, atol=2e-6)
    assert abs(got - statistics.dominance_chance(counts, k, threshold)) < 0.02


@pytest.mark.parametrize("pool", [1, 2, 256])
def test_a_split_that_needs_one_pair_is_found(spark, pool):
    """Only exchanging 7 and 5 meets the window, and no single move gains; the pool is too small to hold the pair."""
    from sitelake.operators import balance

    tokens = {1: (0, 100.0), 2: (0, 7.0), 3: (1, 98.0), 4: (1, 5.0), 5: (0, 1000.0), 6: (1, 1000.0)}
    features = spark.createDataFrame([(c, "tokens", t) for c, (_, t) in tokens.items()], "cluster_id long, feature string, value double")
    start = spark.createDataFrame([(c, k) for c, (k, _) in tokens.items()], "cluster_id long, code int")
    plan = balance.SplitPlan(names=("a", "b"), fractions=(0.5, 0.5), min_sites=(0, 0), token_tolerance=1e-4, swap_pool=pool)
    got = {r["cluster_id"]: r["code"] for r in balance.polish(features, start, plan).collect()}
    assert abs(sum(t for c, (_, t) in tokens.items() if got[c]) - 1105) < 0.2
    with pytest.raises(ValueError, match="no feasible split"):
        balance.polish(features.where("cluster_id <> 4"), start.where("cluster_id <> 4"), plan)
