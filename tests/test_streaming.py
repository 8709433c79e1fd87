from pyspark.sql import functions as F

from sitelake.streaming import folds


def events(spark, folder, parts=4):
    base = spark.range(400).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("latent"), (F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")).alias("value"), F.expr("id div 20").alias("batch"))
    base = base.withColumn("fired", F.col("value") > 90)
    for i in range(parts):  # files end inside batches of 20
        base.where(f"event_id div 110 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return base


def key(frame):
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=repr)


def run(spark, tmp_path, merge):
    batch = events(spark, str(tmp_path / "in"))
    stream = folds.read_stream(spark, str(tmp_path / "in"), batch)
    folds.fold(stream, str(tmp_path / "state"), str(tmp_path / "ckpt"), merge)
    assert len(folds.state_versions(spark, str(tmp_path / "state"))) == 4
    return batch, folds.read_state(spark, str(tmp_path / "state"))


def test_top_k_over_several_batches(spark, tmp_path):
    merge = folds.top_k_merge(3, "latent", [F.desc("value"), F.col("event_id")], ["value", "event_id"])
    batch, state = run(spark, tmp_path, merge)
    assert key(state) == key(merge(None, batch))


def test_running_threshold_over_several_batches(spark, tmp_path):
    rows = lambda f: f.select("batch", F.col("event_id").alias("row"), "value")
    batch = events(spark, str(tmp_path / "in"))
    stream = folds.read_stream(spark, str(tmp_path / "in"), batch)
    folds.fold(rows(stream), str(tmp_path / "state"), str(tmp_path / "ckpt"), folds.threshold_merge(0.9))
    got = folds.threshold_report(folds.read_state(spark, str(tmp_path / "state")), 0.9).first()
    values = [r["v"] for r in folds.batch_thresholds(rows(batch)).orderBy("batch").collect()]
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + 0.1 * v
    assert abs(got["threshold"] - want) < 1e-9 and got["batches"] == len(values)


def test_census_over_several_batches(spark, tmp_path):
    from sitelake.operators.statistics import dead_census

    batch, state = run(spark, tmp_path, folds.census_merge)
    assert key(folds.census_report(state, 100)) == key(dead_census(batch, 100))


def test_ingest_resumes_without_repeats(spark, tmp_path):
    first = spark.range(10).select(F.col("id").alias("k"))
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain = lambda: folds.ingest(folds.read_stream(spark, str(tmp_path / "in"), first), str(tmp_path / "out"), str(tmp_path / "ckpt"), "k")
    drain()
    spark.range(5, 15).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain()
    drain()
    versions = folds.state_versions(spark, str(tmp_path / "out" / "rows"))
    got = [r["k"] for r in spark.read.parquet(*[str(tmp_path / "out" / "rows" / f"v={v}") for v in versions]).collect()]
    assert sorted(got) == list(range(15))


def test_ingest_keeps_one_row_per_key(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(folds.KEY_STORE[0])
    folds.ingest(folds.read_stream(spark, str(tmp_path / "in"), rows), str(tmp_path / "out"), str(tmp_path / "ckpt"), "k")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out" / "rows" / "v=0")).collect()) == [1, 2]
    assert spark.conf.get(folds.KEY_STORE[0]) == before


def test_concentration_counts_over_several_batches(spark, tmp_path):
    mark = lambda f: f.select(
        "latent", "fired", (F.col("latent") % 2).cast("string").alias("stratum"), F.when(F.col("event_id") % 3 > 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("types"),
        F.when(F.col("event_id") % 3 == 0, "hard").alias("tier"))
    batch = events(spark, str(tmp_path / "in"))
    stream = folds.read_stream(spark, str(tmp_path / "in"), batch)
    folds.aggregate(folds.concentration_counts(mark(stream)), str(tmp_path / "state"), str(tmp_path / "ckpt"))
    got = folds.read_state(spark, str(tmp_path / "state"))
    assert key(got) == key(folds.concentration_counts(mark(batch)))
    totals = {r["level"] + (r["label"] or ""): r["n"] for r in got.groupBy("level", "label").agg(F.sum("total").alias("n")).collect()}
    assert totals == {"stratum": 400, "typea": 266, "typeb": 266, "tierhard": 134}
