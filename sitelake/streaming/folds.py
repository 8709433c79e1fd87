"""Accumulators over streams. Built-in aggregation where it fits; otherwise a small state table that every
micro-batch replaces: version n is written from version n-1 and batch n, so a replayed batch is harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def state_versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions of a state table, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    versions = [v for v in state_versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/v={versions[-1]}") if versions else None


def fold(stream: DataFrame, folder: str, checkpoint: str, merge: Merge) -> None:
    """Drain the stream through ``merge(previous state or None, batch) -> state``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        merge(read_state(batch.sparkSession, folder, before=batch_id), batch).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def aggregate(aggregated: DataFrame, folder: str, checkpoint: str) -> None:
    """Drain a streaming aggregation; each version holds its complete result."""

    def step(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    query = aggregated.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def evaluation_sums(codes: DataFrame) -> DataFrame:
    """Sums that merge: rows, values, squares, squared errors, active values. ``codes``: latent, value, target."""
    return codes.groupBy("latent").agg(
        F.count("*").alias("n"), F.sum("value").alias("sum_x"), F.sum(F.col("value") * F.col("value")).alias("sum_xx"),
        F.sum((F.col("value") - F.col("target")) * (F.col("value") - F.col("target"))).alias("sse"), F.count_if("fired").alias("fired"))


def concentration_counts(rows: DataFrame) -> DataFrame:
    """All and active residues per latent, by stratum, by (stratum, type) and by negative tier, in one aggregation; ratios are
    taken when the stream is read. ``rows``: stratum, types (null or empty for a negative), tier (null for a positive),
    latent, fired. A residue of several types counts once under each."""
    none, text = F.lit(None).cast("string"), lambda c: c.cast("string")
    entry = lambda level, stratum, label: F.struct(F.lit(level).alias("level"), text(stratum).alias("stratum"), text(label).alias("label"))
    stratum, tier = F.col("stratum"), F.col("tier")
    types = F.array_distinct(F.coalesce("types", F.array().cast("array<string>")))
    entries = F.concat(
        F.array(entry("stratum", stratum, none)), F.transform(types, lambda t: entry("type", stratum, t)),
        F.filter(F.array(entry("tier", none, tier)), lambda e: e["label"].isNotNull()))
    return rows.select("latent", "fired", F.inline(entries)).groupBy("level", "stratum", "label", "latent").agg(
        F.count("*").alias("total"), F.count_if("fired").alias("active"))


def code_counts(rows: DataFrame, code: str) -> DataFrame:
    return rows.groupBy(code).agg(F.count("*").alias("n"))


def metric_tail(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "metric").agg(F.max_by("value", "step").alias("value"), F.max("step").alias("step"))


def top_k_merge(k: int, key: str, order: list, keep: list[str]) -> Merge:
    """The k first rows per key over everything seen; the state holds k rows per key."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.select(key, *keep)
        rows = rows if state is None else state.select(key, *keep).unionByName(rows)
        w = Window.partitionBy(key).orderBy(*order)
        return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")

    return merge


def census_merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Tokens seen and, per latent, the last batch it fired in and the tokens seen at the end of that batch. Batches come in
    order, but a micro-batch may end inside one: when it goes on, its end moves for the latents that fired in it.
    The state holds one row per latent plus one for the total."""
    from sitelake.operators.statistics import running_total

    ends = running_total(batch.groupBy("batch").agg(F.count("*").alias("tokens")), "batch", "tokens", "batch_end").select(F.col("batch").alias("last_batch"), "batch_end")
    seen = F.lit(0).cast("bigint") if state is None else state.where("latent is null").select("last_end").scalar()
    none = F.lit(None).cast("bigint")
    rows = batch.groupBy("latent").agg(F.max(F.when(F.col("fired"), F.col("batch"))).alias("last_batch")).withColumn("last_end", none)
    rows = rows if state is None else state.where("latent is not null").unionByName(rows)
    last = rows.groupBy("latent").agg(F.max("last_batch").alias("last_batch"), F.max("last_end").alias("last_end"))
    moved = last.join(ends, "last_batch", "left").select("latent", "last_batch", F.coalesce(F.col("batch_end") + seen, "last_end").alias("last_end"))
    total = batch.agg((F.count("*") + seen).alias("last_end")).select(none.alias("latent"), none.alias("last_batch"), "last_end")
    return moved.unionByName(total)


def census_report(state: DataFrame, window: int) -> DataFrame:
    total = state.where("latent is null").select("last_end").scalar()
    since = total - F.coalesce("last_end", F.lit(0))
    return state.where("latent is not null").select("latent", since.alias("tokens_since"), (since > window).alias("dead"))


def batch_thresholds(codes: DataFrame) -> DataFrame:
    """Per batch: mean over rows of the smallest positive value; rows and batches without one fall away.
    ``codes``: batch, row, value."""
    per_row = codes.where("value > 0").groupBy("batch", "row").agg(F.min("value").alias("v"))
    return per_row.groupBy("batch").agg(F.avg("v").alias("v"))


def running_threshold(values: DataFrame, decay: float) -> DataFrame:
    """The threshold after all batches in order. t = d t + (1 - d) v unrolls to a weighted sum, so no fold over
    the batches is needed: weight d^(n-1) for the first and (1 - d) d^(n-1-i) for the i-th."""
    from sitelake.operators.statistics import running_total

    placed = running_total(values.withColumn("one", F.lit(1).cast("bigint")), "batch", "one", "place")
    n = values.agg(F.count("*")).scalar()
    weight = F.when(F.col("place") == 1, F.pow(F.lit(decay), n - 1)).otherwise((1 - decay) * F.pow(F.lit(decay), n - F.col("place")))
    return placed.agg(F.sum(F.col("v") * weight).alias("threshold"), F.count("*").alias("batches"))


def _carried(state: DataFrame | None, values: DataFrame, decay: float) -> DataFrame:
    """(threshold, batches) of the state after more batches; n of them scale the old value by decay^n."""
    new = running_threshold_tail(values, decay)
    if state is None:
        return new.select(F.col("fresh").alias("threshold"), "batches")
    folded = state.where("batch is null")
    old, seen = folded.select("threshold").scalar(), folded.select("batches").scalar()
    power = F.pow(F.lit(decay), F.col("batches"))
    return new.select(F.when(old.isNull(), F.col("fresh")).otherwise(old * power + F.coalesce("tail", F.lit(0.0))).alias("threshold"), (F.col("batches") + seen).alias("batches"))


def threshold_merge(decay: float) -> Merge:
    """State: one row (threshold, batches) over the batches that are closed, and the row minima of the open one. Batches come in
    order; one is closed when a later one appears, since it may go on in the next micro-batch."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.where("value > 0").select("batch", "row", "value")
        if state is not None:
            rows = state.where("batch is not null").select("batch", "row", "value").unionByName(rows)
        newest = rows.agg(F.max("batch")).scalar()
        open_rows = rows.where(F.col("batch") == newest).groupBy("batch", "row").agg(F.min("value").alias("value"))
        return _carried(state, batch_thresholds(rows.where(F.col("batch") < newest)), decay).unionByName(open_rows, allowMissingColumns=True)

    return merge


def threshold_report(state: DataFrame, decay: float) -> DataFrame:
    """(threshold, batches) at the end of the stream, which closes the open batch."""
    return _carried(state, batch_thresholds(state.where("batch is not null")), decay)


def running_threshold_tail(values: DataFrame, decay: float) -> DataFrame:
    from sitelake.operators.statistics import running_total

    placed = running_total(values.withColumn("one", F.lit(1).cast("bigint")), "batch", "one", "place")
    n = values.agg(F.count("*")).scalar()
    later = (1 - decay) * F.pow(F.lit(decay), n - F.col("place"))
    first = F.when(F.col("place") == 1, F.pow(F.lit(decay), n - 1)).otherwise(later)
    return placed.agg(F.sum(F.col("v") * later).alias("tail"), F.sum(F.col("v") * first).alias("fresh"), F.count("*").alias("batches"))


KEY_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest(stream: DataFrame, folder: str, checkpoint: str, key: str) -> None:
    """Append one row per key; a key that was committed, or repeats inside a batch, is skipped. The keys seen are the state
    of the stream, kept on disk by key and saved as changes, so a batch costs its own size and not that of all keys. Rows
    are written under the batch id: a replayed batch overwrites its own rows, a restart neither repeats nor loses a key."""
    name, store = KEY_STORE
    conf = stream.sparkSession.conf
    before = conf.get(name)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/v={batch_id}")

    conf.set(name, store)
    try:  # the query takes the settings of the moment it starts
        query = stream.dropDuplicates([key]).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
