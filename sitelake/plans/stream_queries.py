"""Catalogue: accumulators run as streams over the event table, checked against the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelake.functions import exprs
from sitelake.plans import inputs as I
from sitelake.plans.oracle import r
from sitelake.plans.registry import query
from sitelake.plans.vector_queries import DEAD, top_codes
from sitelake.session import ensure_checkpoint_dir
from sitelake.streaming import folds


def places(spark):
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/state", f"{base}/progress"


def events(spark, sf):
    return folds.read_stream(spark, f"{sf}/event[s].parquet", I.table(spark, sf, "events"))


def firing(spark, sf):
    return events(spark, sf).select(
        F.expr("event_id div 100").alias("batch"), F.col("user_id").alias("latent"), "value", (F.col("value") > 60).alias("fired"), "event_id", F.col("event_type").alias("stratum"))


def aggregated(spark, rows):
    state, progress = places(spark)
    folds.aggregate(rows, state, progress)
    return folds.read_state(spark, state)


def folded(spark, rows, merge):
    state, progress = places(spark)
    folds.fold(rows, state, progress, merge)
    return folds.read_state(spark, state)


@query("t1_evaluation_sums", f"select latent, count(*) as n, {r('sum(value)')} as sum_x, {r('sum(value * value)')} as sum_xx, {r('sum((value - 50) * (value - 50))')} as sse, count(*) filter (where fired) as fired from o_fire group by latent")
def t1(spark, sf):
    sums = aggregated(spark, folds.evaluation_sums(firing(spark, sf).withColumn("target", F.lit(50.0))))
    return sums.select("latent", "n", *[exprs.rounded(c).alias(c) for c in ("sum_x", "sum_xx", "sse")], "fired")


N_FIRED = "count(*) as total, count(*) filter (where value > 60) as active"


@query("t2_concentration_counts", f"""select 'stratum' as level, event_type as stratum, null::varchar as label, user_id as latent, {N_FIRED} from events group by all
    union all select 'type', event_type, 'odd', user_id, {N_FIRED} from events where event_id % 2 = 1 group by event_type, user_id
    union all select 'type', event_type, 'third', user_id, {N_FIRED} from events where event_id % 3 = 1 group by event_type, user_id
    union all select 'tier', null, case when value > 90 then 'gold' when value > 30 then 'hard' else 'background' end as tier, user_id, {N_FIRED}
      from events where event_id % 2 <> 1 and event_id % 3 <> 1 group by tier, user_id""")
def t2(spark, sf):
    types = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 1, "odd"), F.when(F.col("event_id") % 3 == 1, "third")))
    tier = F.when(F.col("value") > 90, "gold").when(F.col("value") > 30, "hard").otherwise("background")
    rows = firing(spark, sf).withColumn("types", types).withColumn("tier", F.when(F.size("types") == 0, tier))
    return aggregated(spark, folds.concentration_counts(rows))


@query("t3_topk_per_latent", "select latent, value, event_id from (select *, row_number() over (partition by latent order by value desc, event_id) as rn from o_fire where value > 0) where rn <= 5")
def t3(spark, sf):
    return folded(spark, firing(spark, sf).where("value > 0"), folds.top_k_merge(5, "latent", [F.desc("value"), F.col("event_id")], ["value", "event_id"]))


@query("t4_code_counts", "select event_type as stratum, count(*) as n from events group by all")
def t4(spark, sf):
    return aggregated(spark, folds.code_counts(firing(spark, sf), "stratum"))


@query("t5_metrics_tail", "select run, metric, arg_max(value, step) as value, max(step) as step from o_log group by run, metric")
def t5(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 8).alias("run"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")
    return aggregated(spark, folds.metric_tail(rows))


@query("t6_resumable_ingest", "select event_id, user_id, value from events")
def t6(spark, sf):
    state, progress = places(spark)
    for _ in range(2):  # every row comes twice in a batch; the second start finds everything committed
        rows = events(spark, sf).select("event_id", "user_id", "value")
        folds.ingest(rows.unionByName(rows), state, progress, "event_id")
    return spark.read.parquet(*[f"{state}/rows/v={v}" for v in folds.state_versions(spark, f"{state}/rows")])


@query("t7_dead_census", DEAD)
def t7(spark, sf):
    return folds.census_report(folded(spark, firing(spark, sf), folds.census_merge), 1000)


FOLD = """with recursive v as (select batch, avg(m) as v, row_number() over (order by batch) as i from ({rows}) group by batch),
    w as (select i, v as t from v where i = 1 union all select v.i, 0.99e0 * w.t + 0.01e0 * v.v from w join v on v.i = w.i + 1)
    select {t} as threshold, i as batches from w order by i desc limit 1"""


@query("t8_running_threshold", FOLD.format(rows="select batch, event_id, min(value) as m from o_fire where value > 0 group by all", t=r("t")))
def t8(spark, sf):
    rows = firing(spark, sf).select("batch", F.col("event_id").alias("row"), "value")
    return folds.threshold_report(folded(spark, rows, folds.threshold_merge(0.99)), 0.99).select(exprs.rounded("threshold").alias("threshold"), "batches")


@query("t8_threshold_batch", FOLD.format(rows="select pid as batch, vec_id, min(value) as m from o_top where value > 0 group by all", t=r("t")))
def t8_batch(spark, sf):
    codes = top_codes(spark, sf).select(F.col("pid").alias("batch"), F.col("position").alias("row"), "value")
    return folds.running_threshold(folds.batch_thresholds(codes), 0.99).select(exprs.rounded("threshold").alias("threshold"), "batches")
