"""Run-log analytics: metric tails, verdicts, comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelake.functions import dims, exprs

# fixed values: metric key, label, low, high, architecture (NULL: all), skipped architecture
CHECKS = [
    ("val/explained_variance", "Explained Variance", 0.85, 0.95, None, None),
    ("val/cosine_sim_mean", "Cosine Similarity (mean)", 0.92, None, None, None),
    ("val/cosine_sim_p10", "Cosine Similarity (p10)", 0.85, None, None, None),
    ("val/mse", "Reconstruction MSE", 0.010, 0.025, None, None),
    ("train/decoder_pre_norm_mean", "Decoder Pre-Norm Mean", 0.90, 1.20, None, "jumprelu"),
    ("val/dead_latent_fraction", "Dead Latent Fraction", None, 0.05, None, None),
    ("val/alive_latent_jaccard", "Alive Latent Jaccard", 0.95, None, None, None),
    ("train/threshold_std", "Threshold Std (log-scale)", None, None, "jumprelu", None),
    ("train/threshold_mean", "Threshold Mean", None, None, "jumprelu", None),
    ("train/decoder_norm_mean", "Decoder Norm Mean", None, None, "jumprelu", None),
    ("train/l0", "L0 (pinned near k)", None, None, "topk", None),
]
CHECK_COLUMNS = ["metric", "label", "low", "high", "only_for", "not_for"]


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, metric, value) from JSON lines; malformed lines and non-numeric values are skipped. ``line_no`` orders the lines of a file: by
    the start of their block, then by their place in the task that read it, since tasks take blocks in any order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    numbered = lines.withColumn("line_no", F.struct("block", F.monotonically_increasing_id().alias("place")))
    return metric_rows(numbered)


def metric_rows(lines: DataFrame) -> DataFrame:
    """Unpivot (…, value = JSON text) into one row per key with a JSON number; quoted numbers are text and skipped."""
    keep = [c for c in lines.columns if c not in ("value", "block")]
    parsed = lines.select(*keep, F.from_json("value", "map<string,variant>", {"mode": "PERMISSIVE"}).alias("m")).where("m is not null")
    numeric = "regexp_like(schema_of_variant(v), '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$')"
    return parsed.select(*keep, F.explode("m").alias("metric", "v")).where(numeric).select(*keep, "metric", F.expr("try_variant_get(v, '$', 'double')").alias("value")).where("value is not null")


def last_values(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.where("value is not null").groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def number_text(value) -> Column:
    """A band limit without trailing zeros."""
    text = F.format_string("%.6f", value)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def band_text() -> Column:
    low, high = F.col("low"), F.col("high")
    return (
        F.when(low.isNull() & high.isNull(), "n/a").when(low.isNull(), F.concat(F.lit("< "), number_text(high)))
        .when(high.isNull(), F.concat(F.lit(">= "), number_text(low))).otherwise(F.concat(number_text(low), F.lit(" - "), number_text(high)))
    )


def check_table(spark: SparkSession, checks: list[tuple] | None = None) -> DataFrame:
    frame = dims.inline_frame(spark, checks or CHECKS, CHECK_COLUMNS)
    return frame.select("metric", "label", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"),
                        F.col("only_for").cast("string").alias("only_for"), F.col("not_for").cast("string").alias("not_for"))


def verdicts(last: DataFrame, checks: DataFrame, architectures: DataFrame) -> DataFrame:
    """(run, label, value, target, status). ``last``: run, metric, value; ``architectures``: run, architecture.
    Metrics a run never logged are left out."""
    rows = last.join(F.broadcast(checks), "metric").join(architectures, "run")
    applies = (F.col("only_for").isNull() | (F.col("only_for") == F.col("architecture"))) & (F.col("not_for").isNull() | (F.col("not_for") != F.col("architecture")))
    return rows.where(applies).select("run", "label", exprs.rounded("value").alias("value"), band_text().alias("target"), exprs.band_verdict("value", "low", "high").alias("status"))


# fixed values: limits of the recommendation rules, and the architecture they are about
RULES_FOR = "jumprelu"
FROZEN_THRESHOLD, NORM_DRIFT, DENSE_SHARE, COLLAPSED_SHARE, VARIANCE_FLOOR = 3.5e-4, 0.05, 0.5, 0.001, 0.90


def recommendations(finals: DataFrame) -> DataFrame:
    """Rules that fire per run. ``finals``: run, architecture, d_hidden, l0, threshold_std_max, decoder_norm, explained_variance
    (the last two may be NULL). The rules are about threshold networks (``RULES_FOR``): a run of another or unknown architecture
    gets one row saying that it has no rules, and a run that matches none gets one row saying so."""
    share = F.col("l0") / F.col("d_hidden")
    rules = [
        ("threshold_frozen", F.col("threshold_std_max") < FROZEN_THRESHOLD, "threshold spread never left its initial range",
         "widen the bandwidth or raise the sparsity coefficient"),
        ("decoder_norm_static", F.abs(F.col("decoder_norm") - 1.0) < NORM_DRIFT, "decoder norms barely moved from 1",
         "raise the sparsity coefficient and keep the norm constraint off"),
        ("dense_code", share > DENSE_SHARE, "most latents fire on every token", "raise the sparsity coefficient substantially"),
        ("collapsed_code", share < COLLAPSED_SHARE, "almost no latent fires", "lower the sparsity coefficient"),
        ("variance_below_floor", F.col("explained_variance") < VARIANCE_FLOOR, "reconstruction failed on its own", "lower the sparsity coefficient or check the learning rate"),
    ]
    fired = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(
        F.lit(name).alias("rule"), F.lit(why).alias("diagnosis"), F.lit(what).alias("change"))) for name, cond, why, what in rules]))
    row = lambda *texts: F.array(F.struct(*[F.lit(t).alias(n) for t, n in zip(texts, ("rule", "diagnosis", "change"))]))
    covered = F.coalesce(F.col("architecture") == RULES_FOR, F.lit(False))
    chosen = F.when(~covered, row("no_rules_for_architecture", "", "")).when(F.size("fired") > 0, F.col("fired")).otherwise(
        row("no_known_signature", "the run may be healthy", "look again at why it was flagged"))
    return finals.withColumn("fired", fired).select("run", F.inline(chosen))


def comparison(last: DataFrame, runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run with the last value of each metric; missing ones are NULL."""
    wide = last.where(F.col("metric").isin(*metrics)).groupBy("run").pivot("metric", metrics).agg(F.first("value"))
    return runs.join(wide, "run", "left")


def concurrency_table(runs: DataFrame) -> DataFrame:
    """Per level: ok runs, mean and sum of throughput, speedup against the lowest level measured."""
    levels = runs.where("ok").groupBy("level").agg(F.count("*").alias("ok_runs"), F.avg("throughput").alias("mean_rate"), F.sum("throughput").alias("total_rate"))
    first = levels.agg(F.min_by("total_rate", "level")).scalar()
    return levels.select("level", "ok_runs", exprs.rounded("mean_rate").alias("mean_rate"), exprs.rounded("total_rate").alias("total_rate"),
                         exprs.rounded(F.col("total_rate") / first).alias("speedup"))


def pick_level(levels: DataFrame, share: float = 0.95) -> DataFrame:
    """The smallest level within ``share`` of the best total rate; 1 where nothing was measured."""
    best = levels.agg(F.max("total_rate")).scalar()
    return levels.where(F.col("total_rate") >= share * best).agg(F.coalesce(F.min("level"), F.lit(1)).alias("level"))


def trends(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(section, step, metric, value): one trend metric per section."""
    section = F.coalesce(*[F.when(F.col("metric") == m, F.lit(s)) for m, s in keys.items()])
    return rows.where(F.col("metric").isin(*keys)).select(section.alias("section"), "run", "step", "metric", "value")


def scalar_history(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Every logged step, one column per metric, no forward fill."""
    return rows.where(F.col("metric").isin(*metrics)).groupBy("run", "step").pivot("metric", metrics).agg(F.max("value"))


def histogram_edges(low, size, count) -> Column:
    """Edges of a packed histogram: low + size * i for i = 0..count."""
    return F.transform(F.sequence(F.lit(0), F.col(count).cast("int")), lambda i: F.col(low) + F.col(size) * i)


def last_histogram(rows: DataFrame) -> DataFrame:
    """(run, counts, edges) of the last histogram of each run. ``rows``: run, step, counts, and either explicit ``bins`` or the packed form
    (bins NULL) low, size, count. One row per run reaches the shuffle from each task."""
    packed = ("counts", "bins", "low", "size", "count")
    last = rows.groupBy("run").agg(F.max_by(F.struct(*packed), "step").alias("last")).select("run", "last.*")
    return last.select("run", "counts", F.coalesce("bins", histogram_edges("low", "size", "count")).alias("edges"))


def artifact_table(artifacts: DataFrame, tables: DataFrame, prefix: str, key: str) -> DataFrame:
    """The rows of the table ``key`` in the first artifact of each run whose name starts with ``prefix``. ``artifacts``: run, artifact, logged (place in
    the run's order); ``tables``: run, artifact, table_key and the table's own columns. A run without such an artifact fails the job."""
    named = F.when(F.col("artifact").startswith(prefix), F.struct("logged", "artifact"))
    first = artifacts.groupBy("run").agg(F.min(named)["artifact"].alias("artifact"))
    missing = F.raise_error(F.concat(F.lit(f"no artifact named '{prefix}...' in run "), F.col("run").cast("string")))
    chosen = first.withColumn("artifact", F.coalesce("artifact", missing))
    return tables.where(F.col("table_key") == key).join(chosen, ["run", "artifact"]).drop("table_key")
