"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.session import cut_lineage


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], group: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """(group, share, value): quantiles with linear interpolation between neighbours, equal to sorting all values; nulls are left out.

    A mergeable sketch first brackets each rank: it knows ranks to n / accuracy, so a bracket a few times as wide on both sides holds the rank for
    certain. Groups of few values are one bracket. Values below the bracket are only counted; those inside are counted by value, and the wanted ones are picked from these. The last step sorts a
    few rows in ``accuracy``, or fewer where values repeat. A bracket that missed its rank would raise an error, never give another value.
    """
    group = group or []
    values = rows.where(F.col(column).isNotNull()).select(*group, F.col(column).cast("double").alias("v"))
    margin = 4 / accuracy
    ends = [min(1.0, max(0.0, p + side * margin)) for p in shares for side in (-1, 1)]
    sketch = values.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
    whole = F.col("n") <= 4 * accuracy  # so few values are all inside
    bracket = lambda i, p: F.struct(
        F.lit(float(p)).alias("share"), F.when(whole | F.lit(p <= margin), F.col("least")).otherwise(F.col("ends")[2 * i]).alias("low"),
        F.when(whole | F.lit(p >= 1 - margin), F.col("most")).otherwise(F.col("ends")[2 * i + 1]).alias("high"))
    brackets = cut_lineage(sketch.select(*group, "n", F.inline(F.array(*[bracket(i, p) for i, p in enumerate(shares)]))))
    both = values.withColumnsRenamed({g: f"{g}_v" for g in group}).join(brackets, F.expr(" and ".join([f"{g} <=> {g}_v" for g in group] + ["v <= high"])))
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counted = both.groupBy(*group, "share", "n", inside.alias("v")).agg(F.count("*").alias("c"))
    # Null stands for everything below the bracket and comes first.
    order = Window.partitionBy(*group, "share").orderBy(F.asc_nulls_first("v"))
    ranked = counted.withColumn("upto", F.sum("c").over(order)).withColumn("place", (F.col("n") - 1) * F.col("share"))
    at = lambda rank: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > rank), F.struct("upto", "v", "c")))
    picked = ranked.groupBy(*group, "share").agg(F.max("place").alias("place"), at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    missed = F.col("b").isNull() | (F.col("a.upto") - F.col("a.c") > F.floor("place"))
    part = F.col("place") - F.floor("place")
    value = F.when(missed, F.raise_error(F.lit("the bracket missed its rank")).cast("double")).otherwise(F.col("a.v") * (1 - part) + F.col("b.v") * part)
    return picked.select(*group, "share", value.alias("value"))
