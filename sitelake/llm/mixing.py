"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.common import stored, unused, width

# Words of a text: runs of anything but blanks.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` times the sum of all
    sizes. A target stops at ``limit`` times its source's size; what is over goes to the others by weight until
    none is above. Water level: sources by limit / weight, the level is the first at which all below are full.
    The table has one row per source; only that table passes through one task.
    """
    weight = " ".join(f"when {i} then {float(w)}D" for i, w in enumerate(weights))
    ranked = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")).selectExpr(
        "source", "source_size", f"{float(limit)}D * source_size as most",
        f"case (row_number() over (order by source nulls last) - 1) % {len(weights)} {weight} end as weight")
    order = "over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)"
    filled = ranked.selectExpr(
        "*", f"coalesce(sum(most) {order}, 0D) as full_sum", f"coalesce(sum(weight) {order}, 0D) as full_weight",
        "sum(weight) over () as all_weight", f"{float(share)}D * sum(source_size) over () as goal")
    level = F.expr("max(case when (goal - full_sum) / (all_weight - full_weight) <= most / weight then (goal - full_sum) / (all_weight - full_weight) end) over ()")
    return filled.withColumn("level", level).selectExpr("source", "source_size", "case when level is null then most else least(most, level * weight) end as target")


def random_offset(source: Column, seed: int) -> Column:
    """One of 65,536 offsets in [0, 1) per source, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit(f"#{seed}"))), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
        share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    A source's rows stand in the order size (largest first), id; each expects target / source_size copies. The
    running sum of expected copies plus one random offset per source gives a copy at each integer that it passes,
    so copies differ by one at most within a source, never exceed ``limit`` rounded up, and the words taken miss
    the target by less than the largest row. Order and running sums come from a range partition: rows before a row are counted
    per partition, so a source with a third of all rows spreads over many tasks.

    Null text and text of blanks: size 0, nothing taken. Null source: a source of its own, last in order. A source of size 0 has target 0.
    Repeated rows count each; rows equal in source, size and id are interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    sizes = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, limit), "mix-targets")
    order = ["source", F.desc("size"), "doc_id"]
    ordered = stored(
        sizes.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "mix-order")
    blocks = ordered.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = blocks.selectExpr("part", "source", "first", "sum(n) over (partition by source order by part) - n as before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_block = (
        before.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source"))
        .select("part", F.col("b.source").alias("block_source"), "first", "before", "source_size", "target", rate.alias("rate"), random_offset(F.col("b.source"), seed).alias("offset")))
    ranked = ordered.join(per_block, [ordered["part"] == per_block["part"], ordered["source"].eqNullSafe(per_block["block_source"])]).withColumn(
        "rank", F.expr("before + row - first"))
    copies = F.floor(F.expr("(rank + 1) * rate + offset")) - F.floor(F.expr("rank * rate + offset"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies")).withColumn("taken", F.expr("copies * size"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` copies it. Rows of one id count as one
    document: all are repeated as often as the copies of the id, shared out over them from the first on."""
    id_col = options.get("id_col", "doc_id")
    key, total, rows, number, share, copy = (unused(n, docs) for n in ("mix_key", "mix_copies", "mix_rows", "mix_no", "mix_share", "mix_copy"))
    id_key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**63)))
    copies = mix(docs, **options).groupBy(id_key("doc_id").alias(key)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    shares = F.expr(f"cast({total} div {rows} + case when {number} <= {total} % {rows} then 1 else 0 end as int)")
    out = docs.withColumn(key, id_key(id_col)).join(copies, key).withColumn(number, place).withColumn(share, shares).where(F.col(share) > 0)
    return out.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(share))).alias(copy)).select(*docs.columns)


# The whole query in SQL, for the check of ``mix`` with its defaults.
SQL = r"""
with s as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
r as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 as place from s group by source),
w as (select *, 2::double * source_size as most, case place when 0 then 5::double when 1 then 2::double else 1::double end as weight from r),
f as (select *, coalesce(sum(most) over o, 0) as full_sum, coalesce(sum(weight) over o, 0) as full_weight,
        sum(weight) over () as all_weight, 1.5::double * sum(source_size) over () as goal from w
      window o as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, max(case when (goal - full_sum) / (all_weight - full_weight) <= most / weight then (goal - full_sum) / (all_weight - full_weight) end) over () as level from f),
t as (select source, source_size, case when level is null then most else least(most, level * weight) end as target,
        ('0x' || substr(md5(coalesce(source, '') || '#17'), 1, 4))::bigint::double / 65536 as u from l),
k as (select s.doc_id, s.source, s.size, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
        row_number() over (partition by s.source order by s.size desc, s.doc_id) - 1 as rank from s join t on s.source is not distinct from t.source)
select doc_id, source, size, source_size, target, cast(floor((rank + 1) * rate + u) - floor(rank * rate + u) as bigint) as copies,
  cast(floor((rank + 1) * rate + u) - floor(rank * rate + u) as bigint) * size as taken from k
"""
