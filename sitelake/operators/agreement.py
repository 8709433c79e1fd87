"""Cross-source agreement, crosstalk, gold negatives, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators.sites import SITE_KEY, source_bits


def site_masks(positives: DataFrame) -> DataFrame:
    """Per site and type: which sources reported it, as a bit mask."""
    return positives.groupBy(*SITE_KEY).agg(source_bits().alias("reporting"))


def names_of(mask: Column, sources: dict[int, str]) -> Column:
    """Sorted comma list of the source names whose bit is set; ``sources`` is rank to name."""
    ranked = sorted(sources.items(), key=lambda kv: kv[1])
    entries = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")) for rank, name in ranked])
    chosen = F.filter(entries, lambda e: F.getbit(mask, e["rank"]) == 1)
    return F.array_join(F.transform(chosen, lambda e: e["name"]), ",")


def site_agreement(masks: DataFrame, sources: dict[int, str]) -> DataFrame:
    """Reporting sources per site against the sources that cover the protein for that type."""
    covering = masks.groupBy("accession", "type").agg(F.bit_or("reporting").alias("covering"))
    rows = masks.join(covering, ["accession", "type"])
    missing = F.col("covering").bitwiseAND(F.bitwise_not("reporting"))
    n_rep, n_cov = F.bit_count("reporting").cast("bigint"), F.bit_count("covering").cast("bigint")
    return rows.select(
        *SITE_KEY, n_rep.alias("n_sources_reporting"), names_of(F.col("reporting"), sources).alias("sources_reporting"),
        n_cov.alias("n_sources_covering"), F.bit_count(missing).cast("bigint").alias("n_sources_disagreeing"),
        names_of(missing, sources).alias("sources_disagreeing"), exprs.rounded(n_rep / n_cov, 3).alias("agreement_ratio"))


def crosstalk(masks: DataFrame, sources: dict[int, str] | None = None) -> DataFrame:
    """Sites with several types, from ``site_masks``. Entries are bounded by the number of types, never by rows."""
    per_site = masks.groupBy("accession", "position").agg(
        F.array_sort(F.collect_list(F.struct("type", "reporting"))).alias("entries")).where("size(entries) > 1")
    types = F.transform("entries", lambda e: e["type"])
    seen = F.aggregate(
        "entries", F.struct(F.lit(0).cast("bigint").alias("once"), F.lit(0).cast("bigint").alias("twice")),
        lambda acc, e: F.struct(
            acc["once"].bitwiseOR(e["reporting"]).alias("once"),
            acc["twice"].bitwiseOR(acc["once"].bitwiseAND(e["reporting"])).alias("twice")))
    if sources:
        evidence = F.when(seen["twice"] != 0, "same_source_multi_type").otherwise("cross_source_only")
        per_type = F.array_join(F.transform(
            "entries", lambda e: F.concat(e["type"], F.lit("="), names_of(e["reporting"], sources))), "; ")
    else:
        evidence, per_type = F.lit("unattributed"), F.lit(None).cast("string")
    return per_site.select(
        "accession", "position", F.size("entries").cast("bigint").alias("n_types"),
        F.array_join(types, " + ").alias("type_combination"), per_type.alias("sources_per_type"),
        evidence.alias("evidence_class"))


def gold_negatives(labelled: DataFrame, positives: DataFrame) -> DataFrame:
    """Rows labelled 'non...' with a flag for those an annotated N-glycosylation site contradicts."""
    confirmed = positives.where("type = 'N-glycosylation'").select("accession", "position").distinct()
    return (
        labelled.where(F.contains(F.lower("label"), F.lit("non")))
        .select("accession", "position", F.lit("N-glycosylation").alias("type"), F.lit("gold").alias("tier"))
        .join(confirmed.withColumn("contradicted", F.lit(True)), ["accession", "position"], "left")
        .withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    )


def gold_contradictions_by_source(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """Per positive source: negatives it contradicts, their share, and the five smallest examples."""
    negs = negatives.select("accession", "position").distinct()
    hits = positives.select("source", "accession", "position").distinct().join(negs, ["accession", "position"])
    ranked = hits.groupBy("source").agg(F.count("*").alias("n_contradicted"))
    example = F.concat_ws(":", "accession", F.col("position").cast("string"))
    smallest = smallest_per_group(hits.withColumn("example", example), "source", "example", 5)
    total = negs.agg(F.count("*")).scalar()
    sources = positives.select("source").distinct()
    n = F.coalesce("n_contradicted", F.lit(0))
    return sources.join(ranked, "source", "left").join(smallest, "source", "left").select(
        "source", total.alias("n_negatives"), n.cast("bigint").alias("n_contradicted"),
        exprs.rounded(100.0 * n / total, 2).alias("pct_contradicted"), F.coalesce("examples", F.lit("")).alias("examples"))


def smallest_per_group(rows: DataFrame, group: str, value: str, k: int, slots: int = 64) -> DataFrame:
    """The k smallest values of a group in two steps, so a hot group is first cut down in many tasks."""
    from pyspark.sql import Window

    slotted = rows.withColumn("slot", F.pmod(F.xxhash64(value), F.lit(slots)))
    inner = Window.partitionBy(group, "slot").orderBy(value)
    few = slotted.withColumn("rn", F.row_number().over(inner)).where(F.col("rn") <= k)
    outer = Window.partitionBy(group).orderBy(value)
    best = few.withColumn("rn", F.row_number().over(outer)).where(F.col("rn") <= k)
    return best.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("examples"))


def pairwise_overlap(rows: DataFrame, sources: list[str], key: list[str]) -> DataFrame:
    """All unordered source pairs: sizes, shared keys, shares. Keys are first reduced to their source mask
    and counted per mask, so pairs are formed only over the few distinct masks."""
    ranks = {name: i for i, name in enumerate(sources)}
    bit = F.coalesce(*[F.when(F.col("source") == s, F.lit(1 << i).cast("bigint")) for s, i in ranks.items()])
    masks = rows.where(F.col("source").isin(*sources)).groupBy(*key).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    has = lambda name: F.getbit("mask", F.lit(ranks[name])) == 1
    pairs = [(a, b) for i, a in enumerate(sorted(sources)) for b in sorted(sources)[i + 1:]]
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    wide = masks.agg(*[F.struct(
        F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), total(has(a)).alias("n_a"), total(has(b)).alias("n_b"),
        total(has(a) & has(b)).alias("n_shared")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    out = wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
    share = lambda n: F.when(F.col(n) > 0, exprs.rounded(100.0 * F.col("n_shared") / F.col(n), 2))
    return out.select("*", share("n_a").alias("pct_a"), share("n_b").alias("pct_b"))


def type_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per type over the union of types: distinct sites on each side, shared, and both fractions."""
    tagged = left.select(*SITE_KEY, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*SITE_KEY, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sites = tagged.groupBy(*SITE_KEY).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    counts = sites.groupBy("type").agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * F.col("r")).alias("n_shared"))
    part = lambda n: F.when(F.col(n) > 0, exprs.rounded(F.col("n_shared") / F.col(n)))
    return counts.select("*", part("n_left").alias("fraction_left"), part("n_right").alias("fraction_right"))


def reliability_sweep(rows: DataFrame, reference: DataFrame, floors: int = 6) -> DataFrame:
    """Rows, unique sites and confirmed sites kept at each floor 0..floors-1. Each row counts at every floor up
    to its own reliability, so a histogram by reliability and its suffix sums replace the floor join."""
    capped = F.least(F.floor("reliability"), F.lit(floors - 1)).cast("bigint")
    rated = rows.where("reliability is not null and reliability >= 0").withColumn("level", capped)
    in_reference = reference.select("accession", "position").distinct().withColumn("confirmed", F.lit(1))
    sites = (
        rated.groupBy("accession", "position").agg(F.max("level").alias("level"))
        .join(in_reference, ["accession", "position"], "left")
        .groupBy("level").agg(F.count("*").alias("sites"), F.count("confirmed").alias("confirmed"))
    )
    by_row = rated.groupBy("level").agg(F.count("*").alias("rows"))
    both = by_row.join(sites, "level", "full")
    at_floor = both.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("level"))).alias("floor"), "rows", "sites", "confirmed")
    total = rows.agg(F.count("*")).scalar()
    sums = at_floor.groupBy("floor").agg(F.sum("rows").alias("n_rows"), F.sum("sites").alias("n_sites"), F.sum("confirmed").alias("n_confirmed"))
    spark = rows.sparkSession
    every = dims.inline_frame(spark, [(i,) for i in range(floors)], ["floor"])
    filled = every.join(sums, "floor", "left").select("floor", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_sites", "n_confirmed")])
    return filled.select(
        "floor", "n_rows", exprs.rounded(100.0 * F.col("n_rows") / total, 2).alias("pct_rows"), "n_sites",
        F.when(F.col("n_sites") > 0, exprs.rounded(100.0 * F.col("n_confirmed") / F.col("n_sites"), 2)).alias("pct_in_reference"))
