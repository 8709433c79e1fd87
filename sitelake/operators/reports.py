"""Profiles and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators.quantiles import exact_quantiles
from sitelake.operators.sampling import bottom_k


def suggested_strata(traced: DataFrame) -> DataFrame:
    """Per type: the stratum whose letters cover most of its residues; the first stratum wins ties."""
    counts = traced.groupBy("type", "residue").agg(F.count("*").alias("n"))
    strata = dims.strata(traced.sparkSession)
    covered = counts.join(F.broadcast(strata), "residue").groupBy("type", "stratum", "stratum_order").agg(F.sum("n").alias("n"))
    best = covered.groupBy("type").agg(F.max_by("stratum", F.struct("n", -F.col("stratum_order"))).alias("suggested"), F.max("n").alias("n_best"))
    totals = counts.groupBy("type").agg(F.sum(F.when(F.col("residue").isNotNull(), F.col("n"))).alias("n_residues"))
    return totals.join(best, "type", "left").select(
        "type", F.coalesce("suggested", F.lit("n/a")).alias("suggested"),
        exprs.rounded(100.0 * F.coalesce("n_best", F.lit(0)) / F.col("n_residues"), 1).alias("suggested_pct"))


def type_dim(frame: DataFrame) -> DataFrame:
    """Spelling-only lookup (no residue): adds ``config_stratum`` and ``config_letters`` for a raw type."""
    table = dims.spellings(frame.sparkSession).select(
        "spelling_key", F.col("spelled_stratum").alias("config_stratum"), F.col("spelled_letters").alias("config_letters"))
    return (
        frame.withColumn("spelling_key", exprs.type_key("type")).join(F.broadcast(table), "spelling_key", "left")
        .withColumn("config_stratum", F.coalesce("config_stratum", F.lit("UNMAPPED"))).drop("spelling_key")
    )


def numeric_summary(frame: DataFrame, column: str, group: list[str]) -> DataFrame:
    """describe() of a text column read as numbers, with the count of values that are not numbers. A group without numbers has no row of quantiles."""
    value = F.expr(f"try_cast({column} as double)")
    rows = frame.select(*group, F.col(column).alias("raw"), value.alias("v"))
    sums = rows.groupBy(*group).agg(
        F.count("v").alias("n"), F.count_if(F.col("raw").isNotNull() & F.col("v").isNull()).alias("n_coerced"),
        exprs.rounded(F.avg("v")).alias("mean"), exprs.rounded(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    found = exact_quantiles(rows, "v", [0.25, 0.5, 0.75], group).groupBy(*group).agg(
        *[exprs.rounded(F.max(F.when(F.col("share") == p, F.col("value")))).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])
    other = found.withColumnsRenamed({g: f"{g}_q" for g in group})
    on = F.expr(" and ".join(f"{g} <=> {g}_q" for g in group) or "true")
    return sums.join(other if group else F.broadcast(other), on, "left").select(*group, "n", "n_coerced", "mean", "std", "min", "p25", "p50", "p75", "max")


def profile(frame: DataFrame, max_values: int = 15) -> DataFrame:
    """Per column: rows, nulls, distinct values, and the values where there are few. Every cell becomes a
    (column, value) pair counted before the shuffle; no list is built for a column of many values."""
    cells = frame.select(F.posexplode(F.array(*[F.col(c).cast("string") for c in frame.columns])).alias("i", "value"))
    names = F.array(*[F.lit(c) for c in frame.columns])
    counted = cells.groupBy("i", "value").agg(F.count("*").alias("n"))
    stats = counted.groupBy("i").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_unique"))
    few = counted.where("value is not null").join(stats.where(F.col("n_unique") <= max_values).select("i"), "i", "left_semi")
    listed = few.groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("unique_values"))
    return stats.join(listed, "i", "left").select(
        F.get(names, F.col("i")).alias("column"), "n_rows", "n_null",
        exprs.rounded(100.0 * F.col("n_null") / F.col("n_rows"), 2).alias("pct_null"), "n_unique",
        F.coalesce("unique_values", F.lit("")).alias("unique_values"))


def value_counts(frame: DataFrame, column: str, top_n: int = 30) -> DataFrame:
    """Counts including NULL with their share; largest first, then by value."""
    total = frame.agg(F.count("*")).scalar()
    counts = frame.groupBy(column).agg(F.count("*").alias("n"))
    ranked = counts.orderBy(F.desc("n"), F.asc_nulls_first(column)).limit(top_n)
    return ranked.withColumn("pct", exprs.rounded(100.0 * F.col("n") / total, 2))


def cluster_sizes(corpus: DataFrame) -> DataFrame:
    """Size report as (metric, value): totals, distribution of the 15 smallest sizes, ten largest clusters."""
    sizes = corpus.groupBy("cluster_id").agg(F.count("*").alias("size"))
    by_size = sizes.groupBy("size").agg(F.count("*").alias("n"))
    n, size = F.col("n"), F.col("size")
    singles = F.coalesce(F.sum(F.when(size == 1, n)), F.lit(0))
    wide = by_size.agg(
        F.sum(n * size).alias("n_proteins"), F.sum(n).alias("n_clusters"), (F.sum(n * size) / F.sum(n)).alias("mean"),
        F.floor(F.percentile("size", F.lit(0.5), n)).alias("median"), F.max("size").alias("max"), singles.alias("singles"),
        (100.0 * singles / F.sum(n * size)).alias("pct"))
    names = [("n_proteins", F.col("n_proteins")), ("n_clusters", F.col("n_clusters")), ("mean_size", exprs.rounded("mean", 3)),
             ("median_size", F.col("median")), ("max_size", F.col("max")), ("n_singletons", F.col("singles")),
             ("pct_in_singletons", exprs.rounded("pct", 2))]
    totals = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in names])))
    smallest = by_size.orderBy("size").limit(15).select(F.concat(F.lit("size:"), "size").alias("metric"), n.cast("double").alias("value"))
    largest = sizes.orderBy(F.desc("size"), "cluster_id").limit(10).select(
        F.concat(F.lit("largest:"), "cluster_id").alias("metric"), size.cast("double").alias("value"))
    return totals.unionByName(smallest).unionByName(largest)


def type_coverage(rows: DataFrame) -> DataFrame:
    """Per (source, raw type): sites, accessions, accessions in the corpus, chemistry match among corpus rows.
    ``rows`` carry ``residue`` and ``seq_length``. One accession is one row before the second grouping."""
    typed = type_dim(rows)
    known = F.col("seq_length").isNotNull()
    match = F.when(known & F.col("config_letters").isNotNull(), F.coalesce(F.contains("config_letters", "residue"), F.lit(False)).cast("int"))
    per_accession = typed.groupBy("source", "type", "config_stratum", "accession").agg(
        F.count("*").alias("n"), F.max(known.cast("int")).alias("known"), F.count(match).alias("checked"), F.sum(match).alias("matched"))
    return per_accession.groupBy("source", "type", F.col("config_stratum").alias("stratum")).agg(
        F.sum("n").alias("n_sites"), F.count("*").alias("n_accessions"), F.sum("known").cast("bigint").alias("n_accessions_in_corpus"),
        exprs.rounded(100.0 * F.sum("known") / F.count("*"), 1).alias("pct_accessions_in_corpus"),
        exprs.rounded(100.0 * F.sum("matched") / F.sum("checked"), 1).alias("chemistry_match_rate"))


def chemistry_failures(rows: DataFrame, top_n: int = 5) -> DataFrame:
    """Per raw type: shares of ok / out of range / mismatch among corpus rows, the residues mismatches land on,
    the stratum that fits best. All of it derives from counts per (type, residue)."""
    counts = type_dim(rows.where("seq_length is not null")).groupBy("type", "config_stratum", "config_letters", "residue").agg(F.count("*").alias("n"))
    ok = F.coalesce(F.contains("config_letters", "residue"), F.lit(False))
    sums = counts.groupBy("type", "config_stratum").agg(
        F.sum("n").alias("n_sites"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_ok"),
        F.sum(F.when(F.col("residue").isNull(), F.col("n")).otherwise(0)).alias("n_out"))
    wrong = counts.where(F.col("residue").isNotNull() & ~ok)
    rank = Window.partitionBy("type").orderBy(F.desc("n"), "residue")
    top = wrong.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= top_n).groupBy("type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "residue", "n"))),
                                 lambda e: F.concat(e["residue"], F.lit(":"), e["n"].cast("string"))), ",").alias("top_mismatch"))
    best = suggested_strata(rows.where("seq_length is not null"))
    pct = lambda c: exprs.rounded(100.0 * c / F.col("n_sites"), 1)
    return sums.join(top, "type", "left").join(best, "type", "left").select(
        "type", "config_stratum", "n_sites", pct(F.col("n_ok")).alias("pct_ok"), pct(F.col("n_out")).alias("pct_out_of_range"),
        pct(F.col("n_sites") - F.col("n_ok") - F.col("n_out")).alias("pct_mismatch"), F.coalesce("top_mismatch", F.lit("")).alias("top_mismatch"),
        "suggested", "suggested_pct",
        F.coalesce((F.col("suggested") != F.col("config_stratum")) & (F.col("suggested_pct") > 60), F.lit(False)).alias("mapping_looks_wrong"))


def isoform_audit(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per source over unique accessions: unmatched, with a numeric suffix, recoverable by cutting the suffix."""
    stem = F.nullif(F.regexp_extract("accession", r"^(.*)-[^-]*$", 1), F.lit(""))
    base = F.coalesce(stem, F.col("accession"))
    known = corpus.select(base.alias("base"), "accession").groupBy("base").agg(F.collect_set("accession").alias("known"))
    names = rows.select("source", "accession").distinct().withColumn("base", base).join(known, "base", "left")
    matched = F.coalesce(F.array_contains("known", F.col("accession")), F.lit(False))
    numeric = exprs.isoform_stem("accession").isNotNull()
    recoverable = ~matched & F.coalesce(F.array_contains("known", stem), F.lit(False))
    return names.groupBy("source").agg(
        F.count("*").alias("n_accessions"), F.count_if(~matched).alias("n_unmatched"), F.count_if(numeric).alias("n_with_suffix"),
        F.count_if(recoverable).alias("n_recoverable"),
        F.coalesce(exprs.rounded(100.0 * F.count_if(recoverable) / F.nullif(F.count_if(~matched), F.lit(0)), 1), F.lit(0.0)).alias("pct_recoverable"))


def suffix_audit(entries: DataFrame, top_n: int = 3) -> DataFrame:
    """Per type: rows, HUMAN rows, share, the three most frequent other suffixes of ``entry_name``."""
    counts = entries.groupBy("type", F.substring_index("entry_name", "_", -1).alias("suffix")).agg(F.count("*").alias("n"))
    human = F.sum(F.when(F.col("suffix") == "HUMAN", F.col("n")).otherwise(0))
    sums = counts.groupBy("type").agg(F.sum("n").alias("n_rows"), human.alias("n_human"))
    rank = Window.partitionBy("type").orderBy(F.desc("n"), "suffix")
    others = counts.where("suffix <> 'HUMAN'").withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= top_n).groupBy("type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "suffix", "n"))),
                                 lambda e: F.concat(e["suffix"], F.lit(":"), e["n"].cast("string"))), ",").alias("top_other"))
    return sums.join(others, "type", "left").select(
        "type", "n_rows", "n_human", exprs.rounded(100.0 * F.col("n_human") / F.col("n_rows"), 1).alias("pct_human"),
        F.coalesce("top_other", F.lit("")).alias("top_other"))


def split_composition(hits: DataFrame, fraction: float = 0.2, floor: int = dims.MIN_SITES_PER_TYPE) -> DataFrame:
    """Per type over hits with ``partition`` and ``n``: sites by side, achieved held-out share, deviation."""
    from sitelake.operators.sites import stratum_of_type

    held = F.col("partition") == "held_out"
    sums = hits.groupBy("type").agg(
        F.sum("n").alias("sites_total"), F.sum(F.when(held, 0).otherwise(F.col("n"))).alias("sites_discovery"),
        F.sum(F.when(held, F.col("n")).otherwise(0)).alias("sites_holdout"))
    share = F.col("sites_holdout") / F.col("sites_total")
    return sums.select(
        "type", F.coalesce(stratum_of_type(), F.lit("UNMAPPED")).alias("stratum"), "sites_total", "sites_discovery", "sites_holdout",
        exprs.rounded(share, 4).alias("achieved_fraction"), exprs.rounded(F.abs(share - fraction), 4).alias("abs_deviation"),
        F.col("type").isin(*dims.PRIMARY_TYPES).alias("is_primary"),
        ((F.col("sites_discovery") >= floor) & (F.col("sites_holdout") >= floor)).alias("both_sides_eligible"))


def discrepancies(mask: DataFrame, gold: DataFrame, agreement: DataFrame) -> DataFrame:
    """Sites where the sources disagree, in three classes."""
    # fixed values: class names and their texts
    contained = mask.where(F.col("mask_reason") == dims.MASK_CONTAINMENT).select(
        "accession", "position", "type", F.lit("containment_uncatalogued_oglcnac").alias("discrepancy_class"),
        F.lit("dbPTM O-linked Glycosylation").alias("evidence_for"), F.lit("absent from O-GlcNAcAtlas").alias("evidence_against"),
        F.lit("does an O-GlcNAc latent fire here?").alias("question_for_latent"))
    contradicted = gold.where("contradicted").select(
        "accession", "position", "type", F.lit("gold_negative_contradicted").alias("discrepancy_class"),
        F.lit("annotated positive in dbPTM / N-GlycositeAtlas").alias("evidence_for"),
        F.lit("N-GlyDE verified non-glycosylated").alias("evidence_against"), F.lit("does an N-glyco latent fire here?").alias("question_for_latent"))
    single = agreement.where("n_sources_disagreeing > 0").select(
        "accession", "position", "type", F.lit("single_source_despite_coverage").alias("discrepancy_class"),
        F.col("sources_reporting").alias("evidence_for"), F.col("sources_disagreeing").alias("evidence_against"),
        F.lit("missed by the other source, or spurious?").alias("question_for_latent"))
    return contained.unionByName(contradicted).unionByName(single)


def source_overview(rows: DataFrame) -> DataFrame:
    """Rows, accessions and types per source, from one grouping by (source, accession, type)."""
    fine = rows.groupBy("source", "accession", "type").agg(F.count("*").alias("n"))
    by_acc = fine.groupBy("source", "accession").agg(F.sum("n").alias("n")).groupBy("source").agg(F.sum("n").alias("n_rows"), F.count("accession").alias("n_accessions"))
    by_type = fine.select("source", "type").distinct().groupBy("source").agg(F.count("type").alias("n_types"))
    return by_acc.join(by_type, "source")


def species_grid(species_labels: DataFrame, human_labels: DataFrame, floor: int = dims.MIN_SITES_PER_TYPE) -> DataFrame:
    """Every species with every type seen anywhere. ``species_labels`` carry ``homologous_to_human`` (NULL
    where unknown) and ``flag_computed``; strict counts take rows whose flag is false or NULL."""
    from sitelake.operators.sites import stratum_of_type

    strict = ~F.coalesce("homologous_to_human", F.lit(False))
    counts = species_labels.groupBy("species", "type").agg(F.count("*").alias("n"), F.count_if(strict).alias("n_strict"))
    human = human_labels.groupBy("type").agg(F.count("*").alias("n_human"))
    types = human.select("type").union(counts.select("type")).agg(F.collect_set("type")).scalar()  # bounded by the type table
    grid = counts.select("species").distinct().select("species", F.explode(types).alias("type"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    n_strict = F.coalesce("n_strict", F.lit(0)).cast("bigint")
    return grid.join(counts, ["species", "type"], "left").join(human, "type", "left").select(
        "species", "type", F.coalesce(stratum_of_type(), F.lit("UNMAPPED")).alias("stratum"), n.alias("n_sites_species"),
        F.coalesce("n_human", F.lit(0)).cast("bigint").alias("n_sites_human"), (n >= floor).alias("testable"),
        F.when(n >= floor, "ok").when(n == 0, "absent_in_species").otherwise("below_min_sites").alias("reason"),
        n_strict.alias("n_sites_species_strict"), (n_strict >= floor).alias("testable_strict"))


def strict_retention(species_labels: DataFrame) -> DataFrame:
    strict = ~F.coalesce("homologous_to_human", F.lit(False))
    return species_labels.groupBy("species").agg(
        F.count("*").alias("n_sites"), F.count_if(strict).alias("n_strict"),
        exprs.rounded(100.0 * F.count_if(strict) / F.count("*"), 2).alias("pct_kept"))


def headline_gate(composition: DataFrame, floor: int = dims.MIN_SITES_HEADLINE) -> DataFrame:
    primary = dims.inline_frame(composition.sparkSession, [(t,) for t in dims.PRIMARY_TYPES], ["type"])
    best = composition.groupBy("type").agg(F.max("sites_discovery").alias("sites_discovery"))
    n = F.coalesce("sites_discovery", F.lit(0)).cast("bigint")
    return primary.join(best, "type", "left").select("type", n.alias("sites_discovery"), (n >= floor).alias("passes"))


def contract_checks(corpus: DataFrame, labels: DataFrame, naive: DataFrame, mask: DataFrame, gold: DataFrame, other_species: DataFrame) -> DataFrame:
    """One violation count per rule; a clean build has only zeros."""
    key = ["accession", "position", "type"]
    split = corpus.groupBy("cluster_id").agg((F.min("partition") != F.max("partition")).alias("bad")).where("bad")
    rules = [
        ("cluster_spans_partitions", split),
        ("unknown_stratum", labels.where(~F.coalesce(F.col("stratum").isin(*dims.STRATUM_RESIDUES), F.lit(False)))),
        ("naive_stratum_not_all", naive.where("stratum <> 'ALL'")),
        ("masked_site_is_positive", labels.join(mask.select(*key).distinct(), key, "left_semi")),
        ("gold_negative_is_positive", labels.where("type = 'N-glycosylation'").join(
            gold.where("not contradicted").select("accession", "position").distinct(), ["accession", "position"], "left_semi")),
        ("type_missing", labels.where("type is null")),
        ("other_species_not_ood", other_species.where("partition is null or partition <> 'ood'")),
    ]
    out = None
    for name, rows in rules:
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def column_types(frame: DataFrame, label: str) -> DataFrame:
    """label, column, dtype, n_rows, n_cols: one row per column; the rows are counted once."""
    fields = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype")) for f in frame.schema.fields])
    return frame.agg(F.count("*").alias("n_rows")).select(F.lit(label).alias("label"), F.inline(fields), "n_rows", F.lit(len(frame.columns)).cast("bigint").alias("n_cols"))


def sample_rows(frame: DataFrame, key: list[str], k: int = 3, width: int = 60) -> DataFrame:
    """place, row: ``k`` rows that are the same in every run, by a hash of their key, each as one text of its columns' first letters."""
    order = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    chosen = bottom_k(frame.withColumn("sample_order", order), [], ["sample_order", *key], k)
    text = F.concat_ws(" | ", *[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, width) for c in frame.columns])
    return chosen.select(F.row_number().over(Window.orderBy("sample_order", *key)).cast("bigint").alias("place"), text.alias("row"))  # k rows


def required_outputs(inventory: DataFrame, required: DataFrame) -> DataFrame:
    """Required names against an inventory of (name, size): present, size."""
    return required.join(inventory, "name", "left").select(
        "name", F.col("size").isNotNull().alias("present"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key by an explicit order: a pre-aggregated minimum, not a sort of every group."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def negative_tiers(labels: DataFrame, gold: DataFrame, corpus: DataFrame, type_name: str, letters: str) -> DataFrame:
    """Counts by subtraction: clean gold rows, target letters of carrier proteins minus positives, the rest."""
    positives = labels.where(F.col("type") == type_name)
    carriers = positives.select("accession").distinct().withColumn("carrier", F.lit(True))
    n = exprs.count_letters("sequence", letters)
    sums = corpus.select("accession", n.alias("n")).join(carriers, "accession", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("carrier"), F.col("n"))), F.lit(0)).alias("carried"))
    n_pos = positives.agg(F.count("*")).scalar()
    n_gold = gold.where("not contradicted").agg(F.count("*")).scalar()
    rows = sums.select(n_gold.alias("gold"), F.greatest(F.lit(0), F.col("carried") - n_pos).alias("hard"),
                       F.greatest(F.lit(0), F.col("total") - F.col("carried")).alias("background"))
    return rows.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).cast("bigint").alias("n")) for t in ("gold", "hard", "background")])))


def length_histogram(labels: DataFrame, corpus: DataFrame, bins: int = 30) -> DataFrame:
    """Protein lengths with and without a site of the most frequent type, each over its own range."""
    top = labels.groupBy("type").agg(F.count("*").alias("n")).agg(F.min_by("type", F.struct(-F.col("n"), F.col("type")))).scalar()
    carriers = labels.where(F.col("type") == top).select("accession").distinct().withColumn("has_site", F.lit(True))
    counts = corpus.select("accession", "length").join(carriers, "accession", "left").groupBy(
        F.coalesce("has_site", F.lit(False)).alias("has_site"), "length").agg(F.count("*").alias("n"))
    edges = counts.groupBy("has_site").agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("length") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return counts.join(F.broadcast(edges), "has_site").groupBy("has_site", F.coalesce(slot, F.lit(0)).cast("bigint").alias("bin")).agg(F.sum("n").alias("n"))


def table_fingerprint(frame: DataFrame) -> DataFrame:
    """Order-insensitive content hash: count, XOR and a wrapped sum of row hashes."""
    row = F.xxhash64(*[F.col(c) for c in sorted(frame.columns)])
    return frame.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(row), F.lit(0).cast("bigint")).alias("xor_hash"),
                     F.coalesce(F.sum(F.shiftright(row, 16)), F.lit(0).cast("bigint")).alias("sum_hash"))


def sequence_fingerprint(corpus: DataFrame, digits: int = 3) -> DataFrame:
    """Digest of (id, sequence) over the discovery partitions, independent of row order. Row digests are
    folded per hash slot first, the slot being their first ``digits`` hexadecimal digits, so no task holds the digests of the whole corpus."""
    rows = corpus.where(F.col("partition").isin("discovery_train", "discovery_val")).select(
        F.sha2(F.concat_ws("\t", "accession", "sequence"), 256).alias("digest"))
    slots = rows.groupBy(F.substring("digest", 1, digits).alias("slot")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    return slots.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "digest"))), lambda e: e["digest"]), ""), 256).alias("fingerprint"))
