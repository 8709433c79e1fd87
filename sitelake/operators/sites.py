"""Cleaning of raw annotation rows: combine sources, recover isoforms, canonicalise, filter, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.session import BROADCAST_LIMIT_BYTES, cut_lineage

SITE_KEY = ["accession", "position", "type"]


def combine_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union in source order. Absent columns become NULL; ``source_rank`` and ``row_no`` keep the order."""
    out = None
    for rank, (label, frame) in enumerate(frames.items(), start=1):
        if "row_no" not in frame.columns:
            frame = frame.withColumn("row_no", F.monotonically_increasing_id())
        frame = frame.withColumn("source", F.lit(label)).withColumn("source_rank", F.lit(rank).cast("bigint"))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def strip_isoforms(sites: DataFrame, corpus: DataFrame) -> DataFrame:
    """'P1-2' becomes 'P1' only where the corpus has 'P1' but not 'P1-2'. Full names and stems share one
    base key, so both lookups are a single narrow equi-join; it also brings the sequence length."""
    base = F.coalesce(exprs.isoform_stem("accession"), F.col("accession"))
    length = F.length("sequence") if "length" not in corpus.columns else F.col("length")
    known = (
        corpus.select(base.alias("base"), F.col("accession").alias("name"), length.cast("bigint").alias("len"))
        .groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("name", "len"))).alias("known"))
    )
    full = F.try_element_at("known", F.col("accession"))
    via_stem = F.when((F.col("base") != F.col("accession")) & full.isNull(), F.try_element_at("known", F.col("base")))
    # the base is a join key, so the pattern runs once per row; nothing below evaluates it again
    return (
        sites.withColumn("base", base)
        .join(known, "base", "left")
        .withColumn("seq_length", F.coalesce(full, via_stem))
        .withColumn("from_isoform_accession", via_stem.isNotNull())
        .withColumn("accession", F.when(F.col("from_isoform_accession"), F.col("base")).otherwise(F.col("accession")))
        .drop("base", "known")
    )


CHUNK = 512


def sequence_chunks(corpus: DataFrame) -> DataFrame:
    """Fixed-size pieces of every sequence, cut on bytes so that a cut costs its own size only."""
    raw = corpus.select("accession", F.col("sequence").cast("binary").alias("raw"))
    starts = F.sequence(F.lit(0), F.expr(f"cast((length(raw) - 1) div {CHUNK} as int)"))
    return raw.where("length(raw) > 0").select("accession", F.explode(starts).alias("chunk"), "raw").select(
        "accession", F.col("chunk").cast("bigint").alias("chunk"),
        F.expr(f"substring(raw, chunk * {CHUNK} + 1, {CHUNK})").alias("piece"))


def attach_residue(sites: DataFrame, corpus: DataFrame) -> DataFrame:
    """Left join to the corpus: the letter at the position, and the length (NULL when unknown). Sites meet
    the piece that holds their position, not the whole sequence, so long sequences and accessions with
    very many sites spread over many tasks."""
    if "seq_length" not in sites.columns:
        length = F.length("sequence") if "length" not in corpus.columns else F.col("length")
        sites = sites.join(corpus.select("accession", length.cast("bigint").alias("seq_length")), "accession", "left")
    inside = (F.col("position") >= 1) & (F.col("position") <= F.col("seq_length"))
    letter = F.expr(f"cast(substring(piece, cast((position - 1) % {CHUNK} as int) + 1, 1) as string)")
    return (
        sites.withColumn("chunk", F.expr(f"(position - 1) div {CHUNK}"))
        .join(sequence_chunks(corpus).hint("merge"), ["accession", "chunk"], "left")  # the planner underrates exploded pieces
        .withColumn("residue", F.when(inside, letter))
        .drop("chunk", "piece")
    )


def canonical_types(sites: DataFrame) -> DataFrame:
    """Residue-resolved name, else known spelling, else the raw text. Adds ``raw_type`` and ``type_status``:
    'known', 'unresolved' (label needs a residue it did not get) or 'unknown' (spelling never seen)."""
    spark = sites.sparkSession
    keyed = sites.withColumnRenamed("type", "raw_type").withColumn("type_key", exprs.type_key("raw_type"))
    ambiguous = F.col("type_key").isin(*dims.TYPE_BY_RESIDUE)
    joined = keyed.join(
        F.broadcast(dims.by_residue(spark)),
        (F.col("type_key") == F.col("resolved_key")) & (F.col("residue") == F.col("resolved_residue")), "left",
    ).join(F.broadcast(dims.spellings(spark)), F.col("type_key") == F.col("spelling_key"), "left")
    canonical = F.coalesce("resolved_type", "spelled_type", "raw_type")
    known = F.col("resolved_type").isNotNull() | F.col("spelled_type").isNotNull()
    return (
        joined.withColumn("type", canonical)
        .withColumn("type_stratum", F.coalesce("resolved_stratum", "spelled_stratum"))
        .withColumn("type_letters", F.coalesce("resolved_letters", "spelled_letters"))
        .withColumn("type_status", F.when(known, "known").when(ambiguous, "unresolved").otherwise("unknown"))
        .drop("resolved_key", "resolved_residue", "resolved_type", "resolved_stratum", "resolved_letters", "spelling_key",
              "spelled_type", "spelled_stratum", "spelled_letters", "type_key")
    )


def unknown_spellings(sites: DataFrame) -> DataFrame:
    return sites.where("type_status = 'unknown'").groupBy(F.col("raw_type").alias("type")).agg(F.count("*").alias("n_rows"))


def require_known_spellings(sites: DataFrame) -> None:
    """The strict path: any spelling no table knows is an error."""
    missing = {row["type"]: row["n_rows"] for row in unknown_spellings(sites).orderBy("type").collect()}
    if missing:
        raise ValueError(f"unmapped type spellings: {missing}")


def known_spellings(sites: DataFrame) -> DataFrame:
    """The strict path without a pass of its own: the first row with an unknown spelling fails the job that reads its status.
    ``require_known_spellings`` names them all."""
    unknown = F.raise_error(F.concat(F.lit("unmapped type spelling: "), F.coalesce("raw_type", F.lit("null")))).cast("string")
    return sites.withColumn("type_status", F.when(F.col("type_status") == "unknown", unknown).otherwise(F.col("type_status")))


def evidence_flag(sites: DataFrame, evidence: str = "evidence") -> DataFrame:
    keep = exprs.evidence_kept(evidence) if evidence in sites.columns else F.lit(True)
    return sites.withColumn("evidence_ok", keep)


def stratum_of_type(type_column: str = "type") -> Column:
    """CASE over the fixed type table; NULL for types outside it."""
    out = None
    for stratum, names in dims.TYPES_BY_STRATUM.items():
        hit = F.col(type_column).isin(*names)
        out = F.when(hit, stratum) if out is None else out.when(hit, stratum)
    return out


def failure_reason() -> Column:
    """First failing check, NULL when the site is valid. Unknown types are not checked for chemistry."""
    return (
        F.when(F.col("seq_length").isNull(), "accession_not_in_corpus")
        .when(F.col("residue").isNull(), "position_out_of_range")
        .when(~F.contains("type_letters", "residue"), "residue_mismatch")
    )


def validate(sites: DataFrame) -> DataFrame:
    return sites.withColumn("reason", failure_reason())


def species_filter(sites: DataFrame, names=("human", "homo sapiens")) -> DataFrame:
    return sites.where(F.lower(F.trim("species")).isin(*names))


def reliability_filter(sites: DataFrame, floor: int = dims.RELIABILITY_FLOOR) -> DataFrame:
    """Applies only where the column exists and holds at least one value."""
    if "reliability" not in sites.columns:
        return sites
    any_value = sites.agg(F.coalesce(F.bool_or(F.col("reliability").isNotNull()), F.lit(False))).scalar()
    return sites.where(~any_value | F.coalesce(F.col("reliability") >= floor, F.lit(False)))


def ambiguous_mask(sites: DataFrame) -> DataFrame:
    return sites.select("accession", "position", F.lit("O-GlcNAcylation").alias("type"),
                        F.lit(dims.MASK_AMBIGUOUS).alias("mask_reason"))


def containment_mask(positives: DataFrame) -> DataFrame:
    """Broad-type sites not confirmed as the narrow type: masked for the narrow type, row by row."""
    confirmed = positives.where("type = 'O-GlcNAcylation'").select("accession", "position").distinct()
    broad = positives.where("type = 'O-glycosylation'").select("accession", "position")
    return broad.join(confirmed, ["accession", "position"], "left_anti").select(
        "accession", "position", F.lit("O-GlcNAcylation").alias("type"), F.lit(dims.MASK_CONTAINMENT).alias("mask_reason"))


def drop_masked(sites: DataFrame, mask: DataFrame) -> DataFrame:
    return sites.join(mask.select(*SITE_KEY).distinct(), SITE_KEY, "left_anti")


# The bit of a source's rank; a rank that has no bit of its own fails the job, since it would be counted as another source.
SOURCE_BIT = "case when source_rank between 0 and 62 then shiftleft(1L, cast(source_rank as int)) else cast(raise_error(concat('source rank out of 0..62: ', coalesce(cast(source_rank as string), 'null'))) as bigint) end"


def source_bits() -> Column:
    """One bit per source rank: distinct sources by OR, with a fixed-width aggregation buffer."""
    return F.expr(f"bit_or({SOURCE_BIT})")


def deduplicate(positives: DataFrame, aux: list[str]) -> DataFrame:
    """One row per (accession, position, type); every other column is its first non-null value in
    source order, then row order. Pre-aggregated before the only shuffle."""
    order = F.struct("source_rank", "row_no")
    first = [
        F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in aux
    ]
    return (
        positives.where("accession is not null and position is not null and type is not null")
        .groupBy(*SITE_KEY)
        .agg(F.bit_count(source_bits()).cast("bigint").alias("source_count"), F.count("*").alias("source_row_count"), *first)
    )


def pool_rare_types(sites: DataFrame, by_stratum: bool, floor: int = dims.MIN_SITES_PER_TYPE,
                    headline: int = dims.MIN_SITES_HEADLINE, within: list[str] | None = None) -> DataFrame:
    """Types under the floor pool to '<stratum>::other_PTM'. The naive variant works on stratum 'ALL'. Counts are per value of ``within``, a few at most; the
    counts, a row per type known to the tables and value, are measured and broadcast, so the sites are not shuffled by type."""
    rows = sites.withColumn("stratum", stratum_of_type() if by_stratum else F.lit("ALL"))
    keys = [*(within or []), "stratum", "type"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_type")).withColumnsRenamed({k: f"{k}_n" for k in keys})
    few = cut_lineage(counts)
    if few.count() * 256 <= BROADCAST_LIMIT_BYTES:
        few = F.broadcast(few)
    return (
        rows.join(few, F.expr(" and ".join(f"{k} <=> {k}_n" for k in keys)), "left").drop(*[f"{k}_n" for k in keys])
        .withColumn("type_pooled", F.when(F.col("n_type") < floor, F.concat("stratum", F.lit("::other_PTM"))).otherwise(F.col("type")))
        .withColumn("headline_eligible", F.col("n_type") >= headline)
        .drop("n_type")
    )


def inherit_partition(sites: DataFrame, corpus: DataFrame, strict: bool = True) -> DataFrame:
    """Left join to the corpus. Strict: a site without a protein fails the job when it runs."""
    out = sites.join(corpus.select("accession", "cluster_id", "partition"), "accession", "left")
    if strict:
        checked = F.when(F.col("partition").isNull(),
                         F.raise_error(F.concat(F.lit("site without a corpus row: "), "accession"))).otherwise(F.col("partition"))
        out = out.withColumn("partition", checked.cast("string"))
    return out


def enrich(labels: DataFrame, crosstalk: DataFrame) -> DataFrame:
    """Flag sites in the crosstalk set (``residue`` is carried from the corpus join)."""
    flags = crosstalk.select("accession", "position", F.lit(True).alias("crosstalk"))
    return labels.join(flags, ["accession", "position"], "left").withColumn("crosstalk", F.coalesce("crosstalk", F.lit(False)))


def species_flag(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """Left map of the per-protein homology flag; stays NULL where it was never computed."""
    return labels.join(flags.select("accession", "homologous_to_human"), "accession", "left")


def carriers(positives: DataFrame, type_name: str) -> DataFrame:
    return positives.where(F.col("type") == type_name).select("accession").distinct()
