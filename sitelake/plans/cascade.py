"""Label cascade: one traced frame carries every row with the verdict of each step, so step logs, survival
tables and the final labels all come from the same plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitelake.functions import dims
from sitelake.operators import agreement, reports, sites
from sitelake.session import stored

AUX = ["evidence", "reliability", "residue", "from_isoform_accession"]
KEY = sites.SITE_KEY


@dataclass
class Cascade:
    traced: DataFrame
    site_types: DataFrame  # one row per (site, type): masks, counts, crosstalk
    mask: DataFrame
    deduped: DataFrame
    masks: DataFrame
    crosstalk: DataFrame
    corpus: DataFrame

    def labels(self, by_stratum: bool = True) -> DataFrame:
        return sites.inherit_partition(sites.pool_rare_types(self.deduped, by_stratum), self.corpus)


def trace(raw: DataFrame, corpus: DataFrame, with_evidence: bool = True, strict_types: bool = True, isoforms: bool = True) -> DataFrame:
    """Every row with the verdict of each step. Strict: a spelling no table knows fails the job when it runs; loose, for other
    species, it is left out by ``valid``. ``isoforms=False`` takes accessions as they are written."""
    rows = sites.attach_residue(sites.strip_isoforms(raw, corpus) if isoforms else raw, corpus)
    rows = sites.canonical_types(rows)
    if strict_types:
        rows = sites.known_spellings(rows)
    rows = sites.evidence_flag(rows) if with_evidence else rows.withColumn("evidence_ok", F.lit(True))
    return sites.validate(rows)


def valid(traced: DataFrame) -> DataFrame:
    return traced.where("type_status = 'known' and evidence_ok and reason is null")


def exclusion_mask(traced: DataFrame, ambiguous_sources: list[str]) -> DataFrame:
    ok = valid(traced)
    ambiguous = F.col("source").isin(*ambiguous_sources)
    return sites.ambiguous_mask(ok.where(ambiguous)).unionByName(sites.containment_mask(ok.where(~ambiguous)))


def site_types(traced: DataFrame, ambiguous_sources: list[str], aux: list[str]) -> DataFrame:
    """Everything the later steps ask of a site, in two pre-aggregated groupings. First per (site, type):
    source bits, row counts and first values of the positive sources, rows of the ambiguous ones. Then per
    site, over at most one entry per type: which entries the mask removes and whether several remain."""
    ambiguous = F.col("source").isin(*ambiguous_sources)
    order = F.struct("source_rank", "row_no")
    first = [F.min(F.when(~ambiguous & F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in aux]
    per_type = valid(traced).groupBy(*KEY).agg(
        F.coalesce(F.bit_or(F.when(~ambiguous, F.expr(sites.SOURCE_BIT))), F.lit(0).cast("bigint")).alias("reporting"),
        F.count_if(~ambiguous).alias("source_row_count"), F.count_if(ambiguous).alias("ambiguous_rows"), *first)
    entries = per_type.groupBy("accession", "position").agg(
        F.collect_list(F.struct("type", "reporting", "source_row_count", "ambiguous_rows", *aux)).alias("entries"))
    narrow = "O-GlcNAcylation"
    rows = entries.select(
        "accession", "position", "entries",
        F.exists("entries", lambda e: e["ambiguous_rows"] > 0).alias("site_ambiguous"),
        F.exists("entries", lambda e: (e["type"] == narrow) & (e["source_row_count"] > 0)).alias("site_confirmed"))
    kept = F.size(F.filter("entries", lambda e: (e["source_row_count"] > 0) & ~((e["type"] == narrow) & F.col("site_ambiguous"))))
    return (
        rows.select("accession", "position", "site_ambiguous", "site_confirmed", (kept > 1).alias("crosstalk"), F.inline("entries"))
        .withColumn("masked", (F.col("type") == narrow) & F.col("site_ambiguous"))
    )


def mask_rows(site_table: DataFrame) -> DataFrame:
    """The exclusion mask with its row multiplicity: ambiguous rows, then unconfirmed broad-type rows."""
    broad = (F.col("type") == "O-glycosylation") & ~F.col("site_confirmed")
    reasons = F.array_compact(F.array(
        F.when(F.col("ambiguous_rows") > 0, F.struct(F.lit(dims.MASK_AMBIGUOUS).alias("mask_reason"), F.col("ambiguous_rows").alias("n"))),
        F.when(broad, F.struct(F.lit(dims.MASK_CONTAINMENT).alias("mask_reason"), F.col("source_row_count").alias("n")))))
    counted = site_table.select("accession", "position", F.inline(reasons)).where("n > 0")
    return counted.select("accession", "position", F.lit("O-GlcNAcylation").alias("type"), "mask_reason",
                          F.explode(F.expr("array_repeat(0, cast(n as int))")).alias("copy")).drop("copy")


def run(raw: DataFrame, corpus: DataFrame, sources: dict[int, str], ambiguous_sources: list[str], strict_types: bool = True,
        aux: list[str] | None = None, lookup: DataFrame | None = None, materialize: bool = False) -> Cascade:
    """Labels for the corpus. ``sources`` maps source rank to name; ambiguous sources feed the mask only.
    ``lookup`` may be a cheaper frame with accession and sequence. ``materialize`` writes the site table
    once to the shared folder as a compressed table, for callers that read several outputs from it."""
    aux = AUX if aux is None else aux
    traced = trace(raw, corpus if lookup is None else lookup, strict_types=strict_types)
    table = site_types(traced, ambiguous_sources, aux)
    if materialize:
        table = stored(table, "sites")
    return _of_sites(traced, table, sources, aux, corpus)


def _of_sites(traced: DataFrame, table: DataFrame, sources: dict[int, str], aux: list[str], corpus: DataFrame) -> Cascade:
    kept = table.where("source_row_count > 0 and not masked")
    deduped = kept.select(*KEY, F.bit_count("reporting").cast("bigint").alias("source_count"), "source_row_count", *aux, "crosstalk")
    masks = kept.select(*KEY, "reporting")
    return Cascade(traced, table, mask_rows(table), deduped, masks, agreement.crosstalk(masks, sources), corpus)


def replication_labels(raw: DataFrame, corpus: DataFrame, mask: DataFrame) -> DataFrame:
    """The replication set: species and reliability floor instead of the evidence filter, accessions as written, and the whole
    first row per key."""
    rows = sites.reliability_filter(sites.species_filter(raw))
    ok = valid(trace(rows, corpus, with_evidence=False, isoforms=False))
    first = reports.first_rows(ok.select(*KEY, "source_rank", "row_no", "source", "evidence", "reliability", "residue"), KEY, ["source_rank", "row_no"])
    kept = stored(sites.drop_masked(first, mask), "kept")  # read for the counts of types, the crosstalk and the labels
    out = sites.inherit_partition(sites.pool_rare_types(kept, True), corpus)
    talk = kept.groupBy("accession", "position").agg(F.count("*").alias("n_types")).where("n_types > 1")
    return sites.enrich(out, talk)


def species_labels(raw: DataFrame, corpus: DataFrame, mask: DataFrame, species: str) -> DataFrame:
    """Labels of all other species in one pass; ``raw`` names a row's species in the column ``species``. No evidence filter, no
    partition; unknown spellings are dropped, and rare types are pooled within their species."""
    rows = raw.withColumn("species", F.col(species))
    ok = valid(trace(rows, corpus, with_evidence=False, strict_types=False))
    kept = sites.drop_masked(ok, mask)
    deduped = stored(sites.deduplicate(kept, [*AUX, "species"]), "species")
    talk = agreement.crosstalk(deduped.select(*KEY, F.lit(0).cast("bigint").alias("reporting")))
    pooled = sites.enrich(sites.pool_rare_types(deduped, True, within=["species"]), talk)
    return pooled.withColumn("partition", F.lit("ood"))


def step_log(traced: DataFrame) -> DataFrame:
    """Rows into and out of each step per source, in one pass."""
    resolved = F.col("type_status") == "known"
    steps = [
        ("step0_canonicalize", F.lit(True), F.col("type_status") != "unresolved"),
        ("step1", resolved, resolved & F.col("evidence_ok")),
        ("step2", resolved & F.col("evidence_ok"), resolved & F.col("evidence_ok") & F.col("reason").isNull()),
    ]
    counts = [F.struct(F.lit(name).alias("step"), F.count_if(before).alias("n_in"), F.count_if(after).alias("n_out")).alias(name)
              for name, before, after in steps]
    wide = traced.groupBy("source").agg(*counts, F.count_if("from_isoform_accession").alias("n_isoform_recovered"))
    return wide.select("source", "n_isoform_recovered", F.inline(F.array(*[F.col(n) for n, _, _ in steps]))).withColumn(
        "n_dropped", F.col("n_in") - F.col("n_out"))


LOG = "step string, source string, counter string, n bigint"


def logged_run(raw: DataFrame, corpus: DataFrame, sources: dict[int, str], ambiguous_sources: list[str], gold: DataFrame,
               replication: DataFrame, lookup: DataFrame | None = None) -> tuple[Cascade, DataFrame]:
    """The labels and the log of all twelve steps: (step, source, counter, n). Counters are observed inside the jobs that write the site
    table, the gold negatives and the replication set, so the log costs no pass of its own. Spark adds observed counts up per task; a stage that runs again
    after a lost executor may count its tasks again, while the tables are right in any case."""
    rows_seen, sites_seen, gold_seen, copies_in, copies_out = (Observation(n) for n in ("rows", "sites", "gold", "replication-in", "replication-out"))
    names = sorted({*sources.values(), *ambiguous_sources})
    traced = trace(raw, corpus if lookup is None else lookup)
    known = F.col("type_status") == "known"
    stages = {"recovered": F.col("from_isoform_accession"), "all": F.lit(True), "resolved": F.col("type_status") != "unresolved", "known": known,
              "evidence": known & F.col("evidence_ok"), "valid": known & F.col("evidence_ok") & F.col("reason").isNull()}
    watched = traced.observe(rows_seen, *[F.count_if((F.col("source") == s) & condition).alias(f"{s}:{name}") for s in names for name, condition in stages.items()])
    table = site_types(watched, ambiguous_sources, AUX)
    kept = (F.col("source_row_count") > 0) & ~F.col("masked")
    uncertain = (F.col("type") == "O-glycosylation") & ~F.col("site_confirmed")
    types = sorted({t for t, _ in dims.type_rows()})
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("source_row_count"))), F.lit(0))
    table = stored(table.observe(
        sites_seen, F.count_if((F.col("type") == "O-GlcNAcylation") & (F.col("source_row_count") > 0)).alias("confirmed"), total(uncertain).alias("uncertain"),
        total(kept).alias("dedup_in"), F.count_if(kept).alias("dedup_out"), *[F.count_if(kept & (F.col("type") == t)).alias(f"type:{t}") for t in types]), "sites")
    cascade = _of_sites(traced, table, sources, AUX, corpus)
    stored(agreement.gold_negatives(gold, cascade.deduped).observe(gold_seen, F.count("*").alias("n"), F.count_if("contradicted").alias("contradicted")), "gold")
    incoming = replication.observe(copies_in, F.count("*").alias("n"))
    stored(replication_labels(incoming, corpus, cascade.mask).observe(copies_out, F.count("*").alias("n")), "replication")
    seen, at = rows_seen.get, sites_seen.get
    log = []
    for s in names:
        n = {name: seen[f"{s}:{name}"] for name in stages}
        if n["recovered"]:
            log.append(("step0_isoform_recovery", s, "n_recovered", n["recovered"]))
        for step, before, after in (("step0_canonicalize", "all", "resolved"), ("step1", "known", "evidence"), ("step2", "evidence", "valid")):
            log += [(step, s, "n_in", n[before]), (step, s, "n_dropped", n[before] - n[after]), (step, s, "n_out", n[after])]
    present = [n for n in (at[f"type:{t}"] for t in types) if n]
    pooled = sum(n < dims.MIN_SITES_PER_TYPE for n in present)
    log += [("step3c_oglcnac_containment", "", "n_confirmed_sites", at["confirmed"]), ("step3c_oglcnac_containment", "", "n_masked", at["uncertain"]),
            ("step4", "dedup", "n_in", at["dedup_in"]), ("step4", "dedup", "n_out", at["dedup_out"]), ("step4", "site_agreement", "n_sites", at["dedup_out"])]
    log += [("step5", kind, counter, n) for kind in ("stratified", "naive") for counter, n in (("n_types_before_pooling", len(present)), ("n_types_pooled_to_other", pooled))]
    log += [("step6", "split_inherited", "n_rows", at["dedup_out"])]
    log += [("gold_negatives", "contradiction_filter", c, n) for c, n in (
        ("n_gold_before", gold_seen.get["n"]), ("n_contradicted", gold_seen.get["contradicted"]), ("n_gold_clean", gold_seen.get["n"] - gold_seen.get["contradicted"]))]
    log += [("step_qptm", "build", "n_in", copies_in.get["n"]), ("step_qptm", "build", "n_out", copies_out.get["n"])]
    return cascade, raw.sparkSession.createDataFrame(log, LOG)  # a few rows per step and source


def type_survival(cascade: Cascade, ambiguous_sources: list[str]) -> DataFrame:
    """Count per type at each stage, first-to-last survival, floors and the pooled class."""
    from sitelake.functions import exprs

    stages = cascade.traced.where(~F.col("source").isin(*ambiguous_sources)).where("type_status <> 'unresolved'")
    early = stages.groupBy("type").agg(
        F.count("*").alias("raw_canonicalized"), F.count_if("evidence_ok").alias("after_evidence"),
        F.count_if(F.col("evidence_ok") & F.col("reason").isNull()).alias("after_chemistry"))
    late = cascade.deduped.groupBy("type").agg(
        F.sum("source_row_count").alias("after_ambiguity_mask"), F.count("*").alias("after_dedup"))
    both = early.join(late, "type", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    stratum = F.coalesce(sites.stratum_of_type(), F.lit("UNMAPPED"))
    last = n("after_dedup")
    return both.select(
        "type", stratum.alias("stratum"), "raw_canonicalized", "after_evidence", "after_chemistry",
        n("after_ambiguity_mask").alias("after_ambiguity_mask"), last.alias("after_dedup"),
        exprs.rounded(100.0 * last / F.col("raw_canonicalized"), 1).alias("pct_surviving"),
        (last >= dims.MIN_SITES_PER_TYPE).alias("meets_floor"), (last >= dims.MIN_SITES_HEADLINE).alias("meets_headline"),
        F.when((last > 0) & (last < dims.MIN_SITES_PER_TYPE), F.concat(stratum, F.lit("::other_PTM"))).otherwise("").alias("pooled_into"))


def composition(labels: DataFrame, stratum_sizes: DataFrame) -> DataFrame:
    """Per (stratum, type): positives, sides, rate, share of sites carrying several types, floors."""
    from sitelake.functions import exprs

    held = F.col("partition") == "held_out"
    out = labels.groupBy("stratum", "type").agg(
        F.count("*").alias("positive_sites"), F.count_if(~held).alias("sites_discovery"), F.count_if(held).alias("sites_holdout"),
        exprs.rounded(F.avg(F.col("crosstalk").cast("int")), 4).alias("crosstalk_fraction"))
    out = out.join(stratum_sizes.select("stratum", F.col("n_residues").alias("stratum_size")), "stratum", "left")
    return out.select(
        "*", F.when(F.col("stratum_size") > 0, exprs.rounded(F.col("positive_sites") / F.col("stratum_size"))).alias("positive_rate"),
        (F.col("positive_sites") >= dims.MIN_SITES_PER_TYPE).alias("meets_floor"),
        (F.col("positive_sites") >= dims.MIN_SITES_HEADLINE).alias("meets_headline"),
        ((F.col("sites_discovery") >= dims.MIN_SITES_PER_TYPE) & (F.col("sites_holdout") >= dims.MIN_SITES_PER_TYPE)).alias("both_sides_eligible"))


def stratum_sizes(corpus: DataFrame) -> DataFrame:
    """Exact letter counts per stratum by string length differences: one pass, no exploded rows."""
    from sitelake.functions import exprs

    sums = [F.sum(exprs.count_letters("sequence", letters)).alias(name) for name, letters in dims.STRATUM_RESIDUES.items()]
    wide = corpus.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).alias("n_residues")) for s in dims.STRATUM_RESIDUES])
    return wide.select(F.inline(pairs))
