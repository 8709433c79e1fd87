"""Catalogue: profiles, report tables and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators import agreement, reports, sites
from sitelake.plans import cascade
from sitelake.plans import inputs as I
from sitelake.plans.oracle import define, r
from sitelake.plans.registry import query
from sitelake.plans.site_queries import AMBIGUOUS, SOURCES, full, labels, traced

FLAGS = "case when quality = 1 then true when quality = 0 then false end"


@query("b9_numeric_summary", f"""select source, count(v) as n, count(*) filter (where t is not null and v is null) as n_coerced, {r('avg(v)')} as mean,
    {r('stddev_samp(v)')} as std, min(v) as min, {r('quantile_cont(v, 0.25)')} as p25, {r('quantile_cont(v, 0.5)')} as p50, {r('quantile_cont(v, 0.75)')} as p75,
    max(v) as max from (select *, try_cast(t as double) as v from (select source, case when reliability = 0 then '-' else reliability::varchar end as t from o_raw)) group by source""")
def b9(spark, sf):
    text = F.when(F.col("reliability") == 0, "-").otherwise(F.col("reliability").cast("string"))
    return reports.numeric_summary(I.raw_sites(spark, sf).select("source", text.alias("t")), "t", ["source"])


def species_rows(spark, sf):
    """Labels of the other languages, with the per-document flag where one exists."""
    rows = cascade.valid(cascade.trace(I.raw_sites(spark, sf).where("lang <> 'en'"), I.sequences(spark, sf), with_evidence=False, strict_types=False))
    deduped = rows.groupBy("pid", "accession", "position", "type", F.col("lang").alias("species")).agg(F.count("*").alias("rows"))
    flags = I.table(spark, sf, "labels").select(F.concat(F.lit("P"), "doc_id").alias("accession"), F.expr(FLAGS).alias("homologous_to_human"))
    return sites.species_flag(deduped, flags)


define("o_sp", f"""select d.*, f.flag as homologous_to_human from (select distinct accession, position, type, lang as species from o_traced
    where lang <> 'en' and type_status = 'known' and reason is null) d left join (select 'P' || doc_id as accession, {FLAGS} as flag from labels) f
    on d.accession = f.accession""")


@query("c14_species_flag", "select species, homologous_to_human, count(*) as n from o_sp group by all")
def c14(spark, sf):
    return species_rows(spark, sf).groupBy("species", "homologous_to_human").agg(F.count("*").alias("n"))


define("o_grid", """with c as (select species, type, count(*) as n, count(*) filter (where not coalesce(homologous_to_human, false)) as ns from o_sp group by all),
    h as (select type, count(*) as nh from o_labels group by type),
    g as (select * from (select distinct species from c) cross join (select type from h union select type from c))
    select g.species, g.type, coalesce(t.stratum, 'UNMAPPED') as stratum, coalesce(c.n, 0) as n_sites_species, coalesce(h.nh, 0) as n_sites_human,
      coalesce(c.n, 0) >= 200 as testable, case when coalesce(c.n, 0) >= 200 then 'ok' when coalesce(c.n, 0) = 0 then 'absent_in_species' else 'below_min_sites' end as reason,
      coalesce(c.ns, 0) as n_sites_species_strict, coalesce(c.ns, 0) >= 200 as testable_strict
    from g left join c on g.species = c.species and g.type = c.type left join h on g.type = h.type left join o_types t on g.type = t.type""")


@query("c17_species_grid", "select * from o_grid")
def c17(spark, sf):
    return reports.species_grid(species_rows(spark, sf), full(spark, sf).deduped)


@query("d31_strict_retention", f"""select species, count(*) as n_sites, count(*) filter (where not coalesce(homologous_to_human, false)) as n_strict,
    {r('100e0 * count(*) filter (where not coalesce(homologous_to_human, false)) / count(*)', 2)} as pct_kept from o_sp group by species""")
def d31(spark, sf):
    return reports.strict_retention(species_rows(spark, sf))


@query("d31_testable_in_both_views", "select species, count(*) filter (where testable) as n_testable, count(*) filter (where testable and testable_strict) as n_both from o_grid group by species")
def d31_both(spark, sf):
    grid = c17(spark, sf)
    return grid.groupBy("species").agg(F.count_if("testable").alias("n_testable"), F.count_if(F.col("testable") & F.col("testable_strict")).alias("n_both"))


@query("d7_cluster_sizes", f"""with s as (select cluster_id, count(*) as size from o_prot group by cluster_id)
    select 'n_proteins' as metric, sum(size)::double as value from s union all select 'n_clusters', count(*)::double from s
    union all select 'mean_size', {r('sum(size)::double / count(*)', 3)} from s union all select 'median_size', floor(median(size))::double from s
    union all select 'max_size', max(size)::double from s union all select 'n_singletons', (count(*) filter (where size = 1))::double from s
    union all select 'pct_in_singletons', {r('100e0 * count(*) filter (where size = 1) / sum(size)', 2)} from s
    union all select * from (select 'size:' || size, count(*)::double from s group by size order by size limit 15)
    union all select * from (select 'largest:' || cluster_id, size::double from s order by size desc, cluster_id limit 10)""")
def d7(spark, sf):
    return reports.cluster_sizes(I.proteins(spark, sf))


@query("d12_corpus_fingerprint", r"""with d as (select sha256(accession || chr(9) || sequence) as digest from o_prot where partition in ('discovery_train', 'discovery_val')),
    s as (select substr(digest, 1, 3) as slot, sha256(string_agg(digest, '' order by digest)) as digest from d group by 1)
    select sha256(string_agg(digest, '' order by slot)) as fingerprint from s""")
def d12(spark, sf):
    return reports.sequence_fingerprint(I.proteins(spark, sf))


@query("d13_table_fingerprint")
def d13(spark, sf):
    return reports.table_fingerprint(I.raw_sites(spark, sf))


@query("d13_fingerprint_order", "select count(*) as n_rows, true as same_reordered, false as same_changed from o_raw")
def d13_order(spark, sf):
    """The fingerprint does not depend on the order of rows, but on every value."""
    raw = I.raw_sites(spark, sf)
    mark = F.struct("n_rows", "xor_hash", "sum_hash")
    same = lambda frame: mark.eqNullSafe(reports.table_fingerprint(frame).select(mark).scalar())
    return reports.table_fingerprint(raw).select("n_rows", same(raw.repartition(7, "row_no")).alias("same_reordered"), same(raw.withColumn("row_no", F.col("row_no") + 1)).alias("same_changed"))


PROFILED = ["source", "type", "evidence", "reliability", "species", "position"]


DESCRIBED = {"documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id", "turn"]}


def _described(name: str) -> str:
    kind = "case column_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' else lower(column_type) end"
    return f"""select '{name}' as label, column_name as "column", {kind} as dtype, (select count(*) from {name}) as n_rows, count(*) over () as n_cols from (describe {name})"""


@query("d14_column_types", " union all ".join(map(_described, DESCRIBED)))
def d14_types(spark, sf):
    return functools.reduce(lambda a, b: a.unionByName(b), [reports.column_types(I.table(spark, sf, name), name) for name in DESCRIBED])


@query("d14_sample_rows", """select 'documents' as label, row_number() over (order by o, doc_id) as place, row from (select doc_id, md5(cast(doc_id as varchar)) as o,
      concat_ws(' | ', substr(cast(doc_id as varchar), 1, 60), substr(text, 1, 60), coalesce(lang, ''), substr(coalesce(source, ''), 1, 60), cast(n_chars as varchar)) as row from documents order by o, doc_id limit 3)
    union all select 'pages', row_number() over (order by o, page_id), row from (select page_id, md5(cast(page_id as varchar)) as o,
      concat_ws(' | ', cast(page_id as varchar), substr(coalesce(url, ''), 1, 60), substr(coalesce(html, ''), 1, 60)) as row from pages order by o, page_id limit 3)""")
def d14_samples(spark, sf):
    rows = [reports.sample_rows(I.table(spark, sf, name), DESCRIBED[name]).select(F.lit(name).alias("label"), "place", "row") for name in ("documents", "pages")]
    return rows[0].unionByName(rows[1])


@query("d14_profile", " union all ".join(
    f"""select '{c}' as "column", count(*) as n_rows, count(*) filter (where "{c}" is null) as n_null,
    {r(f'100e0 * count(*) filter (where "{c}" is null) / count(*)', 2)} as pct_null, count(distinct "{c}") as n_unique,
    case when count(distinct "{c}") <= 15 then coalesce(string_agg(distinct "{c}"::varchar, '|' order by "{c}"::varchar), '') else '' end as unique_values from o_raw"""
    for c in PROFILED))
def d14(spark, sf):
    return reports.profile(I.raw_sites(spark, sf).select(*PROFILED))


@query("d15_value_counts", f"select evidence, count(*) as n, {r('100e0 * count(*) / (select count(*) from o_raw)', 2)} as pct from o_raw group by evidence order by n desc, evidence nulls first limit 30")
def d15(spark, sf):
    return reports.value_counts(I.raw_sites(spark, sf), "evidence")


define("o_rawres", """select r.source, r.accession, r.position, r.type, p.length as seq_length,
    case when r.position between 1 and p.length then substr(p.sequence, r.position, 1) end as residue,
    coalesce(t.stratum, 'UNMAPPED') as config_stratum, t.stratum is not null as mapped,
    coalesce(exists (select 1 from o_strata s where s.stratum = t.stratum and s.residue = case when r.position between 1 and p.length then substr(p.sequence, r.position, 1) end), false) as ok
    from o_raw r left join o_prot p on r.accession = p.accession
    left join o_spell k on replace(replace(replace(lower(trim(r.type)), '_', '-'), '  ', ' '), ' ', '-') = k.spelling_key left join o_types t on k.spelled_type = t.type""")


@query("d16_type_coverage", f"""select source, type, config_stratum as stratum, count(*) as n_sites, count(distinct accession) as n_accessions,
    count(distinct accession) filter (where seq_length is not null) as n_accessions_in_corpus,
    {r('100e0 * count(distinct accession) filter (where seq_length is not null) / count(distinct accession)', 1)} as pct_accessions_in_corpus,
    {r('100e0 * (count(*) filter (where seq_length is not null and mapped and ok))::double / nullif(count(*) filter (where seq_length is not null and mapped), 0)', 1)} as chemistry_match_rate
    from o_rawres group by all""")
def d16(spark, sf):
    return reports.type_coverage(sites.attach_residue(I.raw_sites(spark, sf), I.sequences(spark, sf)))


@query("d17_chemistry_failures", f"""with b as (select * from o_rawres where seq_length is not null),
    s as (select type, config_stratum, count(*) as n_sites, count(*) filter (where ok) as n_ok, count(*) filter (where residue is null) as n_out from b group by all),
    m as (select type, string_agg(residue || ':' || n, ',' order by n desc, residue) filter (where rn <= 5) as top_mismatch from (select type, residue, count(*) as n,
      row_number() over (partition by type order by count(*) desc, residue) as rn from b where residue is not null and not ok group by type, residue) group by type),
    c as (select b.type, st.stratum, min(st.stratum_order) as o, count(*) as n from b join o_strata st on b.residue = st.residue group by b.type, st.stratum),
    g as (select type, arg_max(stratum, n * 100 - o) as suggested, max(n) as n_best from c group by type),
    t as (select type, count(residue) as n_res from b group by type)
    select s.type, config_stratum, n_sites, {r('100e0 * n_ok / n_sites', 1)} as pct_ok, {r('100e0 * n_out / n_sites', 1)} as pct_out_of_range,
      {r('100e0 * (n_sites - n_ok - n_out) / n_sites', 1)} as pct_mismatch, coalesce(top_mismatch, '') as top_mismatch, coalesce(suggested, 'n/a') as suggested,
      {r('100e0 * coalesce(n_best, 0) / n_res', 1)} as suggested_pct,
      coalesce(coalesce(suggested, 'n/a') <> config_stratum and {r('100e0 * coalesce(n_best, 0) / n_res', 1)} > 60, false) as mapping_looks_wrong
    from s left join m on s.type = m.type left join g on s.type = g.type left join t on s.type = t.type""")
def d17(spark, sf):
    return reports.chemistry_failures(sites.attach_residue(I.raw_sites(spark, sf), I.sequences(spark, sf)))


@query("d18_isoform_audit", f"""with n as (select distinct source, accession from o_raw), f as (select source, accession, accession in (select accession from o_prot) as matched,
      regexp_extract(accession, '^(.*)-[0-9]+$', 1) <> '' as suffixed, regexp_extract(accession, '^(.*)-[^-]*$', 1) in (select accession from o_prot) as stem_ok from n)
    select source, count(*) as n_accessions, count(*) filter (where not matched) as n_unmatched, count(*) filter (where suffixed) as n_with_suffix,
      count(*) filter (where not matched and stem_ok) as n_recoverable,
      coalesce({r('100e0 * count(*) filter (where not matched and stem_ok) / nullif(count(*) filter (where not matched), 0)', 1)}, 0) as pct_recoverable from f group by source""")
def d18(spark, sf):
    return reports.isoform_audit(I.raw_sites(spark, sf), I.sequences(spark, sf))


@query("d19_suffix_audit", f"""with e as (select type, case lang when 'en' then 'HUMAN' else upper(lang) end as suffix, count(*) as n from o_raw group by all),
    o as (select type, string_agg(suffix || ':' || n, ',' order by n desc, suffix) as top_other from (select *, row_number() over (partition by type order by n desc, suffix) as rn
      from e where suffix <> 'HUMAN') where rn <= 3 group by type)
    select e.type, sum(n)::bigint as n_rows, coalesce(sum(n) filter (where suffix = 'HUMAN'), 0)::bigint as n_human,
      {r("100e0 * coalesce(sum(n) filter (where suffix = 'HUMAN'), 0) / sum(n)", 1)} as pct_human, coalesce(any_value(top_other), '') as top_other
    from e left join o on e.type = o.type group by e.type""")
def d19(spark, sf):
    suffix = F.when(F.col("lang") == "en", "HUMAN").otherwise(F.upper("lang"))
    return reports.suffix_audit(I.raw_sites(spark, sf).select("type", F.concat_ws("_", "accession", suffix).alias("entry_name")))


STEP_SQL = """select source, step, n_isoform_recovered, n_in, n_out, n_in - n_out as n_dropped from (
    select source, 'step0_canonicalize' as step, count(*) as n_in, count(*) filter (where type_status <> 'unresolved') as n_out, count(*) filter (where from_isoform_accession) as n_isoform_recovered from o_traced group by source
    union all select source, 'step1', count(*) filter (where type_status = 'known'), count(*) filter (where type_status = 'known' and evidence_ok), count(*) filter (where from_isoform_accession) from o_traced group by source
    union all select source, 'step2', count(*) filter (where type_status = 'known' and evidence_ok), count(*) filter (where type_status = 'known' and evidence_ok and reason is null), count(*) filter (where from_isoform_accession) from o_traced group by source)"""


@query("d20_step_log", STEP_SQL)
def d20(spark, sf):
    return cascade.step_log(traced(spark, sf))


FULL_LOG = """with k as (select source, count(*) filter (where from_isoform_accession) as rec, count(*) as a, count(*) filter (where type_status <> 'unresolved') as b, count(*) filter (where type_status = 'known') as c,
      count(*) filter (where type_status = 'known' and evidence_ok) as d, count(*) filter (where type_status = 'known' and evidence_ok and reason is null) as e from o_traced group by source),
    ty as (select count(*) as n from o_dedup group by type), g as (select count(*) as n, count(*) filter (where contradicted) as c from o_goldneg)
    select 'step0_isoform_recovery' as step, source, 'n_recovered' as counter, rec as n from k where rec > 0
    union all select 'step0_canonicalize', source, unnest(['n_in', 'n_dropped', 'n_out']), unnest([a, a - b, b]) from k
    union all select 'step1', source, unnest(['n_in', 'n_dropped', 'n_out']), unnest([c, c - d, d]) from k
    union all select 'step2', source, unnest(['n_in', 'n_dropped', 'n_out']), unnest([d, d - e, e]) from k
    union all select 'step3c_oglcnac_containment', '', 'n_confirmed_sites', count(*) from (select distinct accession, position from o_cand where type = 'O-GlcNAcylation')
    union all select 'step3c_oglcnac_containment', '', 'n_masked', count(*) from o_mask where mask_reason = '""" + dims.MASK_CONTAINMENT + """'
    union all select 'step4', 'dedup', 'n_in', count(*) from o_pos union all select 'step4', 'dedup', 'n_out', count(*) from o_dedup
    union all select 'step4', 'site_agreement', 'n_sites', count(*) from o_agree
    union all select 'step5', kind, 'n_types_before_pooling', (select count(*) from ty) from (values ('stratified'), ('naive')) v(kind)
    union all select 'step5', kind, 'n_types_pooled_to_other', (select count(*) from ty where n < 200) from (values ('stratified'), ('naive')) v(kind)
    union all select 'step6', 'split_inherited', 'n_rows', count(*) from o_labels
    union all select 'gold_negatives', 'contradiction_filter', unnest(['n_gold_before', 'n_contradicted', 'n_gold_clean']), unnest([n, c, n - c]) from g
    union all select 'step_qptm', 'build', 'n_in', count(*) from o_raw union all select 'step_qptm', 'build', 'n_out', count(*) from o_repl"""


@query("d20_full_step_log", FULL_LOG)
def d20_full(spark, sf):
    raw = I.raw_sites(spark, sf)
    return cascade.logged_run(raw, I.corpus(spark, sf), SOURCES, AMBIGUOUS, I.gold_rows(spark, sf), raw, lookup=I.sequences(spark, sf))[1]


@query("d26_waterfall", f"select source, step, n_in, n_out from ({STEP_SQL}) where step in ('step1', 'step2')")
def d26_waterfall(spark, sf):
    return cascade.step_log(traced(spark, sf)).where("step in ('step1', 'step2')").select("source", "step", "n_in", "n_out")


def typed_hits(spark, sf):
    hits = traced(spark, sf).where("type_status = 'known' and seq_length is not null").groupBy("accession", "type").agg(F.count("*").alias("n"))
    return sites.inherit_partition(hits, I.corpus(spark, sf))


define("o_t3", f"""select t.type, t.type_stratum as stratum, count(*) as sites_total, count(*) filter (where p.partition <> 'held_out') as sites_discovery,
    count(*) filter (where p.partition = 'held_out') as sites_holdout, {r("(count(*) filter (where p.partition = 'held_out'))::double / count(*)", 4)} as achieved_fraction,
    {r("abs((count(*) filter (where p.partition = 'held_out'))::double / count(*) - 0.2e0)", 4)} as abs_deviation,
    t.type in ('N-glycosylation', 'O-GlcNAcylation', 'succinylation') as is_primary,
    count(*) filter (where p.partition <> 'held_out') >= 200 and count(*) filter (where p.partition = 'held_out') >= 200 as both_sides_eligible
    from o_traced t join o_prot p on t.accession = p.accession where type_status = 'known' group by t.type, t.type_stratum""")


@query("d22_split_composition", "select * from o_t3")
def d22(spark, sf):
    return reports.split_composition(typed_hits(spark, sf))


define("o_t4", f"""with e as (select type, count(*) as a, count(*) filter (where evidence_ok) as b, count(*) filter (where evidence_ok and reason is null) as c
      from o_traced where source <> 's3' and type_status <> 'unresolved' group by type),
    m as (select type, count(*) as n from o_pos group by type), d as (select type, count(*) as n from o_dedup group by type)
    select e.type, coalesce(t.stratum, 'UNMAPPED') as stratum, e.a as raw_canonicalized, e.b as after_evidence, e.c as after_chemistry, coalesce(m.n, 0) as after_ambiguity_mask,
      coalesce(d.n, 0) as after_dedup, {r('100e0 * coalesce(d.n, 0) / e.a', 1)} as pct_surviving, coalesce(d.n, 0) >= 200 as meets_floor, coalesce(d.n, 0) >= 1000 as meets_headline,
      case when d.n < 200 then t.stratum || '::other_PTM' else '' end as pooled_into
    from e left join m on e.type = m.type left join d on e.type = d.type left join o_types t on e.type = t.type""")


@query("d23_type_survival", "select * from o_t4")
def d23(spark, sf):
    return cascade.type_survival(full(spark, sf), AMBIGUOUS)


@query("d30_heavy_loss", "select type, pct_surviving from o_t4 where pct_surviving < 70")
def d30_loss(spark, sf):
    return cascade.type_survival(full(spark, sf), AMBIGUOUS).where("pct_surviving < 70").select("type", "pct_surviving")


define("o_disc", f"""select accession, position, type, 'containment_uncatalogued_oglcnac' as discrepancy_class, 'dbPTM O-linked Glycosylation' as evidence_for,
      'absent from O-GlcNAcAtlas' as evidence_against, 'does an O-GlcNAc latent fire here?' as question_for_latent from o_mask where mask_reason = '{dims.MASK_CONTAINMENT}'
    union all select accession, position, type, 'gold_negative_contradicted', 'annotated positive in dbPTM / N-GlycositeAtlas', 'N-GlyDE verified non-glycosylated',
      'does an N-glyco latent fire here?' from o_goldneg where contradicted
    union all select accession, position, type, 'single_source_despite_coverage', sources_reporting, sources_disagreeing, 'missed by the other source, or spurious?'
      from o_agree where n_sources_disagreeing > 0""")


def discrepancy_rows(spark, sf):
    c = full(spark, sf, materialize=True)
    gold = agreement.gold_negatives(I.gold_rows(spark, sf), c.deduped)
    return reports.discrepancies(c.mask, gold, agreement.site_agreement(c.masks, SOURCES))


@query("d24_discrepancies", "select * from o_disc")
def d24(spark, sf):
    return discrepancy_rows(spark, sf)


@query("d30_discrepancy_classes", "select discrepancy_class, count(*) as n_sites from o_disc group by all")
def d30_classes(spark, sf):
    return discrepancy_rows(spark, sf).groupBy("discrepancy_class").agg(F.count("*").alias("n_sites"))


@query("d25_source_overview", "select source, count(*) as n_rows, count(distinct accession) as n_accessions, count(distinct type) as n_types from o_raw group by source")
def d25(spark, sf):
    return reports.source_overview(I.raw_sites(spark, sf))


@query("d26_type_panel", f"select type, count(*) as n, {r('avg(crosstalk::int)')} as crosstalk_fraction from o_labels group by type")
def d26_types(spark, sf):
    return full(spark, sf).deduped.groupBy("type").agg(F.count("*").alias("n"), exprs.rounded(F.avg(F.col("crosstalk").cast("int"))).alias("crosstalk_fraction"))


@query("d26_negative_tiers", """with p as (select * from o_dedup where type = 'N-glycosylation'), c as (select sum(length(sequence) - length(replace(sequence, 'N', '')))::bigint as total,
      (sum(length(sequence) - length(replace(sequence, 'N', ''))) filter (where accession in (select accession from p)))::bigint as carried from o_prot)
    select 'gold' as tier, (select count(*) from o_goldneg where not contradicted) as n union all select 'hard', greatest(0, carried - (select count(*) from p)) from c
    union all select 'background', greatest(0, total - carried) from c""")
def d26_tiers(spark, sf):
    c = full(spark, sf, materialize=True)
    gold = agreement.gold_negatives(I.gold_rows(spark, sf), c.deduped)
    return reports.negative_tiers(c.deduped, gold, I.sequences(spark, sf), "N-glycosylation", "N")


@query("d26_length_histogram", """with top as (select type from o_dedup group by type order by count(*) desc, type limit 1),
    l as (select p.accession in (select accession from o_dedup where type = (select type from top)) as has_site, length from o_prot p),
    e as (select has_site, min(length) as lo, max(length) as hi from l group by has_site)
    select l.has_site, coalesce(case when hi > lo then least(floor((length - lo) * 30 / (hi - lo)), 29) end, 0)::bigint as bin, count(*) as n
    from l join e on l.has_site = e.has_site group by all""")
def d26_lengths(spark, sf):
    return reports.length_histogram(full(spark, sf, materialize=True).deduped, I.sequences(spark, sf))


@query("d28_partition_counts", """select partition, count(*) as n_proteins, sum(length)::bigint as n_residues from o_prot group by partition
    union all select 'published', count(*), sum(length)::bigint from o_prot where partition in ('discovery_train', 'discovery_val')""")
def d28(spark, sf):
    rows = I.sequences(spark, sf).withColumn("partition", I.partition_of(F.col("pid")))
    per = rows.groupBy("partition").agg(F.count("*").alias("n_proteins"), F.sum("length").alias("n_residues"))
    published = per.where(F.col("partition").isin("discovery_train", "discovery_val")).agg(
        F.sum("n_proteins").alias("n_proteins"), F.sum("n_residues").alias("n_residues")).withColumn("partition", F.lit("published"))
    return per.unionByName(published)


@query("d30_crosstalk_top", "select type_combination, count(*) as n_sites from o_talk group by all order by n_sites desc, type_combination limit 25")
def d30_top(spark, sf):
    counts = full(spark, sf).crosstalk.groupBy("type_combination").agg(F.count("*").alias("n_sites"))
    return counts.orderBy(F.desc("n_sites"), "type_combination").limit(25)


@query("d30_crosstalk_classes", "select evidence_class, n_types, count(*) as n_sites from o_talk group by all")
def d30_talk(spark, sf):
    return full(spark, sf).crosstalk.groupBy("evidence_class", "n_types").agg(F.count("*").alias("n_sites"))


@query("d30_agreement_by_type", f"""select type, n_sources_reporting, count(*) as n_sites, {r('avg(n_sources_disagreeing)')} as mean_disagreeing, max(n_sources_disagreeing) as max_disagreeing
    from o_agree group by all""")
def d30_agree(spark, sf):
    rows = agreement.site_agreement(full(spark, sf).masks, SOURCES)
    return rows.groupBy("type", "n_sources_reporting").agg(
        F.count("*").alias("n_sites"), exprs.rounded(F.avg("n_sources_disagreeing")).alias("mean_disagreeing"), F.max("n_sources_disagreeing").alias("max_disagreeing"))


@query("d30_split_deviation", "select type, abs_deviation from o_t3 where abs_deviation > 0.1")
def d30_dev(spark, sf):
    return reports.split_composition(typed_hits(spark, sf)).where("abs_deviation > 0.1").select("type", "abs_deviation")


@query("d32_headline_gate", """select p.type, coalesce(max(sites_discovery), 0) as sites_discovery, coalesce(max(sites_discovery), 0) >= 1000 as passes
    from (values ('N-glycosylation'), ('O-GlcNAcylation'), ('succinylation')) p(type) left join o_t2 on o_t2.type = p.type group by p.type""")
def d32(spark, sf):
    return reports.headline_gate(cascade.composition(labels(spark, sf), cascade.stratum_sizes(I.sequences(spark, sf))))


@query("d33_contract_checks", """select 'cluster_spans_partitions' as rule, count(*) as violations from (select cluster_id from o_prot group by cluster_id having count(distinct partition) > 1)
    union all select 'unknown_stratum', count(*) from o_labels where stratum not in (select stratum from o_strata) or stratum is null
    union all select 'naive_stratum_not_all', 0
    union all select 'masked_site_is_positive', count(*) from o_labels l where exists (select 1 from o_mask m where m.accession = l.accession and m.position = l.position and m.type = l.type)
    union all select 'gold_negative_is_positive', count(*) from o_labels l where type = 'N-glycosylation' and exists (select 1 from o_goldneg g where not contradicted and g.accession = l.accession and g.position = l.position)
    union all select 'type_missing', count(*) from o_labels where type is null union all select 'other_species_not_ood', 0""")
def d33(spark, sf):
    c = full(spark, sf, materialize=True)
    gold = agreement.gold_negatives(I.gold_rows(spark, sf), c.deduped)
    other = cascade.species_labels(I.raw_sites(spark, sf), I.sequences(spark, sf), c.mask, "lang")
    return reports.contract_checks(I.proteins(spark, sf), c.labels(), c.labels(False), c.mask, gold, other)


@query("g7_label_cascade", """select accession, position, type, source_count, source_row_count, evidence, reliability, residue, from_isoform_accession, stratum, type_pooled,
    headline_eligible, cluster_id, partition, crosstalk from o_labels""")
def g7(spark, sf):
    return labels(spark, sf)


@query("g7_species_labels", """with d as (select accession, position, type, min(residue) as residue, count(distinct source) as source_count, min(lang) as species from o_traced t
      left join (select distinct accession, position, type, true as masked from o_mask) m using (accession, position, type) where type_status = 'known' and reason is null and masked is null group by accession, position, type)
    select accession, position, d.type, t.stratum, residue, source_count, species, 'ood' as partition,
      case when count(*) over (partition by species, d.type) < 200 then t.stratum || '::other_PTM' else d.type end as type_pooled,
      count(*) over (partition by accession, position) > 1 as crosstalk from d join o_types t on d.type = t.type""")
def g7_species(spark, sf):
    mask = full(spark, sf, materialize=True).mask
    out = cascade.species_labels(I.raw_sites(spark, sf), I.sequences(spark, sf), mask, "lang")
    return out.select("accession", "position", "type", "stratum", "residue", "source_count", "species", "partition", "type_pooled", "crosstalk")


@query("g7_replication_labels", """select accession, position, r.type, t.stratum, residue, source, evidence, reliability, case when count(*) over (partition by r.type) < 200 then t.stratum || '::other_PTM' else r.type end as type_pooled,
    count(*) over (partition by accession, position) > 1 as crosstalk from o_repl r join o_types t on r.type = t.type""")
def g7_replication(spark, sf):
    out = cascade.replication_labels(I.raw_sites(spark, sf), I.corpus(spark, sf), full(spark, sf, materialize=True).mask)
    return out.select("accession", "position", "type", "stratum", "residue", "source", "evidence", "reliability", "type_pooled", "crosstalk")


@query("s1_union_by_name", """select source, count(*) as n, count(evidence) as n_evidence, count(reliability) as n_reliability from (select source, evidence, null as reliability from o_raw where source = 's1'
    union all select source, null, reliability from o_raw where source = 's2') group by source""")
def s1(spark, sf):
    raw = I.raw_sites(spark, sf)
    base = ["accession", "position", "type", "row_no"]
    rows = sites.combine_sources({"s1": raw.where("source = 's1'").select(*base, "evidence"), "s2": raw.where("source = 's2'").select(*base, "reliability")})
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("evidence").alias("n_evidence"), F.count("reliability").alias("n_reliability"))


def keys_of(spark, sf, source):
    return I.raw_sites(spark, sf).where(F.col("source") == source).select("accession", "position")


@query("s2_set_operations", """select 'intersect' as op, * from (select accession, position from o_raw where source = 's1' intersect select accession, position from o_raw where source = 's2')
    union all select 'subtract', * from (select accession, position from o_raw where source = 's1' except select accession, position from o_raw where source = 's2')""")
def s2(spark, sf):
    a, b = keys_of(spark, sf, "s1"), keys_of(spark, sf, "s2")
    return a.intersect(b).withColumn("op", F.lit("intersect")).unionByName(a.subtract(b).withColumn("op", F.lit("subtract")))


@query("s3_first_row", """select accession, position, type, source_rank, row_no, evidence from (select *, row_number() over (partition by accession, position, type order by source_rank, row_no) as rn from o_raw) where rn = 1""")
def s3(spark, sf):
    rows = I.raw_sites(spark, sf).select("accession", "position", "type", "source_rank", "row_no", "evidence")
    return reports.first_rows(rows, ["accession", "position", "type"], ["source_rank", "row_no"])


@query("s4_union_of_ids", "select accession from o_prot where partition = 'discovery_train' union select accession from o_prot where partition = 'discovery_val'")
def s4(spark, sf):
    rows = I.sequences(spark, sf).withColumn("partition", I.partition_of(F.col("pid")))
    return rows.where("partition = 'discovery_train'").select("accession").union(rows.where("partition = 'discovery_val'").select("accession")).distinct()


@query("s5_skip_committed", "select pid, accession from o_seq where pid not in (select vec_id // 20 from embeddings)")
def s5(spark, sf):
    return I.sequences(spark, sf).select("pid", "accession").join(I.vectors(spark, sf).select("pid"), "pid", "left_anti")


@query("e4_top_by_count", "select accession, count(*) as n from o_raw group by accession order by n desc, accession limit 20")
def e4(spark, sf):
    return I.raw_sites(spark, sf).groupBy("accession").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "accession").limit(20)


@query("e5_last_value", "select run, metric, arg_max(value, step) as value from o_log where value is not null group by run, metric")
def e5(spark, sf):
    return I.run_log(spark, sf).where("value is not null").groupBy("run", "metric").agg(F.max_by("value", "step").alias("value"))


@query("e12_ranked_table", "select type, n, row_number() over (order by n desc, type) as rank from (select type, count(*) as n from o_raw group by type)")
def e12(spark, sf):
    from pyspark.sql import Window

    counts = I.raw_sites(spark, sf).groupBy("type").agg(F.count("*").alias("n"))  # a few rows: the type vocabulary
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "type")).cast("bigint"))
