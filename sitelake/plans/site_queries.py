"""Catalogue: scalar functions, joins and the label cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators import agreement, sites
from sitelake.plans import cascade
from sitelake.plans import inputs as I
from sitelake.plans.oracle import define, r
from sitelake.plans.registry import query
from sitelake.session import stored

SOURCES = {1: "s1", 2: "s2"}
ALL_SOURCES = {1: "s1", 2: "s2", 3: "s3"}
AMBIGUOUS = ["s3"]

define("o_stem", r"select *, regexp_extract(accession, '^(.*)-[0-9]+$', 1) as stem from o_raw")
define("o_iso", """select * exclude (accession, stem), case when recovered then stem else accession end as accession,
    recovered as from_isoform_accession from (select s.*, s.stem <> '' and a.accession is null and b.accession is not null as recovered
    from o_stem s left join o_prot a on s.accession = a.accession left join o_prot b on s.stem = b.accession)""")
define("o_res", """select i.*, p.length as seq_length, case when i.position between 1 and p.length then substr(p.sequence, i.position, 1) end as residue
    from o_iso i left join o_prot p on i.accession = p.accession""")
define("o_key", "select *, replace(replace(replace(lower(trim(type)), '_', '-'), '  ', ' '), ' ', '-') as k from o_res")
define("o_canon", """select c.* exclude (type, k), c.type as raw_type, coalesce(b.resolved_type, s.spelled_type, c.type) as type,
    case when b.resolved_type is not null or s.spelled_type is not null then 'known'
         when c.k in (select resolved_key from o_byres) then 'unresolved' else 'unknown' end as type_status
    from o_key c left join o_byres b on c.k = b.resolved_key and c.residue = b.resolved_residue left join o_spell s on c.k = s.spelling_key""")
define("o_ev", """select *, coalesce(regexp_matches(lower(trim(evidence)), 'ms/ms|low-throughput|experimental|mass spectrometry')
    and not regexp_matches(lower(trim(evidence)), 'by similarity|potential|probable|text-mining'), false) as evidence_ok from o_canon""")
define("o_traced", """select e.*, t.stratum as type_stratum, case when seq_length is null then 'accession_not_in_corpus'
    when e.residue is null then 'position_out_of_range'
    when t.stratum is not null and not exists (select 1 from o_strata s where s.stratum = t.stratum and s.residue = e.residue) then 'residue_mismatch' end as reason
    from o_ev e left join o_types t on e.type = t.type""")
define("o_valid", "select * from o_traced where type_status = 'known' and evidence_ok and reason is null")
define("o_cand", "select * from o_valid where source <> 's3'")
define("o_mask", f"""select accession, position, 'O-GlcNAcylation' as type, '{dims.MASK_AMBIGUOUS}' as mask_reason from o_valid where source = 's3'
    union all select c.accession, c.position, 'O-GlcNAcylation', '{dims.MASK_CONTAINMENT}' from o_cand c
    left join (select distinct accession, position, true as confirmed from o_cand where type = 'O-GlcNAcylation') d on d.accession = c.accession and d.position = c.position
    where c.type = 'O-glycosylation' and d.confirmed is null""")
define("o_pos", """select c.* from o_cand c left join (select distinct accession, position, type, true as masked from o_mask) m
    on m.accession = c.accession and m.position = c.position and m.type = c.type where m.masked is null""")
define("o_dedup", """select accession, position, type, count(distinct source) as source_count, count(*) as source_row_count,
    arg_min(evidence, source_rank * 1e12 + row_no) filter (where evidence is not null) as evidence,
    arg_min(reliability, source_rank * 1e12 + row_no) filter (where reliability is not null) as reliability,
    min(residue) as residue, arg_min(from_isoform_accession, source_rank * 1e12 + row_no) as from_isoform_accession
    from o_pos group by accession, position, type""")
define("o_pooled", """select d.*, t.stratum, case when n < 200 then t.stratum || '::other_PTM' else d.type end as type_pooled, n >= 1000 as headline_eligible
    from (select *, count(*) over (partition by type) as n from o_dedup) d join o_types t on d.type = t.type""")
define("o_labels", """select o.* exclude (n), p.cluster_id, p.partition, count(*) over (partition by o.accession, o.position) > 1 as crosstalk
    from (select * from o_pooled) o left join o_prot p on o.accession = p.accession""")


def traced(spark, sf):
    return cascade.trace(I.raw_sites(spark, sf), I.sequences(spark, sf))


def full(spark, sf, materialize=False):
    return cascade.run(I.raw_sites(spark, sf), I.corpus(spark, sf), SOURCES, AMBIGUOUS,
                       lookup=I.sequences(spark, sf), materialize=materialize)


def labels(spark, sf):
    return full(spark, sf, materialize=True).labels()


def positives(spark, sf):
    """Row level: candidates minus the mask, as an anti join. The traced rows are used four times, so they are written once."""
    rows = stored(traced(spark, sf), "traced")
    return sites.drop_masked(cascade.valid(rows).where(~F.col("source").isin(*AMBIGUOUS)), cascade.exclusion_mask(rows, AMBIGUOUS))


@query("b1_type_key", """select source, replace(replace(replace(lower(trim(type)), '_', '-'), '  ', ' '), ' ', '-') as type_key, count(*) as n
    from o_raw group by all""")
def b1(spark, sf):
    return I.raw_sites(spark, sf).groupBy("source", exprs.type_key("type").alias("type_key")).agg(F.count("*").alias("n"))


@query("b2_canonical_type", "select raw_type, residue, type, count(*) as n from o_canon group by all")
def b2(spark, sf):
    return traced(spark, sf).groupBy("raw_type", "residue", "type").agg(F.count("*").alias("n"))


define("o_raw_odd", "select * exclude (type), case when type = 'Sulfoxidation' and source = 's2' then 'Unassigned mark' else type end as type from o_raw")


@query("b3_canonicalize", """with k as (select o.*, replace(replace(replace(lower(trim(o.type)), '_', '-'), '  ', ' '), ' ', '-') as k,
      case when o.position between 1 and p.length then substr(p.sequence, o.position, 1) end as residue
      from o_raw_odd o left join o_prot p on o.accession = p.accession)
    select case when b.resolved_type is not null or s.spelled_type is not null then 'known'
      when k.k in (select resolved_key from o_byres) then 'unresolved' else 'unknown' end as type_status,
      coalesce(b.resolved_type, s.spelled_type, k.type) as type, count(*) as n from k
    left join o_byres b on k.k = b.resolved_key and k.residue = b.resolved_residue left join o_spell s on k.k = s.spelling_key group by all""")
def b3(spark, sf):
    odd = F.when((F.col("type") == "Sulfoxidation") & (F.col("source") == "s2"), "Unassigned mark").otherwise(F.col("type"))
    rows = sites.attach_residue(I.raw_sites(spark, sf).withColumn("type", odd), I.sequences(spark, sf))
    return sites.canonical_types(rows).groupBy("type_status", "type").agg(F.count("*").alias("n"))


@query("b4_residue_lookup", """select r.source, r.accession, r.position, r.row_no,
    case when r.position between 1 and p.length then substr(p.sequence, r.position, 1) end as residue from o_raw r left join o_prot p using (accession)""")
def b4(spark, sf):
    return sites.attach_residue(I.raw_sites(spark, sf), I.sequences(spark, sf)).select("source", "accession", "position", "row_no", "residue")


@query("b5_isoform_recovery", "select source, accession, position, row_no, from_isoform_accession from o_iso")
def b5(spark, sf):
    out = sites.strip_isoforms(I.raw_sites(spark, sf), I.sequences(spark, sf))
    return out.select("source", "accession", "position", "row_no", "from_isoform_accession")


@query("b6_evidence_filter", """select evidence, count(*) as n_in, count(*) filter (where coalesce(
    regexp_matches(lower(trim(evidence)), 'ms/ms|low-throughput|experimental|mass spectrometry')
    and not regexp_matches(lower(trim(evidence)), 'by similarity|potential|probable|text-mining'), false)) as n_out from o_raw group by evidence""")
def b6(spark, sf):
    rows = sites.evidence_flag(I.raw_sites(spark, sf))
    return rows.groupBy("evidence").agg(F.count("*").alias("n_in"), F.count_if("evidence_ok").alias("n_out"))


@query("b7_validate_sites", "select source, type, coalesce(reason, 'kept') as reason, count(*) as n from o_traced group by all")
def b7(spark, sf):
    return traced(spark, sf).groupBy("source", "type", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("b8_species_reliability", """select source, accession, position, type, row_no, reliability from o_raw
    where lower(trim(species)) in ('human', 'homo sapiens') and reliability >= 2""")
def b8(spark, sf):
    rows = sites.reliability_filter(sites.species_filter(I.raw_sites(spark, sf)))
    return rows.select("source", "accession", "position", "type", "row_no", "reliability")


@query("b10_residue_positions", "select accession, residue, count(*) as n, min(position) as first_position, max(position) as last_position from o_letters group by all")
def b10(spark, sf):
    rows = I.explode_residues(I.sequences(spark, sf), ["accession"])
    return rows.groupBy("accession", "residue").agg(
        F.count("*").alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


@query("b11_strata", """select case residue when 'K' then 'K' when 'S' then 'ST' when 'T' then 'ST' when 'N' then 'N' when 'C' then 'C' when 'R' then 'R'
    when 'Y' then 'Y' else 'other' end as header_stratum, coalesce((select stratum from o_strata s where s.residue = l.residue), 'other') as stratum,
    count(*) as n from o_letters l group by all""")
def b11(spark, sf):
    letters = I.explode_residues(I.sequences(spark, sf), []).groupBy("residue").agg(F.count("*").alias("k"))
    return letters.groupBy(
        exprs.stratum_of_residue("residue", dims.HEADER_STRATA).alias("header_stratum"),
        exprs.stratum_of_residue("residue").alias("stratum")).agg(F.sum("k").alias("n"))


@query("b11_type_strata", """select k.type, coalesce(t.stratum, 'UNMAPPED') as stratum, k.n from (select type, count(*) as n from o_canon group by type) k
    left join o_types t on k.type = t.type""")
def b11_types(spark, sf):
    counts = traced(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    return counts.select("type", F.coalesce(sites.stratum_of_type(), F.lit("UNMAPPED")).alias("stratum"), "n")


@query("b12_enrich", "select accession, position, type, residue, crosstalk from o_labels")
def b12(spark, sf):
    return labels(spark, sf).select("accession", "position", "type", "residue", "crosstalk")


@query("b13_residue_code", f"""select case when instr('{dims.RESIDUE_VOCABULARY}', residue) > 0 then instr('{dims.RESIDUE_VOCABULARY}', residue) - 1 else 20 end::bigint as code,
    count(*) as n from o_letters group by all""")
def b13(spark, sf):
    letters = I.explode_residues(I.sequences(spark, sf), [])
    return letters.groupBy(exprs.residue_code("residue").alias("code")).agg(F.count("*").alias("n"))


@query("b14_chain_end", """select accession, count(*) filter (where least(position - 1, length - position) < 5) as n_end, count(*) as n from o_letters group by accession""")
def b14(spark, sf):
    rows = I.explode_residues(I.sequences(spark, sf), ["accession", "length"])
    return rows.groupBy("accession").agg(
        F.count_if(exprs.end_distance("position", "length") < 5).alias("n_end"), F.count("*").alias("n"))


define("o_stratum_residue_counts", """select l.accession, s.stratum, s.stratum_order, count(*) as n from o_letters l join o_strata s on l.residue = s.residue group by all""")


@query("b17_suggest_stratum", """with k as (select t.type, t.residue, count(*) as n from o_traced t where residue is not null group by all),
    c as (select k.type, s.stratum, min(s.stratum_order) as o, sum(k.n)::double / any_value(tot.n) as frac from k join (select type, sum(n) as n from k group by type) tot
      on k.type = tot.type join o_strata s on s.residue = k.residue group by k.type, s.stratum),
    types as (select distinct type from o_traced)
    select types.type, coalesce(arg_max(stratum, frac * 1e6 - o), 'n/a') as suggested from types left join c on types.type = c.type group by types.type""")
def b17(spark, sf):
    from sitelake.operators import reports

    return reports.suggested_strata(traced(spark, sf)).select("type", "suggested")


@query("c1_sites_with_corpus", """select r.source, p.accession is not null as in_corpus, count(*) as n, count(distinct r.accession) as accessions
    from o_raw r left join o_prot p using (accession) group by all""")
def c1(spark, sf):
    joined = sites.attach_residue(I.raw_sites(spark, sf), I.sequences(spark, sf))
    return joined.groupBy("source", F.col("seq_length").isNotNull().alias("in_corpus")).agg(
        F.count("*").alias("n"), F.countDistinct("accession").alias("accessions"))


@query("c2_inherit_partition", "select accession, position, type, cluster_id, partition from o_labels")
def c2(spark, sf):
    return sites.inherit_partition(full(spark, sf).deduped, I.corpus(spark, sf)).select("accession", "position", "type", "cluster_id", "partition")


@query("c3_mask_antijoin", "select source, accession, position, type, row_no from o_pos")
def c3(spark, sf):
    return positives(spark, sf).select("source", "accession", "position", "type", "row_no")


define("o_goldneg", """select g.accession, g.position, 'N-glycosylation' as type, 'gold' as tier, coalesce(d.found, false) as contradicted from o_gold g
    left join (select distinct accession, position, true as found from o_dedup where type = 'N-glycosylation') d on d.accession = g.accession and d.position = g.position
    where contains(lower(label), 'non')""")


@query("c4_gold_negatives", "select * from o_goldneg")
def c4(spark, sf):
    return agreement.gold_negatives(I.gold_rows(spark, sf), full(spark, sf).deduped)


@query("c5_gold_contradictions", f"""with neg as (select distinct accession, position from o_gold where contains(lower(label), 'non')),
    hit as (select distinct p.source, p.accession, p.position from o_valid p join neg on p.accession = neg.accession and p.position = neg.position),
    ex as (select source, accession || ':' || position as e, row_number() over (partition by source order by accession || ':' || position) as rn from hit)
    select s.source, (select count(*) from neg) as n_negatives, count(e) as n_contradicted,
      {r('100e0 * count(e) / (select count(*) from neg)', 2)} as pct_contradicted,
      coalesce(string_agg(e, ',' order by e) filter (where rn <= 5), '') as examples
    from (select distinct source from o_valid) s left join ex on s.source = ex.source group by s.source""")
def c5(spark, sf):
    negatives = I.gold_rows(spark, sf).where(F.contains(F.lower("label"), F.lit("non")))
    return agreement.gold_contradictions_by_source(negatives, cascade.valid(traced(spark, sf)))


@query("c6_exclusion_mask", "select * from o_mask")
def c6(spark, sf):
    return full(spark, sf).mask


@query("c7_source_overlap", f"""with k as (select distinct source, accession, position from o_valid),
    n as (select source, count(*) as n from k group by source)
    select a.source as source_a, b.source as source_b, a.n as n_a, b.n as n_b, coalesce(x.s, 0) as n_shared,
      {r('100e0 * coalesce(x.s, 0) / a.n', 2)} as pct_a, {r('100e0 * coalesce(x.s, 0) / b.n', 2)} as pct_b
    from n a join n b on a.source < b.source left join (select l.source as sa, q.source as sb, count(*) as s from k l join k q
      on l.accession = q.accession and l.position = q.position and l.source < q.source group by all) x on x.sa = a.source and x.sb = b.source""")
def c7(spark, sf):
    return agreement.pairwise_overlap(cascade.valid(traced(spark, sf)), list(ALL_SOURCES.values()), ["accession", "position"])


define("o_rkey", """select r.* exclude (type), substr(p.sequence, r.position, 1) as residue,
    replace(replace(replace(lower(trim(r.type)), '_', '-'), '  ', ' '), ' ', '-') as k from o_raw r join o_prot p on r.accession = p.accession
    where lower(trim(r.species)) in ('human', 'homo sapiens') and r.reliability >= 2 and r.position between 1 and p.length""")
define("o_rfirst", """select * from (select c.*, coalesce(b.resolved_type, s.spelled_type) as type from o_rkey c
      left join o_byres b on c.k = b.resolved_key and c.residue = b.resolved_residue left join o_spell s on c.k = s.spelling_key)
    where (type, residue) in (select t.type, s.residue from o_types t join o_strata s on t.stratum = s.stratum)
    qualify row_number() over (partition by accession, position, type order by source_rank, row_no) = 1""")
define("o_repl", """select r.* from o_rfirst r left join (select distinct accession, position, type, true as masked from o_mask) m
    on r.accession = m.accession and r.position = m.position and r.type = m.type where m.masked is null""")


@query("c8_type_overlap", f"""with s as (select coalesce(a.type, b.type) as type, a.type is not null as l, b.type is not null as r
      from (select accession, position, type from o_repl) a full join (select accession, position, type from o_labels) b
      on a.accession = b.accession and a.position = b.position and a.type = b.type)
    select type, count(*) filter (where l) as n_left, count(*) filter (where r) as n_right, count(*) filter (where l and r) as n_shared,
      case when count(*) filter (where l) > 0 then {r('(count(*) filter (where l and r))::double / count(*) filter (where l)')} end as fraction_left,
      case when count(*) filter (where r) > 0 then {r('(count(*) filter (where l and r))::double / count(*) filter (where r)')} end as fraction_right
    from s group by type""")
def c8(spark, sf):
    c = full(spark, sf, materialize=True)
    replication = cascade.replication_labels(I.raw_sites(spark, sf), I.corpus(spark, sf), c.mask)
    return agreement.type_overlap(replication, c.deduped)


@query("c9_reliability_sweep", f"""with f as (select unnest(range(6)) as floor), ref as (select distinct accession, position from o_dedup),
    k as (select f.floor, r.accession, r.position from f join o_raw r on r.reliability >= f.floor),
    u as (select floor, count(*) as n_sites, count(ref.accession) as n_conf from (select distinct * from k) d left join ref using (accession, position) group by floor)
    select f.floor, (select count(*) from k where k.floor = f.floor) as n_rows,
      {r('100e0 * (select count(*) from k where k.floor = f.floor) / (select count(*) from o_raw)', 2)} as pct_rows, u.n_sites,
      {r('100e0 * u.n_conf / u.n_sites', 2)} as pct_in_reference from f join u on u.floor = f.floor""")
def c9(spark, sf):
    return agreement.reliability_sweep(I.raw_sites(spark, sf), full(spark, sf).deduped)


@query("c18_carriers", "select distinct accession from o_labels where type = 'N-glycosylation'")
def c18(spark, sf):
    return sites.carriers(labels(spark, sf), "N-glycosylation")


@query("d1_dedup", "select * from o_dedup")
def d1(spark, sf):
    rows = positives(spark, sf)
    return sites.deduplicate(rows, cascade.AUX)


@query("d2_min_frequency", "select accession, position, type, stratum, type_pooled, headline_eligible from o_pooled")
def d2(spark, sf):
    return labels(spark, sf).select("accession", "position", "type", "stratum", "type_pooled", "headline_eligible")


@query("d2_min_frequency_naive", """select accession, position, type, 'ALL' as stratum, case when n < 200 then 'ALL::other_PTM' else type end as type_pooled,
    n >= 1000 as headline_eligible from (select *, count(*) over (partition by type) as n from o_dedup)""")
def d2_naive(spark, sf):
    return full(spark, sf, True).labels(by_stratum=False).select("accession", "position", "type", "stratum", "type_pooled", "headline_eligible")


define("o_cover", "select accession, type, list(distinct source) as cov from o_pos group by all")
define("o_agree", f"""select p.accession, p.position, p.type, len(rep) as n_sources_reporting, array_to_string(list_sort(rep), ',') as sources_reporting,
    len(cov) as n_sources_covering, len(list_filter(cov, lambda x: not list_contains(rep, x))) as n_sources_disagreeing,
    array_to_string(list_sort(list_filter(cov, lambda x: not list_contains(rep, x))), ',') as sources_disagreeing,
    {r('len(rep)::double / len(cov)', 3)} as agreement_ratio
    from (select accession, position, type, list(distinct source) as rep from o_pos group by all) p join o_cover c on p.accession = c.accession and p.type = c.type""")


@query("d3_site_agreement", "select * from o_agree")
def d3(spark, sf):
    return agreement.site_agreement(full(spark, sf).masks, SOURCES)


define("o_talk", """with st as (select accession, position, type, string_agg(distinct source, ',' order by source) as srcs from o_pos group by all),
    ms as (select accession, position, max(c) as c from (select accession, position, source, count(distinct type) as c from o_pos group by all) group by all)
    select st.accession, st.position, count(*) as n_types, string_agg(type, ' + ' order by type) as type_combination,
      string_agg(type || '=' || srcs, '; ' order by type) as sources_per_type,
      case when any_value(ms.c) > 1 then 'same_source_multi_type' else 'cross_source_only' end as evidence_class
    from st join ms on st.accession = ms.accession and st.position = ms.position group by st.accession, st.position having count(*) > 1""")


@query("d4_crosstalk", "select * from o_talk")
def d4(spark, sf):
    return full(spark, sf).crosstalk


@query("d5_raw_type_hits", "select accession, type, count(*) as n from o_canon where type_status = 'known' group by all")
def d5(spark, sf):
    return traced(spark, sf).where("type_status = 'known'").groupBy("accession", "type").agg(F.count("*").alias("n"))


@query("d6_stratum_counts", """select s.stratum, count(l.residue) as n_residues from o_strata s left join o_letters l on l.residue = s.residue group by s.stratum
    union all select '__residues', sum(length)::bigint from o_prot union all select '__proteins', count(*) from o_prot""")
def d6(spark, sf):
    corpus = I.sequences(spark, sf)
    totals = corpus.agg(F.sum("length").alias("a"), F.count("*").alias("b")).select(F.inline(F.array(
        F.struct(F.lit("__residues").alias("stratum"), F.col("a").alias("n_residues")),
        F.struct(F.lit("__proteins").alias("stratum"), F.col("b").alias("n_residues")))))
    return cascade.stratum_sizes(corpus).unionByName(totals)


define("o_t2", f"""with s as (select *, count(*) over (partition by accession, position) > 1 as several from o_labels),
    z as (select st.stratum, count(*) as n from o_letters l join o_strata st on l.residue = st.residue group by all)
    select s.stratum, s.type, count(*) as positive_sites, count(*) filter (where partition <> 'held_out') as sites_discovery,
      count(*) filter (where partition = 'held_out') as sites_holdout, {r('avg(several::int)', 4)} as crosstalk_fraction, any_value(z.n) as stratum_size,
      {r('count(*)::double / any_value(z.n)')} as positive_rate, count(*) >= 200 as meets_floor, count(*) >= 1000 as meets_headline,
      count(*) filter (where partition <> 'held_out') >= 200 and count(*) filter (where partition = 'held_out') >= 200 as both_sides_eligible
    from s left join z on s.stratum = z.stratum group by s.stratum, s.type""")


@query("d21_composition", "select * from o_t2")
def d21(spark, sf):
    return cascade.composition(labels(spark, sf), cascade.stratum_sizes(I.sequences(spark, sf)))
