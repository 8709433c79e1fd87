"""Catalogue: sources, inventories and run logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from sitelake.functions import exprs
from sitelake.operators import reports, runlog
from sitelake.plans import inputs as I
from sitelake.plans.oracle import define, r
from sitelake.plans.registry import query
from sitelake.plans.split import SplitResult, write_split
from sitelake.session import ensure_checkpoint_dir, read_shared, write_shared
from sitelake.sources import inventory, readers


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/source-{name}-{uuid.uuid4().hex}"


def as_tsv(rows, path, **options):
    """Delimited text as the sources ship it: blanks around a value stay."""
    rows.write.options(sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


@query("a1_fasta", "select accession as uniprot_id, length, case when length <= 1022 then sequence end as sequence from o_seq")
def a1(spark, sf):
    """Sequences as wrapped lower-case records with a stop mark, written as text and read back."""
    path = folder(spark, "fasta")
    rows = I.sequences(spark, sf).select(
        F.concat(F.lit("sp|"), "accession", F.lit("|"), "source", F.lit(" OS=Homo sapiens")).alias("uniprot_id"),
        F.concat(F.lower(F.substring("sequence", 1, 60)), F.lit("\n"), F.expr("substr(sequence, 61)"), F.lit("*\n")).alias("sequence"))
    readers.write_fasta(rows, path)
    valid, skipped = readers.read_fasta(spark, path)
    return valid.select("uniprot_id", "length", "sequence").unionByName(skipped, allowMissingColumns=True)


@query("a3_headerless_table", "select accession, position, type, lang as species from o_raw where position % 13 <> 0")
def a3(spark, sf):
    text = F.when(F.col("position") % 13 == 0, "n/a").otherwise(F.col("position").cast("string"))
    none = F.lit(None).cast("string")
    rows = I.raw_sites(spark, sf).select(
        F.col("row_no").cast("string"), "accession", text.alias("position"), "type", none.alias("protein_name"), none.alias("gene"), "lang", none.alias("window"), none.alias("pmid"))
    return readers.parse(spark, "lysine", as_tsv(rows, folder(spark, "lysine"))).drop("pmid")


@query("a5_multi_species", "select accession, position, type, species, reliability from o_raw")
def a5(spark, sf):
    rows = I.raw_sites(spark, sf).select(
        F.col("accession").alias("UniProt Accession"), F.col("position").alias("Site Position"), F.col("type").alias("PTM type"),
        F.col("species").alias("Organism"), F.col("reliability").alias("Reliability score"))
    return readers.parse(spark, "multi_species", as_tsv(rows, folder(spark, "species"), header=True)).drop("pmid")


@query("a7_paired_lines", "select accession, position, lower(label) as label from o_gold")
def a7(spark, sf):
    path = folder(spark, "pairs")
    flag = F.when(F.col("label") == "Glycosylated", "1").otherwise("0")
    cells = I.gold_rows(spark, sf).groupBy("accession").agg(F.array_join(F.collect_list(F.concat_ws(",", flag, "position")), ",").alias("cells"))
    lines = cells.select(F.concat("accession", F.lit(","), "cells", F.lit("\nSEQUENCE")).alias("value"))
    lines.write.option("maxRecordsPerFile", 100_000).text(path)
    return readers.parse(spark, "pairs", path)


@query("a8_header_row", "select accession, lang from o_seq")
def a8(spark, sf):
    """Two rows above the header row; all cells are text until the header is found."""
    top = spark.createDataFrame([(-3, "Table 1", None), (-2, "sites of all texts", "version 1"), (-1, " UniProt ID", "Language ")], "line_no bigint, c1 string, c2 string")
    rows = I.sequences(spark, sf).select(F.col("pid").alias("line_no"), F.col("accession").alias("c1"), F.col("lang").alias("c2"))
    found = readers.header_row(top.unionByName(rows), ["uniprot", "language"], "line_no")
    return found.select(F.col("UniProt ID").alias("accession"), F.col("Language").alias("lang"))


@query("a9_encodings", "select accession || ' caf' || chr(233) || ' ' || chr(8364) || ' ' || lang as line from o_seq where pid % 2 = 0 union all select accession || ' caf' || chr(233) || ' ' || lang from o_seq where pid % 2 = 1")
def a9(spark, sf):
    """Half of the files in UTF-8, half in a one-byte code page; read by what their bytes allow."""
    path, rows = folder(spark, "encodings"), I.sequences(spark, sf)
    line = lambda *middle: F.concat_ws(" ", "accession", *[F.lit(m) for m in middle], "lang").alias("line")
    rows.where("pid % 2 = 0").select(line("caf\u00e9", "\u20ac")).write.csv(f"{path}/utf8")
    rows.where("pid % 2 = 1").select(line("caf\u00e9")).write.option("encoding", "ISO-8859-1").csv(f"{path}/latin")
    return readers.decoded_lines(spark, f"{path}/*/part-*").select("line")


@query("a10_containers", "select accession, lang from o_seq")
def a10(spark, sf):
    """Half of the files compressed, half plain; the content decides, not the name."""
    path, rows = folder(spark, "containers"), I.sequences(spark, sf)
    lines = lambda part: rows.where(f"pid % 2 = {part}").select(F.concat_ws("\t", "accession", "lang").alias("value"))
    lines(0).write.option("maxRecordsPerFile", 100_000).option("compression", "gzip").text(f"{path}/packed")
    lines(1).write.option("maxRecordsPerFile", 100_000).text(f"{path}/plain")
    return readers.split_lines(readers.container_lines(spark, f"{path}/*/part-*"), ["accession", "lang"]).select("accession", "lang")


@query("a15_split_manifest", "select partition, count(*) as n, 'kept' as other_build from o_prot group by partition")
def a15(spark, sf):
    """Corpus, sites and manifest written and read back; keys of other builds stay in the manifest."""
    path, corpus = folder(spark, "split"), I.corpus(spark, sf).select("accession", "cluster_id", "partition")
    report = corpus.groupBy(F.col("partition").alias("feature")).agg(F.count("*").alias("n"))
    write_shared(spark, f"{path}/split_manifest.json", json.dumps({"other_build": "kept", "balance": "old"}))
    write_split(SplitResult(corpus, corpus, None, report, None, [{"pass": 0}]), path)
    manifest = json.loads(read_shared(spark, f"{path}/split_manifest.json"))
    sizes = spark.createDataFrame([(k, v["n"]) for k, v in manifest["balance"].items()], "partition string, n bigint")  # one row per partition
    return spark.read.parquet(f"{path}/corpus").groupBy("partition").agg(F.count("*").alias("n")).join(sizes, ["partition", "n"]).withColumn("other_build", F.lit(manifest["other_build"]))


@query("a20_partition_layout", "select accession, cluster_id from o_prot where partition = 'held_out'")
def a20(spark, sf):
    path = folder(spark, "layout")
    I.corpus(spark, sf).select("accession", "cluster_id", "partition").write.partitionBy("partition").parquet(path)
    return spark.read.parquet(path).where("partition = 'held_out'").select("accession", "cluster_id")


@query("u1_registered_parser", "select doc_id, lang from documents where n_chars is not null")
def u1(spark, sf):
    readers.register_parser("documents", lambda spark, path: spark.read.parquet(path).where("n_chars is not null").select("doc_id", "lang"))
    return readers.parse(spark, "documents", f"{sf}/documents.parquet")


@query("u3_cached_table", "select lang, count(*) as n, false as first_reused, true as second_reused, false as changed_reused from documents group by lang")
def u3(spark, sf):
    """Built, then found by its fingerprint, then built again for another configuration."""
    docs, path = I.table(spark, sf, "documents").select("doc_id", "lang"), folder(spark, "cache")
    build = lambda: docs.groupBy("lang").agg(F.count("*").alias("n"))
    runs = [inventory.cached_table(spark, path, {"documents": docs}, {"version": v}, build) for v in (1, 1, 2)]
    flags = [F.lit(reused).alias(name) for name, (_, reused) in zip(("first_reused", "second_reused", "changed_reused"), runs)]
    return runs[-1][0].select("lang", "n", *flags)


@query("a2_reviewed_proteome", "select accession, length, sequence from o_seq where length <= 1022")
def a2(spark, sf):
    rows = I.sequences(spark, sf).select(F.col("accession").alias("Entry Accession"), F.col("length").alias("Length"), F.lower("sequence").alias(" Sequence "))
    return readers.reviewed_proteome(rows)


@query("a4_flat_file_sites", "select accession, position, type, 'experimental' as evidence, upper(lang) as species_suffix from o_raw where position is not null")
def a4(spark, sf):
    rows = I.raw_sites(spark, sf).select(
        F.concat_ws("_", "accession", F.upper("lang")).alias("entry_name"), "accession", F.col("position").cast("string").alias("position"),
        F.lit(None).cast("string").alias("pmid"), F.concat(F.lit("/flat/"), "type", F.lit(".txt")).alias("file"))
    return readers.flat_sites(rows, {}).drop("pmid")


@query("a6_atlas_sites", "select accession, position, 'O-GlcNAcylation' as type from o_raw where lower(trim(species)) = 'human' and evidence = 'MS/MS' and reliability is not null")
def a6(spark, sf):
    rows = I.raw_sites(spark, sf).select(
        "species", "accession", F.when(F.col("evidence") == "MS/MS", " UniProt").otherwise("other").alias("accession_source"),
        F.when(F.col("reliability").isNotNull(), F.col("position").cast("string")).alias("position_in_protein"))
    return readers.atlas_sites(rows)


@query("a12_pruned_scan", "select doc_id, lang, n_chars from documents where source = 'src3'")
def a12(spark, sf):
    return I.table(spark, sf, "documents").where("source = 'src3'").select("doc_id", "lang", "n_chars")


define("o_inv", "select page_id::varchar as name, split_part(url, '/', 3) as source, length(html) as size, sha256(html) as sha256, url from pages")


def page_files(spark, sf):
    return I.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("name"), F.split_part("url", F.lit("/"), F.lit(3)).alias("source"), F.length("html").cast("bigint").alias("size"),
        F.sha2("html", 256).alias("sha256"), "url")


LOCAL = "not contains(url, '/en/')"


@query("a13_reconcile", """select r.name, r.size, case when l.name is null then 'missing' when contains(r.url, '?page=') then 'size_mismatch' when contains(r.url, '#top') then 'checksum_mismatch' else 'up_to_date' end as action
    from o_inv r left join (select * from o_inv where not contains(url, '/en/')) l on r.name = l.name""")
def a13(spark, sf):
    remote = page_files(spark, sf)
    size = F.when(F.contains("url", F.lit("?page=")), F.col("size") + 1).otherwise(F.col("size"))
    digest = F.when(F.contains("url", F.lit("#top")), F.sha2("url", 256)).otherwise(F.col("sha256"))
    local = remote.where(LOCAL).select("name", size.alias("size"), digest.alias("sha256"))
    return inventory.reconcile(remote, local, verify=True)


@query("a14_size_report", "select coalesce(source, 'TOTAL') as source, count(*) as n_files, sum(size)::bigint as bytes from o_inv group by rollup (source)")
def a14(spark, sf):
    return inventory.size_report(page_files(spark, sf))


@query("d34_output_inventory", "select i.name, l.name is not null as present, coalesce(l.size, 0) as size from o_inv i left join (select * from o_inv where not contains(url, '/en/')) l on i.name = l.name")
def d34(spark, sf):
    files = page_files(spark, sf)
    return reports.required_outputs(files.where(LOCAL).select("name", "size"), files.select("name"))


@query("a16_metrics_tail", "select user_id % 8 as run, event_type as metric, arg_max(value, event_id) as value from events group by all union all select user_id % 8, 'k', arg_max((props::json->>'k')::double, event_id) from events group by all")
def a16(spark, sf):
    """The log as JSON lines: one numeric key per event type, one from its properties, text that is skipped."""
    rows = I.table(spark, sf, "events").select(
        (F.col("user_id") % 8).alias("run"), F.col("event_id").alias("line_no"),
        F.concat(F.lit('{"'), "event_type", F.lit('": '), F.col("value").cast("string"), F.lit(', "note": "text", "count": "12", '), F.expr("substr(props, 2)")).alias("value"))
    return runlog.last_values(runlog.metric_rows(rows), ["run", "metric"], "line_no")


@query("a19_scalar_history", "select user_id % 8 as run, event_id as step, max(value) filter (where event_type = 'click') as click, max(value) filter (where event_type = 'view') as view from events where event_type in ('click', 'view') group by all")
def a19(spark, sf):
    return runlog.scalar_history(I.run_log(spark, sf), ["click", "view"])


@query("a19_histogram_edges", f"""with h as (select run, arg_max(value, step) as low, count(*) % 7 + 1 as n from o_log group by run)
    select run, i as edge, {r('low + 0.5e0 * i')} as value from (select run, low, unnest(range(n + 1)) as i from h)""")
def a19_edges(spark, sf):
    rows = I.run_log(spark, sf).groupBy("run").agg(F.max_by("value", "step").alias("low"), (F.count("*") % 7 + 1).alias("n")).withColumn("size", F.lit(0.5))
    out = rows.select("run", F.posexplode(runlog.histogram_edges("low", "size", "n")).alias("edge", "value"))
    return out.select("run", F.col("edge").cast("bigint").alias("edge"), exprs.rounded("value").alias("value"))


LAST_BLOCK = "select *, event_id // 1000 as block, max(event_id // 1000) over (partition by user_id % 8) as newest from events"


@query("a19_last_histogram", f"""with e as ({LAST_BLOCK}), h as (select user_id % 8 as run, least(floor(value / 20), 4)::bigint as bin, count(*) as n from e where block = newest group by all)
    select run, bin, n, case when run % 2 = 0 then 20e0 * bin else bin * bin * 1e0 end as low_edge, case when run % 2 = 0 then 20e0 * (bin + 1) else (bin + 1) * (bin + 1) * 1e0 end as high_edge from h""")
def a19_histogram(spark, sf):
    """A histogram per run and thousand steps: packed bins for even runs, explicit ones for odd runs."""
    binned = I.run_log(spark, sf).select("run", F.expr("step div 1000").alias("step"), F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("int").alias("bin"))
    counts = binned.groupBy("run", "step").agg(*[F.count_if(F.col("bin") == b).alias(f"n{b}") for b in range(5)])
    even, packed = F.col("run") % 2 == 0, lambda v: F.when(F.col("run") % 2 == 0, F.lit(v))
    rows = counts.select("run", "step", F.array(*[f"n{b}" for b in range(5)]).alias("counts"), F.when(~even, F.array(*[F.lit(float(b * b)) for b in range(6)])).alias("bins"),
                         packed(0.0).alias("low"), packed(20.0).alias("size"), packed(5).alias("count"))
    last = runlog.last_histogram(rows)
    cells = last.select("run", "edges", F.posexplode("counts").alias("bin", "n")).where("n > 0")
    return cells.select("run", F.col("bin").cast("bigint").alias("bin"), "n", F.expr("edges[bin]").alias("low_edge"), F.expr("edges[bin + 1]").alias("high_edge"))


@query("a19_artifact_table", """with e as (select *, user_id % 8 as run, event_type || '-' || event_id // 2000 % 3 as artifact from events),
    f as (select run, arg_min(artifact, event_id) as artifact from e where artifact like 'click%' group by run)
    select run, artifact, event_id as step, value from e join f using (run, artifact) where event_id % 2 = 1""")
def a19_table(spark, sf):
    name = F.concat_ws("-", "metric", F.expr("(step div 2000) % 3").cast("string"))
    rows = I.run_log(spark, sf).select("run", name.alias("artifact"), F.when(F.col("step") % 2 == 1, "odd").otherwise("even").alias("table_key"), "step", "value")
    artifacts = rows.groupBy("run", "artifact").agg(F.min("step").alias("logged"))
    return runlog.artifact_table(artifacts, rows, "click", "odd")


@query("a21_fasta_lines", "select '>' || accession || chr(10) || sequence as value from o_seq")
def a21(spark, sf):
    return readers.fasta_lines(I.sequences(spark, sf), "accession")


@query("a22_hit_queries", "select count(distinct user_id) as n_queries from events where least(value, 100) / 100 >= 0.4 and value / 100 >= 0.5")
def a22(spark, sf):
    hits = I.table(spark, sf, "events").select(F.col("user_id").alias("query"), F.least("value", F.lit(100.0)).alias("pident"), (F.col("value") / 100).alias("qcov"))
    return readers.hit_queries(hits, 0.4, 0.5)


CHECKS = [("click", "Clicks", 10.0, 40.0, None, None), ("view", "Views", 20.0, None, None, None), ("error", "Errors", None, 50.0, None, "topk"),
          ("signup", "Signups", None, None, "jumprelu", None), ("purchase", "Purchases", 5.0, 60.0, None, None)]
define("o_last", "select run, metric, arg_max(value, step) as value from o_log group by run, metric")


def architectures(spark, sf):
    return I.run_log(spark, sf).select("run").distinct().withColumn("architecture", F.when(F.col("run") % 2 == 0, "topk").otherwise("jumprelu"))


@query("r1_verdicts", f"""with c as (select * from (values ('click', 'Clicks', 10e0, 40e0, '10 - 40'), ('view', 'Views', 20e0, null, '>= 20'), ('error', 'Errors', null, 50e0, '< 50'), ('signup', 'Signups', null, null, 'n/a'),
      ('purchase', 'Purchases', 5e0, 60e0, '5 - 60')) t(metric, label, low, high, target))
    select run, label, {r('value')} as value, target, case when low is null and high is null then 'n/a' when value < low or value > high then 'fail' else 'pass' end as status
    from o_last l join c on l.metric = c.metric where not (c.metric = 'error' and run % 2 = 0) and not (c.metric = 'signup' and run % 2 = 0)""")
def r1(spark, sf):
    last = runlog.last_values(I.run_log(spark, sf), ["run", "metric"], "step")
    return runlog.verdicts(last, runlog.check_table(spark, CHECKS), architectures(spark, sf))


@query("b15_band_verdict", "select metric, case when value < 10 then 'fail' when value > 40 then 'fail' else 'pass' end as status, count(*) as n from o_log group by all")
def b15(spark, sf):
    rows = I.run_log(spark, sf).withColumn("status", exprs.band_verdict("value", F.lit(10.0), F.lit(40.0)))
    return rows.groupBy("metric", "status").agg(F.count("*").alias("n"))


define("o_finals", """select run, 64e0 as d_hidden, max(value) filter (where metric = 'click') as l0, (select min(value) / 100 from o_log g where g.run = l.run) as threshold_std_max,
    max(value) filter (where metric = 'view') / 30 as decoder_norm, max(value) filter (where metric = 'error') / 50 as explained_variance from o_last l group by run""")


@query("r2_recommendations", """with texts as (select * from (values ('threshold_frozen', 'threshold spread never left its initial range', 'widen the bandwidth or raise the sparsity coefficient'),
      ('decoder_norm_static', 'decoder norms barely moved from 1', 'raise the sparsity coefficient and keep the norm constraint off'),
      ('dense_code', 'most latents fire on every token', 'raise the sparsity coefficient substantially'), ('collapsed_code', 'almost no latent fires', 'lower the sparsity coefficient'),
      ('variance_below_floor', 'reconstruction failed on its own', 'lower the sparsity coefficient or check the learning rate'),
      ('no_known_signature', 'the run may be healthy', 'look again at why it was flagged'), ('no_rules_for_architecture', '', '')) t(rule, diagnosis, change)),
    jump as (select * from o_finals where run % 2 = 1),
    f as (select run, unnest([case when threshold_std_max < 3.5e-4 then 'threshold_frozen' end, case when abs(decoder_norm - 1) < 0.05 then 'decoder_norm_static' end,
      case when l0 / d_hidden > 0.5 then 'dense_code' end, case when l0 / d_hidden < 0.001 then 'collapsed_code' end, case when explained_variance < 0.9 then 'variance_below_floor' end]) as rule from jump),
    g as (select run, rule from f where rule is not null union all select run, 'no_known_signature' from jump where run not in (select run from f where rule is not null)
      union all select run, 'no_rules_for_architecture' from o_finals where run % 2 = 0)
    select g.run, g.rule, t.diagnosis, t.change from g join texts t on t.rule = g.rule""")
def r2(spark, sf):
    log = I.run_log(spark, sf)
    wide = runlog.comparison(runlog.last_values(log, ["run", "metric"], "step"), log.groupBy("run").agg((F.min("value") / 100).alias("threshold_std_max")), ["click", "view", "error"])
    finals = wide.select("run", F.lit(64.0).alias("d_hidden"), F.col("click").alias("l0"), "threshold_std_max", (F.col("view") / 30).alias("decoder_norm"), (F.col("error") / 50).alias("explained_variance"))
    return runlog.recommendations(finals.join(architectures(spark, sf), "run"))


@query("r3_run_comparison", """select run, count(*) as n_steps, (select value from o_last l where l.run = o.run and metric = 'click') as click, (select value from o_last l where l.run = o.run and metric = 'view') as view
    from o_log o group by run""")
def r3(spark, sf):
    log = I.run_log(spark, sf)
    return runlog.comparison(runlog.last_values(log, ["run", "metric"], "step"), log.groupBy("run").agg(F.count("*").alias("n_steps")), ["click", "view"])


define("o_levels", "select event_type, length(event_type) - 3 as level, value as throughput, value > 5 as ok from events")
LEVELS = f"""with l as (select level, count(*) as ok_runs, avg(throughput) as m, sum(throughput) as s from o_levels where ok group by level)
    select level, ok_runs, {r('m')} as mean_rate, {r('s')} as total_rate, {r('s / (select arg_min(s, level) from l)')} as speedup from l"""


def levels(spark, sf):
    rows = I.table(spark, sf, "events").select((F.length("event_type") - 3).cast("bigint").alias("level"), F.col("value").alias("throughput"), (F.col("value") > 5).alias("ok"))
    return runlog.concurrency_table(rows)


@query("r4_concurrency", LEVELS)
def r4(spark, sf):
    return levels(spark, sf)


@query("e13_smallest_level", f"select coalesce(min(level), 1) as level from ({LEVELS}) where total_rate >= 0.95 * (select max(total_rate) from ({LEVELS}))")
def e13(spark, sf):
    return runlog.pick_level(levels(spark, sf))


@query("r5_trends", "select case metric when 'click' then 'stratum' when 'error' then 'tier' end as section, run, step, metric, value from o_log where metric in ('click', 'error')")
def r5(spark, sf):
    return runlog.trends(I.run_log(spark, sf), {"click": "stratum", "error": "tier"})
