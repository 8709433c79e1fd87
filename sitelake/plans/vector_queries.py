"""Catalogue: vectors, scoring and statistics."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators import scoring as S
from sitelake.operators import statistics as T
from sitelake.operators import vectors as V
from sitelake.plans import inputs as I
from sitelake.plans.oracle import define, r
from sitelake.plans.registry import query
from sitelake.plans.site_queries import full

DIM, TOP, SCALE = 64, 8, 1.5
LATENTS = 40

# per-latent parameters as expressions that read the same in both engines
BIAS = "(latent % 5 - 2) * 0.02e0"
LOG_THRESHOLD = "-2.0e0 + 0.02e0 * latent"
R_MAG = "0.01e0 * latent"
B_MAG = "(2 - latent % 5) * 0.01e0"

define("o_xlong", "select vec_id, pid, position, label, unnest(vec)::double as x, generate_subscripts(vec, 1) as d from o_vec")
define("o_mean", "select d, avg(x) as m from o_xlong group by d")
define("o_meanlist", "select list(m order by d) as m from o_mean")
define("o_x", "select vec_id, pid, position, label, list(x order by d) as x from o_xlong group by all")
define("o_dot", f"""select v.vec_id, v.pid, v.position, v.label, d.latent, {SCALE}e0 * list_inner_product(v.x, d.w) - list_inner_product((select m from o_meanlist), d.w) as dot
    from o_x v cross join o_dict d""")
define("o_pre", f"select *, dot + {BIAS} as value from o_dot")
define("o_top", f"""select * from (select *, row_number() over (partition by vec_id order by value desc, latent) as rn from o_pre where value > 0) where rn <= {TOP}""")


def latents(spark, sf):
    return I.dictionary(spark, sf).select(
        "latent", "w", F.expr(BIAS).alias("b"), F.expr(LOG_THRESHOLD).alias("log_threshold"), F.expr(BIAS).alias("b_gate"),
        F.expr(R_MAG).alias("r_mag"), F.expr(B_MAG).alias("b_mag"))


def encoder(spark, sf, bias=True):
    rows = latents(spark, sf)
    return S.Encoder(rows if bias else rows.select("latent", "w"), S.mean_vector(I.vectors(spark, sf), DIM), SCALE)


def top_codes(spark, sf):
    return S.encode(I.vectors(spark, sf), encoder(spark, sf), top=TOP)


def out(codes):
    return codes.select("pid", "position", "latent", exprs.rounded("value").alias("value"))


@query("c13_dictionary_scores", f"select v.pid, v.position, d.latent, {r('list_inner_product(v.x, d.w)')} as value from o_x v cross join o_dict d")
def c13(spark, sf):
    return out(S.encode(I.vectors(spark, sf), S.Encoder(I.dictionary(spark, sf)), positive=False))


@query("c13_blocked_scores", f"select v.pid, v.position, d.latent, {r('list_inner_product(v.x, d.w)')} as value from o_x v cross join o_dict d")
def c13_blocked(spark, sf):
    """The path beyond the broadcast limit, with a limit low enough to take it."""
    return out(S.encode(I.vectors(spark, sf), S.Encoder(I.dictionary(spark, sf)), positive=False, limit_bytes=8192))


@query("h1_pre_activation", f"select pid, position, latent, {r('value')} as value from o_pre")
def h1(spark, sf):
    return out(S.encode(I.vectors(spark, sf), encoder(spark, sf), positive=False))


@query("h2_topk_encode", f"select pid, position, latent, {r('value')} as value from o_top")
def h2(spark, sf):
    return out(top_codes(spark, sf))


@query("e1_topk_per_row", f"select pid, position, latent, {r('value')} as value from (select *, row_number() over (partition by vec_id order by value desc, latent) as rn from o_pre where value > 0) where rn <= 3")
def e1(spark, sf):
    return out(S.top_per_row(S.encode(I.vectors(spark, sf), encoder(spark, sf)), 3))


define("o_btop", f"""select * from (select p.*, row_number() over (partition by p.pid order by value desc, p.position, latent) as rn, n from o_pre p
    join (select pid, count(*) as n from o_vec group by pid) b on p.pid = b.pid where value > 0) where rn <= {TOP} * n""")


@query("e2_batch_topk", f"select pid, position, latent, {r('value')} as value from o_btop")
def e2(spark, sf):
    codes = S.encode(I.vectors(spark, sf), encoder(spark, sf)).withColumn("batch", F.col("pid"))
    sizes = I.vectors(spark, sf).groupBy(F.col("pid").alias("batch")).agg(F.count("*").alias("rows"))
    return out(S.top_per_batch(codes, sizes, TOP))


@query("h3_batch_topk_scoring", f"select pid, position, latent, {r('value')} as value from o_pre where value > 0.12e0")
def h3(spark, sf):
    return out(S.above_threshold(S.encode(I.vectors(spark, sf), encoder(spark, sf)), 0.12))


@query("h4_jump_relu", f"select pid, position, latent, {r('value')} as value from o_pre where value > exp({LOG_THRESHOLD})")
def h4(spark, sf):
    return out(S.jump(S.encode(I.vectors(spark, sf), encoder(spark, sf), positive=False), latents(spark, sf)))


@query("h5_gated", f"select pid, position, latent, {r(f'dot * exp({R_MAG}) + {B_MAG}')} as value from o_dot where dot + {BIAS} > 0 and dot * exp({R_MAG}) + {B_MAG} > 0")
def h5(spark, sf):
    return out(S.gated(S.encode(I.vectors(spark, sf), encoder(spark, sf, bias=False), positive=False), latents(spark, sf)))


define("o_rec", f"""select c.vec_id, c.pid, c.position, d.d, (sum(c.value * d.w) + any_value(m.m)) / {SCALE}e0 as y from o_top c join o_dictlong d on c.latent = d.latent
    join o_mean m on m.d = d.d group by c.vec_id, c.pid, c.position, d.d""")


def reconstruction(spark, sf):
    return S.decode(top_codes(spark, sf), I.dictionary(spark, sf), S.mean_vector(I.vectors(spark, sf), DIM), SCALE)


@query("h6_decode", f"select pid, position, (d - 1)::bigint as dim, {r('y')} as value from o_rec")
def h6(spark, sf):
    return reconstruction(spark, sf).select("pid", "position", "dim", exprs.rounded("value").alias("value"))


@query("h7_unit_rows", f"select latent::bigint as latent, (d - 1)::bigint as dim, {r('w / greatest(sqrt(sum(w * w) over (partition by latent)), 1e-8)')} as w from o_dictlong")
def h7(spark, sf):
    rows = S.unit_rows(I.dictionary(spark, sf)).select("latent", F.posexplode("w").alias("dim", "w"))
    return rows.select("latent", F.col("dim").cast("bigint").alias("dim"), exprs.rounded("w").alias("w"))


@query("h8_activation_scale", f"select {r('1 / sqrt(avg(s))')} as scale from (select sum(x * x) as s from o_xlong group by vec_id)")
def h8(spark, sf):
    return S.activation_scale(I.vectors(spark, sf)).select(exprs.rounded("scale").alias("scale"))


@query("g8_geometric_median", "with " + ", ".join(
    ["c0 as (select d, m from o_mean)"] + [
        f"""w{i} as (select vec_id, 1 / greatest(sqrt(sum((x - c.m) * (x - c.m))), 1e-6) as w from o_xlong v join c{i} c on v.d = c.d group by vec_id),
        c{i + 1} as (select v.d, sum(v.x * w.w) / sum(w.w) as m from o_xlong v join w{i} w on v.vec_id = w.vec_id group by v.d)""" for i in range(20)]
    ) + f" select (d - 1)::bigint as dim, {r('m')} as value from c20")
def g8(spark, sf):
    centre = F.array(*[F.lit(c) for c in S.geometric_median(I.vectors(spark, sf), DIM)])
    row = I.vectors(spark, sf).agg(F.count("*").alias("n"))
    return row.select(F.posexplode(centre).alias("dim", "v")).select(F.col("dim").cast("bigint").alias("dim"), exprs.rounded("v").alias("value"))


@query("h9_activation_stats", f"""with n as (select sum(x * x) as s from o_xlong group by vec_id), m as (select d, avg(x) as mean, var_samp(x) as v from o_xlong group by d)
    select (select {r('avg(s)')} from n) as mean_sq_norm, (select {r('quantile_cont(sqrt(s), 0.5)')} from n) as norm_p50, (select {r('quantile_cont(sqrt(s), 0.99)')} from n) as norm_p99,
      (select {r('(select sum(v) from (select v from m order by v desc limit 5)) / sum(v)')} from m) as top5_variance_share, (select {r('max(abs(mean) / sqrt(v))')} from m) as max_mean_over_std""")
def h9(spark, sf):
    return T.activation_stats(I.vectors(spark, sf))


@query("h10_evaluation", f"""with b as (select v.vec_id, v.d, v.x, coalesce(y.y, 0) as y from o_xlong v left join o_rec y on v.vec_id = y.vec_id and v.d = y.d),
    p as (select vec_id, sum((x - y) * (x - y)) as sse, sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-8) as c, count(*) as k from b group by vec_id)
    select {r('sum(sse) / sum(k)')} as mse, {r('greatest(0, 1 - sum(sse) / (select sum(v) from (select var_pop(x) * count(*) as v from o_xlong group by d)))')} as explained_variance,
      {r('(select count(*) from o_top)::double / count(*)')} as l0_mean, {r('1 - (select count(distinct latent) from o_top) / 40e0')} as never_fired_fraction,
      {r('avg(c)')} as cosine_mean, {r('quantile_cont(c, 0.1)')} as cosine_p10 from p""")
def h10(spark, sf):
    return T.evaluation(I.vectors(spark, sf), top_codes(spark, sf), reconstruction(spark, sf), LATENTS)


@query("h11_density_histogram", """select least(floor((log10(greatest(d, 1e-12)) + 12) / 12 * 20)::bigint + 1, 20) as bin, count(*) as n
    from (select latent, count(*) / (select count(*) from o_vec)::double as d from o_top group by latent) group by bin""")
def h11(spark, sf):
    return T.density_histogram(top_codes(spark, sf), I.vectors(spark, sf).agg(F.count("*")).scalar())


@query("h12_alive_jaccard", f"""with a as (select distinct latent from o_pre where value > 0.12e0), b as (select distinct latent from o_pre where value > exp({LOG_THRESHOLD}))
    select {r('case when count(*) = 0 then 1 else count(*) filter (where a.latent is not null and b.latent is not null) / count(*)::double end')} as jaccard from a full join b on a.latent = b.latent""")
def h12(spark, sf):
    pre = S.encode(I.vectors(spark, sf), encoder(spark, sf), positive=False)
    return T.alive_jaccard(S.above_threshold(pre, 0.12), S.jump(pre, latents(spark, sf)))


@query("h13_pairwise_cosine", f"""with u as (select latent, d, w / greatest(sqrt(sum(w * w) over (partition by latent)), 1e-8) as w from o_dictlong),
    c as (select a.latent, b.latent as l2, abs(sum(a.w * b.w)) as c from u a join u b on a.d = b.d group by all)
    select {r('(sum(c) - 40) / (40e0 * 39e0)')} as mean_abs_cosine from c""")
def h13(spark, sf):
    unit = S.unit_rows(I.dictionary(spark, sf))
    rows = unit.select(F.col("latent").alias("pid"), F.lit(1).cast("bigint").alias("position"), F.col("w").alias("vec"))
    return T.mean_pairwise_cosine(S.encode(rows, S.Encoder(unit), positive=False), LATENTS)


DEAD = """with e as (select batch, sum(count(*)) over (order by batch) as batch_end from o_fire group by batch), t as (select count(*) as total from o_fire),
    l as (select latent, max(batch) filter (where fired) as b from o_fire group by latent)
    select l.latent, (t.total - coalesce(e.batch_end, 0))::bigint as tokens_since, t.total - coalesce(e.batch_end, 0) > 1000 as dead from l cross join t left join e on e.batch = l.b"""


@query("h14_dead_census", DEAD)
def h14(spark, sf):
    return T.dead_census(I.firing_log(spark, sf), 1000)


# tiers over every residue of the corpus
define("o_goldok", "select distinct accession, position from o_goldneg where not contradicted")
define("o_tier", """select l.pid, l.accession, l.position, l.residue, s.stratum, y.types, case when y.types is not null then null when g.accession is not null then 'gold'
      when c.accession is not null then 'hard' else 'background' end as tier
    from o_letters l join o_strata s on l.residue = s.residue left join (select accession, position, list(distinct type) as types from o_labels group by all) y on y.accession = l.accession and y.position = l.position
    left join (select distinct accession, position from o_mask) m on m.accession = l.accession and m.position = l.position left join o_goldok g on g.accession = l.accession and g.position = l.position
    left join (select distinct accession, stratum from o_labels) c on c.accession = l.accession and c.stratum = s.stratum where y.types is not null or m.accession is null""")


def tiers(spark, sf, residues=None):
    from sitelake.operators import agreement, sites

    c = full(spark, sf, materialize=True)
    gold = agreement.gold_negatives(I.gold_rows(spark, sf), c.deduped).where("not contradicted")
    rows = I.explode_residues(I.sequences(spark, sf), ["pid", "accession"]) if residues is None else residues
    return T.residue_tiers(rows, c.deduped.withColumn("stratum", sites.stratum_of_type()), c.mask, gold)


@query("h15_negative_tiers", "select stratum, coalesce(tier, 'positive') as tier, len(coalesce(types, [])) as n_types, count(*) as n from o_tier group by all")
def h15(spark, sf):
    types = F.coalesce(F.size("types"), F.lit(0))
    n_types = F.when(F.col("types").isNull(), 0).otherwise(types).cast("bigint")
    return tiers(spark, sf).groupBy("stratum", F.coalesce("tier", F.lit("positive")).alias("tier"), n_types.alias("n_types")).agg(F.count("*").alias("n"))


define("o_tc", "select t.*, c.latent from o_top c join o_tier t on c.pid = t.pid and c.position = t.position")
define("o_ta", "select t.* from o_vec v join o_tier t on v.pid = t.pid and v.position = t.position")


def held_residues(spark, sf, keep):
    return I.explode_residues(V.reached(I.sequences(spark, sf), I.vectors(spark, sf)), keep)


def tiers_with_codes(spark, sf):
    held = I.vectors(spark, sf).select("pid", "position")
    residues = held_residues(spark, sf, ["pid", "accession"]).join(held, ["pid", "position"])
    return top_codes(spark, sf), tiers(spark, sf, residues)


@query("h16_concentration_by_stratum", f"""with b as (select stratum, count(*) as total, count(types) as modified from o_ta group by stratum),
    h as (select stratum, latent, count(*) as active, count(types) as hit from o_tc group by all),
    x as (select b.stratum, h.latent, h.active, case when modified > 0 then (hit / active::double) / (modified / total::double) end as ratio from b left join h on h.stratum = b.stratum)
    select stratum, count(latent) as active_latents, {r('coalesce(avg(ratio), 0)')} as mean_ratio, count(*) filter (where ratio > 2) as over_2x,
      count(*) filter (where active >= 5 and ratio is not null) as supported, {r('coalesce(avg(ratio) filter (where active >= 5), 0)')} as supported_mean_ratio,
      {r('coalesce(count(*) filter (where active >= 5 and ratio > 2) / nullif(count(*) filter (where active >= 5 and ratio is not null), 0)::double, 0)')} as supported_share_over_2x
    from x group by stratum""")
def h16(spark, sf):
    return T.concentration_by_stratum(*tiers_with_codes(spark, sf), min_active=5)


@query("h17_concentration_by_type", f"""with ty as (select *, unnest(types) as type from o_ta), tc as (select *, unnest(types) as type from o_tc),
    s as (select stratum, count(*) as total from o_ta group by stratum), p as (select t.stratum, t.type, c.n as positives from o_types t left join (select stratum, type, count(*) as n from ty group by all) c on c.stratum = t.stratum and c.type = t.type),
    a as (select stratum, latent, count(*) as active from o_tc group by all), h as (select stratum, type, latent, count(*) as hit from tc group by all),
    x as (select p.stratum, p.type, a.latent, a.active, coalesce(h.hit, 0) as hit, coalesce(h.hit, 0) / a.active::double / (positives / total::double) as ratio
      from p left join s on s.stratum = p.stratum left join a on a.stratum = p.stratum left join h on h.stratum = p.stratum and h.type = p.type and h.latent = a.latent),
    y as (select *, max(ratio) over (partition by stratum, type) as best from x)
    select stratum, type, {r('coalesce(avg(ratio), 0)')} as mean_ratio, count(*) filter (where ratio > 2) as over_2x, {r('coalesce(max(ratio), 0)')} as best_ratio,
      count(*) filter (where best > 0 and ratio > 0.8e0 * best) as near_best, count(*) filter (where active >= 5 and hit >= 2) as supported,
      {r('coalesce(max(ratio) filter (where active >= 5 and hit >= 2), 0)')} as supported_best_ratio from y group by stratum, type""")
def h17(spark, sf):
    return T.concentration_by_type(*tiers_with_codes(spark, sf), min_active=5, min_hits=2, known=dims.types(spark))


@query("h18_shortcut_suspects", """with b as (select stratum, count(*) as total, count(types) as n_mod, count(*) filter (where tier = 'hard') as n_hard from o_ta group by stratum),
    h as (select stratum, latent, count(*) as active, count(types) as h_mod, count(*) filter (where tier = 'hard') as h_hard from o_tc group by all)
    select h.stratum, count(*) as active_latents, count(*) filter (where case when n_mod > 0 then (h_mod / active::double) / (n_mod / total::double) else 0 end > 2 and h_mod > 0
      and h_hard / greatest(1, n_hard)::double > 0.8e0 * (h_mod / greatest(1, n_mod)::double)) as suspects from h join b on h.stratum = b.stratum group by h.stratum""")
def h18(spark, sf):
    return T.shortcut_suspects(*tiers_with_codes(spark, sf))


define("o_ltop", """select * from (select *, row_number() over (partition by latent order by value desc, pid, position) as k from o_top) where k <= 10""")


def latent_top(spark, sf):
    return T.top_activations(top_codes(spark, sf), I.vectors(spark, sf).select("pid", "position", "label"), 10)


@query("e3_topk_per_latent", f"select latent, pid, position, label, {r('value')} as value from o_ltop")
def e3(spark, sf):
    return latent_top(spark, sf).select("latent", "pid", "position", "label", exprs.rounded("value").alias("value"))


@query("h19_dominance", f"""with s as (select latent, sum(n) as filled, max(n) / 10e0 as share from (select latent, label, count(*) as n from o_ltop group by all) group by latent having sum(n) = 10)
    select count(*) as alive, {r('avg(share)')} as mean_dominance, {", ".join(f"{r(f'(count(*) filter (where share >= {t}e0 - 1e-6)) / {d}')} as rate_{w}_{m}" for w, d in (('all', '40e0'), ('alive', 'greatest(1, count(*))')) for m, t in (('t', 0.75), ('50', 0.5), ('90', 0.9)))} from s""")
def h19(spark, sf):
    return T.dominance(latent_top(spark, sf), LATENTS, 10, 0.75)


@query("h21_covariance", f"""select (a.d - 1)::bigint as i, (b.d - 1)::bigint as j, {r('avg(a.x * b.x) - avg(a.x) * avg(b.x)')} as cov from o_xlong a join o_xlong b on a.vec_id = b.vec_id group by a.d, b.d""")
def h21(spark, sf):
    cov, _ = T.spectrum(I.vectors(spark, sf), DIM)
    flat = F.array(*[F.lit(float(v)) for v in cov.ravel()])  # d x d values, whatever the number of rows
    cells = I.vectors(spark, sf).agg(F.count("*").alias("n")).select(F.posexplode(flat).alias("c", "v"))
    return cells.select(F.expr(f"cast(c div {DIM} as bigint)").alias("i"), F.expr(f"cast(c % {DIM} as bigint)").alias("j"), exprs.rounded("v").alias("cov"))


@query("h21_spectrum")
def h21_spectrum(spark, sf):
    report = T.spectrum_report(*T.spectrum(I.vectors(spark, sf), DIM))
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(round(v, 6)).alias("value")) for k, v in report.items()])
    return I.vectors(spark, sf).agg(F.count("*").alias("n")).select(F.inline(pairs))


@query("h21_participation", """with c as (select a.d as i, b.d as j, avg(a.x * b.x) - avg(a.x) * avg(b.x) as cov from o_xlong a join o_xlong b on a.vec_id = b.vec_id group by a.d, b.d)
    select 'participation' as metric, round(pow(sum(cov) filter (where i = j), 2) / sum(cov * cov), 6) as value from c""")
def h21_participation(spark, sf):
    """The squared trace over the squared norm of the covariance: what its eigenvalues give, without them."""
    return h21_spectrum(spark, sf).where("metric = 'participation'")


@query("h22_class_variance", f"""with c as (select label, d, count(*) as n, var_pop(x) * count(*) as w from o_xlong group by all), s as (select label, sum(w) as within, max(n) as tokens from c group by label),
    t as (select sum(v) as t from (select var_pop(x) * count(*) as v from o_xlong group by d)), m as (select label, avg(s) as norm from (select label, sqrt(sum(x * x)) as s from o_xlong group by label, vec_id) group by label)
    select s.label, tokens, {r('norm')} as mean_norm, {r('within / (select sum(within) from s)')} as share_of_within, {r('1 - (select sum(within) from s) / (select t from t)')} as explained from s join m on s.label = m.label""")
def h22(spark, sf):
    return T.class_variance(I.vectors(spark, sf), "label")


@query("h23_chain_ends", f"""with x as (select least(position - 1, 20 - position) < 5 as near_end, vec_id, x, x - avg(x) over (partition by d) as dev from o_xlong),
    v as (select near_end, vec_id, sum(dev * dev) as dev, sqrt(sum(x * x)) as norm from x group by all)
    select near_end, count(*) as tokens, {r('count(*) / (select count(*) from v)::double')} as token_share, {r('sum(dev) / (select sum(dev) from v)')} as deviation_share, {r('avg(norm)')} as mean_norm from v group by near_end""")
def h23(spark, sf):
    return T.end_share(I.vectors(spark, sf), exprs.end_distance("position", F.lit(20)) < 5)


@query("h24_sparse_oracle", f"""with x as (select label, vec_id, (x - avg(x) over (partition by d)) as e from o_xlong), q as (select label, vec_id, e * e as e, row_number() over (partition by vec_id order by e * e desc) as rn from x)
    select label, k, {r('sum(e) filter (where rn <= k) / sum(e)')} as share_kept from q cross join (select unnest([4, 8, 16, 32])::bigint as k) group by label, k""")
def h24(spark, sf):
    return T.sparse_oracle(I.vectors(spark, sf), S.mean_vector(I.vectors(spark, sf), DIM), [4, 8, 16, 32], ["label"])


@query("h24_sparse_bases")
def h24_bases(spark, sf):
    return T.sparse_bases(I.vectors(spark, sf), DIM, [4, 8, 16, 32, 64], "label")[0]


@query("h24_sparse_bases_raw", f"""with x as (select vec_id, x - avg(x) over (partition by d) as e from o_xlong), q as (select vec_id, e * e as e, row_number() over (partition by vec_id order by e * e desc) as rn from x)
    select k, {r('sum(e) filter (where rn <= k) / sum(e)')} as raw_sparse, k = 64 as whole from q cross join (select unnest([4, 8, 16, 32, 64])::bigint as k) group by k""")
def h24_raw(spark, sf):
    """What SQL can say of the bases: the raw shares, and that all coefficients of any basis explain everything."""
    rows = h24_bases(spark, sf)
    whole = (F.col("pca_dense") > 0.999999) & (F.col("pca_sparse") > 0.999999) & (F.col("raw_sparse") > 0.999999)
    return rows.select("k", exprs.rounded("raw_sparse").alias("raw_sparse"), whole.alias("whole"))


@query("h24_classes")
def h24_classes(spark, sf):
    return T.sparse_bases(I.vectors(spark, sf), DIM, [32], "label")[1]


@query("h20_chance_rate", " union all ".join(f"""select {t}e0 as threshold, {r(f"1 - p[11] * {math.factorial(10)}e0")} as chance from (select list_reduce(list_prepend([1e0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], list([n / total] order by n)),
      lambda a, q: list_transform(range(0, 11), lambda d: list_sum(list_transform(range(0, least(d, {math.ceil(t * 10 - 1e-6) - 1}) + 1), lambda j: a[d - j + 1] * pow(q[1], j) / factorial(j::int)::double)))) as p
      from (select count(*)::double as n, sum(count(*)) over ()::double as total from o_vec group by label))""" for t in (0.5, 0.75, 0.9)))
def h20(spark, sf):
    counts = I.vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    rows = [T.exact_chance(counts, 10, t) for t in (0.5, 0.75, 0.9)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("h26_architecture_metrics", f"""with p as (select latent, sqrt(list_inner_product(w, w)) as norm, exp({LOG_THRESHOLD}) as t from o_dict),
    h as (select sum((exp(2 * 4 * abs(value) * norm) - 1) / (exp(2 * 4 * abs(value) * norm) + 1)) as th, sum((greatest(0, t - value) - greatest(0, t)) * norm) as pa from o_top c join p on c.latent = p.latent)
    select {r('avg(norm)')} as norm_mean, {r('stddev_samp(norm)')} as norm_std, {r('avg(t)')} as threshold_mean, {r('stddev_samp(t)')} as threshold_std,
      {r('(select th from h) / (select count(*) from o_vec)')} as tanh_mean, {r('sum(greatest(0, t) * norm) + (select pa from h) / (select count(*) from o_vec)')} as preact_mean from p""")
def h26(spark, sf):
    rows = latents(spark, sf).select("latent", "w", F.exp("log_threshold").alias("threshold"))
    return T.architecture_metrics(top_codes(spark, sf), rows, I.vectors(spark, sf).agg(F.count("*")).scalar())


@query("d27_mean_pooling", f"select pid, (d - 1)::bigint as dim, {r('avg(x)')} as value from o_xlong group by pid, d")
def d27(spark, sf):
    rows = V.mean_vectors(I.vectors(spark, sf)).select("pid", F.posexplode("mean_vec").alias("dim", "v"))
    return rows.select("pid", F.col("dim").cast("bigint").alias("dim"), exprs.rounded("v").alias("value"))


@query("c12_vectors_with_residues", "select v.pid, v.position, l.residue, v.label from o_vec v join o_letters l on v.pid = l.pid and v.position = l.position")
def c12(spark, sf):
    return V.aligned(I.vectors(spark, sf), held_residues(spark, sf, ["pid"])).select("pid", "position", "residue", "label")


@query("b16_length_guard", """select p.pid, least(count(v.position), any_value(p.length)) as n_used from o_prot p join o_vec v on v.pid = p.pid group by p.pid""")
def b16(spark, sf):
    rows = V.aligned(I.vectors(spark, sf), held_residues(spark, sf, ["pid"]))
    return rows.groupBy("pid").agg(F.count("*").alias("n_used"))


CAPACITY = 50_000
define("o_entries", "select partition, pid as seq, pid as id, length, row_number() over (partition by partition order by pid) as rn from o_prot")
define("o_plan", f"""with recursive w as (select partition, rn, id, length, 0::bigint as shard, 0::bigint as start_offset from o_entries where rn = 1
    union all select e.partition, e.rn, e.id, e.length, case when w.start_offset + w.length + e.length > {CAPACITY} then w.shard + 1 else w.shard end,
      case when w.start_offset + w.length + e.length > {CAPACITY} then 0 else w.start_offset + w.length end from w join o_entries e on e.partition = w.partition and e.rn = w.rn + 1)
    select partition, id, length, shard, start_offset, start_offset + length as end_offset from w""")


def index(spark, sf):
    rows = I.sequences(spark, sf).withColumn("partition", I.partition_of(F.col("pid")))
    return V.shard_plan(rows.select("partition", F.col("pid").alias("seq"), F.col("pid").alias("id"), "length"), CAPACITY)


@query("e6_shard_plan", "select * from o_plan")
def e6(spark, sf):
    return index(spark, sf).select("partition", "id", "length", "shard", "start_offset", "end_offset")


@query("a17_shard_layout", "select partition, shard, count(*) as n_ids, sum(length)::bigint as tokens, max(end_offset) as end_offset from o_plan group by all")
def a17(spark, sf):
    return index(spark, sf).groupBy("partition", "shard").agg(F.count("*").alias("n_ids"), F.sum("length").alias("tokens"), F.max("end_offset").alias("end_offset"))


@query("a18_vector_lookup", f"""with ix as (select pid as id, count(*) as length from o_vec group by pid), q as (select event_id, user_id as id, event_id % 25 as position from events)
    select q.event_id, q.id, q.position, case when ix.id is null then 'unknown_id' when q.position < 1 or q.position > ix.length then 'out_of_range' else 'ok' end as status,
      {r('v.x[1]')} as first_value from q left join ix on ix.id = q.id left join o_x v on v.pid = q.id and v.position = q.position""")
def a18(spark, sf):
    ix = I.vectors(spark, sf).groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("length"))
    requests = I.table(spark, sf, "events").select("event_id", F.col("user_id").alias("id"), (F.col("event_id") % 25).alias("position"))
    found = V.lookup(requests, ix, I.vectors(spark, sf))
    return found.select("event_id", "id", "position", "status", exprs.rounded(F.get("vec", F.lit(0)).cast("double")).alias("first_value"))


WANTED = "select pid as id from o_prot where lang = 'en' union all select doc_id + 1000000000 from labels where toxic = 1"


def wanted(spark, sf):
    extra = I.table(spark, sf, "labels").where("toxic = 1").select((F.col("doc_id") + 1_000_000_000).alias("id"))
    return I.sequences(spark, sf).where("lang = 'en'").select(F.col("pid").alias("id")).unionByName(extra)


@query("c10_coverage", f"select count(*) as n_wanted, count(shard) as n_covered, coalesce(sum(length), 0)::bigint as tokens from (select distinct id from ({WANTED})) w left join o_plan p using (id)")
def c10(spark, sf):
    return V.coverage(index(spark, sf), wanted(spark, sf))


@query("c11_needed_shards", f"select distinct partition, shard from o_plan where id in ({WANTED})")
def c11(spark, sf):
    return V.needed_shards(index(spark, sf), wanted(spark, sf))


@query("e10_budgeted_sample", "select partition, shard, id, length from (select *, coalesce(sum(length) over (partition by partition, shard order by start_offset rows between unbounded preceding and 1 preceding), 0) as b from o_plan) where b < 20000")
def e10(spark, sf):
    return V.budgeted_sample(index(spark, sf), 20_000).select("partition", "shard", "id", "length")


SHARD_TOKENS = 110
define("o_ventries", "select case when pid % 2 = 0 then 1 else 2 end as version, case when pid % 10 < 7 then 'discovery_train' when pid % 10 = 7 then 'discovery_val' else 'held_out' end as partition, pid as id, count(*) as length from o_vec group by pid")
define("o_vrank", "select *, row_number() over (partition by version, partition order by id) as rn from o_ventries")
STORE = f"""with recursive w as (select version, partition, rn, id, length, 0::bigint as shard, 0::bigint as start_offset from o_vrank where rn = 1
    union all select e.version, e.partition, e.rn, e.id, e.length, case when w.start_offset + w.length + e.length > {SHARD_TOKENS} then w.shard + 1 else w.shard end,
      case when w.start_offset + w.length + e.length > {SHARD_TOKENS} then 0 else w.start_offset + w.length end from w join o_vrank e on e.version = w.version and e.partition = w.partition and e.rn = w.rn + 1),
    f as (select partition, max(shard) + 1 as first from w where version = 1 group by partition),
    p as (select w.version, w.partition, w.shard + case when w.version = 2 then coalesce(f.first, 0) else 0 end as shard, w.id, w.length, w.start_offset from w left join f using (partition))
    select version, p.partition, shard, count(distinct id) as n_ids, count(*) as n_rows, max(start_offset + length) as end_offset, {r('avg(v.vec[1]::double)')} as mean_first
    from p join o_vec v on v.pid = p.id group by version, p.partition, shard"""


def store(spark, sf, odd=True):
    """Even ids, the same once more, then all: three calls, two versions."""
    from sitelake.operators.vector_store import VectorStore
    from sitelake.session import ensure_checkpoint_dir

    held = VectorStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-store-{uuid.uuid4().hex}", SHARD_TOKENS)
    rows = I.vectors(spark, sf)
    entries = rows.groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("length")).select(I.partition_of(F.col("id")).alias("partition"), F.col("id").alias("seq"), "id", "length")
    even = F.col("id") % 2 == 0
    held.commit(entries.where(even), rows)
    held.commit(entries.where(even), rows)
    held.commit(entries, rows)
    return held


@query("a17_committed_store", STORE)
def a17_store(spark, sf):
    held = store(spark, sf)
    rows = held.vectors().groupBy("attempt", "partition", "shard").agg(F.count("*").alias("n_rows"), exprs.rounded(F.avg(F.col("vec")[0].cast("double"))).alias("mean_first"))
    ids = held.index().groupBy(F.col("version").cast("bigint").alias("version"), "attempt", "partition", "shard").agg(F.count("*").alias("n_ids"), F.max("end_offset").alias("end_offset"))
    return ids.join(rows, ["attempt", "partition", "shard"]).drop("attempt")


@query("c11_pruned_read", f"select pid, position, {r('vec[1]::double')} as first_value from o_vec where pid % 7 = 3")
def c11_read(spark, sf):
    held = store(spark, sf)
    wanted = held.index().where("id % 7 = 3").select("id")
    return held.read(wanted).select("pid", "position", exprs.rounded(F.col("vec")[0].cast("double")).alias("first_value"))


@query("e10_seeded_sample", """with d as (select partition, shard from (select distinct partition, shard from o_plan) order by md5('7:' || partition || ':' || shard), partition, shard limit 3),
    r as (select p.partition, p.shard, p.id, p.length, coalesce(sum(p.length) over (partition by p.partition, p.shard order by md5('7:' || p.id), p.id rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from o_plan p join d using (partition, shard))
    select * from r where before < 60000 // (select greatest(1, count(*)) from d)""")
def e10_seeded(spark, sf):
    return V.seeded_sample(index(spark, sf), tokens=60_000, shards=3, seed=7)


@query("e7_epoch_order")
def e7(spark, sf):
    return V.epoch_order(index(spark, sf).select("partition", "shard").distinct(), seed=7, epoch=1, workers=4)


@query("e8_shuffled_batches")
def e8(spark, sf):
    return V.shuffled_batches(I.vectors(spark, sf).select("pid", "position"), ["pid", "position"], seed=7, epoch=1, batch=64)


@query("e7_epoch_checks", """select count(*) as shards, count(*) as places, 0 as first_place, count(*) - 1 as last_place, (count(*) + 3) // 4 as most_per_worker from (select distinct partition, shard from o_plan)""")
def e7_checks(spark, sf):
    """Every shard at a place of its own, places without gaps, shards spread evenly over the workers."""
    order = e7(spark, sf)
    most = order.groupBy("worker").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    return order.agg(F.count_distinct("partition", "shard").alias("shards"), F.count_distinct("place").alias("places"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), most.alias("most_per_worker"))


@query("e8_batch_sizes", """select 64 as size, count(*) // 64 as n_batches from embeddings having count(*) >= 64 union all select count(*) % 64, 1 from embeddings having count(*) % 64 > 0""")
def e8_sizes(spark, sf):
    """Every row in one batch, all batches full but the last."""
    sizes = e8(spark, sf).groupBy("batch").agg(F.count_distinct("pid", "position").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_batches"))


@query("e9_strided_sample", """with n as (select greatest(1, count(*) // 64 // 3) as stride from o_vec), b as (select vec_id // 64 as batch, pid, position from o_vec)
    select batch, pid, position from b, n where batch % stride = 0 and batch < stride * 3""")
def e9(spark, sf):
    rows = I.vectors(spark, sf).select("pid", "position").withColumn("batch", F.expr("(pid * 20 + position - 1) div 64"))
    total = I.vectors(spark, sf).count()
    return V.strided_sample(rows, total, 64, 3).select("batch", "pid", "position")


@query("h25_feature_extraction", "select pid, length as n_vectors from o_seq where pid not in (select vec_id // 20 from embeddings)")
def h25(spark, sf):
    from sitelake.operators.extraction import extract, hashed_kmers

    vectors = extract(I.sequences(spark, sf), hashed_kmers(), committed=I.vectors(spark, sf))
    return vectors.groupBy("pid").agg(F.count("vec").alias("n_vectors"))


define("o_codes", """select pid, position, ascii(residue) - 64 as own, case prev when '' then 0 else ascii(prev) - 64 end as l, case next when '' then 0 else ascii(next) - 64 end as r from o_ctx""")
_parts = ("own", "l", "r", "(31 * l + 7 * own + r) % 101")


@query("h25_committed_vectors", f"""select pid, count(*) as n_vectors, {', '.join(f"sum(position * ({p}))::bigint as placed_{i}, {r(f'sum({p})::double / count(*)')} as mean_{i}" for i, p in enumerate(_parts))} from o_codes group by pid""")
def h25_committed(spark, sf):
    """Vectors of even ids, then of all: two versions, no id twice; each component summed by position, and the stored means."""
    from sitelake.operators.extraction import extract_into, neighbour_codes
    from sitelake.operators.vector_store import VectorStore
    from sitelake.session import ensure_checkpoint_dir

    held = VectorStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracted-{uuid.uuid4().hex}", 1 << 20)
    rows = I.sequences(spark, sf).select("pid", "sequence", "length", I.partition_of(F.col("pid")).alias("partition"))
    extract_into(held, rows.where("pid % 2 = 0"), neighbour_codes)
    extract_into(held, rows, neighbour_codes)
    placed = [F.sum(F.col("position") * F.col("vec")[i].cast("bigint")).alias(f"placed_{i}") for i in range(4)]
    sums = held.vectors().groupBy("pid").agg(F.count("*").alias("n_vectors"), *placed)
    return sums.join(held.means().select("pid", *[exprs.rounded(F.col("mean_vec")[i]).alias(f"mean_{i}") for i in range(4)]), "pid")
