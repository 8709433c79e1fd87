"""Statistics over vectors and sparse codes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators.quantiles import exact_quantiles
from sitelake.operators.scoring import ROW, mean_vector, partition_sums
from sitelake.operators.vectors import dimension_sums
from sitelake.session import cut_lineage

r = exprs.rounded


def long_vectors(vectors: DataFrame, keep: list[str]) -> DataFrame:
    return vectors.select(*keep, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def dimension_moments(vectors: DataFrame) -> DataFrame:
    squares = F.greatest(F.col("q") - F.col("s") ** 2 / F.col("n"), F.lit(0.0))
    return dimension_sums(vectors, []).select(
        "dim", (F.col("s") / F.col("n")).alias("mean"), (squares / F.col("n")).alias("var_pop"), F.when(F.col("n") > 1, squares / (F.col("n") - 1)).alias("var_samp"), "n")


def activation_stats(vectors: DataFrame) -> DataFrame:
    """Mean squared norm, norm percentiles, variance share of the five widest dimensions, max |mean| / std."""
    squares = vectors.select(exprs.sum_squares("vec").alias("s"))
    found = cut_lineage(exact_quantiles(squares.select(F.sqrt("s").alias("norm")), "norm", [0.5, 0.99]))
    quantile = lambda p: r(found.where(F.col("share") == p).select("value").scalar())
    norms = squares.agg(r(F.avg("s")).alias("mean_sq_norm")).select("*", quantile(0.5).alias("norm_p50"), quantile(0.99).alias("norm_p99"))
    moments = dimension_moments(vectors)
    packed = moments.agg(F.sort_array(F.collect_list("var_samp"), asc=False).alias("v"), F.max(F.abs("mean") / F.sqrt("var_samp")).alias("offset"))  # one value per dimension
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    row = packed.select(r(add(F.slice("v", 1, 5)) / add(F.col("v"))).alias("top5_share"), r("offset").alias("max_offset"))
    return norms.select("*", row.select("top5_share").scalar().alias("top5_variance_share"), row.select("max_offset").scalar().alias("max_mean_over_std"))


def evaluation(vectors: DataFrame, codes: DataFrame, reconstruction: DataFrame, n_latents: int) -> DataFrame:
    """MSE, explained variance (population variance per dimension, clamped at 0), mean L0, never-fired share,
    cosine mean and 10th percentile. ``reconstruction`` is long (pid, position, dim, value); absent is zero."""
    x = long_vectors(vectors, ROW)
    both = x.join(reconstruction.withColumnRenamed("value", "y"), [*ROW, "dim"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    per_row = both.groupBy(*ROW).agg(
        F.sum((F.col("x") - F.col("y")) ** 2).alias("sse"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"),
        F.sum(F.col("y") ** 2).alias("yy"), F.count("*").alias("d"))
    cosine = F.col("xy") / F.greatest(F.sqrt("xx") * F.sqrt("yy"), F.lit(1e-8))
    per_row = cut_lineage(per_row.select("sse", "d", cosine.alias("cosine")))
    sums = per_row.agg(F.sum("sse").alias("sse"), F.sum("d").alias("cells"), F.count("*").alias("rows"), F.avg("cosine").alias("cm"))
    low = exact_quantiles(per_row, "cosine", [0.1]).select("value").scalar()
    total = dimension_moments(vectors).agg(F.sum(F.col("var_pop") * F.col("n"))).scalar()
    fired = codes.where("value > 0").groupBy("latent").agg(F.count("*").alias("n")).agg(F.count("*").alias("alive"), F.sum("n").alias("l0"))
    alive, l0 = fired.select("alive").scalar(), fired.select("l0").scalar()
    return sums.select(
        r(F.col("sse") / F.col("cells")).alias("mse"), r(F.greatest(F.lit(0.0), 1 - F.col("sse") / total)).alias("explained_variance"),
        r(F.coalesce(l0, F.lit(0)) / F.col("rows")).alias("l0_mean"), r(1 - alive / F.lit(float(n_latents))).alias("never_fired_fraction"),
        r("cm").alias("cosine_mean"), r(low).alias("cosine_p10"))


def density_histogram(codes: DataFrame, n_rows, bins: int = 20) -> DataFrame:
    """log10 of the firing share of alive latents over [-12, 0]; the right edge falls in the last bin."""
    share = codes.where("value > 0").groupBy("latent").agg((F.count("*") / n_rows).alias("d"))
    slot = F.least(F.width_bucket(F.log10(F.greatest("d", F.lit(1e-12))), F.lit(-12.0), F.lit(0.0), F.lit(bins)), F.lit(bins))
    return share.groupBy(slot.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def alive_jaccard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Intersection over union of the alive latents of two passes, 1.0 when neither has any."""
    one = lambda f, n: f.where("value > 0").select("latent").distinct().withColumn(n, F.lit(1))
    both = one(before, "l").join(one(after, "r"), "latent", "full")
    return both.agg(r(F.when(F.count("*") == 0, 1.0).otherwise(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.count("*"))).alias("jaccard"))


def dead_census(firing: DataFrame, window: int) -> DataFrame:
    """Tokens since a latent last fired, at batch granularity: (latent, tokens_since, dead)."""
    ends = firing.groupBy("batch").agg(F.count("*").alias("tokens"))
    upto = running_total(ends, "batch", "tokens", "batch_end")
    total = ends.agg(F.sum("tokens")).scalar()
    last = firing.groupBy("latent").agg(F.max(F.when(F.col("fired"), F.col("batch"))).alias("batch"))
    since = total - F.coalesce("batch_end", F.lit(0))
    return last.join(upto, "batch", "left").select("latent", since.alias("tokens_since"), (since > window).alias("dead"))


def running_total(rows: DataFrame, order: str, value: str, name: str, slot_rows: int = 10_000) -> DataFrame:
    """Inclusive running sum over an integer order key, through key ranges so no task holds all rows."""
    slotted = rows.withColumn("slot", F.floor(F.col(order) / slot_rows))
    sums = slotted.groupBy("slot").agg(F.sum(value).alias("t"))
    ahead = sums.select("slot", F.coalesce(F.sum("t").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("slot").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slotted.join(ahead, "slot").withColumn(name, F.sum(value).over(inner) + F.col("ahead")).drop("slot", "ahead")


def spectrum(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Population covariance and its eigenvalues (descending). The d x d sums are built on the executors."""

    def fold(pdf):
        x = np.vstack(pdf["vec"].to_numpy()).astype("float64")
        return np.concatenate([(x.T @ x).ravel(), x.sum(axis=0), [len(x)]])

    sums = partition_sums(vectors, fold, dim * dim + dim + 1, ["vec"])
    n = sums[-1]
    mean = sums[dim * dim:-1] / n
    cov = sums[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean)
    return cov, np.sort(np.linalg.eigvalsh(cov))[::-1]


def spectrum_report(cov: np.ndarray, eigen: np.ndarray) -> dict[str, float]:
    share = np.cumsum(eigen) / eigen.sum()
    report = {f"components_{int(t * 100)}": float(np.searchsorted(share, t) + 1) for t in (0.5, 0.8, 0.9, 0.95, 0.99)}
    keep = np.sort(np.argsort(np.diag(cov))[:-5])
    narrow = np.linalg.eigvalsh(cov[np.ix_(keep, keep)])
    ratio = lambda e: float(e.sum() ** 2 / (e**2).sum())
    return report | {"top1_share": float(share[0]), "top10_share": float(share[min(9, len(share) - 1)]), "participation": ratio(eigen), "participation_without_top5": ratio(narrow)}


def class_variance(vectors: DataFrame, label: str) -> DataFrame:
    """Per class: tokens, mean norm, share of the within-class squares; plus variance explained by the class."""
    cells = dimension_sums(vectors, [label])
    within = cells.groupBy(label).agg(F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("within"), F.max("n").alias("tokens"))
    total = cells.groupBy("dim").agg((F.sum("q") - F.sum("s") ** 2 / F.sum("n")).alias("t")).agg(F.sum("t")).scalar()
    all_within = within.agg(F.sum("within")).scalar()
    norms = vectors.groupBy(label).agg(F.avg(F.sqrt(exprs.sum_squares("vec"))).alias("norm"))
    return within.join(norms, label).select(
        label, "tokens", r("norm").alias("mean_norm"), r(F.col("within") / all_within).alias("share_of_within"), r(1 - all_within / total).alias("explained"))


def end_share(vectors: DataFrame, near_end) -> DataFrame:
    """Share of tokens and of squared deviation at chain ends, and mean norms on both sides."""
    flagged = vectors.withColumn("near_end", near_end)
    cells = dimension_sums(flagged, ["near_end"])
    means = cells.groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("m"))
    deviation = cells.join(F.broadcast(means), "dim").groupBy("near_end").agg(
        F.sum(F.col("q") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") ** 2).alias("dev"), F.max("n").alias("tokens"))
    norms = flagged.groupBy("near_end").agg(F.avg(F.sqrt(exprs.sum_squares("vec"))).alias("norm"))
    total_dev, total_n = deviation.agg(F.sum("dev")).scalar(), deviation.agg(F.sum("tokens")).scalar()
    return deviation.join(norms, "near_end").select(
        "near_end", "tokens", r(F.col("tokens") / total_n).alias("token_share"), r(F.col("dev") / total_dev).alias("deviation_share"), r("norm").alias("mean_norm"))


def sparse_oracle(vectors: DataFrame, centre: list[float], ks: list[int], group: list[str] | None = None) -> DataFrame:
    """Share of squared deviation kept by the k largest squared coefficients per row, raw basis."""
    middle = F.array(*[F.lit(float(c)) for c in centre])
    squares = F.sort_array(F.zip_with("vec", middle, lambda x, c: (x.cast("double") - c) * (x.cast("double") - c)), asc=False)
    rows = vectors.select(*(group or []), squares.alias("sq"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    kept = [F.struct(F.lit(k).cast("bigint").alias("k"), add(F.slice("sq", 1, k)).alias("kept"), add(F.col("sq")).alias("total")) for k in ks]
    out = rows.select(*(group or []), F.inline(F.array(*kept)))
    return out.groupBy(*(group or []), "k").agg(r(F.sum("kept") / F.sum("total")).alias("share_kept"))


def sparse_bases(vectors: DataFrame, dim: int, ks: list[int], label: str, class_k: int = 32) -> tuple[DataFrame, DataFrame]:
    """Two tables: (k, pca_dense, pca_sparse, raw_sparse), the variance that k coefficients explain if they are the first principal components, the largest of
    each row in the principal basis, or the largest of each row as it stands; and (label, explained, share_of_unexplained) per class for
    ``class_k`` coefficients in the principal basis. The basis comes from the d x d sums; every row is turned, ranked and added up in its task."""
    spark = vectors.sparkSession
    cov, _ = spectrum(vectors, dim)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    mean = np.array(mean_vector(vectors, dim))
    classes = [row[0] for row in vectors.select(label).distinct().sort(label).collect()]  # one per class
    at = {c: i for i, c in enumerate(classes)}
    n, limits = len(ks), [min(k, dim) for k in ks]

    def kept(x: np.ndarray, k: int) -> np.ndarray:
        return np.partition(x * x, dim - k, axis=1)[:, dim - k:].sum(axis=1)

    def fold(pdf):
        x = np.vstack(pdf["vec"].to_numpy()).astype("float64") - mean
        turned, total, code = x @ basis, (x * x).sum(axis=1), pdf[label].map(at).to_numpy()
        sums = [kept(turned, k).sum() for k in limits] + [kept(x, k).sum() for k in limits]
        per_class = [np.bincount(code, w, len(classes)) for w in (total, kept(turned, min(class_k, dim)))]
        return np.concatenate([sums, *per_class])

    out = partition_sums(vectors, fold, 2 * n + 2 * len(classes), ["vec", label])
    totals, held = out[2 * n: 2 * n + len(classes)], out[2 * n + len(classes):]
    total, dense = totals.sum(), np.cumsum(values) / values.sum()
    rounded = lambda v: round(float(v), 6)
    by_k = [(k, rounded(dense[c - 1]), rounded(out[i] / total), rounded(out[n + i] / total)) for i, (k, c) in enumerate(zip(ks, limits))]
    by_class = [(c, rounded(held[i] / totals[i]), rounded((totals[i] - held[i]) / (total - held.sum()))) for i, c in enumerate(classes)]
    kind = vectors.schema[label].dataType.simpleString()
    return (spark.createDataFrame(by_k, "k bigint, pca_dense double, pca_sparse double, raw_sparse double"),
            spark.createDataFrame(by_class, f"{label} {kind}, explained double, share_of_unexplained double"))


def mean_pairwise_cosine(codes_of_self: DataFrame, n: int) -> DataFrame:
    """From all scores of the unit dictionary against itself: (sum |cos| - n) / (n (n - 1))."""
    return codes_of_self.agg(r((F.sum(F.abs("value")) - n) / float(n * (n - 1))).alias("mean_abs_cosine"))


def architecture_metrics(codes: DataFrame, latents: DataFrame, n_rows, c: float = 4.0) -> DataFrame:
    """Decoder norms, thresholds, and two row means: sum tanh(c |f| norm), and sum relu(theta - f) norm where
    a silent latent counts with its whole threshold. ``latents``: latent, w, threshold."""
    info = latents.select("latent", F.sqrt(exprs.sum_squares("w")).alias("norm"), "threshold")
    params = info.agg(r(F.avg("norm")).alias("norm_mean"), r(F.stddev_samp("norm")).alias("norm_std"), r(F.avg("threshold")).alias("threshold_mean"),
                      r(F.stddev_samp("threshold")).alias("threshold_std"), F.sum(F.greatest(F.lit(0.0), "threshold") * F.col("norm")).alias("silent"))
    hit = codes.join(info, "latent").agg(
        F.sum(F.tanh(c * F.abs("value") * F.col("norm"))).alias("t"),
        F.sum((F.greatest(F.lit(0.0), F.col("threshold") - F.col("value")) - F.greatest(F.lit(0.0), "threshold")) * F.col("norm")).alias("p"))
    return params.select(
        "norm_mean", "norm_std", "threshold_mean", "threshold_std", r(hit.select("t").scalar() / n_rows).alias("tanh_mean"),
        r(F.col("silent") + hit.select("p").scalar() / n_rows).alias("preact_mean"))


def residue_tiers(residues: DataFrame, labels: DataFrame, mask: DataFrame, gold: DataFrame) -> DataFrame:
    """Every residue of a known stratum with its types or negative tier: gold if listed, hard if its protein has
    a positive of that stratum, else background. Mask and gold apply to the position whatever the type.
    ``residues``: pid, accession, position, residue."""
    spark = residues.sparkSession
    rows = residues.join(F.broadcast(dims.strata(spark).select("stratum", "residue")), "residue")
    positive = labels.groupBy("accession", "position").agg(F.array_sort(F.collect_set("type")).alias("types"))
    per_protein = labels.select("accession", "stratum").distinct().withColumn("carrier", F.lit(True))
    flag = lambda f, n: f.select("accession", "position").distinct().withColumn(n, F.lit(True))
    joined = (
        rows.join(positive, ["accession", "position"], "left").join(flag(mask, "is_masked"), ["accession", "position"], "left")
        .join(flag(gold, "is_gold"), ["accession", "position"], "left").join(per_protein, ["accession", "stratum"], "left")
    )
    tier = F.when(F.col("types").isNotNull(), F.lit(None)).when(F.col("is_gold"), "gold").when(F.col("carrier"), "hard").otherwise("background")
    return joined.where("types is not null or is_masked is null").select("pid", "accession", "position", "residue", "stratum", "types", tier.alias("tier"))


def concentration_by_stratum(codes: DataFrame, tiers: DataFrame, min_active: int = 20) -> DataFrame:
    """Per stratum: mean over active latents of (modified share when active / base rate), latents over 2x, and
    the same for latents with enough active residues. Every stratum has a row; one that is silent or has no
    modified residue has zeros besides its active latents."""
    mod = F.col("types").isNotNull()
    base = tiers.groupBy("stratum").agg(F.count("*").alias("total"), F.count_if(mod).alias("modified"))
    hits = codes.join(tiers, ROW).groupBy("stratum", "latent").agg(F.count("*").alias("active"), F.count_if(mod).alias("hit"))
    ratio = F.when(F.col("modified") > 0, (F.col("hit") / F.col("active")) / (F.col("modified") / F.col("total")))
    rows = base.join(hits, "stratum", "left").withColumn("ratio", ratio).withColumn("ok", ratio.isNotNull() & (F.col("active") >= min_active))
    over, zero = F.col("ratio") > 2, F.lit(0.0)
    return rows.groupBy("stratum").agg(
        F.count("latent").alias("active_latents"), r(F.coalesce(F.avg("ratio"), zero)).alias("mean_ratio"), F.count_if(over).alias("over_2x"),
        F.count_if("ok").alias("supported"), r(F.coalesce(F.avg(F.when(F.col("ok"), F.col("ratio"))), zero)).alias("supported_mean_ratio"),
        r(F.coalesce(F.avg(F.when(F.col("ok"), over.cast("double"))), zero)).alias("supported_share_over_2x"))


def concentration_by_type(codes: DataFrame, tiers: DataFrame, min_active: int = 20, min_hits: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Per (stratum, type): mean ratio over the latents active in the stratum, latents over 2x, the best ratio, how many
    come near it, and latents with enough active residues and hits (``min_hits`` is 1 at least). A residue with several
    types counts once for each; a pair that no latent meets has zeros, and so has every pair of ``known`` (stratum, type) without a positive."""
    typed = tiers.select(*ROW, "stratum", F.explode("types").alias("type"))
    strata = tiers.groupBy("stratum").agg(F.count("*").alias("total"))
    pairs = typed.groupBy("stratum", "type").agg(F.count("*").alias("positives"))
    if known is not None:
        pairs = known.select("stratum", "type").join(pairs, ["stratum", "type"], "full")
    pairs = pairs.join(strata, "stratum", "left")
    active = codes.join(tiers.select(*ROW, "stratum"), ROW).groupBy("stratum", "latent").agg(F.count("*").alias("active"))
    n_active = active.groupBy("stratum").agg(F.count("*").alias("n_active"))
    hits = codes.join(typed, ROW).groupBy("stratum", "type", "latent").agg(F.count("*").alias("hit")).join(active, ["stratum", "latent"])
    rows = pairs.join(n_active, "stratum", "left").join(hits, ["stratum", "type"], "left").withColumn(
        "ratio", (F.col("hit") / F.col("active")) / (F.col("positives") / F.col("total")))
    best = rows.groupBy("stratum", "type").agg(F.max("ratio").alias("best"))
    supported = (F.col("active") >= min_active) & (F.col("hit") >= min_hits)
    or_zero = lambda c: r(F.coalesce(c, F.lit(0.0)))
    return rows.join(best, ["stratum", "type"]).groupBy("stratum", "type").agg(
        or_zero(F.sum("ratio") / F.max("n_active")).alias("mean_ratio"), F.count_if(F.col("ratio") > 2).alias("over_2x"),
        or_zero(F.max("ratio")).alias("best_ratio"), F.count_if(F.col("ratio") > 0.8 * F.col("best")).alias("near_best"),
        F.count_if(supported).alias("supported"), or_zero(F.max(F.when(supported, F.col("ratio")))).alias("supported_best_ratio"))


def shortcut_suspects(codes: DataFrame, tiers: DataFrame) -> DataFrame:
    """Latents concentrated on modified residues that fire nearly as often on the hard negatives of the stratum."""
    kind = F.when(F.col("types").isNotNull(), "modified").otherwise(F.col("tier"))
    rows = tiers.withColumn("kind", kind)
    n = lambda k: F.count_if(F.col("kind") == k)
    base = rows.groupBy("stratum").agg(F.count("*").alias("total"), n("modified").alias("n_mod"), n("hard").alias("n_hard"))
    hits = codes.join(rows, ROW).groupBy("stratum", "latent").agg(F.count("*").alias("active"), n("modified").alias("h_mod"), n("hard").alias("h_hard"))
    ratio = F.when(F.col("n_mod") > 0, (F.col("h_mod") / F.col("active")) / (F.col("n_mod") / F.col("total"))).otherwise(0.0)
    rate_mod = F.col("h_mod") / F.greatest(F.lit(1), "n_mod")
    rate_hard = F.col("h_hard") / F.greatest(F.lit(1), "n_hard")
    suspect = (ratio > 2) & (F.col("h_mod") > 0) & (rate_hard > 0.8 * rate_mod)
    return hits.join(base, "stratum").groupBy("stratum").agg(F.count("*").alias("active_latents"), F.count_if(suspect).alias("suspects"))


def top_activations(codes: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The k highest positive values per latent with their class. The limit is applied before the shuffle too."""
    w = Window.partitionBy("latent").orderBy(F.desc("value"), *ROW)
    top = codes.where("value > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.join(classes, ROW).drop("rn")


def dominance(top: DataFrame, n_latents: int, k: int, threshold: float, label: str = "label") -> DataFrame:
    """Alive latents fill all k slots; dominance is the largest class share. Rates over all and over alive."""
    shares = top.groupBy("latent", label).agg(F.count("*").alias("n")).groupBy("latent").agg(F.sum("n").alias("filled"), (F.max("n") / k).alias("share")).where(F.col("filled") == k)
    marks = [("t", threshold), ("50", 0.5), ("90", 0.9)]
    sums = shares.agg(F.count("*").alias("alive"), *[F.count_if(F.col("share") >= t - 1e-6).alias(f"n_{m}") for m, t in marks], F.avg("share").alias("mean"))
    alive = F.greatest(F.lit(1), "alive")
    return sums.select(
        "alive", r("mean").alias("mean_dominance"), *[r(F.col(f"n_{m}") / float(n_latents)).alias(f"rate_all_{m}") for m, _ in marks],
        *[r(F.col(f"n_{m}") / alive).alias(f"rate_alive_{m}") for m, _ in marks])


def dominance_chance(frequencies: DataFrame, k: int, threshold: float, draws: int = 20_000, seed: int = 0) -> float:
    """Share of random k-draws by class frequency whose most common class reaches the threshold. Draws are rows
    of a range, each with k uniform numbers mapped through the cumulative frequencies."""
    rows = frequencies.orderBy("code").collect()  # one row per class
    total = sum(row["n"] for row in rows)
    edges = np.cumsum([row["n"] / total for row in rows])[:-1].tolist()
    spark = frequencies.sparkSession
    slots = spark.range(draws * k).select(F.expr(f"id div {k}").alias("draw"), F.rand(seed).alias("u"))
    bounds = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    coded = slots.withColumn("code", F.size(F.filter(bounds, lambda e: e <= F.col("u"))))
    top = coded.groupBy("draw", "code").agg(F.count("*").alias("n")).groupBy("draw").agg(F.max("n").alias("n"))
    return top.agg(F.avg((F.col("n") / k >= threshold - 1e-6).cast("double"))).first()[0]


def exact_chance(frequencies: DataFrame, k: int, threshold: float) -> DataFrame:
    """(threshold, chance): the probability that the most common of k independent draws by class frequency takes ``threshold`` of them, exactly.
    Draws in which every class stays below the mark are counted by a product of power series cut at the mark, one factor per class;
    its coefficient of degree k, times k!, is their probability. ``frequencies`` has n per class, a few classes."""
    least = max(1, math.ceil(threshold * k - 1e-6))
    inverse = F.array(*[F.lit(1.0 / math.factorial(j)) for j in range(k + 1)])
    total = frequencies.agg(F.sum("n")).scalar()
    shares = frequencies.where("n > 0").select((F.col("n") / total).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("p"))  # one per class
    below = lambda poly, p: F.transform(F.sequence(F.lit(0), F.lit(k)), lambda d: F.aggregate(
        F.sequence(F.lit(0), F.least(d, F.lit(least - 1))), F.lit(0.0), lambda s, j: s + poly[d - j] * F.pow(p, j) * inverse[j]))
    product = F.aggregate("p", F.array(F.lit(1.0), *[F.lit(0.0)] * k), below)
    return shares.select(F.lit(float(threshold)).alias("threshold"), r(1 - product[k] * float(math.factorial(k))).alias("chance"))
