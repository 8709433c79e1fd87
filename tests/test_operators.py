import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.functions import dims, exprs
from sitelake.operators import agreement, balance, clustering, components, scoring, similarity, sites, statistics, vectors

K = 4


def grams(text):
    return {text[i:i + K] for i in range(len(text) - K + 1)}


def matches(a, b, t=0.4):
    x, y = grams(a), grams(b)
    return bool(x and y) and len(x & y) >= np.ceil(round(t * min(len(x), len(y)), 9))


@pytest.fixture(scope="module")
def texts():
    """A third of the rows are copies or near copies of one text; the rest share a common line."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ACDEFGHIKL") for _ in range(n))
    hot, line = word(60), word(12)
    out = {}
    for i in range(60):
        if i % 3 == 0:
            cut = rnd.randrange(0, 60)
            out[i] = hot if i % 2 == 0 else hot[:cut] + "W" + hot[cut:]
        else:
            out[i] = word(rnd.randrange(20, 60)) + (line if i % 5 else "") + (out[i - 1][:30] if i % 7 == 0 and i else "")
    out[60] = "AB"
    return out


def test_best_matches_against_brute_force(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    got = {r["query"]: r["reference"] for r in similarity.best_matches(rows.where("id % 4 = 1 or id = 60"), rows.where("id % 4 <> 1 and id <> 60"), 0.4, K).collect()}
    want = {}
    for q in texts:
        if q % 4 == 1 or q == 60:
            refs = [r for r in texts if r % 4 != 1 and r != 60 and matches(texts[q], texts[r])]
            if refs:
                want[q] = refs
    assert set(got) == set(want)
    assert all(got[q] in want[q] for q in got)


def test_matching_pairs_is_complete(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in texts.items() if i % 2], "id long, sequence string")
    sh = similarity.shingles(rows, K)
    got = {(r["query"], r["reference"]) for r in similarity.matching_pairs(sh, sh, 0.4).collect()}
    odd = [i for i in texts if i % 2]
    assert got == {(a, b) for a in odd for b in odd if matches(texts[a], texts[b])}


@pytest.mark.parametrize("across", [True, False])
def test_shared_shingles_leave_out_what_one_side_alone_holds(spark, texts, across, monkeypatch):
    """By definition, over several slices; shingles that can't count towards a pair are no rows."""
    monkeypatch.setattr(similarity, "SLICE", 300)
    asks = lambda i: across and i % 4 == 1
    first = {}
    for i in sorted(texts):
        first.setdefault((texts[i], asks(i)), i)
    rows = [(i, text, len(text), ask) for (text, ask), i in first.items()]
    got = similarity.shared_shingles(spark.createDataFrame(rows, "id long, sequence string, length long, asks boolean"), K, across).collect()
    holders = {}
    for i, text, _, ask in rows:
        for gram in grams(text):
            holders.setdefault(gram, []).append((i, ask))
    want = []
    for held in holders.values():
        refs = [i for i, ask in held if not ask]
        if len(held) > 1 and refs and (not across or len(refs) < len(held)):
            want += [(i, ask, len(grams(texts[i])), len(refs), min(refs)) for i, ask in held]
    assert sorted((r["id"], r["asks"], r["n"], r["df"], r["low"]) for r in got) == sorted(want)
    assert len({r["s"] for r in got}) < len(holders)


def test_similarity_clusters_are_components(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    got = {r["id"]: r["cluster_id"] for r in clustering.similarity_clusters(rows, 0.4, K).collect()}
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (texts[a] == texts[b] or matches(texts[a], texts[b])) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert got == root


def test_representatives_equal_sequential_greedy(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    got = {r["id"]: r["representative"] for r in clustering.representative_clusters(rows, 0.4, K).collect()}
    firsts = {}
    for i, t in texts.items():
        firsts.setdefault(t, i)
    reps, want = [], {}
    for t, i in sorted(firsts.items(), key=lambda kv: (-len(kv[0]), kv[1])):
        hit = next((r for r in reps if matches(t, texts[r])), None)
        if hit is None:
            reps.append(i)
        want[t] = i if hit is None else hit
    assert got == {i: want[t] for i, t in texts.items()}


def sequential(texts):
    firsts, reps, want = {}, [], {}
    for i, t in sorted(texts.items()):
        firsts.setdefault(t, i)
    for t, i in sorted(firsts.items(), key=lambda kv: (-len(kv[0]), kv[1])):
        hit = next((r for r in reps if matches(t, texts[r])), None)
        if hit is None:
            reps.append(i)
        want[t] = i if hit is None else hit
    return {i: want[t] for i, t in texts.items()}


@pytest.mark.parametrize("direct", [0, 1e9])
def test_representatives_in_rounds_and_at_once(spark, texts, direct):
    """Families in families, with texts of few different shingles among them, so that a longer text is often the smaller set."""
    rnd = random.Random(11)
    rows = dict(texts)
    for i in range(1000, 1060):
        own, source = "".join(rnd.choice("ACDE") for _ in range(rnd.randrange(5, 60))), rnd.choice(sorted(rows.values()))
        rows[i] = rnd.choice([own + source[rnd.randrange(40):][:rnd.randrange(20, 120)], source[:30] * rnd.randrange(1, 9) + own])
    frame = spark.createDataFrame(list(rows.items()), "id long, sequence string")
    got = {r["id"]: r["representative"] for r in clustering.representative_clusters(frame, 0.4, K, direct).collect()}
    assert got == sequential(rows)


def test_sequences_wait_only_for_those_they_could_match(spark, monkeypatch):
    """Texts in a row, each of which shares some shingles with the two before it and the two behind it, too few for a match: they don't wait for each other one by one."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    shared = {(i, j): word(K + 12) for i in range(-2, 16) for j in (i + 1, i + 2)}
    texts = {i: "".join(t for pair, t in shared.items() if i in pair) + word(30 - i) for i in range(16)}
    calls = []
    monkeypatch.setattr(clustering, "marked_joins", lambda *a: calls.append(a) or similarity.marked_joins(*a))
    rows = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    got = {r["id"]: r["representative"] for r in clustering.representative_clusters(rows, 0.4, K).collect()}
    assert got == sequential(texts) == {i: i for i in texts}
    assert len(calls) <= 2


def test_merge_clusters_is_transitive(spark):
    members = spark.createDataFrame([("a", 5), ("b", 9), ("c", 12), ("d", 3)], "uniprot_id string, cluster_id long")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "reference_id string, query_id string")
    merged = components.merge_clusters(members, pairs)
    assert {r["uniprot_id"]: r["cluster_id"] for r in merged.collect()} == {"a": 5, "b": 5, "c": 5, "d": 3}
    assert components.absorbed(merged).first()[0] == 2


def test_components_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))


def test_written_frames_leave_no_shuffle_files(spark):
    from sitelake.session import cut_lineage, dropped_tables, stored

    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",").count("shuffle_")
    before = files()
    rows = spark.range(100_000).groupBy(F.xxhash64("id").alias("key")).agg(F.count("*").alias("n"))
    with dropped_tables(spark):
        held = stored(rows, "rows")
        kept = cut_lineage(held.repartition(4, "key"))
    for _ in range(50):
        if files() > before:
            time.sleep(0.1)  # files go in the background
    assert files() <= before
    assert kept.count() == 100_000
    with pytest.raises(Exception, match="(?i)not.exist"):
        held.select("n").collect()


def test_split_reads_its_inputs_once(spark):
    from sitelake.plans import split

    proteins, sites = corpus(spark, n=60)
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda text: read.add(1) or text, "string").asNondeterministic()
    plan = balance.SplitPlan(min_sites=(0, 0, 0), token_tolerance=0.5, audit_passes=1)
    n = proteins.count()
    result = split.assign_partitions(proteins.withColumn("sequence", seen("sequence")), sites, plan, 0.4, K + 8)
    assert result.corpus.count() == n
    assert read.value == n


def test_audits_go_on_until_the_target(spark):
    from sitelake.plans import split, split_queries

    assert split_queries.TEXT_PLAN == balance.SplitPlan(audit_passes=None)
    proteins, sites = corpus(spark, n=60)
    first = proteins.where("uniprot_id = 0").first()["sequence"]
    copies = proteins.withColumn("sequence", F.when(F.col("cluster_id") % 30 == 0, F.lit(first)).otherwise(F.col("sequence"))).withColumn("length", F.length("sequence").cast("bigint"))
    plan = balance.SplitPlan(min_sites=(0, 0, 0), token_tolerance=0.5, audit_passes=None, leak_target=0.0)
    result = split.assign_partitions(copies, sites, plan, 0.4, K + 8)
    assert result.audit[-1]["within_target"]
    assert result.corpus.where(F.col("sequence") == first).select("partition").distinct().count() == 1


def test_moves_of_a_round_are_no_sql_text(spark, monkeypatch):
    plan = balance.SplitPlan(min_type_sites=50, min_sites=(0, 50, 100), token_tolerance=0.03)
    features = balance.cluster_features(*corpus(spark), plan)
    monkeypatch.setattr(balance.dims, "inline_frame", lambda *_: pytest.fail("a literal per move"))
    start = balance.seed_partition(features, plan).withColumn("code", F.lit(0))
    assert balance.polish(features, start, plan).select("code").distinct().count() == 3


def test_parts_of_the_hashes_make_the_same_sets(spark):
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("ACDE") for _ in range(300)) for _ in range(8)]
    rows = [(i, text[i:], len(text) - i, i % 3 == 0) for i, text in enumerate(pool * 4)]
    sides = spark.createDataFrame(rows, "id long, sequence string, length long, asks boolean")
    sets = lambda parts: {tuple(map(str, r)) for r in similarity.shared_sets(sides, K, True, "asks", parts=parts).select("id", "asks", "n", "m", "held").collect()}
    assert len(sets(1)) == len(rows) and sets(1) == sets(4) == sets(5)


def test_searches_leave_no_tables(spark):
    from pathlib import Path

    from sitelake.operators import clustering
    from sitelake.session import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    tables = lambda: {f for name in ("sequences", "shingles", "part", "pairs", "settled", "marked", "mixed") for f in folder.glob(f"{name}-*")}
    before = tables()
    rows = spark.createDataFrame([(i, ("ACDEFGHIKLMNPQRSTVWY" * 5)[i % 7:]) for i in range(30)], "id long, sequence string")
    assert similarity.best_matches(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.4, K).count() == 15
    assert clustering.similarity_clusters(rows, 0.4, K).select("cluster_id").distinct().count() == 1
    assert clustering.representative_clusters(rows, 0.4, K).select("representative").distinct().count() == 1
    assert tables() == before


def corpus(spark, n=300, seed=3):
    rnd = random.Random(seed)
    proteins, found, pid = [], [], 0
    for cluster in range(n):
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 5])):
            length = rnd.randrange(80, 400)
            proteins.append((pid, cluster, "".join(rnd.choice("KSTNCRYEMWQA") for _ in range(length)), length))
            found += [(pid, cluster, kind, rnd.random() < 0.1) for kind, rate in (("phospho", 0.03), ("ubiq", 0.015)) for _ in range(length) if rnd.random() < rate]
            pid += 1
    return (spark.createDataFrame(proteins, "uniprot_id long, cluster_id long, sequence string, length long"),
            spark.createDataFrame(found, "uniprot_id long, cluster_id long, type_pooled string, crosstalk boolean"))


def test_balanced_split_is_balanced_and_repeatable(spark):
    plan = balance.SplitPlan(min_type_sites=50, min_sites=(0, 50, 100), token_tolerance=0.03)
    features = balance.cluster_features(*corpus(spark), plan)
    first = balance.balanced_split(features, plan)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, balance.balanced_split(features, plan).collect()))
    summary = balance.balance_summary(balance.balance_report(features, first, plan), plan).collect()
    assert all(r["mean_deviation"] < 0.05 and r["max_deviation"] < 0.15 for r in summary)
    again = balance.balanced_split(features, plan, first)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def test_infeasible_split_raises(spark):
    proteins = spark.createDataFrame([(i, i, "A" * 100, 100) for i in range(3)], "uniprot_id long, cluster_id long, sequence string, length long")
    found = spark.createDataFrame([(0, 0, "t", False)], "uniprot_id long, cluster_id long, type_pooled string, crosstalk boolean")
    plan = balance.SplitPlan()
    with pytest.raises(ValueError, match="no feasible split"):
        balance.balanced_split(balance.cluster_features(proteins, found, plan), plan)


def test_excluded_types_reasons(spark):
    found = [(i, i, "K::other_PTM", False) for i in range(5)] + [(i, i, "rare", False) for i in range(5)] + [(i, 0, "lumpy", False) for i in range(400)]
    frame = spark.createDataFrame(found, "uniprot_id long, cluster_id long, type_pooled string, crosstalk boolean")
    got = {r["type_pooled"]: r["reason"] for r in balance.excluded_types(frame, balance.SplitPlan()).collect()}
    assert got == {"K::other_PTM": "pooled rare-type class", "rare": "fewer than 300 sites", "lumpy": "one cluster holds too large a share of its sites"}


def test_first_non_null_follows_source_then_row(spark):
    raw = spark.createDataFrame([("P", 1, "t", 2, 1, "late", "s2"), ("P", 1, "t", 1, 2, "second", "s1"), ("P", 1, "t", 1, 1, None, "s1"), (None, 1, "t", 1, 1, "x", "s1")],
                                "accession string, position long, type string, source_rank long, row_no long, evidence string, source string")
    row = sites.deduplicate(raw, ["evidence"]).collect()
    assert [(r["source_count"], r["source_row_count"], r["evidence"]) for r in row] == [(2, 3, "second")]


def test_strict_paths_raise(spark):
    labels = spark.createDataFrame([("P9", 1)], "accession string, position long")
    known = spark.createDataFrame([("P1", 1, "held_out")], "accession string, cluster_id long, partition string")
    with pytest.raises(Exception, match="without a corpus row"):
        sites.inherit_partition(labels, known).collect()
    odd = sites.canonical_types(spark.createDataFrame([("Mystery", "K")], "type string, residue string"))
    with pytest.raises(ValueError, match="Mystery"):
        sites.require_known_spellings(odd)
    with pytest.raises(Exception, match="unmapped type spelling: Mystery"):
        sites.known_spellings(odd).where("type_status = 'known'").collect()


def test_residue_lookup_crosses_chunks(spark):
    seq = "".join(dims.RESIDUE_VOCABULARY[i % 20] for i in range(1300))
    frame = spark.createDataFrame([("P", seq)], "accession string, sequence string")
    asked = spark.createDataFrame([("P", p) for p in (0, 1, 512, 513, 1024, 1300, 1301)] + [("Q", 1)], "accession string, position long")
    got = {(r["accession"], r["position"]): r["residue"] for r in sites.attach_residue(asked, frame).collect()}
    assert got == {("P", p): (seq[p - 1] if 1 <= p <= 1300 else None) for p in (0, 1, 512, 513, 1024, 1300, 1301)} | {("Q", 1): None}


def test_isoform_full_name_wins(spark):
    known = spark.createDataFrame([("P1", "AAA"), ("P2-2", "AAA"), ("P2", "AAA")], "accession string, sequence string")
    raw = spark.createDataFrame([("P1-2",), ("P2-2",), ("P3-1",), ("P1-x",)], "accession string")
    got = sorted((r["accession"], r["from_isoform_accession"]) for r in sites.strip_isoforms(raw, known).collect())
    assert got == [("P1", True), ("P1-x", False), ("P2-2", False), ("P3-1", False)]


def test_overlap_includes_empty_pairs(spark):
    raw = spark.createDataFrame([("a", "P", 1), ("b", "P", 2)], "source string, accession string, position long")
    got = [(r["source_a"], r["source_b"], r["n_shared"]) for r in agreement.pairwise_overlap(raw, ["a", "b"], ["accession", "position"]).collect()]
    assert got == [("a", "b", 0)]


def test_shard_plan_does_not_depend_on_its_ranges(spark):
    lengths = [(i * 37) % 11 + (40 if i % 29 == 0 else 0) for i in range(300)]  # zeros and entries above the capacity too
    rows = spark.createDataFrame([(p, i, i, n) for p in "ab" for i, n in enumerate(lengths)], "partition string, seq long, id long, length long")
    shard, used, want = 0, 0, []
    for i, n in enumerate(lengths):
        if used and used + n > 25:
            shard, used = shard + 1, 0
        want.append((i, shard, used))
        used += n
    for size in (1, 7, 64, 1000):
        got = vectors.shard_plan(rows, 25, size).collect()
        for p in "ab":
            assert sorted((r["id"], r["shard"], r["start_offset"]) for r in got if r["partition"] == p) == want


def test_shard_plan_keeps_a_range_together_however_its_rows_arrive(spark):
    """Enough rows from enough tasks that a join which turns into a broadcast reads them by the task they come from."""
    rows = spark.range(0, 400_000, 1, 20).selectExpr("if(id % 10 < 7, 'a', 'b') as partition", "id as seq", "id", "id * 37 % 11 + 1 as length")
    got = vectors.shard_plan(rows, 25).toPandas().sort_values(["partition", "seq"])
    assert len(got) == 400_000
    current, shard, used = None, 0, 0
    for partition, length, *place in got[["partition", "length", "shard", "start_offset"]].itertuples(index=False):
        if partition != current:
            current, shard, used = partition, 0, 0
        if used and used + length > 25:
            shard, used = shard + 1, 0
        assert place == [shard, used]
        used += length


def test_only_the_reached_head_of_a_sequence_is_kept(spark):
    sequences = spark.createDataFrame([(1, "ABCDEF"), (2, "GH"), (3, "K" * 1000)], "pid long, sequence string")
    held = spark.createDataFrame([(1, 3), (1, 1), (2, 1), (2, 5), (4, 1)], "pid long, position long")
    assert {tuple(r) for r in vectors.reached(sequences, held).collect()} == {(1, "ABC"), (2, "GH")}


def test_vector_and_shard_rules(spark, tmp_path):
    rows = spark.createDataFrame([("t", i, i, n) for i, n in enumerate([3, 2, 4, 10, 1])], "partition string, seq long, id long, length long")
    got = {r["id"]: (r["shard"], r["start_offset"], r["end_offset"]) for r in vectors.shard_plan(rows, 5).collect()}
    assert got == {0: (0, 0, 3), 1: (0, 3, 5), 2: (1, 0, 4), 3: (2, 0, 10), 4: (3, 0, 1)}
    vecs = spark.createDataFrame([(0, p, [float(p), 1.0]) for p in (1, 2, 3)], "pid long, position long, vec array<float>")
    plan = vectors.shard_plan(rows, 5).where("id = 0")
    stored = vectors.mean_vectors(vecs)
    assert stored.first()["mean_vec"] == [2.0, 1.0]
    assert vectors.pooled(plan, stored.where("false"), vecs).first()["mean_vec"] == [2.0, 1.0]
    with pytest.raises(ValueError):
        vectors.require_coverage(plan, spark.createDataFrame([(0,), (7,)], "id long"))


def test_epoch_and_batches_keep_every_row(spark):
    shards = spark.createDataFrame([("t", i) for i in range(20)], "partition string, shard long")
    orders = [[r["shard"] for r in vectors.epoch_order(shards, 1, e, 4).orderBy("place").collect()] for e in (0, 1, 1)]
    assert sorted(orders[0]) == list(range(20)) and orders[0] != orders[1] and orders[1] == orders[2]
    rows = spark.range(1000).withColumnRenamed("id", "pid")
    got = vectors.shuffled_batches(rows, ["pid"], 1, 0, 64)
    counts = {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()}
    assert got.select("pid").distinct().count() == 1000 and [counts[b] for b in range(16)] == [64] * 15 + [40]


def test_encode_blocks_equal_broadcast(spark):
    rnd = np.random.default_rng(0)
    vec = spark.createDataFrame([(i, 1, rnd.standard_normal(6).tolist()) for i in range(50)], "pid long, position long, vec array<double>")
    dic = spark.createDataFrame([(i, rnd.standard_normal(6).tolist(), 0.1) for i in range(20)], "latent long, w array<double>, b double")
    enc = scoring.Encoder(dic)
    key = lambda f: sorted((r["pid"], r["latent"], round(r["value"], 9)) for r in f.collect())
    assert key(scoring.encode(vec, enc, top=3)) == key(scoring.encode(vec, enc, top=3, limit_bytes=200))


def test_dominance_chance_for_uniform_pairs(spark):
    freq = spark.createDataFrame([(0, 5), (1, 5)], "code long, n long")
    assert abs(statistics.dominance_chance(freq, 2, 1.0) - 0.5) < 0.02


def test_explained_variance_with_large_mean(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((200, 4))
    x[:, 0] += 3000
    y = x + 0.1 * rnd.standard_normal(x.shape)
    vec = spark.createDataFrame([(i, 1, x[i].tolist()) for i in range(200)], "pid long, position long, vec array<double>")
    rec = spark.createDataFrame([(i, 1, d, float(y[i, d])) for i in range(200) for d in range(4)], "pid long, position long, dim long, value double")
    codes = spark.createDataFrame([(i, 1, i % 2, 1.0) for i in range(200)], "pid long, position long, latent long, value double")
    got = statistics.evaluation(vec, codes, rec, 6).first()
    want = 1 - ((x - y) ** 2).sum() / ((x - x.mean(axis=0)) ** 2).sum()
    assert abs(got["explained_variance"] - want) < 1e-5 and abs(got["never_fired_fraction"] - 4 / 6) < 1e-5


def test_residue_tiers(spark):
    residues = spark.createDataFrame([(1, "C", i + 1, r) for i, r in enumerate("KKSSSTAAAA")], "pid long, accession string, position long, residue string")
    labels = spark.createDataFrame([("C", 1, "ubiquitination", "K"), ("C", 3, "phosphorylation_ST", "ST"), ("C", 5, "phosphorylation_ST", "ST"), ("C", 5, "O-GlcNAcylation", "ST")],
                                   "accession string, position long, type string, stratum string")
    none = labels.select("accession", "position").where("false")
    got = {r["position"]: (r["types"], r["tier"]) for r in statistics.residue_tiers(residues, labels, none, none).collect()}
    assert {p for p, (t, _) in got.items() if t} == {1, 3, 5} and len(got[5][0]) == 2
    assert {p: tier for p, (t, tier) in got.items() if not t} == {2: "hard", 4: "hard", 6: "hard"}


def test_small_expressions(spark):
    row = spark.range(1).select(
        exprs.type_key(F.lit("  N_linked  Glyco ")).alias("k"), exprs.residue_code(F.lit("Z")).alias("z"), exprs.residue_code(F.lit("C")).alias("c"),
        exprs.evidence_kept(F.lit("MS/MS; Probable")).alias("e"), exprs.band_verdict(F.lit(0.95), F.lit(0.85), F.lit(0.95)).alias("v")).first()
    assert tuple(row) == ("n-linked-glyco", 20, 1, False, "pass")


def test_split_takes_every_move_whatever_the_batch(spark):
    """1,000 equal clusters that start in one partition end at the fractions, also if few moves reach the driver at once."""
    from sitelake.operators import balance

    rows = [(c, f, v) for c in range(1000) for f, v in (("tokens", 10.0), ("proteins", 1.0))]
    features = spark.createDataFrame(rows, "cluster_id long, feature string, value double")
    start = spark.range(1000).selectExpr("id as cluster_id", "0 as code")
    for batch in (40, 20_000):
        plan = balance.SplitPlan(min_sites=(0, 0, 0), moves_per_round=batch)
        out = balance.polish(features, start, plan)
        counts = {r["code"]: r["count"] for r in out.groupBy("code").count().collect()}
        assert sum(counts.values()) == 1000 and abs(counts[1] - 100) <= 2 and abs(counts[2] - 200) <= 4


def test_block_scoring_keeps_values_below_zero_if_asked(spark):
    from sitelake.operators import scoring

    codes = spark.createDataFrame([(1, 1, 0, -2.0), (1, 1, 1, -1.0)], "pid long, position long, latent long, value double")
    assert [r["latent"] for r in scoring.top_per_row(codes, 1, positive=False).collect()] == [1]
    assert scoring.top_per_row(codes, 1).count() == 0


def test_source_rank_without_a_bit_fails(spark):
    import pytest as pt

    from sitelake.operators import sites

    rows = spark.createDataFrame([(1,), (65,)], "source_rank long")
    with pt.raises(Exception, match="source rank out of 0..62"):
        rows.agg(sites.source_bits()).collect()


def shuffled_rows(spark, job):
    """The rows that the stages of a job write to shuffles, and what the job returns."""
    def stages():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}
    before = stages()
    out = job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for i, n in stages().items() if i not in before), out


def test_a_pair_of_sets_costs_its_ids(spark):
    """Sixty sets that share 300 of their 500 shingles: 3,600 pairs, whose shingles were 1.8 million rows."""
    rows = spark.range(60).selectExpr("id", "explode(sequence(0, 499)) as i").selectExpr("id", "if(i < 300, i, id * 1000 + i) as s", "500L as n")
    written, got = shuffled_rows(spark, lambda: similarity.matching_pairs(rows, rows, 0.4).collect())
    assert {(r["query"], r["reference"], r["shared"]) for r in got} == {(a, b, 500 if a == b else 300) for a in range(60) for b in range(60)}
    assert written < 900_000


def test_moves_reach_the_driver_once_a_round(spark):
    """The best moves of a round are the rows that the driver gets, not those of every task."""
    plan = balance.SplitPlan(names=("a", "b"), fractions=(0.8, 0.2), min_sites=(0, 0), moves_per_round=2000)
    rows = [(i, f, float(v)) for i in range(16_000) for f, v in (("tokens", 100), ("size_1", 100), ("sites_all", i % 7 + 1))]
    features = spark.createDataFrame(rows, "cluster_id long, feature string, value double")
    start = spark.range(16_000).selectExpr("id as cluster_id", "if(id % 2 = 0, 0, 1) as code")
    def sent():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}
    before = sent()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = balance.balanced_split(features, plan, start).groupBy("code").agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    n = {r["code"]: r["n"] for r in got}
    assert n[0] + n[1] == 16_000 and abs(n[1] - 3200) <= 64
    assert max(size for i, size in sent().items() if i not in before) < 1_000_000
