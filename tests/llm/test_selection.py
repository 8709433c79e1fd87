"""op11, op12, op13: brute force on small tables, edge cases, and what the methods promise."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest_llm import EDGE
from sitelake.llm import centroids, decontamination, resampling

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_centroids", "op12_resampling", "op13_decontamination"])
def test_query_equals_sql(spark, name):
    problem, n, _, _ = compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert not problem and n > 0


# op11


def lloyd(rows, how):
    kept = [(i, [math.floor(how.scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == how.dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centers = [q for _, q in hashed[: how.clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda q: min((distance(q, c), k) for k, c in enumerate(centers))
    for _ in range(how.rounds):
        own = [nearest(q)[1] for _, q in kept]
        for k in set(own):
            held = [q for (_, q), o in zip(kept, own) if o == k]
            centers[k] = [sum(c) // len(held) for c in zip(*held)]
    found = [(i, *nearest(q)) for i, q in kept]
    total = {k: sum(d for _, d, o in found if o == k) for _, _, k in found}
    return sorted((-1 if i is None else i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, d, k in found)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as point", "3 as distance").repartition(3)


@pytest.mark.parametrize("pivots", [1, 4])
def test_clusters_equal_plain_rounds(spark, pivots):
    rng = np.random.default_rng(4)
    how = centroids.Clustering(dims=3, clusters=7, rounds=4, pivots=pivots)
    rows = [(i, (rng.integers(-3, 4, 3) / 2).tolist()) for i in range(150)]  # coarse values: many ties and equal vectors
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(200, 260)] + [(None, [9.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 0.0, 0.0]), (304, [0.0, float("inf"), 0.0])]
    got = sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in centroids.cluster(vectors(spark, rows), how).collect())
    assert got == lloyd(rows, how)


def test_cluster_edges(spark):
    how = centroids.Clustering(dims=2, clusters=5)
    assert centroids.cluster(vectors(spark, []), how).count() == 0
    few = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    assert sorted(tuple(r) for r in centroids.cluster(vectors(spark, few), how).collect()) == lloyd(few, how)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, few + [(3, [3e30, 0.0])]), how).collect()


def test_pivots_spare_distances_and_lose_none():
    rng = np.random.default_rng(2)
    middles = rng.integers(-3000, 3000, (30, 16))
    rows = (middles[rng.integers(0, 30, 4000)] + rng.integers(-40, 40, (4000, 16))).astype(np.int32)
    pivots = centroids.choose_pivots(rows[:200].astype(np.int64), 12)
    table = np.stack([centroids.squared(rows, p) for p in pivots], axis=1)
    own, best, measured = centroids.assign_rows(rows, table, middles, pivots)
    every = ((rows[:, None, :].astype(np.int64) - middles[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured < 0.2 * every.size


# op12


def weigh(docs, target, how):
    def features(text):
        words = words_of(text)
        return [" ".join(words[i : i + n]) for n in range(1, how.grams + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % how.buckets
    count = lambda texts: np.bincount([bucket(f) for t in texts for f in features(t)], minlength=how.buckets).tolist()
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + how.buckets) / ((a + 1) * (sum(t) + how.buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in out if r[4] >= how.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: how.percent * len(able) // 100]
    rest = able[len(drawn) :] + [r for r in out if r[4] < how.least_words]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], 0) for r in rest], key=repr)


def texts(rng, n):
    vocabulary = [rng.choice(["Re", "ha", "é", "ou"]) + rng.choice("abcdef") + str(rng.randrange(20)) for _ in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("grams,head", [(1, 50_000), (2, 10), (3, 5)])
def test_resampling_equals_definition(spark, grams, head):
    rng = random.Random(grams)
    how = resampling.Resampling(grams=grams, buckets=97, percent=37, least_words=8, head=head)
    docs = [(i, t) for i, t in enumerate(texts(rng, 200))] + [(3, "another text of the same id " * 3), (None, "no id here " * 5), (None, "no id here " * 5), (900, None), (901, ""), (902, "-- !!"), (903, "w" * 300 + " x " * 9)]
    target = texts(random.Random(9), 20) + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as rank", "3 as part").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "7 as doc_id")
    got = sorted(((*tuple(r)[:4], r["rank"] or 0) for r in resampling.resample(frame, wanted, how).collect()), key=repr)
    assert got == weigh(docs, target, how)


def test_resampling_edges(spark, edge, none):
    target = edge.select("text")
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(edge, none.select("text")).count() == len(EDGE)
    how = resampling.Resampling(percent=50, least_words=2)
    ids = {r["doc_id"] for r in resampling.resample(edge, target, how).where("rank is not null").collect()}
    rows = resampling.drawn_rows(edge, target, how)
    assert rows.columns == edge.columns and {r["doc_id"] for r in rows.collect()} == ids


# op13


def contaminated(docs, items, window):
    runs = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for p in range(len(words) - n + 1 if n else 0):
            runs.setdefault(tuple(words[p : p + n]), set()).add(item)
    sizes, out = {len(r) for r in runs}, []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for p in range(len(words) - n + 1):
                own = runs.get(tuple(words[p : p + n]))
                if own:
                    hit |= set(range(p, p + n))
                    found |= own
        found.discard(None)
        names = ",".join(sorted(map(str, found)))
        out.append((-1 if i is None else i, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("window,chunk", [(10, 4096), (10, 16), (4, 7), (1, 5), (13, 64)])
def test_decontamination_equals_definition(spark, window, chunk):
    """Few different words, so windows repeat and overlap; items shorter than a window; a passage that many documents hold; chunk borders."""
    rng = random.Random(window * chunk)
    word = lambda: rng.choice(["The", "cat", "É", "sat", "a7"])
    passage = [word() for _ in range(30)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(window, 3 * window + 8)))) for i in range(12)]
    items += [(20, " ".join(passage)), (21, " ".join(passage).upper().replace("É", "é")), (20, "zebra zebra"), (22, None), (23, ""), (24, "..."), (25, "La la la la la la la la la la la la"), (None, "the quick brown fox jumps over the lazy dog near the river")]
    items += [(30 + n, " ".join(f"q{k}" for k in range(n))) for n in (1, 3, 9)]
    docs = []
    for i in range(120):
        own = [word() for _ in range(rng.randrange(80))]
        own += rng.choice([[], passage, passage[5:20], words_of(rng.choice(items)[1] or ""), ["la"] * 40, ["zebra"] * 3, [f"q{k}" for k in range(rng.randrange(12))]])
        docs.append((i, ", ".join(own + [word() for _ in range(rng.randrange(20))])))
    docs += [(200, None), (201, ""), (202, "?!"), (None, " ".join(passage)), (5, "cat"), (203, "The quick brown fox jumps over the lazy dog near the river bank")]
    how = decontamination.Winnowing(window=window, chunk=chunk)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as chunk", "3 as bits", "4 as item").repartition(4)
    known = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as row", "2 as doc_id")
    got = sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in decontamination.decontaminate(frame, known, how).collect())
    assert got == contaminated(docs, items, window)


def test_large_item_tables_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_LIMIT_BYTES", 0)
    docs = [(i, f"x{i} y one two three four five six seven eight nine ten eleven") for i in range(40)]
    items = [(1, "one two three four five six seven eight nine ten"), (2, "nothing of it is in any text at all, not a word")]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == contaminated(docs, items, 10)


def test_decontamination_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "the lazy dog near the river bank today and more of it")], "item_id long, text string")
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(edge, items.limit(0)).where("contaminated").count() == 0
    rows = decontamination.clean_rows(edge, spark.createDataFrame([(1, EDGE[0][1])], "item_id long, text string"))
    assert rows.columns == edge.columns and rows.count() == len(EDGE) - 3


def test_no_python_on_the_main_path(spark):
    for plan in (entry.queries()["op13_decontamination"](spark, FOLDER), entry.queries()["op9_exact_dedup"](spark, FOLDER)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
