"""op9 and op8: brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import pytest

from conftest_llm import EDGE
from sitelake.llm import exact_dedup, near_dedup
from sitelake.llm.common import shared_folder


def test_exact(edge, none):
    rows = exact_dedup.dedup_once(edge).collect()
    groups = collections.defaultdict(list)
    for i, text, _, _ in EDGE:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(i)
    assert len(rows) == len(EDGE)
    for r in rows:
        own = groups[r["text_sha256"]]
        assert r["doc_id"] in own and r["group_size"] == len(own) and r["keep_id"] == max((i for i in own if i is not None), default=None)
    kept = collections.Counter(r["text_sha256"] for r in rows if r["kept"])
    assert kept == {k: 1 for k in groups}
    stay = exact_dedup.kept_rows(edge)
    assert stay.columns == edge.columns and stay.count() == len(groups)
    assert exact_dedup.dedup_once(none).count() == 0 and exact_dedup.kept_rows(none).count() == 0


def test_index_meets_later_batches(spark):
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), 3)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    flags = lambda rows: {(r["doc_id"]): (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(batch(rows), index).collect()}
    assert flags([(1, "x"), (5, "x"), (2, "y")]) == {1: (5, False), 5: (5, True), 2: (2, True)}
    assert flags([(9, "x"), (10, "z")]) == {9: (5, False), 10: (10, True)}
    assert flags([(9, "x"), (10, "z")]) == {9: (5, False), 10: (10, True)}  # a batch that is run again
    assert index.rows().count() == 3


def test_index_opened_again(spark):
    """A second object, and a session of another shuffle width, find every digest; another bucket count is refused."""
    where = shared_folder(spark, "index")
    batch = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    exact_dedup.dedup(batch, exact_dedup.DigestIndex(spark, where, 3)).count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        index = exact_dedup.DigestIndex(spark, where)
        assert index.buckets == 3
        assert exact_dedup.dedup(batch, index).where("kept").count() == 500 and index.rows().count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="3 buckets"):
        exact_dedup.DigestIndex(spark, where, 5)


def test_hot_text_is_split(spark):
    """Nearly all rows hold one text: the last join is a skewed one that the session splits."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id % 40 > 0, '', concat('t', id)) as text").repartition(8)
    held = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = exact_dedup.dedup_once(docs)
        assert rows.where("kept").count() == 1_001
        rows.collect()
        assert "skewed" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_columns_of_the_caller_come_back(spark):
    names = ["near_key", "near_print", "near_no", "near_rows", "dedup_key", "dedup_digest", "dedup_no", "last_rows"]
    docs = spark.range(30).selectExpr("id div 2 as doc_id", "concat('some words of text number ', id div 2) as text", *[f"concat('{n}', id) as {n}" for n in names])
    for rows in (exact_dedup.kept_rows(docs), near_dedup.kept_rows(docs)):
        assert rows.columns == docs.columns
        got = rows.collect()
        assert len(got) in (15, 30) and all(r[n].startswith(n) for r in got for n in names)
        assert len({tuple(r[n][len(n):] for n in names) for r in got}) == len(got)


def words(rng, n):
    return [rng.choice(["re", "ha", "tion", "ou", "st", "ble"]) + rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="module")
def copies():
    """A group of near copies with links to some of them only, a passage that many share, and short and equal texts."""
    rng, texts = random.Random(5), []
    base, passage = words(rng, 120), words(rng, 60)
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = words(rng, 1)[0]
        texts.append(" ".join(own))
    for _ in range(40):
        texts.append(" ".join(words(rng, 80) + passage))
    for k in range(8):  # a chain: each is similar to the next
        texts.append(" ".join(base[:40] * 1 + words(random.Random(1), 8 * k) + base[40:]))
    return texts + ["a b", "A, b!", "a b c", "one two three four five", texts[3].upper(), texts[70]]


def brute(texts, s):
    grams = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        grams.append(collections.Counter(tuple(w[i : i + s.words]) for i in range(max(1, len(w) - s.words + 1))) if w else {})
    df = collections.Counter(g for c in grams for g in c)
    idf = {g: round(16 * math.log(1 / max(n / len(texts), s.rare)) / math.log(1 / s.rare)) for g, n in df.items()}
    weigh = [{g: (1 + idf[g] / 16) * (1 + round(4 * math.log2(n)) / 4) for g, n in c.items()} for c in grams]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(weigh):
        for j in range(i):
            b = weigh[j]
            both = sum(min(v, b[g]) for g, v in a.items() if g in b)
            if both and both / (sum(a.values()) + sum(b.values()) - both) >= s.least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_equals_brute_force(spark, copies):
    s = near_dedup.Similarity(bands=40, rows=3)
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(4)
    rows = near_dedup.near_classes(docs, similarity=s).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(copies))] == brute(copies, s)
    sizes = collections.Counter(got.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_near_edges(edge, none):
    rows = near_dedup.near_classes(edge).collect()
    assert len(rows) == len(EDGE)
    classes = collections.defaultdict(list)
    for r in rows:
        classes[r["class_id"], r["print"] if r["class_id"] in (1, None) else 0].append(r)
    assert {r["class_id"] for r in rows if r["doc_id"] in (4, 5)} == {4} and {r["class_id"] for r in rows if r["doc_id"] in (9, 10)} == {9}
    assert all(r["class_size"] == 1 and r["kept"] for r in rows if r["doc_id"] in (2, 3, 6))
    assert sum(r["kept"] for r in rows if r["doc_id"] == 1) == 2
    stay = near_dedup.kept_rows(edge)
    assert stay.columns == edge.columns and stay.count() == sum(r["kept"] for r in rows)
    assert near_dedup.near_classes(none).count() == 0 and near_dedup.kept_rows(none).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    """Consistent weighted sampling: the share of equal samples estimates the weighted Jaccard similarity."""
    import numpy as np

    from sitelake.llm import text as tx

    rng = np.random.default_rng(2)
    s = near_dedup.Similarity(bands=2000, rows=1)
    h = tx.mixed(np.arange(400, dtype=np.uint64) + np.uint64(9))
    code = rng.integers(0, 17, 400)
    weight = (1 + code / 16).astype(np.float32)
    a, b = np.arange(0, 300), np.arange(60, 400)
    keys = near_dedup.band_keys(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([h[a], h[b]]), np.concatenate([code[a], code[b]]), np.concatenate([weight[a], weight[b]]), s)[1]
    order = [np.argsort(h[x]) for x in (a, b)]
    want = near_dedup.weighted_jaccard(h[a][order[0]], weight[a][order[0]], h[b][order[1]], weight[b][order[1]])
    assert abs((keys[0] == keys[1]).mean() - want) < 0.035


def test_blocks_equal_pairs():
    import numpy as np

    rng = np.random.default_rng(6)
    texts = []
    for _ in range(30):
        h = np.sort(rng.choice(50, rng.integers(1, 40), replace=False).astype(np.uint64))
        texts.append((h, rng.choice([1.0, 1.25, 1.5, 2.0, 3.5], len(h)).astype(np.float32)))
    table = near_dedup.similar(texts, 12, 0.25)
    want = [[near_dedup.weighted_jaccard(*a, *b) >= 0.25 for b in texts[12:]] for a in texts[:12]]
    assert table.tolist() == want and 0 < table.sum() < table.size
    for cells in (1, 100, 1000):  # slices of one shingle and of several
        assert near_dedup.similar(texts, 12, 0.25, cells).tolist() == want
    alone = [(np.array([i], dtype=np.uint64), np.ones(1, dtype=np.float32)) for i in range(3)]
    assert not near_dedup.similar(alone, 1, 0.25).any()


def test_blocks_of_long_texts_hold_slices(spark):
    """320 texts of 20,000 to 27,000 shingles, most of the different ones in one text alone, take memory by shingles held and not texts times different shingles."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(8)
    shared = np.arange(18_000, dtype=np.uint64)
    texts = []
    for i in range(320):
        own = np.arange(2_000 if i % 2 else 9_000, dtype=np.uint64) + np.uint64(10**6 * (i + 1))
        h = np.concatenate([shared, own])
        texts.append((h, np.ones(len(h), dtype=np.float32)))
    tracemalloc.start()
    table = near_dedup.similar(texts, 64, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    odd = np.arange(320) % 2 == 1
    assert (table == (odd[:64, None] & odd[None, 64:])).all() and peak < 1.5e9  # a matrix of all columns has 4.5 GB


@pytest.mark.parametrize("held", [1, 40])
def test_blocks_by_shingles_give_the_same_classes(spark, held):
    rows = [(i, " ".join(f"w{(i // 6) * 50 + j}" for j in range(40)) + f" x{i} y{i % 3}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lambda s: sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(docs, similarity=s).collect())
    assert classes(near_dedup.Similarity(bands=40, rows=1, shingles_per_task=held)) == classes(near_dedup.Similarity(bands=40, rows=1))
