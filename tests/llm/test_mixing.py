"""op2: targets against a plain water filling, copies against the definition."""

import math

import pytest

from sitelake.llm import mixing


def water(sizes: dict, weights, share, limit):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        level = (goal - sum(target.values())) / (sum(weight[s] for s in open_) or 1)
        over = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: limit * sizes[s] for s in over}
        open_ -= over


ROWS = [(i, " ".join(["w"] * (1 + i * i % 37)), ["b", "a", "é", None, "Z"][i % 5 if i % 3 else 0]) for i in range(300)] + [(300, None, "a"), (301, " \t\n", "empty"), (None, "x y", "b"), (7, "x y", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as rank", "3 as copies").repartition(5)


def test_targets_and_copies(docs):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(ROWS)
    sizes = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target = water(sizes, (5, 2, 1), 1.5, 2.0)
    for row in got:
        assert row["source_size"] == sizes[row["source"]]
        assert math.isclose(row["target"], target[row["source"]], abs_tol=1e-9)
        rate = row["target"] / row["source_size"] if row["source_size"] else 0
        assert row["copies"] in (math.floor(rate), math.ceil(rate)) and row["taken"] == row["copies"] * row["size"] <= 2 * row["size"]
    for source in sizes:
        taken = sum(r["taken"] for r in got if r["source"] == source)
        assert abs(taken - target[source]) <= max((r["size"] for r in got if r["source"] == source), default=0)


def test_runs_agree(docs):
    key = lambda r: (r["doc_id"] or -1, r["size"], r["source"] or "", r["copies"])
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, mixing.mix(docs.repartition(3)).collect()))


def test_mixed_rows_repeat_whole_rows(spark, docs):
    unique = docs.where("doc_id is not null and doc_id <> 7")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(unique).collect()}
    rows = mixing.mixed_rows(unique)
    assert rows.columns == unique.columns
    found = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert found == {k: v for k, v in copies.items() if v}
    total = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mixed_rows(docs).count() == total


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
