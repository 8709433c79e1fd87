"""The catalogue against DuckDB at the smallest scale (a selection; the whole is run by tests/compare.py)."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SELECTED = ["b2_canonical_type", "c15_cross_partition_pairs", "d1_dedup", "d3_site_agreement", "d10_balance_report", "d21_composition", "d24_discrepancies",
            "e6_shard_plan", "g2_similarity_clusters", "h2_topk_encode", "h15_negative_tiers", "r1_verdicts", "t3_topk_per_latent"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SELECTED)
def test_plan_equals_sql(spark, con, name):
    problem, n, _, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert not problem and n > 0


def test_oracles_belong_to_plans():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_replication_rows_are_read_once(spark, tmp_path):
    rows = [(i, "SONEASEINEKOSEH AKEINE TOHOSE " * 20, "web", "en") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()["g7_replication_labels"](spark, str(tmp_path))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # the texts' sites are in tables by then
    assert out.count() > 0
