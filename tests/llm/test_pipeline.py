"""The pipeline stage by stage on a table of edge cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from conftest_llm import EDGE
from sitelake.llm.common import stored, table


def test_stages(spark, edge, none):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    for docs in (edge, none):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, rows, ""), name)
            if name != "packing":
                assert out.columns == docs.columns
            rows = out
        assert (rows.count() > 0) == (docs is edge)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0 and out.count() > 100


def test_language_stage_drops_unlearned_and_keeps_mixed(spark):
    """Planted foreign scripts, a foreign language and junk letters go; texts in two learned languages and the table's own stay."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    clean = {r["lang"]: r["t"] for r in docs.where("n_chars between 300 and 3000 and doc_id % 7 = 3").groupBy("lang").agg(F.max_by("text", "n_chars").alias("t")).collect()}
    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(4, 10))) for _ in range(80))
    gone = ["日本語の文章はここにあります。" * 9, "Привет, это обычный русский текст о погоде. " * 5, junk,
            "Hyvää huomenta, tänään sataa lunta ja järvi on jäässä, joten kävelemme yhdessä metsän läpi kylään ostamaan leipää ja maitoa. " * 2]
    langs = sorted(clean)
    stay = [clean[a][:200] + "\n" + clean[b][:200] for a in langs for b in langs if a < b] + list(clean.values())
    planted = [(10**9 + i, t, None, "planted") for i, t in enumerate(gone + stay)]
    extra = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    kept = {r[0] for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra.select(*docs.columns)), "").select("doc_id").collect()}
    assert {i - 10**9 for i in kept if i >= 10**9} == set(range(len(gone), len(planted)))
    own = docs.where(r"text rlike '\\p{L}'").count()
    assert sum(i < 10**9 for i in kept) >= 0.99 * own
