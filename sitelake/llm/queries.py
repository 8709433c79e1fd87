"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelake.llm import ann, centroids, decontamination, exact_dedup, language_id, license_scan, mixing, near_dedup, packing, resampling, token_counts, url_filter, warc
from sitelake.llm.common import table


def _over(name: str, operator):
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, name))

    return plan


PLANS = {
    "op1_token_counts": _over("documents", token_counts.token_counts),
    "op2_source_mixing": _over("documents", mixing.mix),
    "op3_nearest": _over("embeddings", lambda rows: ann.nearest(rows, "vec_id % 50 = 0")),
    "op4_packing": _over("documents", packing.pack),
    "op5_warc": _over("pages", warc.round_trip),
    "op6_license_scan": _over("documents", license_scan.scan),
    "op7_url_filter": url_filter.blocked_pages,
    "op8_near_dedup": _over("documents", lambda docs: near_dedup.near_classes(docs).drop("print")),
    "op9_exact_dedup": _over("documents", exact_dedup.dedup_once),
    "op10_language_id": _over("documents", language_id.identify),
    "op11_centroids": _over("embeddings", centroids.cluster),
    "op12_resampling": lambda spark, sf_dir: resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_decontamination": lambda spark, sf_dir: decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

# The others tokenize, learn, sample or search; tests/llm holds them against brute force.
ORACLES = {
    "op2_source_mixing": mixing.SQL,
    "op5_warc": warc.SQL,
    "op7_url_filter": url_filter.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_centroids": centroids.sql(),
    "op12_resampling": resampling.SQL,
    "op13_decontamination": decontamination.SQL,
}
