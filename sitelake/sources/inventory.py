"""File inventories, reconciliation, provenance, cached tables and index commits."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.operators.reports import table_fingerprint
from sitelake.session import read_shared, write_shared


def file_inventory(spark: SparkSession, path: str, with_hash: bool = True) -> DataFrame:
    """(name, size, sha256, modified) of files; content is hashed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digest = F.sha2("content", 256) if with_hash else F.lit(None).cast("string")
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), digest.alias("sha256"), F.col("modificationTime").alias("modified"))


def reconcile(remote: DataFrame, local: DataFrame, verify: bool = False, force: bool = False) -> DataFrame:
    """One action per wanted file, first rule that applies: forced, missing, size, checksum, up to date."""
    have = local.select("name", F.col("size").alias("local_size"), F.col("sha256").alias("local_hash"))
    changed = F.col("sha256").isNotNull() & (F.col("local_hash") != F.col("sha256"))
    action = (
        F.when(F.lit(force), "forced").when(F.col("local_size").isNull(), "missing").when(F.col("local_size") != F.col("size"), "size_mismatch")
        .when(F.lit(verify) & F.coalesce(changed, F.lit(False)), "checksum_mismatch").otherwise("up_to_date")
    )
    return remote.join(have, "name", "left").select("name", "size", action.alias("action"))


def require_present(remote: DataFrame, available: DataFrame) -> DataFrame:
    """``remote`` has name and optional: absent required files raise, absent optional ones are returned."""
    absent = remote.join(available, "name", "left_anti")
    required = [r["name"] for r in absent.where("not optional").select("name").orderBy("name").collect()]
    if required:
        raise FileNotFoundError(f"required files missing: {required}")
    return absent.select("name")


def size_report(inventory: DataFrame) -> DataFrame:
    """Files and bytes per source, with a total row."""
    return inventory.rollup("source").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")).select(
        F.coalesce("source", F.lit("TOTAL")).alias("source"), "n_files", "bytes")


def cached_table(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], config: dict, build: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """The table under ``folder`` if the fingerprint of its inputs and configuration is unchanged, else a new one."""
    marks = {name: [str(v) for v in table_fingerprint(frame).first()] for name, frame in sorted(inputs.items())}
    expected = json.dumps({"inputs": marks, "config": config}, sort_keys=True, default=str)
    sidecar = f"{folder}.fp.json"
    if not force and read_shared(spark, sidecar) == expected:
        return spark.read.parquet(folder), True
    build().write.mode("overwrite").parquet(folder)
    write_shared(spark, sidecar, expected)
    return spark.read.parquet(folder), False
