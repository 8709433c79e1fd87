import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.functions import dims
from sitelake.operators import runlog
from sitelake.operators.extraction import extract, extract_into, neighbour_codes
from sitelake.operators.vector_store import VectorStore
from sitelake.plans import split


def proteins(spark, sequences):
    rows = [(i, s, len(s), "a") for i, s in sequences.items()]
    return spark.createDataFrame(rows, "pid bigint, sequence string, length bigint, partition string")


def test_vectors_and_means_of_new_ids_only(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), 10)
    seen = spark.sparkContext.accumulator(0)

    def model(sequences):
        seen.add(len(sequences))
        return neighbour_codes(sequences)

    assert extract_into(store, proteins(spark, {1: "ABC", 2: "ZZ"}), model) == 1
    assert extract_into(store, proteins(spark, {1: "ABC", 2: "ZZ"}), model) is None
    assert extract_into(store, proteins(spark, {1: "ABC", 2: "ZZ", 3: "QRSTUVW"}), model) == 2
    assert seen.value == 3  # once per id, though vectors and means are written
    got = {(r["pid"], r["position"]): list(r["vec"]) for r in store.vectors().collect()}
    want = {(i, n + 1): list(v) for i, s in ((1, "ABC"), (2, "ZZ"), (3, "QRSTUVW")) for n, v in enumerate(neighbour_codes([s])[0])}
    assert got == want
    means = {r["pid"]: r["mean_vec"] for r in store.means().collect()}
    assert all(np.allclose(means[i], neighbour_codes([s])[0].mean(axis=0)) for i, s in ((1, "ABC"), (2, "ZZ"), (3, "QRSTUVW"))) and len(means) == 3


def test_short_sequences_share_batches_and_long_ones_are_cut(spark):
    from sitelake.operators.extraction import vector_batches

    matrices = [np.arange(6, dtype="float32").reshape(3, 2)] * 400 + [np.arange(200, dtype="float32").reshape(100, 2)]
    batches = list(vector_batches([*range(400), None], matrices, 50))
    assert [b.num_rows for b in batches] == [50] * 26  # one of at most three rows per sequence before
    rows = [r for b in batches for r in b.to_pylist()]
    want = [(i if i < 400 else None, p + 1, m[p].tolist()) for i, m in enumerate(matrices) for p in range(len(m))]
    assert [(r["pid"], r["position"], r["vec"]) for r in rows] == want
    got = extract(proteins(spark, {i: "ABCDEF" for i in range(300)}), neighbour_codes, rows_per_batch=70)
    assert got.count() == 1800 and got.select("pid", "position").distinct().count() == 1800


def test_failure_before_the_commit_leaves_the_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), 10)

    def model(sequences):
        if any(s == "BAD" for s in sequences):
            raise ValueError("model")
        return neighbour_codes(sequences)

    with pytest.raises(Exception, match="model"):
        extract_into(store, proteins(spark, {1: "ABC", 2: "BAD"}), model)
    assert store.versions() == [] and store.vectors().count() == 0
    assert extract_into(store, proteins(spark, {1: "ABC"}), model) == 1 and store.vectors().count() == 3


def test_extracted_rows_are_held_in_few_bytes(spark, tmp_path):
    """All that an extraction leaves beside the store, by letter."""
    from pathlib import Path

    from sitelake.session import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before, letters = used(), "ACDEFGHIKL" * 20_000
    assert extract_into(VectorStore(spark, str(tmp_path / "held"), 1 << 20), proteins(spark, {1: letters}), neighbour_codes) == 1
    assert (used() - before) / len(letters) < 14


def test_batch_out_of_memory_is_repeated_by_sequence(spark):
    def model(sequences):
        if len(sequences) > 1:
            raise MemoryError
        return neighbour_codes(sequences)

    rows = extract(proteins(spark, {1: "ABCDE", 2: "Z"}).coalesce(1), model, rows_per_batch=2).collect()
    assert sorted((r["pid"], r["position"]) for r in rows) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]


def test_last_histogram_explicit_and_packed(spark):
    rows = spark.createDataFrame(
        [("x", 1, [9, 9], None, 0.0, 1.0, 2), ("x", 5, [1, 2, 3], None, -1.0, 0.5, 3), ("y", 2, [4, 5], [0.0, 1.0, 10.0], None, None, None)],
        "run string, step bigint, counts array<bigint>, bins array<double>, low double, size double, count int")
    got = {r["run"]: (list(r["counts"]), list(r["edges"])) for r in runlog.last_histogram(rows).collect()}
    assert got == {"x": ([1, 2, 3], [-1.0, -0.5, 0.0, 0.5]), "y": ([4, 5], [0.0, 1.0, 10.0])}


def test_artifact_table_takes_the_first_and_fails_without(spark):
    artifacts = spark.createDataFrame([(1, "top-b", 2), (1, "top-a", 7), (1, "other", 1), (2, "top-z", 3)], "run bigint, artifact string, logged bigint")
    tables = spark.createDataFrame([(1, "top-b", "t", 10), (1, "top-b", "u", 11), (1, "top-a", "t", 12), (2, "top-z", "t", 13)], "run bigint, artifact string, table_key string, x bigint")
    got = sorted((r["run"], r["artifact"], r["x"]) for r in runlog.artifact_table(artifacts, tables, "top", "t").collect())
    assert got == [(1, "top-b", 10), (2, "top-z", 13)]
    with pytest.raises(Exception, match="no artifact named"):
        runlog.artifact_table(artifacts, tables, "top-z", "t").collect()


def test_species_corpora(spark):
    base = "ACDEFGHIKLMNPQRSTVWY"
    human = spark.createDataFrame([(1, base * 2), (2, "W" * 2000)], "uniprot_id bigint, sequence string").withColumn("length", F.length("sequence").cast("bigint"))
    rows = [(10, base * 2, "mouse"), (11, "STYK" * 10, "mouse"), (12, "ST", "mouse"), (13, base[::-1] * 2, "yeast"), (14, "W" * 1100, "yeast"), (15, "W" * 50, "yeast")]
    others = spark.createDataFrame(rows, "uniprot_id bigint, sequence string, species string").withColumn("length", F.length("sequence").cast("bigint"))
    corpus, report, strata = split.species_corpora(others, human, 0.4, 16)
    flags = {r["uniprot_id"]: r["homologous_to_human"] for r in corpus.collect()}
    assert flags == {10: True, 11: False, 12: False, 13: False, 15: False}  # 14 and human 2 are beyond the length limit
    got = {r["species"]: (r["n_proteins"], r["n_with_homolog"], r["n_too_short"], r["total_residues"]) for r in report.collect()}
    assert got == {"mouse": (3, 1, 1, 82), "yeast": (2, 0, 0, 90)}
    counts = {(r["species"], r["stratum"]): r["n_residues"] for r in strata.collect()}
    text = {"mouse": base * 2 + "STYK" * 10 + "ST", "yeast": base[::-1] * 2 + "W" * 50}
    assert counts == {(s, name): sum(text[s].count(c) for c in letters) for s in text for name, letters in dims.STRATUM_RESIDUES.items()}


def test_type_split(spark):
    placed = spark.createDataFrame([("P1", "discovery"), ("P2", "holdout")], "accession string, partition string")
    hits = spark.createDataFrame([("P1", "a", 6), ("P2", "a", 2), ("P1", "b", 5), ("P9", "b", 7)], "accession string, type string, n bigint")
    got = {r["type"]: tuple(r)[1:] for r in split.type_split(placed, hits, 0.2, 2).collect()}
    assert got == {"a": (8, 6, 2, 0.25, 0.05, True), "b": (5, 5, 0, 0.0, 0.2, False)}
