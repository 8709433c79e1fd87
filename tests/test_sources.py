import gzip
import io
import json
import tarfile
import zipfile

import pytest

from sitelake.operators import runlog
from sitelake.sources import inventory, readers


def rows(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


def test_fasta(spark, tmp_path):
    text = "junk before\n>sp|P04637|P53 human\nmeep*\nqs\n>plain desc\nACDE\n>sp|EMPTY|x\n\n>sp|LONG1|y\n" + "A" * 30 + "\n"
    (tmp_path / "a.fasta").write_text(text)
    valid, skipped = readers.read_fasta(spark, str(tmp_path / "a.fasta"), max_length=20)
    assert rows(valid, "uniprot_id", "sequence", "length") == [("P04637", "MEEPQS", 6), ("plain", "ACDE", 4)]
    assert rows(skipped, "uniprot_id", "length") == [("LONG1", 30)]


def test_lysine_and_registry(spark, tmp_path):
    lines = ["1\tP1\t5\tAcetylation\tn\tg\tHomo\tw\t1", "2\tP2\t-\tAcetylation\tn\tg\tHomo\tw\t1", "3\t\t7\tAcetylation\tn\tg\tHomo\tw\t1"]
    (tmp_path / "k.txt").write_text("\n".join(lines) + "\n")
    assert rows(readers.parse(spark, "lysine", str(tmp_path / "k.txt")), "accession", "position", "type") == [("P1", 5, "Acetylation")]
    readers.register_parser("mine", lambda s, p: s.createDataFrame([(p,)], "accession string"))
    assert rows(readers.parse(spark, "mine", "x"), "accession") == [("x",)]
    with pytest.raises(KeyError):
        readers.parse(spark, "nope", "x")


def test_flat_files_take_type_from_name(spark, tmp_path):
    (tmp_path / "Acetylation.txt").write_text("A_HUMAN\tP1\t4\tx\t9\tw\nB_C_MOUSE\tP2\t6\tx\t9\tw\n")
    out = readers.read_flat_sites(spark, str(tmp_path / "*.txt"), {"Acetylation": "acetylation"})
    assert rows(out, "accession", "position", "type", "species_suffix") == [("P1", 4, "acetylation", "HUMAN"), ("P2", 6, "acetylation", "MOUSE")]


def test_multi_species_header(spark):
    frame = spark.createDataFrame([("P1", "3", "Phospho", "Human", "-")], ["UniProt ID", "Position", "PTM", "Organism", "Reliability"])
    assert rows(readers.multi_species_sites(frame), "accession", "position", "pmid", "reliability") == [("P1", 3, None, None)]
    with pytest.raises(ValueError):
        readers.multi_species_sites(frame.drop("Position"))


def test_atlas(spark):
    frame = spark.createDataFrame([(" Human ", "UniProt", "P1", "7"), ("mouse", "UniProt", "P2", "7"), ("human", "RefSeq", "P3", "7"), ("human", "uniprot", "P4", None)],
                                  ["species", "accession_source", "accession", "position_in_protein"])
    assert rows(readers.atlas_sites(frame), "accession", "position") == [("P1", 7)]


def test_paired_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("P1,1,5,0,9,1,x\nMEEPQS\nP2,0,3\nACD\n")
    out = readers.paired_lines(spark, str(tmp_path / "p.txt"))
    assert rows(out, "accession", "position", "label") == [("P1", 5, "glycosylated"), ("P1", 9, "non-glycosylated"), ("P2", 3, "non-glycosylated")]


def test_header_row(spark):
    frame = spark.createDataFrame([(0, "title", None), (1, "UniProt", "Position"), (2, "P1", "4")], "n int, a string, b string")
    assert rows(readers.header_row(frame, ["uniprot", "position"], "n"), "UniProt", "Position") == [("P1", "4")]
    with pytest.raises(ValueError):
        readers.header_row(frame, ["absent"], "n")


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("naïve,β\n".encode())
    (tmp_path / "w.csv").write_bytes("smart “quote”,x\n".encode("cp1252"))
    (tmp_path / "l.csv").write_bytes(b"odd \x81,y\n")
    lines = {r["line"] for r in readers.decoded_lines(spark, str(tmp_path)).collect()}
    assert lines == {"naïve,β", "smart “quote”,x", "odd \x81,y"}


def test_containers(spark, tmp_path):
    with tarfile.open(tmp_path / "t.dat", "w") as tar:
        for name, body in (("small", b"no\n"), ("large", b"a\tb\nc\td\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "g.dat").write_bytes(gzip.compress(b"e\tf\n"))
    (tmp_path / "p.dat").write_bytes(b"g\th\n")
    with zipfile.ZipFile(tmp_path / "z.dat", "w") as archive:
        archive.writestr("one", "i\tj\n")
    out = readers.split_lines(readers.container_lines(spark, str(tmp_path)), ["x", "y"])
    assert rows(out, "x", "y") == [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")]


def test_match_column():
    assert readers.match_column(["Gene", " UniProt Accession "], ["accession", "gene"]) == " UniProt Accession "
    assert readers.match_column(["x"], ["y"], required=False) is None


def test_metrics_file_and_fasta_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"step": 1, "a": 1.0}\nbroken\n{"step": 3, "a": 1.5, "note": "text", "quoted": "12", "flag": true, "none": null, "list": [1]}\n')
    last = runlog.last_values(runlog.read_metrics(spark, str(tmp_path / "m.jsonl")), ["metric"], "line_no")
    assert rows(last, "metric", "value") == [("a", 1.5), ("step", 3.0)]
    readers.write_fasta(spark.createDataFrame([("P1", "ACD")], "uniprot_id string, sequence string"), str(tmp_path / "out"))
    valid, _ = readers.read_fasta(spark, str(tmp_path / "out"))
    assert rows(valid, "uniprot_id", "sequence") == [("P1", "ACD")]


def test_inventory_and_cache(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("hello")
    files = inventory.file_inventory(spark, str(tmp_path / "f"))
    assert rows(files, "name", "size") == [("a.txt", 5)]
    wanted = spark.createDataFrame([("a.txt", False), ("b.txt", True)], "name string, optional boolean")
    assert rows(inventory.require_present(wanted, files), "name") == [("b.txt",)]
    with pytest.raises(FileNotFoundError):
        inventory.require_present(wanted.selectExpr("name", "false as optional"), files)
    base = spark.createDataFrame([(1,), (2,)], "x int")
    calls = []

    def build():
        calls.append(1)
        return base

    folder = str(tmp_path / "cache")
    assert [inventory.cached_table(spark, folder, {"b": base}, {"k": 1}, build)[1] for _ in range(2)] == [False, True]
    assert inventory.cached_table(spark, folder, {"b": base}, {"k": 2}, build)[1] is False
    assert inventory.cached_table(spark, folder, {"b": base.union(base)}, {"k": 2}, build)[1] is False and len(calls) == 3


def test_split_manifest_keeps_other_keys(spark, tmp_path):
    from sitelake.plans.split import SplitResult, write_split

    corpus = spark.createDataFrame([(1, 1, "held_out")], "uniprot_id long, cluster_id long, partition string")
    report = spark.createDataFrame([("tokens", 1.0)], "feature string, total double")
    (tmp_path / "split_manifest.json").write_text(json.dumps({"kept": 1}))
    write_split(SplitResult(corpus, corpus, None, report, None, [{"pass": 0}]), str(tmp_path))
    manifest = json.loads((tmp_path / "split_manifest.json").read_text())
    assert manifest["kept"] == 1 and manifest["homology_audit"] == [{"pass": 0}] and "tokens" in manifest["balance"]
    assert spark.read.parquet(str(tmp_path / "corpus")).where("partition = 'held_out'").count() == 1


def test_text_before_the_first_header_is_dropped(spark, tmp_path):
    """Several lines before a header, in files of several splits; other files stay as they are."""
    (tmp_path / "a.fasta").write_text("; a comment\nand a second line\nACDEF\n>sp|P1|X one\nAC\nDE\n" + "".join(f">q{i}\nACDEFGHIKL\n" for i in range(400)))
    (tmp_path / "b.fasta").write_text("\n\n>sp|P2|Y two\r\nMK\r\n")
    (tmp_path / "c.fasta").write_text(">sp|P3|Z\nGG\n")
    (tmp_path / "d.fasta").write_text("no header at all\nACD\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = {r["uniprot_id"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path))[0].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {"P1": "ACDE", "P2": "MK", "P3": "GG"} | {f"q{i}": "ACDEFGHIKL" for i in range(400)}


def test_letters_become_rows_only_where_a_motif_may_fit(spark, tmp_path):
    """Odd texts: null, none, letters of other alphabets, doc borders; neighbours as an exploded text gives them."""
    import re

    from sitelake.plans import inputs as I

    texts = [None, "", "12 3", "aé中BzK", "NESE OSE", "O", "ſteE ÀA", "OSHOTEiNeae", " E" * 5, "ONE" * 400]
    rows = spark.createDataFrame([(i, t, "x", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    clean = {i: s for i, t in enumerate(texts) if t and (s := re.sub("[^A-Za-z]", "", t).upper())}
    assert {r["pid"]: (r["sequence"], r["length"]) for r in I.sequences(spark, str(tmp_path)).collect()} == {i: (s, len(s)) for i, s in clean.items()}
    around = lambda s, i: (s[i - 1] if i else "", s[i], s[i + 1] if i + 1 < len(s) else "")
    fits = lambda p, r, n: n == "E" and p != "" and p in "AINO" or p == "O" and r in "ST" and n != "" and n in "EH"
    want = sorted((i, k + 1, *around(s, k)) for i, s in clean.items() for k in range(len(s)) if fits(*around(s, k)))
    got = I.contexts(spark, str(tmp_path), I.near_motif)
    assert sorted((r["pid"], r["position"], r["prev"], r["residue"], r["next"]) for r in got.collect()) == want
    assert want and all(r["length"] == len(clean[r["pid"]]) and r["accession"] == f"P{r['pid']}" for r in got.collect())
