"""Input views over the given tables: documents stand in for proteins, embeddings for per-position
vectors, events for firing and run logs, orders/lineitem for a large split input."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Use all cores where the input has fewer splits than the session has slots; large inputs stay as read."""
    slots = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(slots) if frame.rdd.getNumPartitions() < slots else frame


UPPER = np.zeros(256, dtype="uint8")  # a letter's upper case, 0 for any other byte
UPPER[65:91] = UPPER[97:123] = np.arange(65, 91)


def letters_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters A-Z of all texts in upper case, end to end, and where each text's begin and end; null has none."""
    text = text.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], dtype="int64")[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype="uint8")[ends[0]:ends[-1]]
    upper = UPPER[raw]
    kept = np.flatnonzero(upper)
    return upper[kept], np.searchsorted(kept, ends - ends[0])


def letters(text: Column) -> Column:
    """``upper(regexp_replace(text, '[^A-Za-z]', ''))`` on whole batches. Declared as not deterministic so that the planner keeps it in one place."""
    def cut(text: pa.Array) -> pa.Array:
        found, ends = letters_of(text)
        return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends.astype("int64")), pa.py_buffer(found)).cast(pa.string())

    return F.arrow_udf(cut, "string").asNondeterministic()(text)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a letter."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).where(F.col("text").rlike("[A-Za-z]"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        texts(spark, sf_dir)
        .select(F.col("doc_id").alias("pid"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("accession"),
                letters(F.col("text")).alias("sequence"), "source", "lang")
        .withColumn("length", F.length("sequence").cast("bigint"))
    )


def partition_of(pid: Column) -> Column:
    slot = pid % 10
    return F.when(slot < 7, "discovery_train").when(slot == 7, "discovery_val").otherwise("held_out")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence; equal sequences share the smallest id as cluster. The group key is a
    digest, so no sequence is shuffled for the grouping and the minimum is pre-aggregated."""
    rows = sequences(spark, sf_dir).withColumn("digest", F.md5("sequence"))
    first = rows.groupBy("digest").agg(F.min("pid").alias("cluster_id"))
    return rows.join(first, "digest").drop("digest").withColumn("partition", partition_of(F.col("pid")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select(
        "pid", "accession", "sequence", "length", "source", "lang", "cluster_id", "partition")


def explode_residues(rows: DataFrame, keep: list[str], sequence: str = "sequence") -> DataFrame:
    """One row per letter, 1-based position."""
    return (
        rows.select(*keep, F.posexplode(F.split(sequence, "")).alias("zero_based", "residue"))
        .where("residue <> ''")
        .select(*keep, (F.col("zero_based") + 1).cast("bigint").alias("position"), "residue")
    )


ONE_LETTER = pa.array(["", *map(chr, range(1, 128))])


def contexts(spark: SparkSession, sf_dir: str, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The residues that ``wanted`` picks by (previous, own, next) letter, given as codes with 0 beyond the ends, with their neighbours.
    No other letter of a text becomes a row."""
    rows = texts(spark, sf_dir).select(F.col("doc_id").alias("pid"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("accession"), "lang", "text")

    def pick(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False))
            first = np.flatnonzero(np.diff(sizes // LETTERS, prepend=-1))  # about LETTERS letters at a time
            for start, end in zip(first, [*first[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                residue, ends = letters_of(part.column(3))
                prev, following = np.roll(residue, 1), np.roll(residue, -1)
                filled = ends[:-1] < ends[1:]
                prev[ends[:-1][filled]] = 0
                following[ends[1:][filled] - 1] = 0
                at = np.flatnonzero(wanted(prev, residue, following))
                owner = np.searchsorted(ends, at, side="right") - 1
                of = pa.array(owner)
                columns = [part.column(0).take(of), part.column(1).take(of), pa.array(np.diff(ends)[owner]), part.column(2).take(of), pa.array(at - ends[owner] + 1)]
                columns += [ONE_LETTER.take(pa.array(codes[at])) for codes in (residue, prev, following)]
                yield pa.RecordBatch.from_arrays(columns, names=["pid", "accession", "length", "lang", "position", "residue", "prev", "next"])

    return rows.mapInArrow(pick, f"pid {rows.schema['pid'].dataType.simpleString()}, accession string, length bigint, lang string, position bigint, residue string, prev string, next string")


LETTERS = 4_000_000


def among(codes: np.ndarray, names: str) -> np.ndarray:
    return np.isin(codes, np.frombuffer(names.encode(), dtype="uint8"))


def near_motif(prev: np.ndarray, residue: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Residues that some motif of ``SOURCE_MOTIFS`` may fit."""
    return (following == ord("E")) & among(prev, "AINO") | (prev == ord("O")) & among(residue, "ST") & among(following, "EH")


def near_gold(prev: np.ndarray, residue: np.ndarray, following: np.ndarray) -> np.ndarray:
    return (residue == ord("N")) & among(following, "EA")


# The four dirty sources, as conditions on a residue and its neighbours.
SOURCE_MOTIFS = (
    ("s1", 1, "next = 'E' and prev in ('A', 'I', 'O')"),
    ("s1", 2, "next = 'E' and prev = 'A'"),
    ("s2", 1, "next = 'E' and prev in ('I', 'N', 'O')"),
    ("s3", 1, "residue in ('S', 'T') and next in ('E', 'H') and prev = 'O'"),
)
ROW_HASH = "(pid * 7919 + position * 104729) % 97"
RAW_TYPE = """case when residue = 'K' and h % 5 = 0 then 'succinylation'
  when residue = 'K' and h % 2 = 0 and copy = 1 then 'Ubiquitylation' when residue = 'K' then ' Acetylation'
  when residue in ('S', 'T') and source = 's3' then 'O-GlcNAc'
  when residue in ('S', 'T') and source = 's1' and h < 30 then 'O-linked Glycosylation'
  when residue in ('S', 'T') and source = 's2' and h between 15 and 45 then 'O-GlcNAc'
  when residue in ('S', 'T', 'Y') then 'Phosphorylation' when residue = 'N' then 'N-linked Glycosylation'
  when residue = 'R' then 'Methylation' when residue = 'C' then 'S-palmitoylation' when residue = 'M' then 'Sulfoxidation'
  when residue = 'W' then 'C-linked Glycosylation' when residue = 'Q' then 'Glycosylation' else 'Deamidation' end"""
RAW_ACCESSION = "case when h = 2 then concat(accession, '-2') when h = 6 then concat('X', accession) else accession end"
RAW_POSITION = "case when h = 3 then position + 1 when h = 9 then position + length else position end"
RAW_EVIDENCE = """case when h = 8 then 'By similarity' when h = 7 then 'MS/MS; probable' when h = 10 then null
  when h = 11 then ' Experimental ' else 'MS/MS' end"""
RAW_RELIABILITY = "case when h = 12 then null else h % 6 end"
RAW_SPECIES = "case h % 4 when 0 then ' Human' when 1 then 'Homo sapiens' when 2 then 'human ' else 'Mouse' end"


def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty annotation rows. The text is scanned once; a letter yields a row per source it hits."""
    hits = ", ".join(f"named_struct('source', '{s}', 'copy', {c}, 'hit', {m})" for s, c, m in SOURCE_MOTIFS)
    rows = (
        contexts(spark, sf_dir, near_motif)
        .withColumn("h", F.expr(ROW_HASH))
        .select("*", F.expr(f"inline(array({hits}))"))
        .where("hit")
    )
    return rows.select(
        "source", F.expr(RAW_ACCESSION).alias("accession"), F.expr(RAW_POSITION).alias("position"),
        F.expr(RAW_TYPE).alias("type"), F.expr(RAW_EVIDENCE).alias("evidence"),
        F.expr(RAW_RELIABILITY).cast("bigint").alias("reliability"), F.expr(RAW_SPECIES).alias("species"),
        F.expr("cast(substr(source, 2) as bigint)").alias("source_rank"),
        (F.col("position") * 10 + F.col("copy")).cast("bigint").alias("row_no"), "pid", "lang",
    )


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired label rows for the residue N: '... non-glycosylated' or 'glycosylated'."""
    return (
        contexts(spark, sf_dir, near_gold)
        .where("residue = 'N' and next in ('E', 'A')")
        .select("accession", "position",
                F.expr(f"case when {ROW_HASH} < 60 then 'Non-glycosylated' else 'Glycosylated' end").alias("label"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-position vectors: twenty positions per id."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 20").alias("pid"), F.expr("vec_id % 20 + 1").alias("position"),
        F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("label"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four decoder rows per label: the means of its vectors, by id slot."""
    long = table(spark, sf_dir, "embeddings").select(
        F.expr("label * 4 + vec_id % 4").cast("bigint").alias("latent"), F.posexplode("embedding").alias("dim", "x"))
    means = long.groupBy("latent", "dim").agg(F.avg(F.col("x").cast("double")).alias("w"))
    return means.groupBy("latent").agg(
        F.expr("transform(array_sort(collect_list(struct(dim, w))), e -> e.w)").alias("w"))


def firing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 100").alias("batch"), F.col("user_id").alias("latent"), "value",
        (F.col("value") > 60).alias("fired"), "event_id")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("run"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")


def split_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uniprot_id"), F.col("o_custkey").alias("cluster_id"),
        (F.floor(F.col("o_totalprice") / 1000) + 1).cast("bigint").alias("length"),
        F.col("o_orderpriority").alias("sequence"))


def split_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uniprot_id"), F.col("l_returnflag").alias("type_pooled"),
        (F.col("l_linenumber") > 3).alias("crosstalk"))
