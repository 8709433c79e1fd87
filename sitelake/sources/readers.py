"""Readers for the annotation formats. Each returns raw site or sequence rows; nothing is inferred."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelake.functions import dims


def match_column(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """First column whose trimmed lower name contains a candidate; candidates in priority order."""
    for candidate in candidates:
        for column in columns:
            if candidate.lower() in column.strip().lower():
                return column
    if required:
        raise ValueError(f"none of {candidates} among columns {columns}")
    return None


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def read_fasta(spark: SparkSession, path: str, max_length: int = dims.MAX_SEQUENCE_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(valid, skipped): records split by the reader itself. Text before the first header is dropped, stop marks
    '*' are removed, records without a sequence appear in neither."""
    records = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"), F.monotonically_increasing_id().alias("place"))
    # The first record of a file keeps its '>': if it has none, all of it lies before the first header.
    firsts = records.where("block = 0").groupBy("file").agg(F.min(F.struct("place", F.col("value").rlike("^\ufeff?>").alias("headed"))).alias("first"))
    records = records.join(firsts.where("not first.headed").select("file", "first.place"), ["file", "place"], "left_anti")
    body = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^﻿?>", "")
    lines = records.select(F.split(body, "\n").alias("lines"), F.col("value"))
    header = F.get("lines", F.lit(0))
    piped = F.regexp_extract(header, r"^[\w-]+\|([\w-]+)\|", 1)
    ident = F.when(piped != "", piped).otherwise(F.regexp_extract(F.trim(header), r"^(\S+)", 1))
    joined = F.array_join(F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.trim(x)), "")
    rows = lines.select(ident.alias("uniprot_id"), F.trim(header).alias("header"), F.upper(F.replace(joined, F.lit("*"), F.lit(""))).alias("sequence"))
    rows = rows.where("uniprot_id <> '' and sequence <> ''").withColumn("length", F.length("sequence").cast("bigint"))
    return rows.where(F.col("length") <= max_length), rows.where(F.col("length") > max_length).select("uniprot_id", "length")


def write_fasta(rows: DataFrame, path: str, id_column: str = "uniprot_id") -> None:
    fasta_lines(rows, id_column).write.mode("overwrite").text(path)


def fasta_lines(rows: DataFrame, id_column: str = "uniprot_id") -> DataFrame:
    return rows.select(F.concat(F.lit(">"), F.col(id_column).cast("string"), F.lit("\n"), "sequence").alias("value"))


def reviewed_proteome(frame: DataFrame, max_length: int = dims.MAX_SEQUENCE_LENGTH) -> DataFrame:
    """Accession, length and sequence columns found by name; rows within the length limit, upper case."""
    accession, length, sequence = (match_column(frame.columns, c) for c in (["accession", "entry"], ["length"], ["sequence"]))
    return frame.select(quoted(accession).alias("accession"), quoted(length).cast("bigint").alias("length"), F.upper(quoted(sequence)).alias("sequence")).where(F.col("length") <= max_length)


def read_tsv(spark: SparkSession, path: str, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    if header:
        return spark.read.option("sep", "\t").option("header", True).csv(path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.option("sep", "\t").schema(schema).csv(path)


# fixed column layouts of the headerless sources
LYSINE_COLUMNS = ["plmd_id", "accession", "position", "type", "protein_name", "gene", "species", "window", "pmid"]
FLAT_COLUMNS = ["entry_name", "accession", "position", "type_text", "pmid", "window"]


def lysine_sites(frame: DataFrame) -> DataFrame:
    """Nine positional columns; rows without accession, position or type fall away."""
    rows = frame.select("accession", F.expr("try_cast(trim(position) as bigint)").alias("position"), "type", "species", "pmid")
    return rows.where("accession is not null and position is not null and type is not null")


def flat_sites(frame: DataFrame, types: dict[str, str], evidence: str = "experimental") -> DataFrame:
    """One file per type: the type comes from the file name, the species from the entry-name suffix."""
    stem = F.regexp_extract(F.col("file"), r"([^/]+?)(\.[^./]*)*$", 1)
    named = F.coalesce(*[F.when(stem == k, F.lit(v)) for k, v in types.items()], stem)
    return frame.select(
        "accession", F.expr("try_cast(trim(position) as bigint)").alias("position"), named.alias("type"), F.lit(evidence).alias("evidence"),
        "pmid", F.substring_index("entry_name", "_", -1).alias("species_suffix")).where("accession is not null and position is not null")


def read_flat_sites(spark: SparkSession, glob: str, types: dict[str, str]) -> DataFrame:
    return flat_sites(read_tsv(spark, glob, False, FLAT_COLUMNS).withColumn("file", F.input_file_name()), types)


def multi_species_sites(frame: DataFrame) -> DataFrame:
    """Header resolved by substring; ``pmid`` and ``reliability`` are optional and become typed NULLs."""
    find = lambda names, required=True: match_column(frame.columns, names, required)
    optional = lambda name, kind: F.lit(None).cast(kind) if name is None else F.expr(f"try_cast(trim(`{name}`) as {kind})")
    return frame.select(
        quoted(find(["uniprot", "accession"])).alias("accession"), F.expr(f"try_cast(trim(`{find(['position'])}`) as bigint)").alias("position"),
        quoted(find(["modification", "ptm", "type"])).alias("type"), quoted(find(["organism", "species"])).alias("species"),
        optional(find(["pmid", "pubmed"], False), "string").alias("pmid"), optional(find(["reliability", "score"], False), "bigint").alias("reliability"),
    ).where("accession is not null and position is not null and type is not null")


def atlas_sites(frame: DataFrame, species: str = "human") -> DataFrame:
    """Rows of the species, from the standard accession source, with a position in the protein."""
    same = lambda c, v: F.lower(F.trim(c)) == v
    rows = frame.where(same("species", species) & same("accession_source", "uniprot"))
    return rows.select("accession", F.expr("try_cast(trim(position_in_protein) as bigint)").alias("position"), F.lit("O-GlcNAcylation").alias("type")).where("position is not null")


def paired_lines(spark: SparkSession, path: str) -> DataFrame:
    """Two-line records: 'acc,label,pos,label,pos...' then a line that is ignored. Files are read whole, one
    file per row; label '1' is glycosylated."""
    files = spark.read.option("wholetext", True).text(path)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    odd = F.filter(lines, lambda x, i: i % 2 == 0)
    cells = files.select(F.explode(odd).alias("line")).select(F.split("line", ",").alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - 2, F.lit(1)), F.lit(2)), lambda i: F.struct(
        F.trim(F.get("c", i)).alias("flag"), F.trim(F.get("c", i + 1)).alias("text")))
    rows = cells.where("size(c) >= 3").select(F.trim(F.get("c", F.lit(0))).alias("accession"), F.inline(pairs))
    return rows.select("accession", F.expr("try_cast(text as bigint)").alias("position"),
                       F.when(F.col("flag") == "1", "glycosylated").otherwise("non-glycosylated").alias("label")).where("position is not null")


def header_row(frame: DataFrame, must_contain: list[str], order: str, max_scan_rows: int = 10) -> DataFrame:
    """Untyped rows below the first of ten rows whose joined text holds all tokens, with its cells as names."""
    cells = [c for c in frame.columns if c != order]
    text = F.lower(F.concat_ws(" ", *cells))
    hits = frame.orderBy(order).limit(max_scan_rows)
    for token in must_contain:
        hits = hits.where(F.contains(text, F.lit(token.lower())))
    first = hits.orderBy(order).limit(1).collect()
    if not first:
        raise ValueError(f"no row among the first {max_scan_rows} holds {must_contain}")
    names = [str(first[0][c]).strip() if first[0][c] is not None else c for c in cells]
    return frame.where(F.col(order) > first[0][order]).select(*[F.col(c).alias(n) for c, n in zip(cells, names)])


@F.pandas_udf(StringType())
def _decode_cp1252(raw: pd.Series) -> pd.Series:
    def one(value):
        try:
            return bytes(value).decode("cp1252")
        except UnicodeDecodeError:
            return bytes(value).decode("latin-1")

    return raw.map(one)


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): UTF-8 where valid, otherwise cp1252, otherwise latin-1."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(valid).select("path", F.decode("content", "UTF-8").alias("text"))
    other = files.where(~valid).select("path", _decode_cp1252("content").alias("text"))
    both = good.unionByName(other)
    return both.select("path", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r?\n")).alias("line_no", "line")).where("line <> ''")


def container_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of files whose extension is not trusted: zip or tar (largest member), gzip by its
    magic bytes, else plain. Members are streamed line by line into Arrow batches."""

    def opened(content: bytes):
        stream = io.BytesIO(content)
        if content[:2] == b"PK" and zipfile.is_zipfile(stream):
            archive = zipfile.ZipFile(stream)
            return archive.open(max(archive.infolist(), key=lambda m: m.file_size))
        try:
            stream.seek(0)
            archive = tarfile.open(fileobj=stream)
            return archive.extractfile(max((m for m in archive.getmembers() if m.isfile()), key=lambda m: m.size))
        except tarfile.TarError:
            stream.seek(0)
        return gzip.open(stream) if content[:2] == b"\x1f\x8b" else stream

    def lines(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                block = []
                for number, line in enumerate(opened(bytes(content))):
                    block.append((name, number, line.decode("utf-8", errors="replace").rstrip("\r\n")))
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=["path", "line_no", "line"])
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=["path", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lines, "path string, line_no bigint, line string").where("line <> ''")


def split_lines(lines: DataFrame, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited text rows to named string columns with the CSV rules of Spark."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return lines.select("path", "line_no", F.from_csv("line", schema, {"sep": sep}).alias("r")).select("path", "line_no", "r.*")


PARSERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lysine": lambda spark, path: lysine_sites(read_tsv(spark, path, False, LYSINE_COLUMNS)),
    "flat": lambda spark, path: read_flat_sites(spark, path, {}),
    "multi_species": lambda spark, path: multi_species_sites(read_tsv(spark, path)),
    "atlas": lambda spark, path: atlas_sites(spark.read.option("header", True).csv(path)),
    "pairs": paired_lines,
}


def register_parser(label: str, parser: Callable[[SparkSession, str], DataFrame]) -> None:
    PARSERS[label] = parser


def parse(spark: SparkSession, label: str, path: str) -> DataFrame:
    if label not in PARSERS:
        raise KeyError(f"no parser for source '{label}'; known: {sorted(PARSERS)}")
    return PARSERS[label](spark, path)


def hit_queries(hits: DataFrame, min_identity: float, min_coverage: float) -> DataFrame:
    """Distinct queries with identity (percent / 100) and query coverage at or above both limits."""
    return hits.where((F.col("pident") / 100 >= min_identity) & (F.col("qcov") >= min_coverage)).agg(F.count_distinct("query").alias("n_queries"))
