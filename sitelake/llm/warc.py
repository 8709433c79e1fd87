"""WARC archives as seekable Zstandard bundles: independent frames, a footer with a seek table, and an index of records."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import shared_folder, stored

FRAME_BYTES = 1 << 20  # records of a frame, uncompressed; a longer record is a frame of its own
BUNDLE_BYTES = 64 << 20  # compressed frames of a bundle
BUNDLE_RECORDS = 20_000
READ_BYTES = 8 << 20  # records that one task of a read takes
LEAST_SHARED = 1000  # shorter payloads are always stored
# Fixed values of the seekable format: a skippable frame with an entry per frame, closed by the count, a descriptor and a magic number.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id bigint, bundle string, frame int, at bigint, length bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def filesystem(uri: str):
    """(Arrow file system, path) of a Hadoop-style address."""
    from pyarrow import fs

    if re.match(r"^(file:)?/", uri):
        return fs.LocalFileSystem(), "/" + re.sub(r"^(file:)?/+", "", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit record that holds the response's HTTP head alone."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); raises if the record and its digest disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda f: None if (v := fields[f].removeprefix("<urn:page:").rstrip(">")) == "None" else int(v)
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To") if "WARC-Refers-To" in fields else None


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames_of(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from the footer of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * count)
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", source.read(8 * count)):
        out.append((at, packed, size))
        at += packed
    return out


class _Bundle:
    def __init__(self, folder: str):
        import zstandard

        fs, path = filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"  # an attempt that fails leaves a file that no index row names
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zip = zstandard.ZstdCompressor(level=3)
        self.sizes: list[tuple[int, int]] = []
        self.frame, self.held, self.packed = [], 0, 0
        self.index: list[tuple] = []

    def add(self, page_id, raw: bytes) -> None:
        if self.held and self.held + len(raw) > FRAME_BYTES:
            self.flush()
        self.index.append((page_id, self.name, len(self.sizes), self.held, len(raw)))
        self.frame.append(raw)
        self.held += len(raw)

    def flush(self) -> None:
        if self.frame:
            packed = self.zip.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.packed += len(packed)
            self.frame, self.held = [], 0

    def full(self) -> bool:
        return self.packed >= BUNDLE_BYTES or len(self.index) >= BUNDLE_RECORDS

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.index), kinds)], names=[c.split()[0] for c in INDEX.split(", ")])


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or _Bundle(folder)
                bundle.add(page_id, record(page_id, url, (html or "").encode(), digest, refers_to, date))
                if bundle.full():
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return run


def revisits(payloads: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, digest, refers_to) of the rows of (page_id, digest, bytes) that repeat the payload of a row with a larger id.
    Counts and largest ids are pre-aggregated per task and written; the join after that is between two plain shuffles, so the session may split its hot digests."""
    long = payloads.where(F.col("bytes") >= least)
    groups = stored(long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null"), "warc-digests")
    return long.join(groups, "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` below ``folder`` and returns the index: page_id, bundle, frame, at, length.

    Each task writes its own bundles, frame by frame, so memory holds a frame or the longest record. A row is a response, or a revisit if ``revisits`` has it.
    The index is written as a table after its bundles; readers see only bundles it names, so a lost task leaves no wrong record.
    Null html is empty; null ids are written as such and never referred to. Rows equal in id and payload are responses each if theirs is the largest id.
    """
    digest = F.sha1(F.coalesce(F.col(html_col), F.lit("")))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), digest.alias("digest"))
    payloads = stored(rows.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")), "warc-payloads")
    repeats = stored(revisits(payloads, least).groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to")), "warc-revisits")
    named = repeats.select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "refers_to")
    marked = rows.join(named, F.expr("page_id <=> of and digest = same"), "left")
    return stored(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder, date), INDEX), "warc-index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, path = filesystem(folder)
        unzip = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                wanted: dict[int, list[tuple[int, int]]] = {}
                for p in places.as_py():
                    wanted.setdefault(p["frame"], []).append((p["at"], p["length"]))
                with fs.open_input_file(f"{path}/{name}") as source:
                    frames = frames_of(source)
                    for k, spans in sorted(wanted.items()):
                        at, packed, size = frames[k]
                        source.seek(at)
                        raw = unzip.decompress(source.read(packed), max_output_size=size)
                        rows = [parse(raw[a : a + n]) for a, n in spans]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in READ.split(", ")])

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records that ``index`` names, which may be any rows of it:
    only their frames are read. A bundle's places are one row, bounded by ``BUNDLE_RECORDS``. Payloads of responses are held against their digest.
    The shuffle carries places only, so the number of tasks follows from the bytes that are to be read."""
    wanted = index.agg(F.sum("length").alias("bytes"), F.count_distinct("bundle").alias("bundles")).first()
    tasks = max(1, min(wanted["bundles"], -(-(wanted["bytes"] or 0) // READ_BYTES)))
    places = index.repartition(tasks, "bundle").groupBy("bundle").agg(F.collect_list(F.struct("frame", "at", "length")).alias("places"))
    return places.mapInArrow(_read(folder), READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of ``pages`` in the shared folder and reads every record back; an empty table gives no rows."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)


SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
g as (select *, max(page_id) over (partition by payload_digest) as last_id from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last_id then last_id end as refers_to from g
"""
