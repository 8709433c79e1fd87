"""Target-distribution importance resampling over hashed n-gram features with a head and tail vocabulary."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import stored, width


@dataclass(frozen=True)
class Resampling:
    grams: int = 1  # features are runs of 1 to so many words
    buckets: int = 10_000
    percent: int = 10  # of the documents with enough words that are drawn
    least_words: int = 20
    seed: str = "2024"
    head: int = 50_000  # frequent words, and frequent pairs, whose CRC states and buckets are broadcast
    head_bytes: int = 64  # of a word or pair in the head at most: the broadcast stays under 2 * head * (head_bytes + 100) bytes


# A-Z are lower-cased; bytes 0-2F 3A-60 7B-7F end a word.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
COUNTED = 200_000  # different words and pairs that a task counts before it sends them on


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORD_BYTES).split()


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def frequent(texts: DataFrame, how: Resampling) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """(CRC state of frequent words, bucket of frequent pairs) of (text): the most frequent ``head`` of each, counted over all texts.

    Tasks count in bounded memory and send partial counts. What is in the head decides which features a task looks up instead
    of hashing them, never a result, as both ways give the same bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            held = [(g, n) for g, n in counts.items() if len(g) <= how.head_bytes]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())], names=["gram", "n"])

        for batch in batches:
            for data in _texts(batch, 0):
                words = words_of(data)
                counts.update(words)
                if how.grams > 1:
                    counts.update(map(b" ".join, zip(words, words[1:])))
                if len(counts) > COUNTED:
                    yield send()
        yield send()

    counted = stored(texts.mapInArrow(run, "gram binary, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    top = lambda rows: [bytes(r["gram"]) for r in rows.orderBy(F.desc("n"), "gram").limit(how.head).collect()]  # bounded: head rows of head_bytes
    pair = F.expr("locate(' ', decode(gram, 'ISO-8859-1')) > 0")
    words = {w: zlib.crc32(w) for w in top(counted.where(~pair))}
    pairs = {p: zlib.crc32(p) % how.buckets for p in top(counted.where(pair))} if how.grams > 1 else {}
    return words, pairs


def features_of(words: list[bytes], states: dict[bytes, int], pairs: dict[bytes, int], how: Resampling) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the different features of a text. A word's CRC comes from the head or is computed; that of a longer run
    goes on from its first word's state, unless it is a frequent pair, whose bucket is known."""
    counts = Counter(words)
    crc = {w: states[w] if w in states else zlib.crc32(w) for w in counts}
    found = np.fromiter(crc.values(), np.int64, len(crc)) % how.buckets
    own = [(found, np.fromiter(counts.values(), np.int64, len(counts)))]
    for n in range(2, how.grams + 1):
        runs = Counter(zip(*[words[i:] for i in range(n)]))
        buckets = np.empty(len(runs), dtype=np.int64)
        for i, run in enumerate(runs):
            known = pairs.get(b" ".join(run)) if n == 2 else None
            buckets[i] = known if known is not None else zlib.crc32(b" " + b" ".join(run[1:]), crc[run[0]]) % how.buckets
        own.append((buckets, np.fromiter(runs.values(), np.int64, len(runs))))
    return np.concatenate([b for b, _ in own]), np.concatenate([c for _, c in own])


def count_features(docs: DataFrame, states, pairs, how: Resampling) -> DataFrame:
    """(doc_id, n_words, buckets, counts) of (doc_id, text), written once: totals and scores read the counts and no text."""
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast((states, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, pairs = head.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                words = [words_of(t) for t in _texts(part, 1)]
                found = [features_of(w, states, pairs, how) for w in words]
                ends = pa.array(np.cumsum([0] + [len(b) for b, _ in found]), pa.int32())
                column = lambda k: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, words)), pa.int64()), column(0), column(1)], names=["doc_id", "n_words", "buckets", "counts"])

    return stored(docs.mapInArrow(run, "doc_id bigint, n_words bigint, buckets array<int>, counts array<int>"), "features")


def bucket_totals(features: DataFrame, how: Resampling) -> np.ndarray:
    """How often each bucket occurs: tasks add up their rows first, so a task sends at most a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, dtype=np.int64)
        for batch in batches:
            flat = [batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)]
            total += np.bincount(flat[0], flat[1], how.buckets).astype(np.int64)  # exact: far fewer than 2**53 in a batch
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    summed = features.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, dtype=np.int64)
    for row in summed.collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray, how: Resampling) -> np.ndarray:
    """What one more feature of a bucket says for the target, in thousandths of a nat, rounded down; counts are smoothed by one a bucket."""
    many, most = float(int(source.sum()) + how.buckets), float(int(target.sum()) + how.buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * many / ((s + 1) * most))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise_of(doc_id: int | None, seed: str) -> int:
    """A fixed Gumbel number per id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, how: Resampling) -> DataFrame:
    """``scored`` with the rank of the drawn rows. Order comes from a range partition whose rows are counted, so no task sees all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    able = scored.where(F.col("n_words") >= how.least_words)
    ordered = stored(
        able.repartitionByRange(width(scored.sparkSession), *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.expr("monotonically_increasing_id() & 8589934591").alias("place")), "resample-order")
    before, total = {}, 0
    for part, n in sorted(ordered.groupBy("part").count().collect()):  # a row per partition
        before[part], total = total, total + n
    ahead = F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]) if before else F.create_map().cast("map<bigint,bigint>")
    rank = F.element_at(ahead, F.col("part").cast("bigint")) + F.col("place") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ordered.select(*columns, F.when(rank <= how.percent * total // 100, rank).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < how.least_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null where not drawn).

    Features of all documents and all target texts fall into ``buckets``; a document's weight is the mean gain of its features, and its
    score adds Gumbel noise fixed by its id, so the highest scores are a sample without replacement in proportion to exp(weight).

    Null and empty texts have no features and weight 0. A null id is written as an empty text in the noise and follows all others in ties. Repeated rows are
    ranked each; rows of equal score and id go by n_features, then weight. Without target texts every gain is smoothed from zero counts.
    An empty table gives no rows. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text_col).cast("string").alias("text"))
    states, pairs = frequent(own.select("text").unionByName(wanted.select("text")), how)
    features = count_features(own, states, pairs, how)
    gains = gains_of(bucket_totals(features, how), bucket_totals(count_features(wanted, states, pairs, how), how), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            buckets, counts = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            sums = np.concatenate([[0], np.cumsum(gains[buckets] * counts)])[ends]
            sizes = np.concatenate([[0], np.cumsum(counts)])[ends]
            n, gain = np.diff(sizes), np.diff(sums)
            weight = np.where(n > 0, gain // np.maximum(n, 1), 0)
            noise = np.array([noise_of(i, how.seed) for i in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    scored = stored(features.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"), "resample-scores")
    return ranked(scored, how)


def drawn_rows(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows of one id are drawn together if one of them is."""
    ids = resample(docs, target, how, id_col, **columns).where("rank is not null").select(F.col("doc_id").alias("drawn")).distinct()
    return docs.join(ids, docs[id_col].cast("bigint").eqNullSafe(ids["drawn"]), "left_semi")


SQL = r"""
with tbl as materialized (select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t from range(256) r(n)),
d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
dw as materialized (select r, word, count(*) as n from (select r, unnest(words) as word from d) group by r, word),
bw as (select word, count(*) as n from (select unnest(words) as word from b) group by word),
crc as materialized (select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(cast(len(x) / 2 as bigint)), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))),
    lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) % 10000 as bucket from (select word, hex(encode(word)) as x from (select word from dw union select word from bw)), tbl),
s as (select bucket, sum(n) as n from dw join crc using (word) group by bucket), t as (select bucket, sum(n) as n from bw join crc using (word) group by bucket),
gain as materialized (select g.b as bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (coalesce((select sum(n) from s), 0) + 10000)::double
    / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double))) as bigint) as gain
  from range(10000) g(b) left join s on s.bucket = g.b left join t on t.bucket = g.b),
w as (select r, cast(sum(n) as bigint) as n, cast(floor(sum(n * gain)::double / sum(n)::double) as bigint) as weight from dw join crc using (word) join gain using (bucket) group by r),
p as (select d.doc_id, len(words) as n_words, coalesce(w.n, 0) as n_features, coalesce(w.weight, 0) as weight,
    cast('0x' || substr(sha256('2024:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) as h from d left join w using (r)),
q as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from p),
k as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id, n_features, weight) end as place, count(*) filter (where n_words >= 20) over () as able from q)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end as rank from k
"""
