"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm import text as tx
from sitelake.llm.common import shared_folder, stored, unused, width
from sitelake.operators.components import components


@dataclass(frozen=True)
class Similarity:
    words: int = 5
    least: float = 0.8
    bands: int = 16
    rows: int = 5  # samples of a band
    rare: float = 1e-3  # shingles in a smaller share of the documents all weigh as if in this share
    cells: int = 1 << 21  # of each of the two rows of the sketch of document frequencies
    blocks: int = 64  # the sketch is summed in so many pieces
    pairs_per_task: int = 256  # members verified at once against one leader
    shingles_per_task: int = 1 << 22  # about as many are held at once for them, so long texts come in smaller blocks


STEPS = 16  # inverse document frequency runs from 1 to 2 in so many steps
DRAWS = 1 << 15
SKETCH_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the different shingles of each text, sorted by text and hash, and two hashes of each text's words.

    Words are runs of letters, numbers and marks in lower case. A text of fewer than ``n`` words is one shingle, one without words has none.
    """
    codes, begins = tx.codes_of([t.lower() for t in texts])
    kind = tx.classes()[codes]
    inside = (kind == tx.LETTER) | (kind == tx.NUMBER) | tx.marks()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    word = tx.span_hashes(codes, starts, ends)
    owner = np.searchsorted(begins, starts, side="right") - 1
    count = np.bincount(owner, minlength=len(texts)) if len(word) else np.zeros(len(texts), dtype=np.int64)
    first = np.cumsum(count) - count
    factor = tx.randoms(23, n)
    h = word * factor[0]
    for k in range(1, n):
        same = owner[k:] == owner[:-k]
        h[:-k] += np.where(same, word[k:] * factor[k], np.uint64(0))
    place = np.arange(len(word)) - first[owner]
    whole = (place + n <= count[owner]) | (place == 0)
    h, owner = tx.mixed(h[whole]), owner[whole]
    # Two order-sensitive hashes of the words.
    keys = np.zeros((2, len(texts)), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        spot = np.arange(len(word), dtype=np.uint64) - np.repeat(first[some], count[some]).astype(np.uint64)
        for row, seed in enumerate((29, 31)):
            salted = tx.mixed(word ^ (spot * tx.randoms(seed, 1)[0]))
            keys[row, some] = tx.mixed(np.add.reduceat(salted, first[some]) + count[some].astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h))), keys


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h * np.uint64(SKETCH_SEEDS[row])) >> np.uint64(64 - int(math.log2(cells)))).astype(np.int64)


def _count(s: Similarity):
    """Per task: the number of its documents in each cell, in ``blocks`` packed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, s.cells), dtype=np.uint32)
        for batch in batches:
            for _, some in tx.chunks([t or "" for t in batch.column(0).to_pylist()]):
                _, h, _, _ = shingles_of(some, s.words)
                for row in range(2):
                    found, n = np.unique(_cells(h, row, s.cells), return_counts=True)
                    sums[row, found] += n.astype(np.uint32)
        for block, piece in enumerate(np.split(sums, s.blocks, axis=1)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    return run


def level_of(share: np.ndarray, s: Similarity) -> np.ndarray:
    """Step of the inverse document frequency 1 + ln(1 / share) / ln(1 / rare), with no share below ``rare``."""
    return np.rint(STEPS * np.log(1 / np.clip(share, s.rare, 1)) / math.log(1 / s.rare)).astype(np.uint8)


def _sum(s: Similarity, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(zlib.decompress(raw), dtype=np.uint32).astype(np.int64)
                held[block] = held[block] + piece if block in held else piece
        for block, piece in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level_of(piece / total, s).tobytes()], pa.binary())], names=["block", "levels"])

    return run


def idf_levels(docs: DataFrame, text_col: str, total: int, s: Similarity) -> np.ndarray:
    """Levels of all cells of a count-min sketch of the shingles' document frequencies over all documents: two rows, of which the
    rarer cell counts. Its size is fixed and its error is a share of the documents (a cell's mean load is the mean number of shingles of a document over
    ``cells``, far below ``rare``), so it behaves alike at every size. Tasks send packed counts, which are summed piece by piece."""
    parts = docs.select(text_col).mapInArrow(_count(s), "block int, counts binary")
    sums = parts.repartition(s.blocks, "block").mapInArrow(_sum(s, total), "block int, levels binary").collect()
    out = np.full((2, s.blocks, s.cells // s.blocks), STEPS, dtype=np.uint8)
    for block, raw in sums:
        out[:, block, :] = np.frombuffer(raw, dtype=np.uint8).reshape(2, -1)
    return out.reshape(2, s.cells)


def weights_of(h: np.ndarray, counts: np.ndarray, levels: np.ndarray, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of shingles: the term frequency 1 + log2(count), in quarters, times the inverse document frequency; equal codes have equal weights."""
    idf = np.maximum(levels[0, _cells(h, 0, s.cells)], levels[1, _cells(h, 1, s.cells)]).astype(np.int64)
    tf = np.rint(4 * np.log2(counts)).astype(np.int64)
    return idf + (STEPS + 1) * tf, ((1 + idf / STEPS) * (1 + tf / 4)).astype(np.float32)


@cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(41))
    return rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS), rng.random(DRAWS)


@cache
def _sample_values(weight: float) -> np.ndarray:
    """Improved consistent weighted sampling: for each draw (r, c, beta), t = floor(ln w / r + beta), y = exp(r (t - beta)) and the value
    a = c / (y exp(r)), as an integer of the same order. The shingle with the smallest value is the sample."""
    r, c, beta = _draws()
    log_y = r * (np.floor(np.log(weight) / r + beta) - beta)
    return np.exp(np.log(c) - log_y - r).astype(np.float32).view(np.uint32)


def band_keys(owner: np.ndarray, h: np.ndarray, code: np.ndarray, weight: np.ndarray, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, keys of their bands). Each sample hashes the shingle to one of a table of draws; the lower half of its value is a hash of the
    shingle, so equal values are the same shingle and step, and shingles that share a draw are told apart."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    kinds, first, kind = np.unique(code, return_index=True, return_inverse=True)
    table = np.concatenate([_sample_values(float(weight[i])) for i in first]).astype(np.uint64) << np.uint64(32)
    base = kind.astype(np.int64) * DRAWS
    out = np.zeros((len(at), s.bands), dtype=np.uint64)
    salts, factors = tx.randoms(43, s.bands * s.rows), tx.randoms(47, s.bands * s.rows)
    for k in range(s.bands * s.rows):
        hk = (h ^ salts[k]) * factors[k]
        value = table[base + (hk >> np.uint64(49)).astype(np.int64)]
        value |= (hk >> np.uint64(17)) & np.uint64(0xFFFFFFFF)
        smallest = np.minimum.reduceat(value, at)
        band = k // s.rows
        out[:, band] = tx.mixed(out[:, band] * np.uint64(3) + smallest + np.uint64(band + 1))
    return owner[at], out


def _signatures(s: Similarity, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for first, some in tx.chunks(texts):
                owner, h, counts, keys = shingles_of(some, s.words)
                bands: list = [None] * len(some)
                if len(h):
                    for i, row in zip(*band_keys(owner, h, *weights_of(h, counts, levels.value, s), s)):
                        bands[i] = row.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first : first + len(some)], batch.column(1)[first : first + len(some)], *(pa.array(k.view(np.int64)) for k in keys), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "print", "h1", "h2", "bands"])

    return run


def _vectors(s: Similarity, levels):
    """The weighted shingles of rows (node, h1, h2, text) whose text still is the one meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, h1, h2 = (batch.column(i).to_numpy() for i in range(3))
            for first, some in tx.chunks([t or "" for t in batch.column(3).to_pylist()]):
                owner, h, counts, keys = shingles_of(some, s.words)
                _, weight = weights_of(h, counts, levels.value, s)
                at = np.searchsorted(owner, np.arange(len(some) + 1))
                keys = keys.view(np.int64)
                good = [i for i in range(len(some)) if keys[0, i] == h1[first + i] and keys[1, i] == h2[first + i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(nodes[first + i]) for i in good], pa.int64()), pa.array([int(at[i + 1] - at[i]) for i in good], pa.int32()), pa.array([h[at[i] : at[i + 1]].tobytes() for i in good], pa.binary()),
                     pa.array([weight[at[i] : at[i + 1]].tobytes() for i in good], pa.binary())], names=["node", "held", "shingles", "weights"])

    return run


def weighted_jaccard(h: np.ndarray, w: np.ndarray, other: np.ndarray, v: np.ndarray) -> float:
    """Sum of the smaller over the sum of the larger weights; both sets of hashes are sorted."""
    at = np.minimum(np.searchsorted(h, other), len(h) - 1)
    both = h[at] == other
    least = float(np.minimum(w[at[both]], v[both]).sum(dtype=np.float64))
    return least / (float(w.sum(dtype=np.float64)) + float(v.sum(dtype=np.float64)) - least) + 1e-9


def _verify(s: Similarity):
    def run(members: pa.Table, leaders: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if leaders.num_rows:
            leader = leaders["of"][0].as_py()
            h, w = (np.frombuffer(leaders[c][0].as_py(), dtype=t) for c, t in (("of_shingles", np.uint64), ("of_weights", np.float32)))
            for member, a, b in zip(members["member"].to_pylist(), members["member_shingles"].to_pylist(), members["member_weights"].to_pylist()):
                if weighted_jaccard(h, w, np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.float32)) >= s.least:
                    found.append((leader, member))
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _blocks(texts, held, most: int, shingles: int):
    return F.greatest(F.ceil(texts / most), F.ceil(held / shingles)).cast("int")


def verified(pairs: DataFrame, vectors: DataFrame, s: Similarity) -> DataFrame:
    """The pairs (leader, member) that are similar. A leader's members come in pieces of about ``pairs_per_task`` texts or ``shingles_per_task``, each with one copy of the leader's shingles."""
    sized = pairs.join(vectors.select(F.col("node").alias("member"), "held"), "member")
    pieces = sized.groupBy("leader").agg(_blocks(F.count("*"), F.sum("held"), s.pairs_per_task, s.shingles_per_task).alias("pieces"))
    dealt = sized.drop("held").join(pieces, "leader").withColumn("piece", F.expr("cast(pmod(xxhash64(member), pieces) as int)"))
    members = dealt.select("leader", "piece", "member").join(_shingles(vectors, "member"), "member")
    leaders = pieces.select(F.col("leader").alias("of"), F.explode(F.expr("sequence(0, pieces - 1)")).alias("part")).join(_shingles(vectors, "of"), "of")
    return members.groupBy("leader", "piece").cogroup(leaders.groupBy("of", "part")).applyInArrow(_verify(s), "a bigint, b bigint")


def _features(owner: np.ndarray, w: np.ndarray, new_shingle: np.ndarray, rows: int) -> np.ndarray:
    """The matrix of which the sum of smaller weights of two rows is the product of their rows: a shingle has a column for each of its different
    weights, worth the square root of the step from the weight below, and a row has all columns up to its own weight. Entries are sorted by shingle and weight."""
    new = new_shingle | np.concatenate([[True], w[1:] != w[:-1]])
    first = np.flatnonzero(new)
    column, worth = np.cumsum(new) - 1, w[first].copy()
    later = np.flatnonzero(~new_shingle[first])
    worth[later] -= w[first[later - 1]]
    out = np.zeros((rows, len(first)))
    out[owner, column] = 1
    for c in later[::-1]:  # a weight includes the weights below it
        out[:, c - 1] = np.maximum(out[:, c - 1], out[:, c])
    return out * np.sqrt(worth)


def similar(texts: list[tuple[np.ndarray, np.ndarray]], rows: int, least: float, cells: int = 1 << 22) -> np.ndarray:
    """Whether each of the first ``rows`` (hashes, weights) is similar to each of the others, as a table of booleans.

    Products are added up over slices of whole shingles, each a matrix of about ``cells`` numbers, so memory follows the shingles held and not
    texts times different shingles. A shingle of one text alone adds to its sum of weights only."""
    owner = np.repeat(np.arange(len(texts)), [len(h) for h, _ in texts])
    h, w = np.concatenate([h for h, _ in texts]), np.concatenate([w for _, w in texts]).astype(np.float64)
    sums = np.bincount(owner, weights=w, minlength=len(texts))
    order = np.lexsort((w, h))
    owner, h, w = owner[order], h[order], w[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    owner, w, new = owner[shared], w[shared], new[shared]
    both = np.zeros((rows, len(texts) - rows))
    column = np.cumsum(new | np.concatenate([[True], w[1:] != w[:-1]])[: len(w)])
    starts = np.flatnonzero(new)
    cuts = starts[np.flatnonzero(np.diff(column[starts] // max(cells // len(texts), 1), prepend=-1))]
    for begin, end in zip(cuts, [*cuts[1:], len(w)]):
        table = _features(owner[begin:end], w[begin:end], new[begin:end], len(texts))
        both += table[:rows] @ table[rows:].T
    return both >= least * (sums[:rows, None] + sums[None, rows:] - both) - 1e-9


def _settle(s: Similarity):
    """Links between the texts of two blocks that are in different components; as many as join them, not all."""

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        read = lambda t, c, kind: [np.frombuffer(x, dtype=kind) for x in t[c].to_pylist()]
        block = lambda t, n: list(zip(read(t, f"{n}_shingles", np.uint64), read(t, f"{n}_weights", np.float32)))
        if few.num_rows and many.num_rows:
            left, nodes, parts, own = block(few, "node"), few["node"].to_pylist(), few["part"].to_pylist(), many["other"].to_pylist()
            right, theirs = block(many, "other"), many["other_part"].to_pylist()
            root = {p: p for p in {*parts, *theirs}}

            def find(p):
                while root[p] != p:
                    p = root[p] = root[root[p]]
                return p

            for a in range(0, len(left), 64):
                for b in range(0, len(right), 256):
                    table = similar(left[a : a + 64] + right[b : b + 256], len(left[a : a + 64]), s.least)
                    for i, j in zip(*np.nonzero(table)):
                        x, y = find(parts[a + i]), find(theirs[b + j])
                        if x != y:
                            root[x] = y
                            links.append((nodes[a + i], own[b + j]))
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _by_node(vectors: DataFrame) -> DataFrame:
    """The vectors as a table bucketed by node in the shared folder: joins on the node move only the other side."""
    spark, buckets = vectors.sparkSession, width(vectors.sparkSession)
    name = f"near_vectors_{uuid.uuid4().hex}"
    vectors.repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", shared_folder(spark, "near-vectors")).saveAsTable(name)
    return spark.table(name).hint("merge")


def _shingles(vectors: DataFrame, node: str) -> DataFrame:
    return vectors.select(F.col("node").alias(node), F.col("shingles").alias(f"{node}_shingles"), F.col("weights").alias(f"{node}_weights"))


def linked(buckets: DataFrame, vectors: DataFrame, s: Similarity) -> DataFrame | None:
    """(node, root) of the texts connected by similar pairs that share a bucket (bucket, node); None without any.

    First each bucket is a star: its smallest node is verified against the others, one pair a text, and components are taken. That closes nearly
    all buckets, among them those of near copies, however large. Where a bucket still holds several components, all texts outside its largest one are verified against all
    texts of other components, in blocks of ``pairs_per_task`` by 2,048 texts, fewer if they are long; blocks emit the links that join components, not all. So every pair
    of a bucket is verified or connected, and nothing is skipped.
    """
    rooted = lambda roots: buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    low = buckets.groupBy("bucket").agg(F.min("node").alias("leader"))
    pairs = stored(buckets.join(low, "bucket").where("node <> leader").select("leader", F.col("node").alias("member")).distinct(), "near-pairs")
    stars = stored(verified(pairs, vectors, s), "near-stars")
    roots = stored(components(stars), "near-roots") if not stars.isEmpty() else None
    placed = rooted(roots) if roots is not None else buckets.withColumn("part", F.col("node"))
    rest = placed.join(low.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti").join(vectors.select("node", "held"), "node")
    sizes = rest.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    shape = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part", "held")).alias("main"), F.sum("n").alias("size"), F.sum("held").alias("held"), F.count("*").alias("parts")).where("parts > 1")
    shape = stored(shape.select(
        "bucket", F.col("main.part").alias("main"), _blocks(F.col("size") - F.col("main.n"), F.col("held") - F.col("main.held"), s.pairs_per_task, s.shingles_per_task).alias("slices"),
        _blocks(F.col("size"), F.col("held"), 2048, s.shingles_per_task).alias("tiles")), "near-open")
    if shape.isEmpty():
        return roots
    open_ = stored(rest.drop("held").join(shape, "bucket"), "near-rest")
    shingles = _shingles(vectors, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    few = open_.where("part <> main").select("bucket", slot("slices").alias("slice"), spread("tiles").alias("tile"), "node", "part").join(shingles, "node")
    many = open_.select(F.col("bucket").alias("of"), spread("slices").alias("of_slice"), slot("tiles").alias("of_tile"), F.col("node").alias("other"), F.col("part").alias("other_part"))
    many = many.join(_shingles(vectors, "other"), "other")
    more = stored(few.groupBy("bucket", "slice", "tile").cogroup(many.groupBy("of", "of_slice", "of_tile")).applyInArrow(_settle(s), "a bigint, b bigint"), "near-links")
    return stored(components(stars.unionByName(more)), "near-roots") if not more.isEmpty() else roots


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity = Similarity()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, print.

    A class is a connected component of texts whose weighted Jaccard similarity is ``least`` or more; class_id is its smallest doc_id, and the
    row that bears it is kept. Texts of the same words are one node, whose copies are counted and never compared. Candidates share a band; each is
    verified on the whole texts. Two texts of similarity s meet with probability 1 - (1 - s^rows)^bands: 0.998 at 0.8.

    Null, empty and wordless texts are classes of their own; a text of fewer than five words is one shingle. Repeated rows are in one class, of which one row is kept.
    Null ids come last. ``print`` is a hash of the raw text that tells rows of one id apart. An empty table gives no rows; other columns are ignored.
    """
    spark, s = docs.sparkSession, similarity
    doc_id = F.col(id_col).cast("bigint")
    source = docs.select(doc_id.alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(idf_levels(source, "text", max(source.count(), 1), s))  # two bytes a cell
    signed = source.mapInArrow(_signatures(s, levels), "doc_id bigint, print bigint, h1 bigint, h2 bigint, bands array<bigint>")
    rows = stored(signed.select(F.monotonically_increasing_id().alias("row"), "*"), "near-signatures")
    texts = stored(rows.where("bands is not null").groupBy("h1", "h2").agg(F.min(F.struct("row", "doc_id", "bands")).alias("first")).select("h1", "h2", "first.*").withColumnRenamed("row", "node"), "near-texts")
    banded = texts.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = stored(banded.join(shared, "bucket").select("bucket", "node"), "near-buckets")
    asked = buckets.select("node").distinct().join(texts.drop("bands"), "node").select("node", "h1", "h2", F.col("doc_id").alias("of"))
    wanted = source.hint("merge").join(asked, F.expr("doc_id <=> of")).select("node", "h1", "h2", "text")
    vectors = _by_node(wanted.mapInArrow(_vectors(s, levels), "node bigint, held int, shingles binary, weights binary").dropDuplicates(["node"]))
    roots = linked(buckets, vectors, s)
    nodes = texts.select("h1", "h2", "node")
    if roots is not None:
        nodes = nodes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("node"))
    classed = stored(
        rows.where("bands is not null").select("row", "doc_id", "print", "h1", "h2").join(nodes, ["h1", "h2"]).select("row", "doc_id", "print", "node")
        .unionByName(rows.where("bands is null").select("row", "doc_id", "print", F.col("row").alias("node"))), "near-classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # Written first, so that the last join is between two plain shuffles and a hot class may be split.
    groups = stored(classed.groupBy("node").agg(first.alias("first"), F.count("*").alias("class_size")), "near-groups")
    return classed.join(groups, "node").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "print")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    key, print_, rows, number = (unused(n, docs) for n in ("near_key", "near_print", "near_rows", "near_no"))
    id_key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**63)))
    kept = near_classes(docs, id_col, text_col, similarity).where("kept").groupBy(id_key("doc_id").alias(key), F.col("print").alias(print_)).agg(F.count("*").alias(rows))
    out = docs.withColumn(key, id_key(id_col)).withColumn(print_, F.xxhash64(text_col)).join(kept, [key, print_])
    place = F.row_number().over(Window.partitionBy(key, print_).orderBy(key))
    return out.withColumn(number, place).where(F.col(number) <= F.col(rows)).select(*docs.columns)
