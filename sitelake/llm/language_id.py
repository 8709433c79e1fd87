"""Language ID: blended-spectrum n-gram presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm import text as tx
from sitelake.llm.common import stored
from sitelake.operators.sampling import bottom_k

ORDERS = (1, 2, 3)
BUCKETS = 1 << 18  # n-grams are hashed to so many features
UNKNOWN = "und"
BLANK = 0x20
BLOCK = 256  # texts scored by one product


@dataclass(frozen=True)
class Sampling:
    """How much labelled text is learned from: rows per language, and how many of them are landmarks, in the order of a hash of the id."""

    rows_per_language: int = 400
    landmarks_per_language: int = 40
    most_languages: int = 200
    ridge: float = 1e-2


@dataclass(frozen=True)
class Model:
    """Scores of a presence vector p: p @ weights / norm of p. ``weights`` is P_L^T A: the landmarks' normalised presence rows
    times the dual coefficients, so one product gives k(x, L) A. ``seen`` marks the features that landmarks have; a text of which a
    smaller share than ``floor`` is seen is in no learned language (see ``coverage_floor``)."""

    languages: tuple[str, ...]
    weights: np.ndarray
    seen: np.ndarray
    floor: float = 0.0


def presence(texts: list[str]) -> Iterator[np.ndarray]:
    """Distinct features of each text: n-grams of lower-case letters, with one blank for any run of other characters and at both
    ends. A text without letters has none."""
    last = np.zeros(BUCKETS, dtype=np.int64)
    for _, some in tx.chunks(texts):
        codes, begins = tx.codes_of([t.lower() for t in some])
        letter = (tx.classes()[codes] == tx.LETTER) | tx.marks()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of other characters, or the end
        keep[:-1] |= letter[1:] & ~letter[:-1]
        keep[1:] &= letter[1:] | letter[:-1] | (codes[:-1] == tx.END)
        kept = np.where(letter, codes, BLANK)[keep]
        bounds = np.searchsorted(np.flatnonzero(keep), begins)
        value = tx.mixed(kept.astype(np.uint64) + np.uint64(1))
        grams = []
        for n in ORDERS:
            h = value[: max(len(value) - n + 1, 0)].copy()
            for k in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + value[k : len(value) - n + 1 + k]
            grams.append((tx.mixed(h + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b <= a or not (kept[a:b] != BLANK).any():
                yield np.zeros(0, dtype=np.int64)
                continue
            own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(ORDERS, grams)])
            place = np.arange(len(own))
            last[own] = place
            yield own[last[own] == place]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.sort(p).astype(np.int32) for p in presence([t or "" for t in batch.column(1).to_pylist()])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["label", "features"])


def _kernel(rows: list[np.ndarray], landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of rows with the landmarks; ``landmarks`` is features x landmarks, each column of length one."""
    return np.stack([landmarks[r].sum(axis=0) / np.sqrt(max(len(r), 1)) for r in rows])


def _moments(landmarks: list[np.ndarray], languages: list[str]):
    """Sums of z z^T and z y^T over the rows of a task, each language weighing the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _columns(landmarks)
        at = {lang: i for i, lang in enumerate(languages)}
        m, c = len(landmarks), len(languages)
        squares, cross = np.zeros((c, m, m)), np.zeros((c, m))
        counts = np.zeros(c)
        for batch in batches:
            labels = np.array([at[v] for v in batch.column(0).to_pylist()], dtype=np.int64)
            z = _kernel([np.asarray(r.values) for r in batch.column(1)], table)
            for k in range(c):
                own = z[labels == k]
                squares[k] += own.T @ own
                cross[k] += own.sum(axis=0)
                counts[k] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (squares, cross, counts)], names=["squares", "cross", "counts"])

    return run


def _columns(landmarks: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((BUCKETS, len(landmarks)), dtype=np.float32)
    for k, own in enumerate(landmarks):
        out[own, k] = 1 / np.sqrt(max(len(own), 1))
    return out


def coverage_floor(landmarks: list[np.ndarray], labels: list[str]) -> float:
    """Half-way between the share of its features that a landmark of a learned language has in common with the others (low quantile) and the
    share that it has with those of other languages alone (median): what an unlearned language would have. Margins don't tell the two
    apart: those of a mixed text and of an unknown one are both near 0. Texts of several learned languages are covered like any other."""
    rows = {r.tobytes(): (r, label) for r, label in zip(landmarks, labels)}  # equal texts say nothing of others
    counts = {label: np.zeros(BUCKETS, dtype=np.int64) for label in set(labels)}
    for r, label in rows.values():
        counts[label][r] += 1
    total = sum(counts.values())
    learned = [np.mean(total[r] > 1) for r, _ in rows.values()]
    foreign = [np.mean(total[r] > counts[label][r]) for r, label in rows.values()]
    known, other = np.quantile(learned, 0.05), np.median(foreign)
    return float(min(known, (known + other) / 2))


def sample_rows(labelled: DataFrame, sampling: Sampling) -> DataFrame:
    """(label, text): of every label the ``rows_per_language`` rows of least hash of id and text, all if there are fewer.

    Labels are counted first, so only rows whose hash is small enough for about four times as many go on; a label that this leaves short is taken
    again without that limit. The rest merges in a tree, so what one task meets of a label follows from the bound and not from the input or its splits.
    Rows are chosen, not ids: an id on many rows fills no more than the bound.
    """
    k = sampling.rows_per_language
    rows = labelled.where("label is not null and id is not null and text is not null").select("label", "text", F.xxhash64("id", "text").alias("hash"), "id")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(sampling.most_languages + 1).collect()}
    if len(counts) > sampling.most_languages:
        raise ValueError(f"more than {sampling.most_languages} languages")
    if not counts:
        return rows.select("label", "text")
    shares = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, 4.0 * k / n))])
    place = F.shiftrightunsigned("hash", 11).cast("double") / float(2**53)
    chosen = stored(bottom_k(rows.where(place < F.element_at(shares, F.col("label"))), ["label"], ["hash", "id"], k), "language-sample")
    found = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    short = [label for label, n in counts.items() if found.get(label, 0) < min(k, n)]
    if short:
        again = bottom_k(rows.where(F.col("label").isin(short)), ["label"], ["hash", "id"], k)
        chosen = chosen.where(~F.col("label").isin(short)).unionByName(stored(again, "language-sample"))
    return chosen.select("label", "text")


def train(labelled: DataFrame, sampling: Sampling = Sampling()) -> Model:
    """Learns from rows (id, text, label) with a label; at most ``sampling.rows_per_language`` of each, see ``sample_rows``.

    Landmarks and the sums over the sample are all that reaches the driver: their size depends on ``sampling`` and the
    number of labels, not on the input. More labels than ``most_languages`` are an error.
    """
    rows = sample_rows(labelled, sampling)
    languages = [r[0] for r in rows.select("label").distinct().sort("label").collect()]  # most_languages at most
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(BUCKETS, dtype=bool))
    features = stored(rows.repartition(4).mapInArrow(_features, "label string, features array<int>").where("size(features) > 0"), "language-features")
    mark = F.expr("row_number() over (partition by label order by xxhash64(features))")
    marked = features.withColumn("rank", mark).where(F.col("rank") <= sampling.landmarks_per_language).select("features", "label").collect()
    landmarks = [np.asarray(r[0]) for r in marked]
    if not landmarks:
        return Model((), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(BUCKETS, dtype=bool))
    m, c = len(landmarks), len(languages)
    squares, cross, counts = np.zeros((c, m, m)), np.zeros((c, m)), np.zeros(c)
    for r in features.coalesce(4).mapInArrow(_moments(landmarks, languages), "squares binary, cross binary, counts binary").collect():
        squares += np.frombuffer(r[0]).reshape(c, m, m)
        cross += np.frombuffer(r[1]).reshape(c, m)
        counts += np.frombuffer(r[2])
    weigh = 1 / np.maximum(counts, 1)
    total = np.tensordot(weigh, squares, axes=1)
    table = _columns(landmarks)
    values, vectors = np.linalg.eigh(_kernel(landmarks, table).astype(np.float64))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström map: z -> z root
    targets = 2 * (weigh[:, None] * cross) - (weigh[:, None] * cross).sum(axis=0)  # one against the rest, +1 and -1
    dual = root @ np.linalg.solve(root.T @ total @ root + sampling.ridge * np.eye(int(good.sum())), root.T @ targets.T)
    return Model(tuple(languages), (table @ dual.astype(np.float32)).astype(np.float32), table.any(axis=1), coverage_floor(landmarks, [r[1] for r in marked]))


def _predict(bundle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, seen, floor = bundle.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.zeros(len(texts), dtype=np.int64)
            scores, covered = np.zeros((len(texts), max(len(languages), 1))), np.zeros(len(texts), dtype=bool)
            for a in range(0, len(texts), BLOCK):  # rows of presence times weights, a block of texts at a time
                found = list(presence(texts[a : a + BLOCK]))
                sizes[a : a + BLOCK] = [len(f) for f in found]
                some = np.flatnonzero(sizes[a : a + BLOCK])
                if len(languages) and len(some):
                    own = sizes[a + some]
                    features = np.concatenate([found[i] for i in some])
                    scores[a + some] = np.add.reduceat(weights[features], np.cumsum(own) - own, axis=0) / np.sqrt(own)[:, None]
                    share = np.add.reduceat(seen[features].astype(np.int64), np.cumsum(own) - own) / own
                    # A text that a classifier claims may fall short by three standard errors; features count as a third, as n-grams overlap.
                    spare = np.where(scores[a + some].max(axis=1) >= 0, 3 * np.sqrt(floor * (1 - floor) * len(ORDERS) / own), 0)
                    covered[a + some] = share >= floor - spare
            best = scores.argmax(axis=1)
            known = (sizes > 0) & bool(languages)
            names = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            sure = np.where(known, np.clip((1 + scores[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(covered, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "covered"])

    return run


def predict(rows: DataFrame, model: Model, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns (named), lang_pred, score and covered, whether landmarks have enough of its features, of every row of ``rows``."""
    spark = rows.sparkSession
    bundle = spark.sparkContext.broadcast((model.languages, model.weights, model.seen, model.floor))  # BUCKETS x languages floats
    source = rows.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_predict(bundle), f"{schema}{', ' if schema else ''}lang_pred string, score double, covered boolean")


def fold_of(doc_id: Column) -> Column:
    """True for documents that are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sampling: Sampling = Sampling()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows outside the held-out fifth (see ``fold_of``) with a label; predicts every row from its whole text alone. score is (1 + margin) / 2 of the
    winning classifier, cut to 0..1: below 0.5 no classifier claims the text. Null text or one without a letter: ``und``, score 0; so
    are all rows if there is no labelled text. Rows without id are predicted and not learned from. Equal scores go to the first language by name.
    Repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
    """
    doc_id = F.col(id_col)
    labelled = docs.where(~fold_of(doc_id)).select(doc_id.cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"))
    return predict(docs, train(labelled, sampling), text_col, [doc_id.cast("bigint").alias("doc_id"), fold_of(doc_id).alias("held_out")]).drop("covered")


def accepted_rows(docs: DataFrame, least: float = 0.5, learned_only: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sampling: Sampling = Sampling()) -> DataFrame:
    """The rows of ``docs`` with all their columns, without those of unknown language or a score below ``least`` and, with
    ``learned_only``, without texts that no learned language covers (see ``coverage_floor``). The columns pass through the scoring task, so nothing is shuffled."""
    doc_id = F.col(id_col)
    labelled = docs.where(~fold_of(doc_id)).select(doc_id.cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"))
    kept = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)]
    found = predict(docs, train(labelled, sampling), text_col, kept)
    if learned_only:
        found = found.where("covered")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
