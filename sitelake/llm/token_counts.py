"""Token counts by offset-mapped attribution."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm import text as tx
from sitelake.llm.tokens import encoder, vocabulary_path

RULES = ("first", "largest", "share")
OUT = "doc_id bigint, field string, section int, start bigint, chars bigint, tokens double, doc_tokens bigint"


def section_ends(text: str, separator: re.Pattern) -> list[int]:
    """Ends of a text's sections; a separator belongs to the section before it. The sections cover the text."""
    ends = [m.end() for m in separator.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Token spans [start, end) meet sections [bounds[i - 1], bounds[i]); both are in order, so the
    join is a binary search. A token inside one section counts there. One that crosses a boundary goes by ``rule``:
    first - the section of its first character; largest - the section with most of its characters, the earlier of equals;
    share - each section by its share of the characters.
    """
    low, high = np.searchsorted(bounds, starts, side="right"), np.searchsorted(bounds, ends, side="left")
    low = np.minimum(low, len(bounds) - 1)
    cross = np.flatnonzero(high > low)
    whole = np.ones(len(starts), dtype=bool)
    if rule != "first":
        whole[cross] = False
    out = np.bincount(low[whole], minlength=len(bounds)).astype(float)
    for t in cross.tolist() if rule != "first" else ():
        edges = np.concatenate([[starts[t]], bounds[low[t] : high[t]], [ends[t]]])
        parts = np.diff(edges)
        if rule == "share":
            out[low[t] : high[t] + 1] += parts / parts.sum()
        else:
            out[low[t] + int(np.argmax(parts))] += 1
    return out


def _counts(fields: Sequence[str], pattern: str, rule: str, path: str):
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separator, enc = re.compile(pattern), encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            values = [[v or "" for v in batch.column(1 + k).to_pylist()] for k in range(len(fields))]
            texts = ["\n".join(parts) for parts in zip(*values)] if len(fields) > 1 else values[0]
            for first, some in tx.chunks(texts):
                ids, begin = enc.encode(some)
                rows: list[list] = [[] for _ in names]
                for i, text in enumerate(some):
                    own = ids[begin[i] : begin[i + 1]]
                    ends, labels, base = [], [], 0
                    for k, name in enumerate(fields):
                        part = values[k][first + i] + ("\n" if k + 1 < len(fields) else "")
                        found = section_ends(part, separator)
                        ends += [base + e for e in found]
                        labels += [(name, n) for n in range(len(found))]
                        base += len(part)
                    bounds = np.array(ends, dtype=np.int64)
                    tokens = attribute(*enc.spans(text, own), bounds, rule)
                    starts = [0, *ends[:-1]]
                    for column, more in zip(rows, (
                        [doc_ids[first + i]] * len(ends), [n for n, _ in labels], [n for _, n in labels], starts,
                        [e - s for s, e in zip(starts, ends)], tokens.tolist(), [len(own)] * len(ends))):
                        column += more
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return run


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), id_col: str = "doc_id", separator: str = r"\n", rule: str = "largest", path: str | None = None) -> DataFrame:
    """One row per document, field and section: doc_id, field, section (from 0), start, chars, tokens, doc_tokens.

    A document is its fields, joined by a line break that belongs to the field before it, and is encoded once and whole; the spans of its
    tokens are then joined with the spans of its sections. ``tokens`` of a document's sections add up to ``doc_tokens`` under every rule
    (see ``attribute``). start and chars count characters of the joined document.

    Each row is worked on alone: no shuffle, and memory is bounded by a chunk of texts or the longest text. Null or empty fields have one
    empty section. Repeated rows count each, null ids stay null, an empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(id_col).cast("bigint")] + [F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)]
    return docs.select(*columns).mapInArrow(_counts(tuple(fields), separator, rule, path or vocabulary_path("byte_bpe_50k.json")), OUT)
