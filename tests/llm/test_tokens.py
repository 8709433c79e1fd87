"""op1 and op4 against the tokenizer itself on whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest_llm import EDGE
from sitelake.llm import packing, token_counts
from sitelake.llm.tokens import encoder, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")
PIECES = ["it's", "'s", " ", "\n", "  ", "\r\n", "we've", "x'll", "'", "''s", "é", "ß", "“q”", "12", "a1", "!?", "日本", "\u00a0", "\t", "<|endoftext|>", "'re", "The", " the", "\x1c", "👍"]


def whole(text):
    return encoder(PATH).whole.encode(text, add_special_tokens=False)


def test_ids_and_spans_equal_the_tokenizer():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(600)] + [t or "" for _, t, _, _ in EDGE]
    ids, begin = encoder(PATH).encode(texts)
    for i, text in enumerate(texts):
        want, got = whole(text), ids[begin[i] : begin[i + 1]]
        assert got.tolist() == want.ids, repr(text)
        assert list(zip(*(s.tolist() for s in encoder(PATH).spans(text, got)))) == want.offsets or not len(got), repr(text)


def test_memory_begun_anew_changes_nothing(monkeypatch):
    monkeypatch.setattr("sitelake.llm.tokens.KEPT_WORDS", 5)
    texts = ["a bc def ghij klm nop", "def nop qrs tuv wxyz a"] * 3
    ids, begin = encoder(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [whole(t).ids for t in texts]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(edge, rule):
    rows = defaultdict(list)
    for r in token_counts.token_counts(edge.where("doc_id is not null and doc_id <> 1"), rule=rule).collect():
        rows[r["doc_id"]].append(r)
    texts = {i: t or "" for i, t, _, _ in EDGE if i not in (None, 1)}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        own = sorted(rows[i], key=lambda r: r["section"])
        bounds = np.cumsum([0] + [r["chars"] for r in own])
        assert bounds[-1] == len(text) and [r["start"] for r in own] == bounds[:-1].tolist()
        want = np.zeros(len(own))
        for a, b in whole(text).offsets:
            over = np.array([max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(bounds, bounds[1:])])
            if rule == "share":
                want += over / over.sum()
            else:
                want[np.flatnonzero(over)[0] if rule == "first" else over.argmax()] += 1
        assert np.allclose(want, [r["tokens"] for r in own]) and {r["doc_tokens"] for r in own} == {len(whole(text).ids)}


def test_fields(spark, none):
    docs = spark.createDataFrame([(1, "A title", "Body text\nmore"), (2, None, "b")], "doc_id long, title string, body string")
    rows = sorted(token_counts.token_counts(docs, fields=("title", "body")).collect(), key=lambda r: (r["doc_id"], r["start"], r["field"] == "body"))
    assert [(r["doc_id"], r["field"], r["section"]) for r in rows] == [(1, "title", 0), (1, "body", 0), (1, "body", 1), (2, "title", 0), (2, "body", 0)]
    assert sum(r["tokens"] for r in rows if r["doc_id"] == 1) == len(whole("A title\nBody text\nmore").ids)
    assert token_counts.token_counts(none).count() == 0


def test_plan_fills_sequences():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([4, 7, 16, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 14))}
        used, found = defaultdict(list), Counter()
        for length, a, b, first, per, offset in packing.plan(counts, capacity):
            for rank in range(a, b + 1):
                used[first + (rank - a) // per].append((offset + (rank - a) % per * length, length))
                found[length] += 1
        assert found == Counter(counts)
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        # No worse than best-fit decreasing, one piece at a time.
        bins = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [i for i, f in enumerate(bins) if f >= length]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= length
            else:
                bins.append(capacity - length)
        assert len(used) <= len(bins)


def test_pack(edge, none):
    rows = packing.pack(edge).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, text, _, _ in EDGE:
        if i in (1, None):
            continue
        ids, own = [*whole(text or "").ids, 2], sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), 1024)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    assert len(by_doc[1]) == 3 and len(by_doc[None]) == 2
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0] + [n for _, n in sorted(spans)])[:-1].tolist() and sum(n for _, n in spans) <= 1024
    assert packing.pack(none).count() == 0
