"""op5, op6, op7, op10, op3: brute force, round trips, held-out accuracy and recall."""

import hashlib
import random
import re
import textwrap

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest_llm import EDGE
from sitelake.llm import ann, language_id, license_scan, url_filter, warc
from sitelake.llm.common import shared_folder, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_source_mixing", "op5_warc", "op7_url_filter", "op9_exact_dedup"])
def test_query_equals_sql(spark, name):
    problem, n, _, _ = compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert not problem and n > 0


def test_warc_edges(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (2, None, big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "z" * 3_000_000), (8, "u", "a\r\n\r\nb" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as refers_to", "2 as bundle").repartition(2)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        repeats = html == big and i != 2
        want.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if repeats else "response", 2 if repeats else None))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reads_only_what_is_asked(spark, tmp_path):
    folder = shared_folder(spark, "warc-test")
    index = warc.write_archives(table(spark, FOLDER, "pages"), folder)
    some = [r["page_id"] for r in warc.read_archives(index.where("page_id in (3, 8)"), folder).collect()]
    assert sorted(some) == [3, 8]
    fs, path = warc.filesystem(folder)
    name = index.first()["bundle"]
    with fs.open_input_file(f"{path}/{name}") as source:
        frames = warc.frames_of(source)
        source.seek(0)
        import zstandard

        whole = zstandard.ZstdDecompressor().stream_reader(source.read(), read_across_frames=True).read()
    assert len(whole) == sum(size for _, _, size in frames) and whole.startswith(b"WARC/1.1\r\n")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licenses(text):
    low = (text or "").translate(LOWER)
    words, places, base, best = WORD.findall(low), [], set(), 0.0
    for phrase, label in license_scan.PHRASES:
        own = phrase.split()
        found = [k for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]
        places += found
        base |= {label} if found else set()
    labels = set(base)
    for label, notice in license_scan.TEMPLATES:
        own = set(WORD.findall(notice.translate(LOWER)))
        reach = int(len(WORD.findall(notice.translate(LOWER))) / license_scan.THRESHOLD + 1e-9)
        for k in range(max(1, len(words) - reach + 1)):
            share = len(own.intersection(words[k : k + reach])) / len(own)
            if share >= license_scan.THRESHOLD:
                labels.add(label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


def test_licenses(spark, edge, none):
    rng = random.Random(4)
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = [t for _, t, _, _ in EDGE]
    for _ in range(400):
        words = [w for w in rng.choice(notices).split() if rng.random() > 0.06]
        rng.shuffle(words) if rng.random() < 0.3 else None
        texts.append("\n".join(["alpha beta", " ".join(words), rng.choice(["The MIT licence", "under the\nMIT license", "CC-by nc", "x"])]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as row", "2 as block").repartition(3)
    for r in license_scan.scan(docs).collect():
        want = licenses(texts[r["doc_id"]])
        assert tuple(r)[1:-1] == want[:-1] and abs(r["score"] - want[-1]) < 1e-12
    assert license_scan.scan(edge).count() == len(EDGE) and license_scan.scan(none).count() == 0


def test_licenses_wrapped(spark):
    """Notices over several lines: in comments, with words missing or added, and words of a notice too far apart to be one."""
    rng, texts, want = random.Random(7), [], []
    for label, notice in license_scan.TEMPLATES:
        for width in (72, 40, 20, 12):
            for mark in ("", "# ", " * ", "// "):
                body = f"{'Intro ' * rng.randrange(12)}{notice} {'Further words follow here. ' * rng.randrange(6)}"
                texts.append("Some title\n\n" + "\r\n".join(mark + line for line in textwrap.wrap(body, width, break_long_words=False)) + "\nend")
                want.append(set(filter(None, licenses(texts[-1])[-2].split(","))))
                assert label in want[-1]
    mit = next(t for _, t in license_scan.TEMPLATES if len(t.split()) > 25)
    real = mit.replace("documentation files, to", 'documentation files (the "Software"), to')
    texts += ["\n".join(textwrap.wrap(x, 72)) for x in (real, mit.replace("charge", "x"), " ".join(mit.split()[:18]))]
    want += [{"mit"}, {"mit"}, set()]
    texts.append("GNU is\nsaid to be a\nGeneral term of a Public kind, no\nLicense has a\nversion, nor 3 of them, and the rest goes on")
    want.append(set())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, labels in enumerate(want):
        assert set(filter(None, got[i]["labels"].split(","))) == labels, texts[i]
        assert got[i]["score"] >= license_scan.THRESHOLD if labels else got[i]["score"] == 0


def test_standard_headers(spark):
    """Notices as files have them, with the words around them."""
    texts = {
        1: "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */",
        2: "// SPDX-License-Identifier: GPL-2.0-or-later", 3: "# SPDX-License-Identifier: BSD-3-Clause\nimport os",
        4: "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        5: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", 6: "licensed under a Creative Commons Attribution 4.0 International License",
        7: "under the terms of the GNU Lesser General Public License, and no more", 8: "a general licence of the public, and the foundation of free software"}
    want = {1: "gpl,gpl-3", 2: "gpl-2", 3: "bsd-3", 4: "isc", 5: "cc-by-sa", 6: "cc-by", 7: "lgpl", 8: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()} == want


def test_runs_hold_every_run():
    """What is left out is part of what is taken, on many small texts."""
    rng = random.Random(3)
    for _ in range(300):
        text, span, least = [rng.randrange(9) for _ in range(rng.randrange(30))], rng.randrange(1, 12), rng.randrange(1, 6)
        own = [(i, w) for i, w in enumerate(text) if w < 6]
        taken = [set(r) for r in license_scan.runs_of(own, span, least)]
        windows = [{w for w in text[i : i + span] if w < 6} for i in range(len(text))]
        assert all(len(t) >= least and t in windows for t in taken)
        assert all(any(w <= t for t in taken) for w in windows if len(w) >= least)


def test_long_text_takes_linear_time():
    """A text full of a phrase: ten million bytes in seconds."""
    import time

    import pyarrow as pa

    phrase, words = license_scan.PHRASES[0][0], license_scan.vocabulary(license_scan.TEMPLATES)
    notices = [(frozenset(license_scan.words_of(t)), license_scan.need_of(len(set(license_scan.words_of(t))), 0.9), license_scan.reach_of(t, 0.9)) for _, t in license_scan.TEMPLATES]
    text = f"{phrase} " * (10_000_000 // len(phrase))
    start = time.time()
    out = next(license_scan._scan(license_scan.PHRASES, words, notices)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])])))
    assert out.column("n_base")[0].as_py() == 10_000_000 // len(phrase) and time.time() - start < 30


def test_url_filter(spark):
    urls = {1: "HTTP://WWW.Example.COM/en/a", 2: "http://example.com/en/a?x#y", 3: "http://a.example.com/en/", 4: "http://a.com", 5: "http://x.net/es/1", 6: "http://net/fr/?", 7: "x.net/es/", 8: None, 9: "http://xnet/es/", 10: "https://s.org/p/?utm_source=f#q", 11: "https://s.org/q", 12: "a://b://c.com/", 13: "https://m.s.org/p.html?ref=z"}
    pages = spark.createDataFrame(list(urls.items()) + [(10, urls[10])], "page_id long, url string").selectExpr("*", "1 as host", "2 as canonical")
    listed = spark.createDataFrame([("s.org/p",), ("s.org/p",), ("",), (None,)], "canonical string")
    rows = url_filter.judge(pages, listed).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(urls) + 1
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("example.com", "/en/a", "example.com/en/", "block"), 3: ("a.example.com", "/en/", "example.com/en/", "block"),
        4: ("a.com", "", None, "allow"), 5: ("x.net", "/es/1", "net/es/", "block"), 6: ("net", "/fr/", "net/fr/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("xnet", "/es/", None, "allow"), 10: ("s.org", "/p/", None, "block"), 11: ("s.org", "/q", None, "allow"), 12: ("b:", "//c.com/", None, "allow"), 13: ("m.s.org", "/p.html", None, "block")}
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id = 10"), listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negative_and_few_positives(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) as canonical")
    blooms, blocks = url_filter.bloom_filter(keys, "canonical")
    assert url_filter.maybe_listed(keys, "canonical", blooms, blocks).count() == 20000
    others = spark.range(20000).selectExpr("concat('o', id) as canonical")
    assert url_filter.maybe_listed(others, "canonical", blooms, blocks).count() < 200


def test_language(spark, edge, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = language_id.identify(edge).collect()
    assert len(got) == len(EDGE)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (2, 3, 6, 8))
    assert language_id.identify(none).count() == 0
    stay = language_id.accepted_rows(edge, 0.0)
    assert stay.columns == edge.columns and stay.count() == sum(r["lang_pred"] != "und" for r in got)
    unlabelled = language_id.identify(edge.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_kernel_scores_equal_the_dual_form():
    """presence @ weights is k(x, L) A: one bit of the landmarks' kernel rows at a time."""
    texts = ["the cat sat", "die katze sass", "le chat est assis", "a cat"]
    found = list(language_id.presence(texts))
    table_ = language_id._columns(found[:3])
    kernel = language_id._kernel(found, table_)
    for i, a in enumerate(found):
        for j, b in enumerate(found[:3]):
            assert np.isclose(kernel[i, j], len(set(a) & set(b)) / np.sqrt(len(a) * len(b)))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as class", "2 as rank", "3 as vector").repartition(4)


def test_nearest_small(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] + [0.0] * 6), (304, [1.0, 2.0]), (305, []), (None, rows[1][1]), (5, rows[5][1])]
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and i not in range(300, 306)}
    got = {}
    for r in ann.nearest(vectors(spark, rows), "vec_id % 10 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    assert set(got) == {i for i in good if i % 10 == 0}
    for q, found in got.items():
        want = sorted(((-round(cosine(good[q], v), 9), i) for i, v in good.items() if i != q))[:5]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
    few = ann.nearest(vectors(spark, rows[:3]), "vec_id = 0").collect()
    assert len(few) == 2 and ann.nearest(vectors(spark, rows).limit(0), "true").count() == 0


def test_nearest_recall_with_lists(spark):
    search = ann.Search(block_rows=64)
    table_ = table(spark, "/root/testdata/sf0.1", "embeddings")
    data = {r[0]: np.array(r[1], dtype=float) for r in table_.select("vec_id", "embedding").collect()}
    ids = np.array(sorted(data))
    unit = np.stack([data[i] / np.linalg.norm(data[i]) for i in ids])
    hits = total = 0
    for q, found in ann.nearest(table_, "vec_id % 50 = 0", search).toPandas().groupby("query_id"):
        scores = unit @ unit[np.searchsorted(ids, q)]
        scores[np.searchsorted(ids, q)] = -2
        hits += len(set(found["vec_id"]) & set(ids[np.argsort(-scores)[:5]]))
        total += 5
    assert hits / total >= 0.9


def recall(spark, folder, queries, search):
    """Share of the true five nearest that are found, and how many neighbours the queries got."""
    table_ = table(spark, folder, "embeddings")
    rows = table_.toPandas()
    ids, unit = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = ann.nearest(table_, queries, search).toPandas().groupby("query_id")["vec_id"].agg(set)
    at = {v: i for i, v in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        scores = unit @ unit[at[q]]
        scores[at[q]] = -2
        hits += len(found & set(ids[np.argpartition(-scores, 5)[:5]]))
    return hits / (5 * len(got)), {len(f) for f in got}


def test_nearest_recall_with_a_sample_far_smaller_than_the_table(spark):
    found, sizes = recall(spark, "/root/testdata/sf0.1", "vec_id % 20 = 0", ann.Search(sample=100, block_rows=64))
    assert found >= 0.9 and sizes == {5}


def test_nearest_finds_only_what_the_lists_hold(spark, monkeypatch):
    """The sample gives no neighbours of its own and holds a small part of the table."""
    fitted = []
    monkeypatch.setattr(ann, "fit_lists", lambda sample, lists, search, fit=ann.fit_lists: fitted.append((len(sample), lists)) or fit(sample, lists, search))
    monkeypatch.setattr(ann, "_probe", lambda spark, *_: spark.createDataFrame([], "query bigint, found bigint"))
    assert ann.nearest(table(spark, "/root/testdata/sf0.01", "embeddings"), "vec_id % 50 = 0").count() == 0
    assert len(fitted) == 1 and fitted[0][0] <= 500 / 8 and fitted[0][1] > 1


def test_margins_solve_the_ridge_system(spark):
    """With every row a landmark, Nyström is kernel ridge regression itself: margins equal K (W K + ridge I)^-1 W y, solved directly."""
    rng = random.Random(11)
    syllables = {"a": "ka ro mi tu ne".split(), "b": "scho ent ung ber sie".split(), "c": "eau oi que les ment".split()}
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=2)) for _ in range(rng.randrange(4, 12))), k) for i, k in enumerate("aabbbcccc" * 3)]
    sampling = language_id.Sampling(ridge=0.05)
    model = language_id.train(spark.createDataFrame(rows, "id long, text string, label string").repartition(5), sampling)
    found = [set(f.tolist()) for f in language_id.presence([t for _, t, _ in rows])]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in found] for x in found])
    labels = np.array([k for *_, k in rows])
    weigh = np.array([1 / (labels == k).sum() for k in labels])
    assert model.languages == ("a", "b", "c")
    for c, name in enumerate(model.languages):
        y = np.where(labels == name, 1.0, -1.0)
        want = kernel @ np.linalg.solve(weigh[:, None] * kernel + sampling.ridge * np.eye(len(y)), weigh * y)
        got = [model.weights[sorted(f), c].sum() / np.sqrt(len(f)) for f in found]
        assert np.allclose(got, want, atol=2e-3)


def test_sample_bounds_rows_not_ids(spark):
    """One id on many rows, and a row on many partitions, fill no more than the bound; the choice doesn't depend on the splits."""
    rows = [(1, f"text {i}", "a") for i in range(3000)] + [(i, "one and the same", "b") for i in range(900)] + [(i, f"few {i}", "c") for i in range(7)] + [(None, "x", "a"), (5, None, "a"), (6, "y", None)]
    labelled = spark.createDataFrame(rows, "id long, text string, label string")
    sampling = language_id.Sampling(rows_per_language=50)
    draws = [sorted(map(tuple, language_id.sample_rows(labelled.repartition(n), sampling).collect())) for n in (3, 17)]
    assert draws[0] == draws[1]
    assert {k: sum(label == k for label, _ in draws[0]) for k in "abc"} == {"a": 50, "b": 50, "c": 7}
