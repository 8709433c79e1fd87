"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import stored

# (words of a phrase, label)
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# (label, notice); a block that holds ``THRESHOLD`` of a notice's different words bears the label. A block is a run of ``reach_of(notice)`` words,
# wherever its lines break, or the whole text if that is shorter. Notices are public standard texts. As sets of words can't tell headers apart that differ by one
# word, the GNU headers bear the family's label, and their version clause, short enough to be needed whole, the version's.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    ("gpl-3", "either version 3 of the License"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-2", "either version 2 of the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "Creative Commons Attribution 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
THRESHOLD = 0.9
SCAN = "row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, blocks array<struct<span:int,words:array<int>>>"
# Bytes 0-2F 3A-60 7B-7F end a word once A-Z are lower-cased.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def vocabulary(templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({w for _, t in templates for w in words_of(t)}))}


def need_of(size: int, threshold: float) -> int:
    """Shared words that a template of ``size`` different words needs."""
    return max(1, math.ceil(threshold * size - 1e-9))


def reach_of(notice: str, threshold: float) -> int:
    """Words of the longest run in which a notice is looked for: it leaves room for as many other words as ``threshold`` lets words be missing."""
    return int(len(words_of(notice)) / threshold + 1e-9)


def runs_of(own: Sequence[tuple[int, int]], span: int, least: int) -> list[tuple[int, ...]]:
    """The different words, sorted, of the runs of ``span`` words that hold ``least`` of them, from (place, word) of a text's known words in order.

    Runs that hold no more than the one before or after them are left out: a run is taken just before it loses a word, if it has gained one since
    the last that was taken. So every run's words are among those of a run that is taken. Linear in the known words.
    """
    held: dict[int, int] = {}
    out, end, gained = [], 0, False
    for at, word in own:
        while end < len(own) and own[end][0] < at + span:
            more = own[end][1]
            held[more] = held.get(more, 0) + 1
            gained |= held[more] == 1
            end += 1
        if held[word] == 1:
            if gained and len(held) >= least:
                out.append(tuple(sorted(held)))
                gained = False
            del held[word]
        else:
            held[word] -= 1
    return out


def _scan(phrases: Sequence[tuple[str, str]], words: dict[bytes, int], notices: Sequence[tuple[frozenset[bytes], int, int]]):
    patterns = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("span", pa.int32()), ("words", pa.list_(pa.int32()))])))
    least = min(need for _, need, _ in notices)
    names = [c.split()[0] for c in SCAN.split(", ")[1:]]

    def one(text: str) -> tuple:
        data = text.encode().translate(WORD_BYTES)
        own = data.split()
        joined = b" " + b" ".join(own) + b" "
        places, labels = [], set()
        for pattern, label in patterns:
            at, before, words_before = joined.find(pattern), 0, 0
            while at >= 0:
                words_before += joined.count(b" ", before, at)
                places.append(words_before)
                labels.add(label)
                at, before = joined.find(pattern, at + 1), at
        blocks = []
        known = words.keys() & set(own)
        if len(known) >= least:
            spans: dict[int, int] = {}
            for notice, need, reach in notices:  # those that the whole text has words enough for
                if len(notice & known) >= need:
                    spans[reach] = min(need, spans.get(reach, need))
            if spans:
                found = [(i, words[w]) for i, w in enumerate(own) if w in known]
                blocks = [{"span": span, "words": list(run)} for span, need in sorted(spans.items()) for run in dict.fromkeys(runs_of(found, span, need))]
        return len(own), len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(one(t or "") for t in batch.column(1).to_pylist()))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(rows, kinds[1:])], names=names)

    return run


def block_matches(blocks: DataFrame, sets: Sequence[tuple[str, Sequence[int], int]], threshold: float) -> DataFrame:
    """(row, block, template, containment) of every block of (row, block, span, words) and template whose containment |block & template| / |template| reaches ``threshold``.
    ``sets`` has label, different words and reach of the templates; a template is looked for in blocks of its reach.

    Words are ordered by the number of blocks of the whole corpus that hold them, rarest first. If a block shares ``need`` words with a template,
    the first |template| - need + 1 words of the one and |block| - need + 1 of the other have a word in common (prefix filter), the block
    has ``need`` words at least (length filter), and from their first common word on both have ``need`` words left (positional filter). The pairs that pass
    are verified. The templates' side has a row per prefix word, so it is broadcast; blocks aren't shuffled and never paired with each other.
    """
    spark = blocks.sparkSession
    counts = {r[0]: r[1] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()}  # at most the templates' words
    universe = sorted({w for _, s, _ in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(universe)}
    prefixes, least = [], min(need_of(len(s), threshold) for _, s, _ in sets)
    for k, (_, words, reach) in enumerate(sets):
        ordered, need = sorted(rank[w] for w in words), need_of(len(words), threshold)
        prefixes += [(r, k, i, len(ordered), need, reach) for i, r in enumerate(ordered[: len(ordered) - need + 1])]
    side = spark.createDataFrame(prefixes, "word int, template int, template_at int, template_size int, need int, span int")
    ranks = F.array(*[F.lit(rank.get(w, -1)) for w in range(max(rank) + 1)])
    full = F.array(*[F.array(*[F.lit(rank[w]) for w in words]) for _, words, _ in sets])
    ordered = blocks.select("row", "block", "span", F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w + 1))).alias("ordered"))
    tokens = ordered.select("row", "block", "span", "ordered", F.size("ordered").alias("size"), F.posexplode(F.expr(f"slice(ordered, 1, greatest(size(ordered) - {least} + 1, 0))")).alias("at", "word"))
    passes = "size >= need and at <= size - need and least(template_size - template_at, size - at) >= need"
    pairs = tokens.join(F.broadcast(side), ["word", "span"]).where(passes)
    shared = F.size(F.array_intersect("ordered", F.element_at(full, F.col("template") + 1)))
    found = pairs.withColumn("shared", shared).where("shared >= need")
    return found.select("row", "block", "template", (F.col("shared") / F.col("template_size")).alias("containment")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lower-cased; a base place is a phrase's words in a row, across line breaks too; blocks are runs of words, a little longer than the notice (see ``reach_of``). ``labels`` are the phrases' and those
    of every template that a block holds (see ``block_matches``); the order of a notice's words doesn't count. score: 1 with a base place, else the highest containment that reached the threshold, else 0.
    Null and empty text: no words, empty labels, score 0. Repeated rows are scanned each, an empty table gives no rows, other columns are ignored.
    """
    words = vocabulary(templates)
    sets = [(label, sorted({words[w] for w in words_of(t)}), reach_of(t, threshold)) for label, t in templates]
    notices = [(frozenset(words_of(t)), need_of(len(s), threshold), reach) for (_, t), (_, s, reach) in zip(templates, sets)]
    scanned = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(phrases, words, notices), SCAN.split(", ", 1)[1])
    rows = stored(scanned.select(F.monotonically_increasing_id().alias("row"), "*"), "license-scan")
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.span", "b.words")
    names = F.array(*[F.lit(label) for label, _, _ in sets])
    found = block_matches(blocks, sets, threshold).groupBy("row").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("more"), F.max("containment").alias("best"))
    return rows.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
