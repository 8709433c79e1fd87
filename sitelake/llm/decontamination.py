"""Benchmark decontamination by winnowing. DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import stored
from sitelake.session import BROADCAST_LIMIT_BYTES


@dataclass(frozen=True)
class Winnowing:
    window: int = 10  # words of the shortest shared span that is found for certain
    chunk: int = 4096  # words of a text that a row holds
    bits: int = 2**22  # of the map of the items' fingerprints, a power of two: 512 kB whatever the tables

    @property
    def span(self) -> int:
        """Grams of a window of which the least is kept."""
        return self.window // 2 + 1

    @property
    def gram(self) -> int:
        return self.window - self.span + 1


# What ends a word: ASCII but letters and digits. Only A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRINT = "gram int, span int, at int, print bigint, lead int, context array<string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def chunked(texts: DataFrame, how: Winnowing) -> DataFrame:
    """(row, id, n_words, chunk, words) of (row, id, text): chunks of the words as written, each with the ``window`` - 1 words that follow it,
    so that every window lies whole in the chunk it starts in. A text without words has one empty chunk."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / how.chunk).cast("int") - 1, F.lit(0))),
        lambda c: F.struct(c.alias("chunk"), F.size(w).cast("bigint").alias("n_words"), F.slice(w, c * how.chunk + 1, F.lit(how.chunk + how.window - 1)).alias("words")))
    return texts.select("row", "id", F.explode(_let(words, cut)).alias("c")).select("row", "id", "c.n_words", "c.chunk", "c.words")


def prints(words: Column, gram: int, span: int, bits: Column | None) -> Column:
    """Fingerprints of a chunk: of every ``span`` neighbouring runs of ``gram`` words the one of least hash, the last of equal ones.

    With the map ``bits`` only fingerprints that an item may have: that test is the cheaper one, so it comes first, and only a run that passes
    is held against its neighbours. Each fingerprint carries the words around it that a window through it can hold: ``lead``
    words before it, and those after. Hashes fold case more widely than A-Z, which may only add candidates.
    """
    empty = F.array().cast(f"array<struct<{', '.join(p.replace(' ', ':') for p in PRINT.split(', '))}>>")

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(h) - (gram - 1)), lambda i: F.xxhash64(F.slice(h, i, gram)))
        return _let(grams, lambda g: of_grams(g) if bits is None else _let(bits, lambda b: of_grams(g, b)))

    def of_grams(g: Column, b: Column | None = None) -> Column:
        places = F.sequence(F.lit(0), F.size(g) - 1) if b is None else F.array_compact(F.transform(g, lambda p, i: F.when(known(p, b), i)))
        if span > 1:
            places = F.filter(places, lambda q: least(g, q))
        return F.transform(places, lambda q: F.struct(
            F.lit(gram).alias("gram"), F.lit(span).alias("span"), q.alias("at"), g[q].alias("print"), F.least(q, F.lit(span - 1)).alias("lead"), around(q).alias("context")))

    def known(p: Column, b: Column) -> Column:
        word, bit = bit_of(p, F.size(b).cast("bigint"))
        return F.getbit(b[word.cast("int")], bit) == 1

    def least(g: Column, q: Column) -> Column:
        """Whether some window has its last least hash here: the smaller ones on both sides are too far apart."""
        before = count_while([F.coalesce(F.get(g, q - i) >= g[q], F.lit(False)) for i in range(1, span)])
        after = count_while([F.coalesce(F.get(g, q + i) > g[q], F.lit(False)) for i in range(1, span)])
        return before + after >= span - 1

    def around(q: Column) -> Column:
        first = F.greatest(q - (span - 1), F.lit(0))
        return F.transform(F.slice(words, first + 1, q + (gram + span - 1) - first), lambda w: F.translate(w, UPPER, LOWER))

    hashes = F.transform(words, lambda w: F.xxhash64(F.lower(w)))
    return F.when(F.size(words) >= gram + span - 1, _let(hashes, of_hashes)).otherwise(empty)


def count_while(holds: list[Column]) -> Column:
    """How many conditions hold before the first that doesn't."""
    out = F.lit(len(holds))
    for n, condition in reversed(list(enumerate(holds))):
        out = F.when(~condition, F.lit(n)).otherwise(out)
    return out


def bit_of(print_: Column, longs: Column | int) -> tuple[Column, Column]:
    """Which of the map's longs (a power of two) has a fingerprint's bit, and which bit it is."""
    return F.shiftrightunsigned(print_, 6).bitwiseAND(F.lit(longs).cast("bigint") - 1 if isinstance(longs, int) else longs - 1), print_.bitwiseAND(F.lit(63)).cast("int")


def item_prints(items: DataFrame, how: Winnowing) -> DataFrame:
    """(gram, span, print, lead, context, of, ids): the items' fingerprints, equal ones with equal surroundings once. An item of fewer
    words than a window is one fingerprint as long as itself."""
    rows = stored(chunked(items, how), "item-words")
    sizes = [r[0] for r in rows.where(F.col("n_words").between(1, how.window - 1)).select("n_words").distinct().sort("n_words").collect()]  # fewer than window
    small = [F.when(F.col("n_words") == n, prints(F.col("words"), n, 1, None)) for n in sizes]
    found = rows.select("id", F.explode(F.coalesce(*small, prints(F.col("words"), how.gram, how.span, None))).alias("p")).select("id", "p.*")
    groups = found.groupBy("gram", "span", "print", "lead", "context").agg(F.collect_set("id").alias("ids"))
    return stored(groups.select("*", F.monotonically_increasing_id().alias("of")), "item-prints")


def bit_map(prints: DataFrame, how: Winnowing) -> DataFrame:
    """One row: the longs whose set bits are the fingerprints' low bits. Its size is a parameter, not one of the tables."""
    word, bit = bit_of(F.col("print"), how.bits // 64)
    set_ = prints.select(word.alias("id"), bit.alias("bit")).select("id", F.expr("shiftleft(1L, bit)").alias("bit"))
    longs = prints.sparkSession.range(how.bits // 64).join(set_.groupBy("id").agg(F.bit_or("bit").alias("long")), "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("long", F.lit(0).cast("bigint")).alias("long"))))
    return longs.agg(F.transform(ordered, lambda x: x["long"]).alias("bits"))


def shared_spans(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts (row, doc_id, n_words), spans (row, first, end, of), fingerprints) of (row, id, text) and (row, id, text).

    Two texts that share ``window`` words in a row keep the same fingerprint inside them, as which one is kept depends on those words alone. So
    fingerprints are joined, and each hit is extended, word by word, as far as the words agree: up to the ends of the windows through it,
    which is enough because every shared window has a hit of its own. What reaches a window's length is a span; others are dropped.
    """
    prints_of_items = item_prints(items, how)
    short = [r["gram"] for r in prints_of_items.where("span = 1").select("gram").distinct().collect()]  # fewer than window rows
    bits = bit_map(prints_of_items, how).scalar().alias("bits")
    levels = [(how.gram, how.span)] + [(n, 1) for n in sorted(short)]
    found = F.concat(*[prints(F.col("words"), g, s, F.col("bits")) for g, s in levels]).alias("prints")
    marked = chunked(docs, how).select("*", bits).select("row", F.col("id").alias("doc_id"), "n_words", "chunk", found)
    marked = stored(marked, "document-prints")
    size = prints_of_items.agg(F.sum(F.size("ids") * 8 + F.aggregate("context", F.lit(0), lambda n, w: n + F.octet_length(w) + 16) + 64)).first()[0] or 0
    known = prints_of_items.select("gram", "span", "print", F.col("lead").alias("item_lead"), F.col("context").alias("item_context"), "of")
    hits = marked.select("row", "chunk", F.explode("prints").alias("p")).select("row", "chunk", "p.*").join(
        F.broadcast(known) if size <= BROADCAST_LIMIT_BYTES else known, ["gram", "span", "print"])

    def same(offset: Column | int) -> Column:
        return F.coalesce(F.get("context", F.col("lead") + offset) == F.get("item_context", F.col("item_lead") + offset), F.lit(False))

    gram, reach = F.col("gram"), F.col("span") - 1
    core = count_while([same(i) for i in range(how.window)])
    left = count_while([(reach >= i) & same(-i) for i in range(1, how.span)])
    right = count_while([(reach > i) & same(gram + i) for i in range(how.span - 1)])
    extended = hits.select("row", "of", "gram", "span", core.alias("core"), left.alias("left"), right.alias("right"), (F.col("chunk").cast("bigint") * how.chunk + F.col("at")).alias("at"))
    spans = extended.where("core >= gram and left + gram + right >= gram + span - 1").select("row", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + gram + F.col("right")).alias("end"), "of")
    return marked.where("chunk = 0").select("row", "doc_id", "n_words"), stored(spans, "shared-spans"), prints_of_items


def _covered(spans: Column) -> Column:
    """Different places in sorted spans (first, end)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["first"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing(), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Only chunks whose fingerprints may be an item's carry anything beyond their counts. Items are broadcast if they are measured to be small, else both sides are
    shuffled by fingerprint. Covered words are counted per chunk, and items per text, after both were made distinct; no text's words
    meet in one task. The written tables hold the fingerprints of candidate places, not the texts.

    Null and empty texts have no words. Null items and items without words occur nowhere. Items of one id count once; so do rows with the null id, which has no place in
    the list that is hashed. Repeated documents are judged each. An empty table gives no rows, and without items no document is contaminated.
    """
    numbered = lambda frame, i, t: frame.select(F.monotonically_increasing_id().alias("row"), F.col(i).cast("bigint").alias("id"), F.col(t).cast("string").alias("text"))
    texts, spans, known = shared_spans(numbered(docs, id_col, text_col), numbered(items, item_id_col, item_text_col), how)
    pieces = spans.select("row", "first", "end", F.explode(F.expr(f"sequence(first div {how.chunk}, (end - 1) div {how.chunk})")).alias("chunk"))
    pieces = pieces.select("row", "chunk", F.struct(F.greatest("first", F.col("chunk") * how.chunk).alias("first"), F.least("end", (F.col("chunk") + 1) * how.chunk).alias("end")).alias("piece"))
    hit = pieces.groupBy("row", "chunk").agg(_covered(F.array_sort(F.collect_set("piece"))).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    pairs = spans.select("row", "of").distinct().join(known.select("of", F.explode("ids").alias("item")), "of").select("row", "item").distinct()
    names = pairs.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("names"))
    return texts.join(hit, "row", "left").join(names, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing(), id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` without a shared span, with all their columns. A row goes if another of its id is contaminated."""
    bad = decontaminate(docs, items, how, id_col, **columns).where("contaminated").select(F.col("doc_id").alias("contaminated_id")).distinct()
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(bad["contaminated_id"]), "left_anti")


SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
i as materialized (select item_id, words, least(10, len(words)) as n from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark) where len(words) > 0),
iw as materialized (select distinct item_id, n, array_to_string(list_slice(words, p, p + n - 1), ' ') as run from (select *, unnest(range(1, len(words) - n + 2)) as p from i)),
dw as (select r, n, p, array_to_string(list_slice(words, p, p + n - 1), ' ') as run from (select r, words, n, unnest(range(1, len(words) - n + 2)) as p from d, (select distinct n from i) where len(words) >= n)),
hit as materialized (select r, p, dw.n, item_id from dw join iw on dw.n = iw.n and dw.run = iw.run),
places as (select r, count(distinct place) as n_hit from (select r, unnest(range(p, p + n)) as place from hit) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, cast(item_id as varchar) as item from hit) group by r)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (r) left join named using (r)
"""
