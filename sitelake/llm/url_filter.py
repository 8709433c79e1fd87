"""URL filters: host and path rules, then a blocked Bloom filter in front of an exact join with a list of canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import stored, table
from sitelake.session import BROADCAST_LIMIT_BYTES

# The rules of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # a block is eight words of 64 bits; a key sets one bit in each word
BITS_PER_KEY = 16


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for null or a url without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_of(url: Column) -> Column:
    """host (no leading www. m. blog. mirror label, no default port) + path (no index page, .html or last slash) + query without
    fields that tell visits or pages of one listing apart (``utm_*``, ``ref``, ``page``: all pages of a listed listing are listed); no scheme, no fragment. Empty for null or a url without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m|blog)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref|page)(=[^&]*)?", ""), r"^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: the host is the rule's or below it and the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(frame: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds ``block`` and the eight masks m0..m7 of the key: six bits of a second hash choose the bit of each word."""
    second = F.xxhash64(F.col(key), F.lit(7))
    frame = frame.withColumn("block", _block(F.col(key), blocks)).withColumn("second", second)
    for i in range(WORDS):
        frame = frame.withColumn(f"m{i}", F.expr(f"shiftleft(1L, cast(shiftrightunsigned(second, {6 * i}) & 63 as int))"))
    return frame.drop("second")


def bloom_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(block, w0..w7) and the number of blocks, sized by the number of keys; a bit-or per block, pre-aggregated per task."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // (64 * WORDS)))
    words = [F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]
    return _bits(listed, key, blocks).groupBy("block").agg(*words), blocks


def maybe_listed(rows: DataFrame, key: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed. Beyond the broadcast limit the filter's blocks are joined by shuffle; a block
    holds a few dozen keys and a hot key is split by the session's skew join."""
    side = F.broadcast(blooms) if blocks * (WORDS + 1) * 8 <= BROADCAST_LIMIT_BYTES else blooms
    passes = " and ".join(f"(w{i} & m{i}) = m{i}" for i in range(WORDS))
    return _bits(rows, key, blocks).join(side, "block").where(passes).select(*rows.columns)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, canonical, listed.

    The longest fitting rule decides; pages without a rule are blocked if their canonical url is in ``listed``
    (column canonical, any repeats), else allowed. The Bloom filter passes possible hits, an exact hash join with the list
    removes false positives, so the verdict doesn't depend on the filter's size.

    Null url or one without ``://``: host, path and canonical are empty, no rule, never listed. Repeated rows are judged each.
    Empty tables give no rows, an empty list allows all. Other columns are ignored.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = stored(
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical_of(url).alias("canonical"))
        .withColumn("rule", rule).withColumn("by_rule", verdict), "url-rows")
    keys = stored(listed.select("canonical").where("canonical <> ''").distinct(), "url-list")
    open_keys = rows.where("rule is null and canonical <> ''").select("canonical").distinct()
    blooms, blocks = bloom_filter(keys, "canonical")
    hits = maybe_listed(open_keys, "canonical", blooms, blocks).join(keys.hint("shuffle_hash"), "canonical", "left_semi").withColumn("hit", F.lit(True))
    # Only rows that the list can decide are looked up; the others would all share one key. The hits are written, so the lookup is between two plain shuffles.
    asked = "rule is null and canonical <> ''"
    found = rows.where(asked).join(stored(hits, "url-hits"), "canonical", "left").select(*rows.columns, "hit")
    judged = found.unionByName(rows.where(f"not ({asked})").withColumn("hit", F.lit(None).cast("boolean")))
    is_listed = F.coalesce("hit", F.lit(False))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), "canonical", is_listed.alias("listed"))


def toxic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the query: canonical urls of pages made of documents labelled toxic (the number that ends the path is the document's id)."""
    url = F.col("url")
    number = F.regexp_extract(F.regexp_replace(path_of(url), r"(\.html?)?/*$", ""), r"([0-9]{1,18})$", 1)
    pages = table(spark, sf_dir, "pages").select(canonical_of(url).alias("canonical"), number.try_cast("bigint").alias("doc_id"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return pages.join(toxic, "doc_id", "left_semi").select("canonical")


def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), toxic_pages(spark, sf_dir))


SQL = r"""
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from r),
c as (select page_id, host, path, regexp_replace(regexp_replace(host, '^(www|m|blog)\.', ''), ':(80|443)$', '')
        || regexp_replace(path, '(/index)?(\.html?)?/*$', '') as site,
        regexp_replace(regexp_replace('&' || query, '&(utm_[a-z]+|ref|page)(=[^&]*)?', '', 'g'), '^&+', '') as q from p),
k as (select page_id, host, path, site || case when q <> '' then '?' || q else '' end as canonical,
        try_cast(regexp_extract(regexp_replace(path, '(\.html?)?/*$', ''), '([0-9]{1,18})$', 1) as bigint) as doc_id,
        case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
             when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
             when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
             when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
             when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from c),
l as (select distinct canonical from k where doc_id in (select doc_id from labels where toxic = 1) and canonical <> '')
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when l.canonical is not null then 'block' else 'allow' end as verdict, k.canonical as canonical, rule is null and l.canonical is not null as listed
from k left join l on k.canonical = l.canonical
"""
