"""Operator 3: URL filters by host and path rules and by a list of canonical URLs.

Every step is a DataFrame expression. Rules decide first (the longest that fits wins). URLs that no rule decides go
through a blocked Bloom filter of the listed canonical URLs: a row (block, word) for each 64-bit block, built by
``bit_or`` and probed by an equi-join on the block. Only possible hits reach the exact hash join with the list, which
removes false positives. A hot host or URL is no problem for either join: the filter has one row for a block and the
list one row for a URL, so Spark can split the pages' side.

Nulls: a null url, or one without ``://``, has an empty host and an empty path; no rule fits it and it is never listed.
Repeated rows give a result row each. An empty list blocks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Bits of a block that a URL sets, and blocks for each listed URL (16 bits a URL: under 1 % of false positives).
BITS_SET = 4
BITS_PER_URL = 16
#: A filter of up to this many blocks of 16 bytes (4 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 1 << 18


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without trailing slashes, sorted query without tracking parameters."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_|ref=)")))
    bare = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(bare, F.regexp_replace(url_path(url), "/+$", ""), tail))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _word(h: Column) -> Column:
    """The bits that a URL sets in its block, from hash bits that the block number doesn't use."""
    out = F.lit(0).cast("long")
    for i in range(BITS_SET):
        bit = F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, word) of the distinct ``canonical`` URLs in ``listed``."""
    h = F.xxhash64("canonical")
    return listed.groupBy(F.pmod(h, F.lit(n_blocks)).alias("block")).agg(F.bit_or(_word(h)).alias("word"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of ``pages``; ``listed`` has a column ``url``."""
    urls = pages.select("page_id", F.col("url").alias("u"))
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    host, path = F.col("host"), F.col("path")
    judged = urls.select("page_id", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"), canonical(F.col("u")).alias("canonical"))
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        which = F.when(_fits(r, host, path), r.host + r.path).otherwise(which)
        verdict = F.when(_fits(r, host, path), r.verdict).otherwise(verdict)
    judged = judged.withColumns({"rule": which, "by_rule": verdict})

    keys = listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct()
    n_blocks = 1 << max(4, math.ceil(math.log2(max(1, keys.count()) * BITS_PER_URL / 64)))
    blocks = bloom_blocks(keys, n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks

    done = judged.where("by_rule is not null or canonical is null").select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(False).alias("listed"))
    open_ = judged.where("by_rule is null and canonical is not null").withColumn("h", F.xxhash64("canonical"))
    probed = open_.withColumn("block", F.pmod("h", F.lit(n_blocks))).join(blocks, "block", "left")
    hit = F.coalesce(F.col("word").bitwiseAND(_word(F.col("h"))) == _word(F.col("h")), F.lit(False))
    probed = probed.select("page_id", "host", "path", "rule", "canonical", hit.alias("possible"))
    sure = probed.where("not possible").select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    exact = probed.where("possible").join(keys.withColumn("on_list", F.lit(True)), "canonical", "left")
    exact = exact.select("page_id", "host", "path", "rule", F.when(F.col("on_list"), "block").otherwise("allow").alias("verdict"), F.coalesce("on_list", F.lit(False)).alias("listed"))
    return done.unionByName(sure).unionByName(exact)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the list is every page URL on a host whose first label (after www. or m.) starts with ``spam``."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.where(url_host(F.col("url")).rlike(r"^(www\.|m\.)?spam"))
    return filter_urls(pages, listed)


_CANON = r"""
CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END"""

SQL = rf"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=)'))) AS kept
  FROM pages),
urls AS (SELECT page_id, url, host, path, {_CANON} AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM urls WHERE regexp_matches(host, '^(www\.|m\.)?spam') AND canonical IS NOT NULL),
rules(verdict, rhost, rpath) AS (VALUES {", ".join(str(tuple(r)) for r in RULES)}),
fit AS (
  SELECT page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM urls) u
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, url)
SELECT u.page_id, u.host, u.path, f.rule,
  coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  f.verdict IS NULL AND l.canonical IS NOT NULL AS listed
FROM urls u LEFT JOIN fit f ON f.page_id IS NOT DISTINCT FROM u.page_id AND f.url = u.url LEFT JOIN listed l ON l.canonical = u.canonical
"""
