"""URL filters: host and path rules first, then a blocked Bloom filter of listed URLs with an exact join behind it.

The filter is a table of blocks (eight 32-bit words each). A URL's hash picks one block and one bit in each
of its words, so a probe is one equi-join on the block number and eight bit tests. Only URLs that pass go to
the exact join with the list, which removes the false positives.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and are not listed;
repeated rows are judged each on its own; an empty list passes nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.scratch import materialize

# The rules of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
WORDS = 8
#: Listed URLs to a block of 256 bits: about ten bits each.
PER_BLOCK = 24
#: Blocks that may be broadcast, at about 100 bytes each; a larger filter is joined by shuffle.
BROADCAST_BLOCKS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path of a url, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without closing slashes; query and fragment do not count."""
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www[.]", ""), F.regexp_replace(path, "/+$", "")))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The list of rules is a short parameter."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: len(x[1])):
        at, _, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def _bits(url: Column) -> list[Column]:
    """One bit of each word, from five bits each of a second hash."""
    h = F.xxhash64(F.lit("bits"), url)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """block, w0..w7 of the column ``url`` of ``listed``; partial bit_or before the shuffle."""
    return listed.groupBy(_block(F.col("url"), n_blocks).alias("block")).agg(*[F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("url")))])


def listed_flags(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with a column ``canon``) and a boolean ``is_listed``, through the filter and the exact join."""
    listed = materialize(listed.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct(), "listed-urls")
    n_blocks = max(1, math.ceil(listed.count() / PER_BLOCK))
    blocks = bloom_blocks(listed, n_blocks)
    # a table by itself where it is joined by shuffle, so that the rows of a very frequent url can be split
    blocks = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else materialize(blocks, "url-blocks")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canon"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    nowhere = -1 - F.pmod(F.xxhash64(*pages.columns), F.lit(n_blocks))  # rows without a url meet no block, and not each other
    probed = pages.withColumn("block", F.when(F.col("canon").isNotNull(), _block(F.col("canon"), n_blocks)).otherwise(nowhere)).join(blocks, "block", "left")
    probed = probed.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])
    exact = probed.where("maybe").join(listed.withColumnRenamed("url", "canon").withColumn("is_listed", F.lit(True)), "canon", "left")
    rest = probed.where("not maybe").withColumn("is_listed", F.lit(False))
    return exact.withColumn("is_listed", F.coalesce("is_listed", F.lit(False))).unionByName(rest)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, is_listed; the verdict is the rule's, else block when listed, else allow."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("canon"))
    flagged = listed_flags(rows, listed)
    return flagged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"), "is_listed")


def spam_list(pages: DataFrame, label: str = "spam-farm") -> DataFrame:
    """A stand-in for an outside list: canonical urls of pages on hosts with the label ``label``."""
    host, path = host_and_path(F.col("url"))
    return pages.select(host.alias("host"), path.alias("path")).where(F.concat(F.lit("."), "host").contains(f".{label}.")).select(canonical(F.col("host"), F.col("path")).alias("url")).distinct()


_RULE_SQL = "case " + " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then {{}}" for h, _, p in (t.partition("/") for _, t in sorted(RULES, key=lambda x: -len(x[1])))
) + " end"
_BY_LENGTH = sorted(RULES, key=lambda x: -len(x[1]))
ORACLE_SQL = f"""
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from r),
c as (select *, case when host <> '' then regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') end canon,
  {_RULE_SQL.format(*[f"'{t}'" for _, t in _BY_LENGTH])} rule, {_RULE_SQL.format(*[f"'{k}'" for k, _ in _BY_LENGTH])} by_rule from h),
l as (select distinct canon url from c where contains('.' || host, '.spam-farm.'))
select page_id, host, path, rule, coalesce(by_rule, case when l.url is not null then 'block' else 'allow' end) verdict, l.url is not null is_listed
from c left join l on c.canon = l.url
"""
