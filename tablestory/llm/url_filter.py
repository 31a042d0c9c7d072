"""Judging URLs by host rules and by a list of URLs behind a blocked Bloom filter.

Everything is DataFrame functions. A listed URL sets one bit in each of the eight words of one
block; blocks are built by a grouped ``bit_or`` and take 24 URLs on average, a false positive
in some ten thousand. Pages look their block up; only possible hits meet the list in an exact join.
The filter is broadcast while it is within ``limit`` bytes, beyond that it is joined by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_BYTES = 32 << 20
_WORDS = 8
_URLS_A_BLOCK = 24
_BLOCK_BYTES = 8 * _WORDS + 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """A URL without scheme, ``www.``/``m.``, default port, closing slash, fragment and tracking parameters; null stays."""
    host, path = split_url(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path, r"(/+|/index\.html?|\.html?)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    h = F.xxhash64(key, F.lit("bit"))
    places = [F.shiftrightunsigned(h, 6 * w).bitwiseAND(63).cast("int") for w in range(_WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in places]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocks of a Bloom filter: ``block`` and eight words."""
    words = {f"w{i}": b for i, b in enumerate(_bits(F.col(key)))}
    made = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(b.alias(w) for w, b in words.items()))
    return made.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words))


def possible_rows(df: DataFrame, key: str, listed: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``df`` whose key may be in ``listed``'s one column: all that are, and few others.

    The filter never takes more than ``limit`` bytes; for a very long list it lets more others pass.
    An exact join of what is left is the caller's.
    """
    listed = listed.toDF("_key")
    blocks = max(1, min(-(-listed.count() // _URLS_A_BLOCK), limit // _BLOCK_BYTES))
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col(key))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    probed = df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return probed.join(F.broadcast(bloom(listed, "_key", blocks)), "block").where(hit).select(df.columns)


def match_listed(df: DataFrame, key: Column, listed: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``_listed``: whether the key is among the different non-null values of ``listed``'s one column."""
    listed = listed.toDF("_key").where("_key IS NOT NULL").distinct()
    blocks = max(1, -(-listed.count() // _URLS_A_BLOCK))
    filter_ = bloom(listed, "_key", blocks)
    if blocks * _BLOCK_BYTES <= limit:
        filter_ = F.broadcast(filter_)
    keyed = df.withColumn("_key", key).withColumn("block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("_key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    probed = keyed.join(filter_, "block", "left").withColumn("_possible", F.coalesce(hit, F.lit(False)) & F.col("_key").isNotNull())
    probed = probed.drop("block", *(f"w{i}" for i in range(_WORDS)))
    sure = probed.where("NOT _possible").withColumn("_listed", F.lit(False))
    exact = listed.withColumn("_found", F.lit(True))
    maybe = probed.where("_possible").join(exact, "_key", "left").withColumn("_listed", F.coalesce("_found", F.lit(False))).drop("_found")
    return sure.unionByName(maybe.select(sure.columns)).drop("_key", "_possible")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, key: str = "page_id", url: str = "url",
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """A verdict for every URL: that of the longest fitting rule, else ``block`` for listed URLs, else ``allow``.

    A rule is (host, path, verdict); it fits its host and all subdomains when the path starts with the
    rule's. ``listed`` has one column of URLs; both sides are compared in canonical form. Returns a row
    per row: key, host, path, rule (host and path of the rule, or null), verdict and listed. A null URL
    has an empty host and path and is allowed. Other columns are not looked at.
    """
    address = F.col("url")
    host, path = split_url(address)
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", "url", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    names = listed.columns[0]
    out = match_listed(base, canonical(address), listed.select(canonical(F.col(names))), limit)
    return out.select(F.col("key").alias(key), "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
                      F.col("_listed").alias("listed"))
