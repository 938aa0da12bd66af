"""URL filter: a blocked Bloom filter of listed URL prefixes, then an exact join.

A rule names a host (with all its subdomains) and the beginning of a path. Its canonical form is
``host/path``. Every URL has few canonical forms that could be listed: each suffix of its host with each
beginning of its path whose length occurs in the list. The Bloom filter throws out nearly all that are not
listed; what passes is joined with the rules themselves, so false positives never reach the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one Bloom block, and how many of them a key sets.
BLOCK_BITS, PROBES = 64, 4
KEYS_PER_BLOCK = 4


def url_host(url: Column) -> Column:
    """Host in lower case (A-Z); empty for NULL and for URLs without ``://``."""
    return _lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """``(block, word)``: the filter, one row for each block in use."""
    key = F.concat("rule_host", "rule_path")
    return rules.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("word"))


def filter_urls(
    urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``urls``.

    ``rules`` has ``(host, path, verdict)``. A rule fits its host and all subdomains if the path starts with the
    rule's. The longest fitting rule wins (longest host, then longest path; equal rules: ``block``). Without
    one, ``rule`` is NULL and the verdict is ``default``: the URL is not listed. NULL or malformed URLs have
    empty host and path; repeated rows stay; NULL ids stay; rules with NULL parts fit nothing.
    """
    rules = (
        rules.filter("host is not null and path is not null and verdict is not null")
        .groupBy(_lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    # Two small facts about the list: how many rules, and which path lengths occur (never more than lengths of URLs).
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("sizes")).first()
    blocks = max(1, facts["n"] // KEYS_PER_BLOCK)
    page = urls.select(
        F.col(id_column).alias("page_key"), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path")
    )
    parts = F.split("host", r"\.")
    hosts = F.when(
        F.col("host") != "",
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts)))),
    )
    sizes = F.filter(F.array(*[F.lit(n) for n in facts["sizes"]]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(
            hosts, lambda h: F.transform(sizes, lambda n: F.struct(h.alias("h"), F.col("path").substr(F.lit(1), n).alias("p")))
        )
    )
    wanted = page.select("page_key", "host", "path", F.explode(keys).alias("key")).select(
        "page_key", "host", "path", F.col("key.h").alias("rule_host"), F.col("key.p").alias("rule_path")
    )
    key = F.concat("rule_host", "rule_path")
    maybe = (
        wanted.withColumn("block", _block(key, blocks))
        .join(bloom_blocks(rules, blocks), "block", "inner")
        .filter(F.col("word").bitwiseAND(_mask(key)) == _mask(key))
    )
    hits = maybe.join(rules, ["rule_host", "rule_path"], "inner")
    best = F.max_by(
        F.struct("rule_host", "rule_path", "rule_verdict"), F.struct(F.length("rule_host"), F.length("rule_path"))
    )
    found = hits.groupBy("page_key", "host", "path").agg(best.alias("best")).select(
        F.col("page_key").alias("k"), F.col("host").alias("h"), F.col("path").alias("p"), "best"
    )
    same = page.page_key.eqNullSafe(found.k) & (page.host == found.h) & (page.path == found.p)
    return page.join(found, same, "left").select(
        F.col("page_key").alias(id_column),
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
