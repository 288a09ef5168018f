"""URL rules: host suffixes and path prefixes of each URL, joined with the rules on short hashes.

A URL is expanded into every host suffix with every path prefix that a rule could name. Expressions meet the rules on a hash of
four bytes (an integer key, cheap to shuffle); what meets is confirmed by the full digest, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to so many rows of RULE_BYTES; larger rule tables are joined by a shuffle.
RULE_BYTES, BROADCAST_BYTES = 256, 16 << 20
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (small letters, port and user as they stand) and path of a URL; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, CAPITALS, SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def short(full: Column) -> Column:
    """The first four bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(full, 1, 4)), 16, 10).cast("long")


def suffixes(host: Column) -> Column:
    """The host and what stands behind each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes with the path's prefixes of the given lengths (no longer than the path)."""
    wanted = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes(host), lambda h: F.transform(wanted, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) with digests. Null hosts and paths never fit and go; of equal rules a block wins."""
    r = rules.where("host is not null and path is not null").select(F.translate("host", CAPITALS, SMALL).alias("h"), F.col("path").alias("p"), "action")
    one = r.groupBy("h", "p").agg(F.max("action").alias("action"))  # "block" is greater than "allow"
    full = digest(F.concat("h", "p"))
    # the longest wins; of two that are as long, the one with the longer host
    rank = F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("nh"), F.concat("h", "p").alias("rule"), "action")
    return one.select(short(full).alias("key"), full.alias("digest"), F.length("p").alias("np"), rank.alias("found"))


def matches(sites: DataFrame, rules: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, found): the winning rule of each distinct site that any fits."""
    e = sites.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
    e = e.select("host", "path", digest(F.col("e")).alias("full")).withColumn("key", short(F.col("full")))
    met = e.join(rules, "key").where(F.col("full") == F.col("digest"))
    return met.groupBy("host", "path").agg(F.max("found").alias("found"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> tuple[DataFrame, dict[str, str]]:
    """pages with host, path, rule (host and path of the winning one, or null) and verdict; {name: column}.

    A rule (action allow or block, host, path) fits its host and all subdomains where the URL's path starts with its own. The longest
    fitting rule wins, then the longer host; without one the verdict is the default. Null URLs and those without :// have
    an empty host and path. Every row of pages stays, repeated ones too.

    Only distinct (host, beginning of the path) are expanded, so a host of any number of pages costs as much as it has beginnings;
    their winners are joined back by a key whose hot values the adaptive planner splits (one row on the other side).
    """
    host, path, rule, verdict, begin = fresh(pages, "host", "path", "rule", "verdict", "begin")
    r = prepared(rules)
    seen = r.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("np")).alias("lengths")).first()  # as many as path lengths differ
    h, p = host_and_path(col(url))
    x = pages.withColumns({host: h, path: p})
    if not seen.n:
        return x.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(default)}), dict(host=host, path=path, rule=rule, verdict=verdict)
    if seen.n * RULE_BYTES <= BROADCAST_BYTES:
        r = F.broadcast(r)
    x = x.withColumn(begin, F.substring(F.col(path), F.lit(1), F.lit(seen.lengths[-1])))
    sites = x.select(F.col(host).alias("host"), F.col(begin).alias("path")).where("host <> '' or path <> ''").distinct()
    wh, wp, wf = fresh(x, "won_host", "won_path", "won")
    won = matches(sites, r, list(seen.lengths)).select(F.col("host").alias(wh), F.col("path").alias(wp), F.col("found").alias(wf))
    x = x.join(won, (F.col(host) == F.col(wh)) & (F.col(begin) == F.col(wp)), "left")
    x = x.withColumns({rule: F.col(wf)["rule"], verdict: F.coalesce(F.col(wf)["action"], F.lit(default))}).drop(begin, wh, wp, wf)
    return x, dict(host=host, path=path, rule=rule, verdict=verdict)
