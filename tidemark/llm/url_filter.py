"""URL filter: exact membership of listed keys by a Bloom filter cascade, in DataFrame operations only.

The corpus's complete key universe (each host suffix, alone and with the path prefixes that a rule could name) is
computed first. Level 1 encodes the listed keys that occur in it; level 2 the unlisted keys of the universe that pass
level 1; level 3 the listed keys that pass level 2; and so on until a level lets nothing wrong through. A key of the
universe is then listed exactly if the first level that turns it away is an even one (or, if none does, the last level
is odd). Pages are judged by expressions alone: no join, no Python.

A filter is a binary literal with six bits in each ASCII byte, so that one bit is read in constant time by built-in
functions. Its size is fixed by the listed keys that occur in the corpus and checked against bloom.MAX_FILTER_BYTES.

Defined results: a url that is null or has no "://" has an empty host and path, fits no rule and is allowed. Rules with
an empty host never fit. Of rules that fit, the longest wins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Level
from .common import ascii_lower, stage, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that are blocked, with their subdomains, where no rule fits: these names, under each of these domains.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_DOMAINS = ("example.com", "example.net", "example.org")
BLOCKED_HOSTS = tuple(f"{n}.{d}" for n in BLOCKED_NAMES for d in BLOCKED_DOMAINS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    )


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys that a listed key could equal: each host suffix with the path's first characters; length 0: the host alone."""
    every = suffixes(host)

    def with_path(n: int) -> Column:  # a default argument would make transform() pass the index
        return F.transform(every, lambda s: F.concat(s, F.substring(path, 1, n)))

    parts = [F.when(F.length(path) >= n, with_path(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


class Cascade:
    """Exact membership over a universe; ``levels`` alternate between listed and unlisted keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, first_number: int = 1) -> Cascade:
    """``universe``: (key, listed), each key once."""
    levels: list[Level] = []
    left = universe
    n_listed, n_all = universe.agg(F.count_if("listed"), F.count(F.lit(1))).first()
    n_other = n_all - n_listed
    if not n_listed:
        return Cascade([])
    encode, size = True, n_listed
    while size:
        rate = min(0.5, max(1e-4, math.sqrt(0.5) * n_listed / max(1, n_other))) if not levels else 0.5
        if len(levels) > 6:
            rate /= 2 ** (len(levels) - 6)
        level = Level(first_number + len(levels), size, rate).fill(left.filter(F.col("listed") == encode))
        levels.append(level)
        left = left.filter((F.col("listed") == encode) | level.passes(F.col("key")))
        encode = not encode
        size = left.filter(F.col("listed") == encode).count()
    return Cascade(levels)


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, hosts: Sequence[str] = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits), verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    listed = {f"{v} {h}{p}" for v, h, p in rules if h} | {f"host {h}" for h in hosts if h}

    short = rows.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()
    universe = short.select(F.explode(F.concat(*_named_keys(F.col("host"), F.col("path"), lengths))).alias("key")).distinct()
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(listed))).cast("array<string>")).alias("key"), F.lit(True).alias("listed"))
    universe = universe.join(names, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascade = build_cascade(stage(universe, "url-universe"))

    of_rules, of_hosts = _named_keys(F.col("host"), F.col("path"), lengths)
    fitting = F.filter(of_rules, cascade.listed)
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))).getField("key")
    rows = rows.withColumn("_fit", F.split(longest, " ", 2)).withColumn("_blocked", F.exists(of_hosts, cascade.listed))
    verdict = F.coalesce(F.col("_fit")[0], F.when(F.col("_blocked"), "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", F.col("_fit")[1].alias("rule"), verdict.alias("verdict"))


def _named_keys(host: Column, path: Column, lengths: Sequence[int]) -> tuple[Column, Column]:
    """What a url could match: "allow key" and "block key" of rules; "host key" of the list of hosts."""
    keys = keys_of(host, path, lengths)
    of_rules = F.concat(*(F.transform(keys, lambda k: F.concat(F.lit(f"{v} "), k)) for v in ("allow", "block")))
    return of_rules, F.transform(keys_of(host, path, [0]), lambda k: F.concat(F.lit("host "), k))


def query(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def _fits(host: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}'))"


_CASES = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = " ".join(f"WHEN {_fits(h)} AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in _CASES)
_VERDICT = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in _CASES)
SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, CASE {_RULE} END AS rule FROM cut)
SELECT page_id, host, path, rule,
       CASE {_VERDICT} WHEN {' OR '.join(_fits(h) for h in BLOCKED_HOSTS)} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
