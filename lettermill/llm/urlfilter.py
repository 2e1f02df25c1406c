"""URL filters: path rules first, then a Bloom filter cascade over host names.

Rules are (host, path, verdict). A rule fits its host and all subdomains if the url's path starts
with the rule's path; the longest fitting rule (host and path together) decides, the first by
code point among equally long ones.

Other urls are judged by a list of blocked hosts that also covers subdomains: a url is blocked if
any dot suffix of its host is listed. Membership is looked up in a cascade of Bloom filters: level 1
encodes the listed keys, level 2 the unlisted keys that level 1 lets through, level 3 the listed
keys that level 2 lets through, and so on until no key is mistaken. The keys are all host suffixes
of the corpus, so the cascade is exact for each of them, and rows are judged without a join.

Size: with n listed among u keys, level 1 has log2(u / n) hashes, so about as many unlisted keys as
there are listed ones pass it, however many there are; a later level lets through one in four. All
levels together hold n * (log2(u / n) + 6) * 1.5 bits. They are constants in the plan: lists with
more than KEYS_PER_PASS keys in the corpus are judged in as many passes, each over the hash range of
the keys that it encodes, so neither the plan nor what the driver gathers grows with the corpus.

Cases: a null url or one without :// has host and path '' and is allowed unless a rule or the
list holds ''. Hosts keep ports and user names. Repeated rows give repeated rows; empty tables an
empty result. Only id and url are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import cut

# The rules of the contract.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# Blocked sites, each with all its subdomains.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

KEYS_PER_PASS = 100_000
#: Hashes of the second level and those after it.
LATER_HASHES = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(name, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class _Level:
    """One Bloom filter: 64-bit words in the plan as a constant array."""

    def __init__(self, keys: DataFrame, n: int, level: int, hashes: int):
        self.level, self.hashes = level, hashes
        # at one bit in two the chance to pass is 2 ** -hashes
        self.bits = max(64, -(-int(n * hashes / math.log(2)) // 64) * 64)
        spots = keys.select(F.explode(F.array(*[self._spot(F.col("key"), i) for i in range(hashes)])).alias("s"))
        words = spots.groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v"))
        held = {r.w: r.v for r in words.collect()}
        self.words = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(self.bits // 64))), ",").cast("array<bigint>")

    def _spot(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(1000 * self.level + i)), F.lit(self.bits))

    def lets_through(self, key: Column) -> Column:
        out = F.lit(True)
        for i in range(self.hashes):
            spot = self._spot(key, i)
            word = F.get(self.words, F.floor(spot / 64).cast("int"))
            out = out & (F.getbit(word, (spot % 64).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership in the listed keys for every key of a universe (key, listed) of distinct keys."""

    def __init__(self, universe: DataFrame):
        self.levels: list[_Level] = []
        sizes = {r.listed: r["count"] for r in universe.groupBy("listed").count().collect()}
        n, others = sizes.get(True, 0), sizes.get(False, 0)
        inside, outside = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key")
        hashes = max(1, math.ceil(math.log2(max(2.0, others / max(1, n)))))
        while n > 0:
            self.levels.append(_Level(inside, n, len(self.levels), hashes))
            # few keys are left after the first level; as a table they are filtered once
            inside, outside = cut(outside.where(self.levels[-1].lets_through(F.col("key")))), inside
            n, hashes = inside.count(), LATER_HASHES

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].lets_through(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def judge(pages: DataFrame, blocked: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", keys_per_pass: int = KEYS_PER_PASS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row; `blocked` has the listed hosts in its column key."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = cut(rows.withColumn("hit", F.lit(False)))
    listed = blocked.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
    hosts = rows.select("host").distinct()
    universe = cut(hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct().join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    passes = max(1, -(-universe.where("listed").count() // keys_per_pass))
    for i in range(passes):
        cascade = Cascade(universe.where(_shard(F.col("key"), passes) == i))
        held = F.exists(suffixes(F.col("host")), lambda k: (_shard(k, passes) == i) & cascade.holds(k))
        rows = rows.withColumn("hit", F.col("hit") | held)
        rows = cut(rows) if i + 1 < passes else rows
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return rows.withColumn("fit", rule).select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
