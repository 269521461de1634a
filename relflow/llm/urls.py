"""URL rules by Bloom filter cascades: exact membership without joins.
DataFrame functions only.

A rule is a host and a path; it fits the urls of that host and its subdomains
whose path starts with the rule's. A url therefore has a small set of candidate
keys: each suffix of its host, cut at dots, with each prefix of its path of a
length that some rule has. The keys of all urls are the universe.

A cascade stands for a set of listed keys over that universe. Level 1 is a Bloom
filter of the listed keys; level 2 one of the universe's other keys that pass
level 1; level 3 one of the listed keys that pass level 2; and so on until no
wrong key passes. A key is listed if the first level it fails is an even one.
Over the universe the answer is exact. With ``r`` listed keys in ``s`` the first
filter's error rate is ``r / s * sqrt(1/2)`` and the later ones' a half, so the
expected size is about ``r * (1.44 * log2(s / r) + 4)`` bits: it follows the list
and only the logarithm of the corpus. The filters are constants of the
expression that judges a url; pages are neither joined nor shuffled.

Urls: the host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path goes from there to ``?``, ``#`` or the end. A null url
or one without ``://`` has neither, and fits no rule. The longest fitting rule
wins (of equally long ones that with the longer host); a rule listed to be both
blocked and allowed blocks; without a rule the verdict is ``default``. Every
input row gets one output row; an empty table gives none. Other columns are
passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.llm import common as C

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    found = url.contains("://")
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.when(found, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")
    path = F.when(found, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]      # the bits, 64 a word
    bits: int
    hashes: int
    salt: int

    def position(self, key: str) -> str:
        """SQL: the ``i``-th bit of a key."""
        a = f"pmod(xxhash64({2 * self.salt}L, {key}), {self.bits}L)"
        b = f"(pmod(xxhash64({2 * self.salt + 1}L, {key}), {self.bits - 1}L) + 1L)"
        return f"pmod({a} + i * {b}, {self.bits}L)"

    def passes(self, key: str) -> str:
        """SQL: whether all bits of a key are set. The array is folded to a constant."""
        p = self.position(key)
        word = f"element_at(from_json('{list(self.words)}', 'array<bigint>'), cast(shiftright({p}, 6) + 1 AS int))"
        return f"forall(sequence(0L, {self.hashes - 1}L), i -> getbit({word}, cast(pmod({p}, 64L) AS int)) = 1)"


def bloom(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the column ``key``; its words (not the keys) reach the driver."""
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    level = Level((), bits, max(1, round(bits / max(n, 1) * math.log(2)) if bits > 64 else max(1, round(math.log2(1 / rate)))), salt)
    at = keys.selectExpr(f"explode(transform(sequence(0L, {level.hashes - 1}L), i -> {level.position('key')})) AS p")
    one = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("v")).collect()
    words = [0] * (-(-bits // 64))
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(tuple(words), bits, level.hashes, salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: str) -> str:
        """SQL: whether a key of the universe is listed."""
        out = "false"
        for level in reversed(self.levels):
            out = f"({level.passes(key)} AND NOT {out})"
        return out


def cascade(listed: DataFrame, universe: DataFrame, n_universe: int, salt: int = 0) -> Cascade:
    """The cascade of ``listed`` (key) over ``universe`` (key, may repeat)."""
    listed = C.stored(listed.select("key").distinct())
    n = listed.count()
    if not n:
        return Cascade(())
    rate = min(0.5, max(1e-12, math.sqrt(0.5) * n / max(n_universe, n, 1)))
    levels = [bloom(listed, n, rate, salt)]
    wrong = universe.select("key").where(levels[0].passes("key")).distinct().join(listed, "key", "left_anti")
    inside, outside = listed, C.stored(wrong)
    while n := outside.count():
        levels.append(bloom(outside, n, 0.5, salt + len(levels)))
        inside, outside = outside, C.stored(inside.where(levels[-1].passes("key")))
    return Cascade(tuple(levels))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (length, host length, key) that a rule for this url can have."""
    if not lengths:
        return F.array().cast("array<struct<n:int,h:int,key:string>>")
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")), lambda s: s != "")
    heads = F.filter(F.array(*[F.when(F.length(path) >= k, F.substr(path, F.lit(1), F.lit(k))) for k in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.struct(
        (F.length(s) + F.length(p)).alias("n"), F.length(s).alias("h"), F.concat(s, p).alias("key")))))


@dataclass(frozen=True)
class UrlFilter:
    lengths: tuple[int, ...]
    block: Cascade
    allow: Cascade
    default: str

    def judge(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
        host, path = host_path(F.col(url))
        out = pages.withColumn("host", host).withColumn("path", path)
        out = out.withColumn("rule", candidates(F.col("host"), F.col("path"), list(self.lengths)))
        fits = f"{self.block.lists('c.key')} OR {self.allow.lists('c.key')}"
        out = out.withColumn("rule", F.expr(f"array_max(filter(rule, c -> {fits})).key"))
        return out.withColumn("verdict", F.when(F.col("rule").isNull(), self.default)
                              .when(F.expr(self.block.lists("rule")), "block").otherwise("allow"))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> UrlFilter:
    """The filter of ``rules`` (host, path, verdict) for the urls of ``pages``.
    Exact for these urls; build it anew when the corpus or the rules change."""
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())   # at most the longest path
    host, path = host_path(F.col(url))
    keys = pages.select(host.alias("host"), path.alias("path")).select(F.explode(candidates(F.col("host"), F.col("path"), lengths)).alias("c"))
    universe = keys.select(F.col("c.key").alias("key"))
    n = universe.agg(F.approx_count_distinct("key")).first()[0]
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    block = cascade(listed.where("verdict = 'block'"), universe, n, 100)
    allow = cascade(listed.where("verdict = 'allow'"), universe, n, 200)
    return UrlFilter(tuple(lengths), block, allow, default)


# The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
