"""Rules and block lists over URLs, answered by a cascade of Bloom filters.

Level 1 holds the listed keys; level 2 the keys of the universe that pass level 1 wrongly; level 3
the listed keys that pass level 2; and so on until no key is wrong. With the whole universe of
keys known, the first level that a key fails tells whether it is listed: exact, and without a join.
Levels are literals of the query. Their bits follow the listed keys and the logarithm of the
universe: about r * (1.5 * log2(u / r) + 6) for r listed of u keys, and r is checked.
Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.session import Scratch

#: Most keys a list may have; with the bound above some 6 MB of bits at 10**12 keys in the universe.
MAX_LISTED = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """Bits of one filter as 64-bit words, and how many places each key sets."""

    bits: int
    hashes: int
    seed: int
    words: str

    def place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed + i)), F.lit(self.bits))

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to one literal
        tests = []
        for i in range(self.hashes):
            place = self.place(key, i)
            word = F.element_at(words, (F.floor(place / 64) + 1).cast("int"))
            tests.append(F.bit_get(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A filter of ``count`` keys with the given rate of false positives."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(count * hashes / math.log(2)))
    shape = Level(bits, hashes, seed, "")
    places = keys.select(F.explode(F.array(*[shape.place(F.col("key"), i) for i in range(hashes)])).alias("place"))
    words = (
        places.select(F.floor(F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(place, 64) as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    filled = [0] * math.ceil(bits / 64)
    for row in words.collect():  # at most bits / 64 rows
        filled[row["word"]] = row["bits"]
    return Level(bits, hashes, seed, ",".join(map(str, filled)))


@dataclass(frozen=True)
class Cascade:
    """Exact membership of every key of the universe it was built over."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """True for listed keys, false for others; a null key is not listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            found = F.when(self.levels[i].passes(key), found).otherwise(F.lit(i % 2 == 1))
        return key.isNotNull() & found


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, max_levels: int = 60) -> Cascade:
    """Cascade of the ``key`` column of ``listed`` over that of ``universe``; nulls and repeats count for nothing.

    Listed keys that the universe lacks are exact as well. An empty list has no level and contains nothing.
    """
    inside = scratch.write(listed.select("key").where("key is not null").distinct(), "listed")
    count = inside.count()
    if count > MAX_LISTED:
        raise ValueError(f"{count} listed keys, more than {MAX_LISTED}")
    if not count:
        return Cascade(())
    outside = scratch.write(universe.select("key").where("key is not null").distinct().join(F.broadcast(inside) if count < 10_000 else inside, "key", "left_anti"), "unlisted")
    others = outside.count()
    rate = min(0.5, count / (math.sqrt(2) * max(1, others)))
    levels, members, rest = [], (inside, count), (outside, others)
    while members[1]:
        if len(levels) == max_levels:
            raise RuntimeError("keys of the list and the universe collide in every level")
        level = _level(*members, rate, 64 * len(levels))
        levels.append(level)
        wrong = scratch.write(rest[0].where(level.passes(F.col("key"))), "wrong")
        members, rest, rate = (wrong, wrong.count()), members, 0.5
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: dict[str, str], blocked_hosts: list[str], scratch: Scratch, *, url: str = "url", keep: list[str]) -> DataFrame:
    """``keep`` columns of every row plus host, path, rule and verdict.

    ``rules`` maps host and path (``example.org/es/``) to ``allow`` or ``block``. A rule fits its host
    and all subdomains if the path starts with the rule's; the longest rule wins, at equal length the
    one with the longer host. Without a rule, hosts in ``blocked_hosts`` and their subdomains are
    blocked and all others allowed. Null and broken URLs have an empty host and path and are allowed.
    """
    spark = pages.sparkSession
    pages = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    shapes = {}  # (labels of the host, length of the path): the only prefixes that can be a rule
    for rule in rules:
        host, slash, path = rule.partition("/")
        shapes[f"__rule_{host.count('.') + 1}_{len(path) + 1}"] = _prefix(host.count(".") + 1, len(slash + path))
    hosts = {f"__host_{n}": F.substring_index("host", ".", -n) for n in {h.count(".") + 1 for h in blocked_hosts}}
    keyed = pages.withColumns(shapes | hosts)

    def cascade(listed: list[str], columns: list[str]) -> Cascade:
        if not listed:
            return Cascade(())
        keys = pages.select("host", "path").distinct().withColumns(shapes | hosts)
        universe = keys.select(F.explode(F.array(*columns)).alias("key"))
        return build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe, scratch)

    allow, block = (cascade([r for r, v in rules.items() if v == verdict], list(shapes)) for verdict in ("allow", "block"))
    blocked = cascade(blocked_hosts, list(hosts))

    def when_rule(c: str) -> Column:
        key = F.col(c)
        fits = F.struct(F.length(key).alias("n"), F.instr(key, "/").alias("host"), key.alias("rule"), F.when(block.contains(key), "block").otherwise("allow").alias("verdict"))
        return F.when(allow.contains(key) | block.contains(key), fits)

    best = F.array_max(F.array_compact(F.array(*[when_rule(c) for c in shapes]))) if shapes else F.lit(None).cast("struct<n:int,host:int,rule:string,verdict:string>")
    on_list = F.lit(False)
    for c in hosts:
        on_list = on_list | blocked.contains(F.col(c))
    judged = keyed.select(*keep, "host", "path", best.alias("__best"), on_list.alias("__listed"))
    return judged.select(*keep, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))


def _prefix(labels: int, length: int) -> Column:
    """Last labels of the host and start of the path; null where the path is shorter."""
    return F.when(F.length("path") >= length, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)))
