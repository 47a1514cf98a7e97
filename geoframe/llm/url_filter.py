"""URL filter: a cascade of Bloom filters that is exact over the corpus's keys.

Every URL gives a bounded list of keys: each suffix of its host that has as many labels as some
rule's host, with each prefix of its path whose length is that of some rule's path.  The cascade's first level holds the listed
keys.  The second holds the keys of the corpus that pass the first by mistake, the third
the listed keys that pass the second by mistake, and so on until no key is left over.  As
the levels are built over all keys that occur, a lookup is exact, and no join takes place.
All of it is Spark SQL expressions.

Rules are a list or a table of any size.  A level is a literal of at most MAX_BITS; lists that
need more are dealt by a hash of their keys into segments of that size.  Each segment has cascades
of its own and judges its share of every URL's keys in one pass over the pages.

Defined results: a null URL or one without ``://`` has host and path ''.  No rule fits an
empty host.  The longest rule (host plus path) wins; of equally long ones that with the
longer host.  Rules with a null are left out; where one host and path has several verdicts, that
which comes last counts (in a list by the verdict's first place, in a table by its name).
A URL that is not listed is allowed.  Repeated rows are judged one by one,
other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, unused

#: Expected share of the corpus's keys that the first level lets through by mistake.
FIRST_LEVEL_ERROR = 0.01
LATER_LEVEL_ERROR = 0.05
MAX_LEVELS = 64
#: Bits of one level at most (32 MB); longer lists are dealt into segments.
MAX_BITS = 1 << 28
#: Words of 64 bits that reach the driver as one row.
CHUNK = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + "\x1f" + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter, as one binary literal."""

    data: bytes
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        data = F.lit(self.data)
        at = [bit_of(key, self.seed, i, 8 * len(self.data)) for i in range(self.hashes)]
        byte = [F.conv(F.hex(F.substring(data, F.shiftright(b, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long") for b in at]
        tests = [F.getbit(v, (b % 8).cast("int")) == 1 for v, b in zip(byte, at, strict=True)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _one(bit: Column) -> Column:
    """The word that has this bit; words are written with their highest byte first."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int").bitwiseXOR(F.lit(56)))


def bit_of(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """All keys of a URL, the longest first.  ``lengths``: of the rules' paths; ``labels``: numbers of labels of their hosts."""
    split = F.split(host, r"\.", -1)
    some = lambda values: F.filter(F.array(*values), lambda v: v.isNotNull())
    hosts = some([F.when(F.size(split) >= n, F.array_join(F.slice(split, -n, n), ".")) for n in sorted(set(labels), reverse=True)])
    prefixes = some([F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)])
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct((-(F.length(h) + F.length(p))).alias("size"), (-F.length(h)).alias("part"), F.concat(h, F.lit("\x1f"), p).alias("key")))))
    return F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: x["key"])


def _bits(count: int, error: float) -> int:
    return 64 * max(1, math.ceil(-count * math.log(error) / math.log(2) ** 2 / 64))


def _level(keys: DataFrame, count: int, error: float, seed: int) -> Level:
    """One aggregate over ``keys`` (a column ``key``); a row for each CHUNK words reaches the driver."""
    bits = _bits(count, error)
    hashes = max(1, min(30, round(bits / max(1, count) * math.log(2))))
    at = keys.select(F.explode(F.array(*[bit_of(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("bit"))
    words = at.select(F.shiftright("bit", 6).alias("word"), _one(F.col("bit")).alias("value")).union(keys.sparkSession.range(bits // 64).select("id", F.lit(0).cast("long")))
    words = words.groupBy("word").agg(F.bit_or("value").alias("value"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: F.lpad(F.hex(x["value"]), 16, "0"))
    chunks = words.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(F.unhex(F.array_join(held, "")).alias("data")).orderBy("chunk")
    return Level(b"".join(bytes(r["data"]) for r in chunks.collect()), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """The deepest level that a key reaches decides: it is listed if that level's number is odd."""
        out = F.lit(True) if len(self.levels) % 2 else F.lit(False)
        for number in range(len(self.levels), 0, -1):
            out = F.when(self.levels[number - 1].holds(key), out).otherwise(F.lit(number % 2 == 0))
        return out


def build_cascades(lists: list[DataFrame], universe: DataFrame, seed: int = 0) -> list[Cascade]:
    """A cascade for each of ``lists``; these and ``universe`` have a column ``key``.  Exact for all keys of both.

    The universe is read once: what passes some first level is kept (about the error rate of it),
    and each further step works on what passes the levels so far."""
    inside = [cut(k.filter("key is not null").distinct()) for k in lists]
    seeds = [seed + 1000 * i for i in range(len(inside))]
    firsts = [_level(k, n, FIRST_LEVEL_ERROR, s) if (n := k.count()) else None for k, s in zip(inside, seeds, strict=True)]
    passes = [first.holds(F.col("key")) if first else F.lit(False) for first in firsts]
    flagged = universe.filter("key is not null").select("key", *[f.alias(f"in{i}") for i, f in enumerate(passes)])
    near = cut(flagged.filter(F.greatest(*[f"in{i}" for i in range(len(passes))], F.lit(False))).distinct())
    out = []
    for i, (listed, first) in enumerate(zip(inside, firsts, strict=True)):
        if first is None:
            out.append(Cascade(()))
            continue
        levels, left, over = [first], cut(near.filter(f"in{i}").select("key").join(listed, "key", "left_anti")), listed
        while count := left.count():
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the cascade doesn't end")
            level = _level(left, count, LATER_LEVEL_ERROR, seeds[i] + len(levels))
            levels.append(level)
            left, over = cut(over.filter(level.holds(F.col("key")))), left
        out.append(Cascade(tuple(levels)))
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
    return build_cascades([listed], universe, seed)[0]


def _table(pages: DataFrame, rules: list[Rule] | DataFrame) -> tuple[DataFrame, list[str]]:
    """verdict, host, path and key, and the verdicts in the order of which the last one counts."""
    if isinstance(rules, DataFrame):
        made = rules.select("verdict", "host", "path").filter("verdict is not null and host is not null and path is not null")
        verdicts = [r["verdict"] for r in made.select("verdict").distinct().orderBy("verdict").collect()]
    else:
        each = [F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules]
        made = pages.sparkSession.range(1).select(F.inline(F.array(*each))) if each else pages.sparkSession.range(0).selectExpr("'' AS verdict", "'' AS host", "'' AS path")
        verdicts = list(dict.fromkeys(r.verdict for r in rules))
    return made.withColumn("key", F.concat("host", F.lit("\x1f"), "path")), verdicts


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; columns of these names are replaced.
    ``rules``: a list, or a table with verdict, host and path."""
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    table, verdicts = _table(pages, rules)
    if not verdicts:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # as many lengths as a URL can have, and the longest list
    lengths = [r[0] for r in table.select(F.length("path")).distinct().collect()]
    labels = [r[0] for r in table.select(F.size(F.split("host", r"\.", -1))).distinct().collect()]
    longest = table.groupBy("verdict").count().agg(F.max("count")).first()[0]
    segments = -(-_bits(longest, FIRST_LEVEL_ERROR) // MAX_BITS)
    if segments > 1:
        segments += segments // 8 + 1  # room for uneven ones
    keys = keys_of(F.col("host"), F.col("path"), lengths, labels)
    name = unused(parts, "hit")
    place = lambda key: F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments))

    def judged(cascades: list[Cascade], key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v, cascade in zip(verdicts, cascades, strict=True):
            out = F.when(cascade.holds(key), F.lit(v)).otherwise(out)
        return out

    places = F.transform(keys, lambda k, i: F.struct(i.alias("at"), k.alias("key")))

    def best(cascades: list[Cascade], segment: int) -> Column:
        some = F.filter(places, lambda x: place(x["key"]) == segment) if segments > 1 else places
        found = F.transform(some, lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"), judged(cascades, x["key"]).alias("verdict")))
        return F.get(F.filter(found, lambda x: x["verdict"].isNotNull()), F.lit(0))

    held = parts
    for s in range(segments):
        mine = F.lit(True) if segments == 1 else place(F.col("key")) == s
        lists = [table.filter((F.col("verdict") == v) & mine).select("key") for v in verdicts]
        hit = best(build_cascades(lists, parts.select(F.explode(keys).alias("key")).filter(mine), seed=100_000 * s), s)
        held = held.withColumn(name, F.least(F.col(f"`{name}`"), hit) if s else hit)
        if segments > 1:  # else one plan would hold the levels of all segments
            held = cut(held)
    return held.select(
        *[F.col(f"`{c}`") for c in keep], "host", "path",
        F.regexp_replace(F.col(f"{name}.key"), "\x1f", "").alias("rule"),
        F.coalesce(F.col(f"{name}.verdict"), F.lit(default)).alias("verdict"),
    )
