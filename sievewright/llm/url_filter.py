"""URL filters: exact set membership by a cascade of Bloom filters, no joins.

Level 0 encodes the listed keys, level 1 the corpus keys that level 0 takes for
listed, level 2 the listed keys that level 1 takes for unlisted, and so on until
no key is mistaken. A key is listed iff the first level that lacks it has an odd
index (or, if none lacks it, iff the number of levels is odd). This is exact for every key in the universe
it was built over, and the universe is every key that the corpus can ask for. Everything
on the main path is DataFrame functions. Listed and corpus keys are told apart by tag, union and aggregation; bitmaps are literals, in pieces of
bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import cut

#: Rules of the production query: (verdict, host, path prefix).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Listed hosts of the production query; subdomains are listed with them.
LISTED = [
    "ads-track.example.com",
    "spam-farm.example.org",
    "casino-win.example.net",
    "adult-x.example.com",
    "cheap-pills.example.net",
    "cheap-pills.example.com",
    "free-bets.example.net",
]
#: Bits of one piece of a level's bitmap; a larger level has several.
PIECE = 1 << 22
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    #: 64-bit words of each piece, as text with commas between
    pieces: tuple[str, ...]


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _in_level(key: Column, level: int, at: Level) -> Column:
    pieces = [F.split(F.lit(x), ",").cast("array<bigint>") for x in at.pieces]  # constants, folded once
    hit = F.lit(True)
    for pos in _positions(key, level, at.bits, at.hashes):
        words = pieces[0]
        for n in range(1, len(pieces)):
            words = F.when(pos >= n * PIECE, pieces[n]).otherwise(words)
        word = F.element_at(words, (F.shiftright(pos % PIECE, 6) + 1).cast("int"))
        hit = hit & (F.call_function("getbit", word, (pos % 64).cast("int")) == 1)
    return hit


def contains(key: Column, cascade: list[Level]) -> Column:
    """Whether ``key`` is listed: exact for the keys of the universe; null is not listed."""
    listed = F.lit(len(cascade) % 2 == 1)
    for n in reversed(range(len(cascade))):
        listed = F.when(~_in_level(key, n, cascade[n]), F.lit(n % 2 == 1)).otherwise(listed)
    return F.coalesce(key.isNotNull() & listed, F.lit(False))


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key") -> list[Level]:
    """Filters of alternating levels over ``universe`` (null keys and repeats count for nothing).

    The first level's error rate follows the size of the list against the universe, so
    all levels together stay near ``n_listed * log2(universe / n_listed)`` bits.
    """
    tagged = listed.select(F.col(key).alias("key"), F.lit(True).alias("listed")).union(
        universe.select(F.col(key).alias("key"), F.lit(False))
    )
    tagged = cut(tagged.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))
    # Listed keys that no corpus key equals may stay: they are encoded, and cost only bits.
    inside, outside = tagged.where("listed").select("key"), tagged.where("not listed").select("key")
    n_in = inside.count()
    if not n_in:
        return []
    n_out = outside.count()
    cascade: list[Level] = []
    put, other, n_put = inside, outside, n_in
    for level in range(MAX_LEVELS):
        ratio = n_in / max(n_out, 1)
        error = min(0.5, ratio * math.sqrt(0.5)) if level == 0 else 0.5
        hashes = max(1, round(-math.log2(error)))
        bits = max(64, math.ceil(n_put * hashes / math.log(2) / 64) * 64)
        # one row per 64-bit word that has a bit: the driver sees the bitmap, whose size follows the list
        rows = (
            put.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
            .toArrow()
        )
        words = np.zeros(bits // 64, dtype=np.int64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy()
        pieces = [words[lo : lo + PIECE // 64] for lo in range(0, len(words), PIECE // 64)]
        cascade.append(Level(bits, hashes, tuple(",".join(map(str, w.tolist())) for w in pieces)))
        wrong = cut(other.where(_in_level(F.col("key"), level, cascade[-1])))
        n_wrong = wrong.count()
        if not n_wrong:
            return cascade
        put, other, n_put = wrong, put, n_wrong
    raise RuntimeError("the cascade did not end")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, most: int | Column) -> Column:
    """The host and its parent domains of at most ``most`` labels, longest first: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(
        F.sequence(F.greatest(F.lit(1), n - F.lit(most) + 1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )


def rule_keys(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """Every (parent domain, path prefix) that a rule could name, at the rules' path lengths."""
    heads = F.array_distinct(
        F.filter(
            F.array(*[F.substring(path, 1, n) for n in lengths]),
            lambda p: F.char_length(p) > 0,
        )
    )
    return F.flatten(F.transform(suffixes(host, most), lambda h: F.transform(heads, lambda p: F.concat(h, p))))


def _strings(spark: SparkSession, values: list[str]) -> DataFrame:
    """A column ``key`` of constants."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values]).cast("array<string>")).alias("key"))


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    listed: list[str] | DataFrame = LISTED,
    url: str = "url",
    page_id: str = "page_id",
) -> DataFrame:
    """Judge each url: ``page_id, host, path, rule, verdict, listed``.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule (host and path together, then the longer host) wins and gives the
    verdict. Where none fits, the verdict is block if the host or a parent domain is
    listed, else allow. Null urls and urls without ``://`` have empty host and path, fit no rule and
    are allowed. ``listed`` is a list of hosts or a table with a column ``key``. Repeated rows are judged alike; an empty table gives an empty result;
    no rules or no list is allowed. Rule keys and listed hosts are looked up in
    one cascade each for allowing rules, blocking rules and listed hosts.
    """
    spark = pages.sparkSession
    at = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    lengths = sorted({len(p) for _, _, p in rules})
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)  # a host of more labels equals no rule's
    asked = at.select(F.explode(rule_keys(F.col("host"), F.col("path"), lengths, most)).alias("key")) if lengths else None
    by = {}
    for verdict in ("allow", "block"):
        keys = [h + p for v, h, p in rules if v == verdict]
        by[verdict] = build_cascade(_strings(spark, keys), asked) if keys else []
    hosts = listed if isinstance(listed, DataFrame) else _strings(spark, listed)
    longest = hosts.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 1
    known = build_cascade(hosts, at.select("host").distinct().select(F.explode(suffixes(F.col("host"), longest)).alias("key")))
    fits = F.array().cast("array<struct<n:int,h:int,rule:string,verdict:string>>")
    if lengths:
        keys = rule_keys(F.col("host"), F.col("path"), lengths, most)
        fits = F.filter(
            F.transform(
                keys,
                lambda k: F.struct(
                    F.char_length(k).alias("n"),
                    F.char_length(F.substring_index(k, "/", 1)).alias("h"),
                    k.alias("rule"),
                    F.when(contains(k, by["block"]), F.lit("block"))
                    .when(contains(k, by["allow"]), F.lit("allow"))
                    .alias("verdict"),
                ),
            ),
            lambda s: s["verdict"].isNotNull(),
        )
    judged = at.withColumn("_rule", F.array_max(fits)).withColumn(
        "listed", F.exists(suffixes(F.col("host"), longest), lambda h: contains(h, known))
    )
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
