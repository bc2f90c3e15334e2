"""URL filter: host and path rules, then a Bloom filter cascade over the corpus's hosts. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import cut, free_name, quoted, release, table

# The rules of the production query, and the sites that it lists.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ENDINGS = ["example.com", "example.net", "example.org"]

WORD_BITS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ? or #, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The last three labels of a host: the key that lists go by."""
    return F.substring_index(host, ".", -3)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule is a host, then a path from its first slash. It fits its host and all subdomains where the url's path
    starts with the rule's. ``rules`` is a list in the program, so its size is bounded.
    """
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, slash, rest = text.partition("/")
        fits = (host == at) | F.endswith(host, F.lit("." + at))
        fits = fits & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


@dataclass
class Level:
    """A Bloom filter: a table of one row with the array ``words``, which a plan reads as a scalar subquery."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """True for each key put in, and for few others."""

        words, out = self.words.scalar(), F.lit(True)  # equal subqueries run once, and their result is one object
        for i in range(self.hashes):
            place = position(key, self.bits, self.seed, i)
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftright", word, place.bitwiseAND(WORD_BITS - 1).cast("int")).bitwiseAND(1) == 1)
        return out


def position(key: Column, bits: int, seed: int, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the ``key`` column: positions to words by a bitwise or, aggregated on the executors."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(WORD_BITS, math.ceil(n * hashes / math.log(2) / WORD_BITS) * WORD_BITS)
    place = F.explode(F.array(*[position(F.col("key"), bits, seed, i) for i in range(hashes)])).alias("p")
    mask = F.expr("shiftleft(cast(1 as bigint), cast(p & 63 as int))")
    empty = keys.sparkSession.range(bits // WORD_BITS).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("m"))
    found = keys.select(place).select(F.shiftright("p", 6).alias("w"), mask.alias("m")).unionByName(empty).groupBy("w").agg(F.bit_or("m").alias("m"))
    words = found.agg(F.sort_array(F.collect_list(F.struct("w", "m")))["m"].alias("words"))
    return Level(cut(words, "level"), bits, hashes, seed)


@dataclass
class Cascade:
    """levels: 0 holds the listed keys, 1 the others that 0 holds too, 2 the listed ones that 1 holds too, and so on."""

    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the universe: the first level that doesn't hold the key decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments))


def cascades(universe: DataFrame, listed: DataFrame, per_cascade: int = 8_000_000, later_rate: float = 0.5) -> list[Cascade]:
    """Cascades for the distinct non-null ``key`` values of both frames, one for each range of a hash (``segment``).

    A cascade has so many listed keys at most, about, whatever the length of the list; keys listed that the universe
    lacks aren't needed. The first level's rate of false positives is the ratio of listed keys to others (0.7 of it), so
    that every later level is about half as large; in all about 1.5 log2(others / listed) + 3 bits a listed key, which
    a plan gets as constants. Which keys of the universe are listed is one aggregate over both frames.
    """
    both = universe.select("key", F.lit(False).alias("in")).unionByName(listed.select("key", F.lit(True).alias("in"))).where("key is not null")
    sides = both.groupBy("key").agg(F.max("in").alias("in"), F.min("in").alias("no")).where("not no").select("key", "in")
    every = cut(sides, "universe")
    n = every.agg(F.count_if("in").alias("a"), F.count_if(~F.col("in")).alias("b")).first()
    segments = max(1, math.ceil(n["a"] / per_cascade))
    out = []
    for part in range(segments):
        own = every if segments == 1 else every.where(segment(F.col("key"), segments) == part)
        inside, outside = own.where("in").select("key"), own.where(~F.col("in")).select("key")
        size = (n["a"], n["b"]) if segments == 1 else (inside.count(), outside.count())
        levels, sides, left, made = [], [inside, outside], size[0], []
        while left:
            rate = later_rate if levels else min(0.5, max(1e-9, 0.7 * size[0] / max(1, size[1])))
            levels.append(level := _level(sides[0], left, rate, len(levels)))
            wrong = cut(sides[1].where(level.holds(F.col("key"))), "wrong")
            made.append(wrong)
            left = wrong.count()
            sides = [wrong, sides[0]]
        release(*made)
        out.append(Cascade(levels))
    release(every)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", per_cascade: int = 8_000_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    listed: one column ``key`` of sites (last three labels of a host). The verdict is the longest fitting rule's, else
    block where the cascade holds the site, else allow. Null and malformed urls have an empty host and path, fit no
    rule, and are allowed unless the empty site is listed. Urls count whole, however long, in time in proportion.
    Repeated rows each give a row, an empty table none; columns of ``pages`` stay, and new names that are taken get
    underscores. The pages are neither joined nor shuffled; only distinct sites are. Where the list takes several
    cascades, the pages of each are judged and written in turn.
    """
    names = {}
    out = pages
    for n in ("host", "path", "rule", "verdict"):
        names[n] = free_name(out, n)
        value = {"host": lambda: host_of(quoted(url)), "path": lambda: path_of(quoted(url))}.get(n, lambda: F.lit(None).cast("string"))()
        out = out.withColumn(names[n], value)
    host, path = quoted(names["host"]), quoted(names["path"])
    key = site_of(host)
    rule, verdict = rule_for(host, path, RULES if rules is None else rules)
    found = cascades(out.select(key.alias("key")), listed, per_cascade)

    def judged(rows: DataFrame, c: Cascade) -> DataFrame:
        rows = rows.withColumn(names["rule"], rule).withColumn(names["verdict"], F.coalesce(verdict, F.when(c.holds(key), "block").otherwise("allow")))
        return rows.select(*[quoted(c) for c in pages.columns], *[quoted(n) for n in names.values()])

    if len(found) == 1:
        return judged(out, found[0])
    whole = None
    for part, c in enumerate(found):
        one = cut(judged(out.where(segment(key, len(found)) == part), c), "judged")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def production_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{n}.{e}",) for n in LISTED_NAMES for e in LISTED_ENDINGS], "key string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, production_list(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    listed = ", ".join(f"'{n}.{e}'" for n in LISTED_NAMES for e in LISTED_ENDINGS)
    cases, verdicts = [], []
    for text, what in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        at, slash, rest = text.partition("/")
        fits = f"(host = '{at}' OR suffix(host, '.{at}')) AND starts_with(path, '{slash}{rest}')"
        cases.append(f"WHEN {fits} THEN '{text}'")
        verdicts.append(f"WHEN {fits} THEN '{what}'")
    return f"""
WITH cutout AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cutout),
judged AS (SELECT page_id, host, path, CASE {' '.join(cases)} END AS rule, CASE {' '.join(verdicts)} END AS ruled FROM hosted)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN regexp_extract(host, '([^.]*[.][^.]*[.][^.]*)$') IN ({listed}) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


SQL = _sql()
