"""URL rules and lists held in a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 lets through wrongly, level 3 the listed
keys that level 2 catches, and so on until no error is left. Over the key universe from which it was built, membership
is then exact, and a URL is judged by bit tests in its own row: no join. Building and testing are built-in Spark SQL.
A list whose first level would not fit into MAX_BITS is dealt by a hash of the key into segments, each with a cascade
of its own; the rows pass them one after the other, so no plan carries more than one segment's filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialize

#: (verdict, key); a key is a host followed by the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts blocked, subdomains included, where no rule fits.
LISTED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")
#: Most bits of a segment's first level, 4 MB; the other levels together take less than twice its keys' share.
MAX_BITS = 1 << 25


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]  # 64 bits each, signed


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ://, and path up to ? or #; both empty if there is no ://, or for null."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and each domain above it: a.b.c gives a.b.c, b.c, c; an empty host gives none."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(host != "", F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def candidate_keys(host: Column, path: Column, lengths: tuple[int, ...]) -> Column:
    """Every key that a rule on this URL could have: a host suffix and the first characters of the path, for each length that rules use."""
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda s: s.isNotNull())
    return F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(starts, lambda s: F.concat(h, s))))


def _positions(key: Column, level_no: int, bits: int, hashes: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(2 * level_no)), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(2 * level_no + 1)), F.lit(bits - 1)) + 1 if bits > 1 else F.lit(0).cast("long")
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def _in_level(key: Column, level_no: int, level: Level) -> Column:
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")  # once a level in the plan, whatever its hashes
    return F.forall(F.array(*_positions(key, level_no, level.bits, level.hashes)), lambda at: F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)


def _first_rate(n: int, n_others: int) -> float:
    """The first level's rate of false positives: about 0.7 wrong keys for each listed one."""
    return min(0.5, 0.7 * n / max(1, n_others))


def _bits(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))


def _encode(keys: DataFrame, n: int, level_no: int, rate: float) -> Level:
    """A filter of n keys with about that rate of false positives. Its bits are set by distinct positions; only its words reach the driver."""
    hashes = max(1, round(-math.log2(rate)))
    bits = _bits(n, rate)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level_no, bits, hashes))).alias("at"))
    # 1 << 63 is the lowest long: shiftleft wraps without an overflow
    words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    filled = {r["word"]: r["bits"] for r in words.collect()}
    return Level(bits, hashes, tuple(filled.get(i, 0) for i in range(bits // 64)))


class Cascade:
    """Exact membership of listed keys among the keys of a universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        """listed and universe: one column `key`, distinct, not null. Keys listed but not in the universe are let go: nothing asks for them."""
        inside = materialize(listed.join(universe, "key", "left_semi"), "cascade-listed")
        outside = universe.join(inside, "key", "left_anti")
        n = inside.count()
        n_others = universe.count() - n
        self.levels: list[Level] = []
        while n:  # each level's hashes are new, so wrong keys halve about; no two keys share all levels' positions
            no = len(self.levels)
            level = _encode(inside, n, no, 0.5 if no else _first_rate(n, n_others))
            self.levels.append(level)
            wrong = materialize(outside.filter(_in_level(F.col("key"), no, level)), "cascade-level")
            inside, outside, n = wrong, inside, wrong.count()

    def contains(self, key: Column) -> Column:
        """True for listed keys, False for the universe's others; the first level that lacks a key decides."""
        found = F.lit(bool(len(self.levels) % 2))
        for no in reversed(range(len(self.levels))):
            found = F.when(~_in_level(key, no, self.levels[no]), F.lit(bool(no % 2))).otherwise(found)
        return found


def _marked(parts: DataFrame, column: str, listed: DataFrame, universe: DataFrame, out: str, max_bits: int) -> DataFrame:
    """parts with the array `out` of those keys in the array `column` that are listed; one pass over the rows for each segment of the list."""
    listed = materialize(listed.join(universe, "key", "left_semi"), "url-listed")
    n = listed.count()
    segments = max(1, math.ceil(_bits(n, _first_rate(n, universe.count() - n)) / max_bits)) if n else 1
    if segments == 1:
        return parts.withColumn(out, F.filter(column, Cascade(listed, universe).contains))
    parts = parts.withColumn(out, F.array().cast("array<string>"))
    for no in range(segments):

        def mine(key: Column) -> Column:
            return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(segments)) == no

        cascade = Cascade(listed.filter(mine(F.col("key"))), universe.filter(mine(F.col("key"))))
        parts = materialize(parts.withColumn(out, F.concat(out, F.filter(column, lambda key: mine(key) & cascade.contains(key)))), "url-segment")
    return parts


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """A block list for judge_urls from text files, one host a line: A-Z lower-cased, blanks around it and a dot at its end gone, empty lines and those that begin with # left out."""
    host = F.translate(F.regexp_extract(F.trim("value"), r"^([^#\s]\S*?)\.?$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return spark.read.text(path).select(host.alias("key")).filter("key != ''").distinct()


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, listed_hosts: tuple[str, ...] | DataFrame = LISTED_HOSTS, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    The longest rule that fits decides; else the list: a host on it, or below one on it, is blocked, every other
    allowed. Null, empty or odd URLs (no ://) have empty host and path, fit no rule and are allowed. Repeated rows are
    each judged; an empty table gives an empty result; columns other than page_id and url are ignored.
    listed_hosts: a tuple, or a table with a column `key`, such as read_hosts gives; null keys are no hosts.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    lengths = tuple(sorted({len(key) - key.index("/") for _, key in rules}))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = materialize(parts.select("host", candidate_keys(F.col("host"), F.col("path"), lengths).alias("keys")).distinct(), "url-keys")
    rule_universe = materialize(distinct.select(F.explode("keys").alias("key")).distinct(), "url-rule-universe")
    host_universe = materialize(distinct.select(F.explode(host_suffixes(F.col("host"))).alias("key")).distinct(), "url-host-universe")

    def keys_of(verdict: str) -> DataFrame:
        return _key_table(spark, [key for v, key in rules if v == verdict])

    listed = listed_hosts.select("key").distinct() if isinstance(listed_hosts, DataFrame) else _key_table(spark, list(listed_hosts))
    parts = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths)).withColumn("suffixes", host_suffixes(F.col("host")))
    for out, column, keys, universe in (("blocks", "keys", keys_of("block"), rule_universe), ("allows", "keys", keys_of("allow"), rule_universe), ("hosts", "suffixes", listed, host_universe)):
        parts = _marked(parts, column, keys, universe, out, max_bits)

    def longest(column: str, verdict: str) -> Column:
        return F.transform(column, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))

    best = F.array_max(F.concat(longest("blocks", "block"), longest("allows", "allow")))
    by_list = F.when(F.size("hosts") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return parts.withColumn("best", best).select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", by_list).alias("verdict"))


def _key_table(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in sorted(set(keys))]).cast("array<string>")).alias("key"))


SQL = r"""
WITH rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(verdict, rule_host, rule_path)),
listed AS (SELECT * FROM (VALUES ('spam-farm.example.com'), ('spam-farm.example.net'), ('spam-farm.example.org')) l(listed_host)),
urls AS (SELECT DISTINCT host, path FROM parts),
judged AS (
  SELECT u.host, u.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM urls u JOIN rules ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path) GROUP BY ALL),
hit AS (SELECT DISTINCT u.host FROM urls u JOIN listed ON u.host = listed_host OR ends_with(u.host, '.' || listed_host))
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, CASE WHEN h.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN judged j ON p.host = j.host AND p.path = j.path LEFT JOIN hit h ON p.host = h.host
"""
