"""URL rules judged through Bloom filter cascades: exact membership over the corpus's own keys, without joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.text import UPPER
from wattframe.session import cut_lineage

MAX_BITS = 1 << 27
# The rules of the registered query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(str(list(self.words))), "array<bigint>")
        tests = []
        for at in _positions(key, self.bits, self.hashes, self.seed):
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            tests.append(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


@dataclass(frozen=True)
class Cascade:
    """Odd levels hold listed keys, even levels the unlisted keys that passed so far."""

    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """True exactly for the listed keys, for every key of the universe that the cascade was built over."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            verdict = F.when(self.levels[number - 1].holds(key), verdict).otherwise(F.lit(number % 2 == 0))
        return verdict


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + j), key), F.lit(bits)) for j in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of n keys with about the given rate of false positives. Its size is checked before its words (64 bits each) reach the driver."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * math.ceil(max(1, n * hashes / math.log(2)) / 64)
    if bits > MAX_BITS:
        raise ValueError(f"a filter level of {bits} bits exceeds the bound of {MAX_BITS}; shard the key list")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set"))
    filled = {r["word"]: r["set"] for r in words.collect()}
    return Level(bits, hashes, seed, tuple(filled.get(i, 0) for i in range(bits // 64)))


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """Cascade over `universe` (key, repeats allowed) for `listed` (key).

    The first level's rate is sqrt(2) * listed / unlisted, all later ones 1/2, which makes the total size smallest; the count of the universe sets sizes only, never
    the result. Keys that pass the first level are written once, and later levels read only those. An empty list gives a cascade without levels, which
    holds nothing.
    """
    listed = cut_lineage(listed.select("key").where("key IS NOT NULL").distinct())
    n = listed.count()
    if n == 0:
        return Cascade(())
    total = universe.select(F.approx_count_distinct("key")).first()[0]
    levels = [_level(listed, n, min(0.5, math.sqrt(2) * n / max(1, total - n)), 1)]
    passed = universe.select("key").where(levels[0].holds(F.col("key"))).distinct()
    outside, inside = cut_lineage(passed.join(listed, "key", "left_anti")), listed
    while True:
        n = outside.count()
        if n == 0:
            return Cascade(tuple(levels))
        levels.append(_level(outside, n, 0.5, len(levels) + 1))
        outside, inside = cut_lineage(inside.where(levels[-1].holds(F.col("key")))), outside


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def candidate_keys(host: Column, path: Column, depth: int, lengths: Sequence[int]) -> Column:
    """All keys (domain suffix of up to `depth` labels, then path prefix of one of `lengths`) by which a rule could fit a url."""
    labels = F.split(host, r"\.")
    pieces = []
    for k in range(1, depth + 1):
        tail = F.array_join(F.slice(labels, -k, k), ".")
        for n in lengths:
            pieces.append(F.when((F.size(labels) >= k) & (F.length(path) >= n), F.concat(tail, F.substring(path, 1, n))))
    return F.array_compact(F.array(*pieces)) if pieces else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    `rules` has verdict (allow or block), host, path; a rule fits its host and all subdomains when the path starts with the rule's; the longest wins. Both lists become
    cascades over the complete key universe of the pages; a url that neither holds is not listed, so it is allowed. The labels and path lengths of the rules
    bound the keys of a url, however long it is. Null urls and urls without `://` have empty host and path and no rule. Repeated rows are judged alike; an
    empty table gives an empty result; other columns are not read.
    """
    shape = rules.select(F.max(F.size(F.split("host", r"\."))).alias("depth"), F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = url_parts(F.col(f"`{url_column}`"))
    split = pages.select(F.col(f"`{id_column}`").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), shape["depth"] or 0, sorted(shape["lengths"]))
    universe = split.select(F.explode(keys).alias("key"))
    listed = rules.select("verdict", F.concat("host", "path").alias("key"))
    block, allow = (build_cascade(universe, listed.where(F.col("verdict") == v)) for v in ("block", "allow"))
    hits = F.filter(keys, lambda key: block.holds(key) | allow.holds(key))
    longest = F.array_max(F.transform(hits, lambda key: F.struct(F.length(key).alias("n"), key.alias("key"))))
    ruled = split.select("page_id", "host", "path", longest["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNotNull() & block.holds(F.col("rule")), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True)]) for r in rules]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


ORACLE_SQL = """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
          ('block', 'net', '/fr/')) AS t(verdict, rule_host, rule_path)),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
      FROM p JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""
