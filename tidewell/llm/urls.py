"""URL filters by a cascade of Bloom filters.

The keys of a universe U are listed or not. Level 0 is a Bloom filter of the listed keys; level 1 one of
the keys of U that level 0 takes for listed; level 2 of the listed keys that level 1 takes for such; and
so on until a level makes no mistake. A key of U is looked up by walking down until a level says no, so
membership is exact over U without a join. U is the complete set of keys that occur in the corpus.

Keys are hashed by Spark; bitmaps are filled by an aggregation over words of 64 bits. Level 0 has as many
hashes as leave about as many false positives as there are listed keys, so that all levels together have
some 1.44 * (log2(unlisted / listed) + 4) bits for each listed key. Keys are dealt to blocks by a hash, as
many as it takes for the levels of one to have at most `block_bits` bits, reckoned with a quarter to spare
(a level has at least LEAST_BITS).
Blocks are built, broadcast and looked up one at a time, a pass over the pages each, so a broadcast is
bounded whatever the sizes of list and corpus.

Rules (host, path, verdict) are found through the same structure: the keys are every suffix of a page's
host with every prefix of its path that is as long as some rule's path; the longest listed one wins.
Pages without a rule are blocked if their host, or one it is a subdomain of, is listed, else allowed.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule, is not listed and
so is allowed; rows are independent, so repeated rows do not matter; of a host, the suffixes with as many
labels as the longest listed host, or rule's host, are looked up, as longer ones cannot be equal to any;
other columns are ignored; empty tables and empty lists work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import counted, forget, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)
MASK = (1 << 64) - 1
BLOCK_BITS, LEAST_BITS = 1 << 26, 1024
#: Hashes of every level but the first: few, as their keys are few; more would save levels and cost bits.
LATER = 3
#: op8's blocklist, as a file would give it: these names under these domains, plain and with the numbers below NUMBERED attached.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS, NUMBERED = ("example.com", "example.net", "example.org"), 2000


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def places(h1: np.ndarray, h2: np.ndarray, depth: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of keys in a level, in another way at every depth."""
    x = h1 + np.uint64((depth + 1) * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    for k in range(hashes):
        yield (x + np.uint64(k) * (h2 | np.uint64(1))) % np.uint64(bits)


@dataclass
class Level:
    depth: int
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for at in places(h1, h2, self.depth, self.hashes, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Cascade:
    """Levels for the keys of one block."""

    def __init__(self, block: int, blocks: int, levels: list[Level]):
        self.block, self.blocks, self.levels = block, blocks, levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed; keys of other blocks are not."""
        out = np.zeros(len(h1), dtype=bool)
        live = np.flatnonzero((h1 >> np.uint64(33)) % np.uint64(self.blocks) == self.block)
        for k, level in enumerate(self.levels):
            live = live[level.has(h1[live], h2[live])]
            out[live] = k % 2 == 0
        return out


def first_hashes(listed: int, unlisted: int) -> int:
    """Hashes of level 0: as many as leave no more false positives than listed keys, and no fewer than a later level has."""
    return max(LATER, math.ceil(math.log2(max(1, unlisted) / max(1, listed))))


def planned_bits(listed: int, unlisted: int) -> int:
    """Bits of all levels: a later level has an eighth of the keys of the one before the last."""
    return math.ceil(listed * (first_hashes(listed, unlisted) + LATER * 9 / 7) / math.log(2))


def _level(keys: DataFrame, depth: int, n: int, hashes: int) -> Level:
    """A Bloom filter of the n keys (h1, h2), its bitmap put together from at most bits / 64 words."""
    bits = max(LEAST_BITS, math.ceil(n * hashes / math.log(2) / 64) * 64)

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h1, h2 = b["h1"].to_numpy().view(np.uint64), b["h2"].to_numpy().view(np.uint64)
            at = np.concatenate(list(places(h1, h2, depth, hashes, bits)))
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            out = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(out, where, np.uint64(1) << (at & np.uint64(63)))
            yield pd.DataFrame({"w": words.view(np.int64), "v": out.view(np.int64)})

    got = keys.mapInPandas(positions, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return Level(depth, bits, hashes, words)


def build(universe: DataFrame, block_bits: int = BLOCK_BITS) -> Iterator[Cascade]:
    """Cascades, a block of keys at a time, from (key, listed) rows; a key listed once is listed."""
    h1, h2 = hashed(F.col("key"))
    keys = written(universe.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")).select(h1.alias("h1"), h2.alias("h2"), "listed"), "keys")
    inside, all_ = keys.agg(F.count_if("listed"), F.count("*")).first()
    blocks = max(1, math.ceil(planned_bits(inside, all_ - inside) * 1.25 / block_bits))
    for block in range(blocks):
        mine = keys.where(F.pmod(F.shiftrightunsigned("h1", 33), F.lit(blocks)) == block) if blocks > 1 else keys
        if blocks > 1:
            inside, all_ = mine.agg(F.count_if("listed"), F.count("*")).first()
        yield Cascade(block, blocks, _levels(mine, inside, all_ - inside))
    forget(keys)


def _levels(keys: DataFrame, listed: int, unlisted: int) -> list[Level]:
    inside, outside, n = keys.where("listed"), keys.where(~F.col("listed")), listed
    levels: list[Level] = []
    while n:
        if len(levels) > 90:
            raise RuntimeError("two keys, one listed and one not, have the same 128 bits of hashes")
        level = _level(inside, len(levels), n, LATER if levels else first_hashes(listed, unlisted))
        levels.append(level)
        shared = keys.sparkSession.sparkContext.broadcast(level)
        wrong, n = counted(outside.where(_member(shared)), "false")
        shared.destroy()
        if len(levels) > 2:  # the two before came from keys
            forget(outside)
        inside, outside = wrong, inside
    return levels


def _member(shared: Broadcast) -> Column:
    @F.pandas_udf("boolean")
    def has(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return has("h1", "h2")


def _listed(cascades: list[Cascade], spark: SparkSession, keys: Column) -> Column:
    """array<boolean>: which of an array of keys are listed."""
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<boolean>")
    def ask(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        a, b = (np.concatenate([x for x in h if len(x)]).astype(np.int64).view(np.uint64) for h in (h1, h2))
        out = np.zeros(len(a), dtype=bool)
        for c in shared.value:
            out |= c.listed(a, b)
        return pd.Series(np.split(out, np.cumsum(sizes)[:-1]))

    return ask(F.transform(keys, lambda k: hashed(k)[0]), F.transform(keys, lambda k: hashed(k)[1]))


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def labels_of(host: Column) -> Column:
    return F.split(host, r"\.")


def suffixes(host: Column, most_labels: int) -> Column:
    """The host and the domains it is part of, longest first, as far as they have at most most_labels labels."""
    labels = labels_of(host)
    n = F.size(labels)
    at = F.sequence(F.least(n, F.lit(most_labels)), F.lit(1), F.lit(-1))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(at, lambda k: F.array_join(F.slice(labels, -k, k), ".")))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, block_bits: int = BLOCK_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of (page_id, url). listed: (host), the blocklist."""
    spark = pages.sparkSession
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    longest = listed.where("host is not null").agg(F.max(F.size(labels_of(F.col("host"))))).first()[0]
    hosts = suffixes(F.col("host"), longest or 1)
    of_rule = suffixes(F.col("host"), max((r.host.count(".") + 1 for r in rules), default=1))
    fits = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("start")) for n in lengths] or [F.lit(None).cast("struct<n:int,start:string>")]), lambda s: s.isNotNull() & (F.length(s["start"]) == s["n"]))
    keys = F.flatten(F.transform(of_rule, lambda h: F.transform(fits, lambda s: F.concat(h, s["start"]))))
    p = p.withColumns({"hosts": hosts, "keys": F.coalesce(keys, F.array().cast("array<string>"))})

    rule_keys = [r.key for r in rules]
    of_rules = p.select(F.explode("keys").alias("key")).distinct().select("key", F.col("key").isin(*rule_keys).alias("listed")) if rules else p.select(F.lit("").alias("key"), F.lit(False).alias("listed")).limit(0)
    of_hosts = p.select(F.explode("hosts").alias("key")).distinct().select("key", F.lit(False).alias("listed")).unionByName(
        listed.select(F.col("host").alias("key"), F.lit(True).alias("listed")).where("key is not null")
    )
    p = p.withColumn("is_rule", _listed(list(build(of_rules, block_bits)), spark, F.col("keys")))
    p = p.withColumn("on_list", F.lit(False))
    for cascade in build(of_hosts, block_bits):
        before, p = p, p.withColumn("on_list", F.col("on_list") | F.exists(_listed([cascade], spark, F.col("hosts")), lambda x: x))
        if cascade.block + 1 < cascade.blocks:  # the last pass is left to the caller's plan
            p = written(p, "judged")
            if hasattr(before, "_tidewell_path"):
                forget(before)
    best = F.element_at(
        F.array_sort(F.transform(F.filter(F.arrays_zip(F.col("keys").alias("key"), F.col("is_rule").alias("hit")), lambda z: z["hit"]), lambda z: F.struct((-F.length(z["key"])).alias("n"), z["key"].alias("key")))), 1
    )
    p = p.withColumn("rule", F.when(F.exists("is_rule", lambda x: x), best["key"]))
    verdict = F.when(F.col("on_list"), "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.key, r.verdict).otherwise(verdict)
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("on_list").alias("listed"))


def blocklist(spark: SparkSession) -> DataFrame:
    """(host): op8's list, known before any page is read; nearly all of it is in no page."""
    names = F.explode(F.array(*[F.lit(f"{n}{{}}.{d}") for n in NAMES for d in DOMAINS])).alias("host")
    return spark.range(NUMBERED).select("id", names).select(F.replace("host", F.lit("{}"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("host"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of pages, by rules and a list of domains."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), blocklist(spark))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), list AS (
  SELECT name || CASE WHEN i > 0 THEN CAST(i AS VARCHAR) ELSE '' END || '.' || domain AS h
  FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(name),
    (VALUES ('example.com'), ('example.net'), ('example.org')) b(domain), range(2000) c(i)
), suffixes AS (
  SELECT host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) AS h FROM (SELECT DISTINCT host FROM parts)
), hosts AS (
  SELECT host, bool_or(list.h IS NOT NULL) AS listed FROM suffixes LEFT JOIN list USING (h) GROUP BY host
), hits AS (
  SELECT p.*, r.rule, r.verdict AS v, row_number() OVER (PARTITION BY page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
    ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')) r(host, start, rule, verdict)
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.start)
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM hits JOIN hosts USING (host) WHERE k = 1
"""
