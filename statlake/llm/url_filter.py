"""URL filters: a blocked Bloom filter over listed canonical URLs, then an exact hash join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statlake.llm.common import fresh, materialize

#: Bits a listed URL gets, and the largest filter (bytes): past it the filter lets more through, the join stays exact.
BITS_PER_KEY, MAX_FILTER_BYTES = 16, 32 << 20
#: A block is eight 64-bit words, one bit set in each; odd multipliers pick the bits (any odd numbers do).
_WORDS = 8
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(_WORDS)], np.uint64)
#: The production rules: host and path, allow or block (fixed values of the contract).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
DEFAULT = "allow"
_LOWER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "".join(_LOWER), "".join(_LOWER.values())), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to '?', '#' or the end; empty without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _blocks(rules: DataFrame, n_blocks: int) -> DataFrame:
    """The filter's non-empty blocks: block number and eight words, or-ed together in the cluster."""
    h = F.xxhash64("rule")
    block = F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)).alias("block")
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pmod(low * {_small(i)}L, 4294967296L), 26) as int))").alias(f"w{i}") for i in range(_WORDS)]
    return (rules.select(block, low.alias("low")).select("block", *bits)
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)]))


def _small(i: int) -> int:
    """31-bit odd multiplier of word i."""
    return int(_MULTIPLIERS[i] >> np.uint64(33)) | 1


def bloom_filter(rules: DataFrame, count: int) -> np.ndarray:
    """(blocks, 8) words. Its size is bounded by MAX_FILTER_BYTES whatever the list."""
    blocks = 1
    while blocks * 64 * 8 < count * BITS_PER_KEY and 2 * blocks * 64 <= MAX_FILTER_BYTES:
        blocks *= 2
    words = np.zeros((blocks, _WORDS), np.int64)
    got = _blocks(rules, blocks).toPandas()
    if len(got):
        words[got["block"].to_numpy()] = got[[f"w{i}" for i in range(_WORDS)]].to_numpy()
    return words.view(np.uint64)


def _possible(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each 64-bit hash: may its URL be listed?"""
    h = hashes.view(np.uint64)
    block = words[((h >> np.uint64(32)) % np.uint64(len(words))).astype(np.int64)]
    low, hit = h & np.uint64(0xFFFFFFFF), np.ones(len(h), bool)
    for i in range(_WORDS):
        bit = ((low * np.uint64(_small(i))) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        hit &= (block[:, i] >> bit) & np.uint64(1) == 1
    return hit


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with columns host, path, rule (null: none fits) and verdict added (other columns stay; clashing names are replaced).

    ``rules``: (rule, verdict), a rule being a canonical URL 'host/path'. It
    fits its host and all subdomains where the url's path starts with its
    path; the longest that fits wins (then the longer host). A url's
    candidates are its host's suffixes with its path's prefixes of the
    lengths that listed paths have; the Bloom filter drops nearly all that are
    not listed, and the rest are joined exactly with the list. No rule fits:
    ``default``. Each distinct url is judged once, however many rows have it.
    Null urls and urls without '://' have an empty host and path and no rule.
    A rule listed twice keeps its 'block'. An empty list gives every row the
    default; an empty table gives no rows.
    """
    spark = pages.sparkSession
    listed = rules.where("rule is not null").select(F.col("rule"), F.col("verdict").alias("rule_verdict"))
    listed = materialize(listed.groupBy("rule").agg(F.max("rule_verdict").alias("rule_verdict")), "url-rules")
    slash = F.locate("/", F.col("rule"))
    lengths = sorted(r[0] for r in listed.select(F.when(slash > 0, F.char_length("rule") - slash + 1).otherwise(0)).distinct().collect())
    words = spark.sparkContext.broadcast(bloom_filter(listed, listed.count()))

    @F.pandas_udf("array<boolean>")
    def possible(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([*hashes, np.empty(0, np.int64)]).astype(np.int64)
        hit = _possible(words.value, flat) if len(flat) else np.empty(0, bool)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    # bounded by the distinct url text, not by its rows
    distinct = pages.select(F.col(url).cast("string").alias("u")).where("u is not null").distinct()
    parts = distinct.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).where("host <> ''")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1 << 30), "."))
    held = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths if n > 0]
    prefixes = F.array_compact(F.array(F.lit("") if 0 in lengths else F.lit(None).cast("string"), *held))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    probed = parts.select("u", keys.alias("keys")).withColumn("hit", possible(F.transform("keys", lambda k: F.xxhash64(k))))
    hits = probed.select("u", F.explode(F.filter(F.arrays_zip("keys", "hit"), lambda z: z["hit"])).alias("z")).select("u", F.col("z.keys").alias("rule"))
    host_length = F.char_length(F.substring_index("rule", "/", 1))
    best = (hits.join(listed, "rule").groupBy("u")
            .agg(F.max(F.struct(F.char_length("rule"), host_length, F.col("rule"), F.col("rule_verdict").alias("v"))).alias("b"))
            .select("u", F.col("b.rule").alias("rule"), F.col("b.v").alias("verdict")))
    added = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in added]
    key = fresh(pages, "url_key")
    best = best.select(F.col("u").alias(key), F.col("rule").alias(key + "_r"), F.col("verdict").alias(key + "_v"))
    out = pages.select(*rest).join(best, F.col(url).cast("string") == F.col(key), "left")
    return out.select(*rest, host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"),
                      F.col(key + "_r").alias("rule"), F.coalesce(F.col(key + "_v"), F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(strpos(url, '://'), 0) AS mark, coalesce(substr(url, strpos(url, '://') + 3), '') AS rest FROM pages
), h AS (
  SELECT page_id, CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p
), rules(rule, rhost, rpath, v) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), m AS (
  SELECT h.page_id, h.host, h.path, r.rule, r.v, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM h LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
