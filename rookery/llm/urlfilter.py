"""URL rules and a host list by Bloom filter cascades: exact membership of keys without joining the list.

Level 0 of a cascade encodes the listed keys; level 1 the keys of the corpus that level 0 lets through wrongly; level 2
the listed keys that level 1 lets through, and so on until a level lets nothing through wrongly. The number of
levels a key passes in a row tells whether it is listed, exactly, for every key of the universe, which is all
candidate keys of the whole table. Level 0 is sized by the universe, so that about as many keys pass it wrongly as are listed; every
later level halves what is left. Keys are dealt by a hash into buckets of about KEYS listed keys; a row meets the few words of
its own bucket only, so filters may hold any number of keys.

Rules: a key is a suffix of the host (whole labels) joined with a prefix of the path; only label counts and
prefix lengths that occur in the rules are candidates. Of the rules that fit a url, the longest wins.

Host list: a host is listed if rules block more than half of its pages. A url that no rule fits is blocked if its host is
listed, else allowed.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is allowed; repeated rows are
judged alike and count as pages of their own; of fitting rules that tie in length the one with fewer labels in its host wins; very long urls are
judged whole; an empty table gives no rows; no pages or no rules give no fits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import staged

#: (host, path, verdict). Fixed values of the query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Listed keys in a bucket, and the most bits of filters that are broadcast (32 MB); larger ones are joined in the shuffle.
KEYS, BROADCAST_BITS = 1 << 16, 1 << 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Cascade:
    """Exact membership in ``listed`` for all keys of ``universe`` (both: column key, without nulls).

    filters: bucket and the words of all levels. Without ``keys_per_bucket`` there is one bucket, whatever the list.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, keys_per_bucket: int | None = KEYS):
        listed = staged(listed.distinct(), "listed-keys")
        n, distinct = listed.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
        self.buckets = max(1, ceil(n / keys_per_bucket)) if keys_per_bucket else 1
        self.levels: list[tuple[int, int]] = []  # bits and hashes of each level
        parts = []
        # ``inside`` is what this level encodes; ``outside`` what it must keep out
        inside, outside, share = self._dealt(listed), self._dealt(universe), min(0.5, max(1e-9, n / (sqrt(2) * max(1, distinct))))
        while True:
            level, count = len(self.levels), inside.count()
            self.levels.append((64 * max(1, ceil(count / self.buckets * log(1 / share) / log(2) ** 2 / 64)), max(1, round(log2(1 / share)))))
            words = staged(self._words(inside, level), f"cascade-words-{level}")
            parts.append(words.select("bucket", F.lit(level).alias("level"), "words"))
            wrong = self._met(outside, words).where(self._passes(F.col("key"), F.col("words"), level)).select("key", "bucket")
            if level == 0:  # the only pass over the whole universe; what is left is a small share of it
                wrong = wrong.distinct().join(listed, "key", "left_anti")
            wrong = staged(wrong, f"cascade-{level}")
            if wrong.isEmpty():
                break
            inside, outside, share = wrong, inside, 0.5
        ordered = F.sort_array(F.collect_list(F.struct("level", "words")))
        self.filters = staged(reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.transform(ordered, lambda x: x["words"]).alias("levels")), "cascade-filters")

    def _dealt(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", self.bucket(F.col("key")).alias("bucket"))

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.buckets)).cast("int")

    def _met(self, rows: DataFrame, filters: DataFrame) -> DataFrame:
        """``rows`` with the filters of their bucket."""
        small = self.buckets * sum(bits for bits, _ in self.levels) <= BROADCAST_BITS
        return rows.join(F.broadcast(filters) if small else filters, "bucket")

    def _spots(self, key: Column, level: int) -> list[Column]:
        bits, hashes = self.levels[level]
        return [F.pmod(F.xxhash64(F.lit(level << 8 | i), key), F.lit(bits)).cast("int") for i in range(hashes)]

    def _words(self, keys: DataFrame, level: int) -> DataFrame:
        """bucket and its 64-bit words; all buckets have all words."""
        count = self.levels[level][0] // 64
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % 64)
        spots = keys.select("bucket", F.explode(F.array(*self._spots(F.col("key"), level))).alias("at")).select("bucket", F.shiftright("at", 6).alias("word"), bit.alias("bit"))
        none = keys.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("word"), F.lit(0).cast("bigint").alias("bit"))
        words = spots.unionByName(none).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        return words.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))

    def _passes(self, key: Column, words: Column, level: int) -> Column:
        hit = lambda at: F.call_function("shiftrightunsigned", F.get(words, F.shiftright(at, 6)), at % 64).bitwiseAND(F.lit(1)) == 1
        return reduce(lambda a, b: a & b, [hit(at) for at in self._spots(key, level)])

    def with_filters(self, rows: DataFrame, key: Column) -> DataFrame:
        """``rows`` with the column ``levels``, which ``contains`` reads; ``key`` decides on the bucket."""
        return self._met(rows.withColumn("bucket", self.bucket(key)), self.filters).drop("bucket")

    def contains(self, key: Column) -> Column:
        """Passed levels in a row: an odd number means listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self._passes(key, F.get(F.col("levels"), F.lit(i)), i), out).otherwise(F.lit(i % 2 == 1))
        return out


def fitted(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule and its verdict (null where no rule fits)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    labels, lengths = sorted({h.count(".") + 1 for h, _, _ in rules}), sorted({len(p) for _, p, _ in rules})
    # \n cannot be confused with a part of host or path of a rule
    candidates = [F.when((F.size(F.split("host", r"\.")) >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.lit("\n"), F.substring("path", 1, n))) for k in labels for n in lengths]
    rows = rows.withColumn("candidates", F.array_compact(F.array(*candidates)))
    listed = pages.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f"{h}\n{p}") for h, p, _ in rules])).alias("key"))
    cascade = Cascade(listed, rows.select(F.explode("candidates").alias("key")), None)
    fits = F.filter("candidates", cascade.contains)
    best = F.reduce(fits, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))
    rows = cascade.with_filters(rows, F.col("host")).withColumn("key", best)
    verdicts = F.create_map(*[F.lit(x) for h, p, v in rules for x in (f"{h}\n{p}", v)])
    return rows.select("page_id", "host", "path", F.translate("key", "\n", "").alias("rule"), F.try_element_at(verdicts, F.col("key")).alias("verdict"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, keys_per_bucket: int = KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of each url."""
    rows = staged(fitted(pages, rules), "url-rules")
    blocked = rows.groupBy("host").agg((2 * F.count_if(F.col("verdict") == "block") > F.count("*")).alias("listed"))
    cascade = Cascade(blocked.where("listed").select(F.col("host").alias("key")), rows.where("verdict IS NULL").select(F.col("host").alias("key")), keys_per_bucket)
    own = F.when(cascade.contains(F.col("host")), "block").otherwise("allow")
    return cascade.with_filters(rows, F.col("host")).select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Typed from the contract, apart from RULES.
SQL = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM s),
v AS (SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' END AS of_rule FROM f),
h AS (SELECT host FROM v GROUP BY host HAVING 2 * count(*) FILTER (WHERE of_rule = 'block') > count(*))
SELECT page_id, host, path, rule, coalesce(of_rule, CASE WHEN host IN (SELECT host FROM h) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""
