"""Quality rules with adaptive thresholds: one mergeable quantile sketch per language, source and measure.

The sketch is a count of rows per level, the levels being whole numbers of six significant bits (so within 3 % of the value, at any
size): sketches merge by adding counts, grow with the logarithm of the values only, and give quantiles that do not depend on partitions or task
order. It holds the rows that pass the base rules. A fence lies some spreads above a quantile of the sketch, a spread being the distance of that quantile from a
lower one. Measures in which up to a fourth of the rows may be junk (symbols, words without blanks) use the quartiles; measures with a long tail of sound
texts (repeated lines, repeated windows, capitals), whose quartiles are mostly 0, use the 0.99 and 0.9 quantiles. A spread is no less than what
EVENTS harmless occurrences make in a short text of the same group (one of lower-quartile size), and this least spread no more than LEAST, so it cannot pass what a
share can be. The fence of a language is drawn towards that of all rows, and the fence of a language and source towards that of its language, with the
weight of SHRINK rows, so small groups lean on larger ones without a switch. Rows are then judged by joining the fences on language
and source.

The base rules come first (fewer than 50 words, or over half of the words inside repeated three-word windows).

Defined cases: a null or empty text has no words and fails the base rules; null lang and source are groups of
their own; long texts are measured whole; repeated rows are judged alike and count as rows of their own; a value that ties with a fence is kept; an empty table gives no rows; other
columns are ignored by ``op1`` and kept by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import SPACE, documents, staged

#: Harmless occurrences, the most that they make up of a spread, rows that the wider group weighs, and the most fence rows that are broadcast.
EVENTS, LEAST, SHRINK, BROADCAST_ROWS = 2, 100, 200, 200_000
#: Lower and upper quantile (per mille), and tenths of spreads above the upper one.
QUARTILES, TAIL = (250, 750, 50), (900, 990, 5)
#: Measure: count, size of the text it is related to, scale, what one harmless occurrence adds to the count, and quantiles.
MEASURES = {
    "symbols": ("n_symbols", "chars", 1000, 1, QUARTILES), "dup_lines": ("n_dup_lines", "lines", 1000, 1, TAIL), "repeats": ("n_repeat_words", "words", 1000, 5, TAIL),
    "long_words": ("word_chars", "words", 50, 5, QUARTILES), "capitals": ("n_capitals", "chars", 1000, 1, TAIL),
}
SIZES = {"chars": "word_chars", "words": "n_words", "lines": "n_lines"}


def measured(docs: DataFrame) -> DataFrame:
    """Struct ``doc`` of all columns of ``docs`` with the counts of the base rules and the measures, each once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("t"), words.alias("w"), lines.alias("l"))
    # Windows are sorted as (hash << b) + position, b bits for the position: plain longs, so the sort is fast. Equal
    # windows become neighbours; where neighbours share a hash and differ in words, the words themselves are sorted.
    n = F.size("w")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: [F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)]
    call = F.call_function
    cut = cut.withColumns({"at": at, "b": F.length(F.bin(n))})
    cut = cut.withColumn("h", F.transform("at", lambda i: call("shiftleft", F.xxhash64(*word(i)), F.col("b")) + i))
    cut = cut.withColumn("s", F.sort_array("h"))
    high = lambda i: call("shiftright", F.get("s", i), F.col("b"))
    place = lambda i: (F.get("s", i) - call("shiftleft", high(i), F.col("b"))).cast("int")
    cut = cut.withColumn("twins", F.filter("at", lambda i: F.coalesce(high(i) == high(i + 1), F.lit(False))))
    clash = F.exists("twins", lambda i: F.struct(*word(place(i))) != F.struct(*word(place(i + 1))))
    cut = cut.withColumn("p", F.flatten(F.transform("twins", lambda i: F.array(place(i), place(i + 1)))))
    exact = F.sort_array(F.transform("at", lambda i: F.struct(F.struct(*[x.alias(k) for k, x in zip("abc", word(i), strict=True)]).alias("g"), i.alias("i"))))
    cut = cut.withColumn("e", F.when((F.size("twins") > 0) & clash, exact))
    same = lambda i: F.coalesce(F.get("e", i)["g"] == F.get("e", i + 1)["g"], F.lit(False))
    slow = F.flatten(F.transform(F.filter("at", same), lambda i: F.array(F.get("e", i)["i"], F.get("e", i + 1)["i"])))
    cut = cut.withColumn("p", F.when(F.col("e").isNotNull(), slow).otherwise(F.col("p")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2)))))
    counts = cut.select(
        "doc", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    ratio = lambda k: F.coalesce(F.expr(f"({MEASURES[k][0]} * {MEASURES[k][2]}) DIV nullif({SIZES[MEASURES[k][1]]}, 0)"), F.lit(0)).cast("long")
    return counts.select(
        "*", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.struct(*[ratio(k).alias(k) for k in MEASURES], *[F.col(v).alias(k) for k, v in SIZES.items()]).alias("m"),
    )


def _group(name: str) -> Column:
    """A join key that holds null apart from every text."""
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name)))


def level(value: Column) -> Column:
    """The value cut to its six leading bits."""
    return value - value % F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), F.length(F.bin(value)) - 6))


def fences(rows: DataFrame) -> DataFrame:
    """g_lang, g_source and the fence of each measure. ``rows``: g_lang, g_source and struct m of the rows that count."""
    names = [*MEASURES, *SIZES]
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[level(F.col(f"m.{k}")) for k in names])))
    sketch = rows.select("g_lang", "g_source", pairs.alias("measure", "value")).groupBy("g_lang", "g_source", "measure", "value").agg(F.count("*").alias("n"))
    sketch = staged(sketch, "quality-sketch")

    def fence(keys: list[str]) -> DataFrame:
        """n and the fences of the sketches merged by ``keys``."""
        merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure")
        ranked = merged.select(*keys, "measure", "value", F.sum("n").over(w.orderBy("value")).alias("upto"), F.sum("n").over(w).alias("total"))
        at = lambda k, share: F.min(F.when((F.col("measure") == k) & (1000 * F.col("upto") >= share * F.col("total")), F.col("value")))
        wide = ranked.groupBy(*keys).agg(
            F.max("total").alias("n"), *[at(k, 250).alias(f"low_{k}") for k in SIZES], *[at(k, m[4][0]).alias(f"low_{k}") for k, m in MEASURES.items()], *[at(k, m[4][1]).alias(f"high_{k}") for k, m in MEASURES.items()]
        )
        least = lambda k: f"least({LEAST}, {EVENTS * MEASURES[k][2] * MEASURES[k][3]} DIV greatest(1, low_{MEASURES[k][1]}))"
        return wide.select(*keys, "n", *[F.expr(f"high_{k} + ({MEASURES[k][4][2]} * greatest(high_{k} - low_{k}, {least(k)})) DIV 10").alias(k) for k in MEASURES])

    drawn = lambda own, wider: F.expr(f"(n * {own} + {SHRINK} * {wider}) DIV (n + {SHRINK})")
    every = fence([]).first()  # one row of numbers
    if every is None:
        every = dict.fromkeys(MEASURES)
    langs = fence(["g_lang"]).select("g_lang", *[drawn(k, "null" if every[k] is None else every[k]).alias(f"lang_{k}") for k in MEASURES])
    return fence(["g_lang", "g_source"]).join(langs, "g_lang").select("g_lang", "g_source", *[drawn(k, f"lang_{k}").alias(f"fence_{k}") for k in MEASURES])


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``measured``, stored, with the fences of their group and ``kept``."""
    keyed = rows.withColumns({"g_lang": _group("doc.lang"), "g_source": _group("doc.source")})
    limits = staged(fences(keyed.where("NOT base_failed").select("g_lang", "g_source", "m")), "quality-fences")
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # beyond it, a shuffled join that Spark may split
        limits = F.broadcast(limits)
    fine = [F.col(f"m.{k}") <= F.col(f"fence_{k}") for k in MEASURES]
    kept = ~F.col("base_failed")
    for x in fine:
        kept = kept & x
    # groups without a row that passes the base rules have no fences
    return keyed.join(limits, ["g_lang", "g_source"], "left").withColumn("kept", F.coalesce(kept, F.lit(False)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return judged(staged(measured(docs), "quality-measures", compression="zstd")).where("kept").select("doc.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    rows = measured(docs).withColumn("doc", F.struct("doc.doc_id", "doc.lang", "doc.source"))
    return judged(staged(rows, "quality-measures")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[F.col(f"m.{k}").alias(k) for k in MEASURES], *[f"fence_{k}" for k in MEASURES],
    )


#: The same rows in DuckDB SQL.
SQL = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars AS chars, n_words AS words, n_lines AS lines, {ratios} FROM b),
p AS (SELECT lang, source, {names} FROM m WHERE NOT base_failed),
u AS (SELECT lang, source, measure, value - value % (1::BIGINT << greatest(0, length(bin(value)) - 6)) AS value FROM (UNPIVOT p ON {names} INTO NAME measure VALUE value)),
t AS (SELECT lang, source, 2 AS depth, measure, value FROM u UNION ALL SELECT lang, NULL, 1, measure, value FROM u UNION ALL SELECT NULL, NULL, 0, measure, value FROM u),
q AS (SELECT lang, source, depth, measure, count(*) AS n, quantile_disc(value, 0.25) AS small, quantile_disc(value, [0.25, 0.75]) AS quartiles, quantile_disc(value, [0.9, 0.99]) AS tail FROM t GROUP BY ALL),
v AS (SELECT a.lang, a.source, a.depth, a.measure, a.n, CASE WHEN e.tailed THEN a.tail[2] + 5 * greatest(a.tail[2] - a.tail[1], least({least_spread}, e.least // greatest(1, z.small))) // 10
    ELSE a.quartiles[2] + 5 * greatest(a.quartiles[2] - a.quartiles[1], least({least_spread}, e.least // greatest(1, z.small))) END AS fence
  FROM q a JOIN (VALUES {least}) e(measure, size, least, tailed) USING (measure)
  JOIN q z ON z.measure = e.size AND z.depth = a.depth AND z.lang IS NOT DISTINCT FROM a.lang AND z.source IS NOT DISTINCT FROM a.source),
lf AS (SELECT v.lang, v.measure, (v.n * v.fence + {shrink} * a.fence) // (v.n + {shrink}) AS fence FROM v JOIN v a ON v.depth = 1 AND a.depth = 0 AND a.measure = v.measure),
f AS (SELECT v.lang, v.source, v.measure, (v.n * v.fence + {shrink} * lf.fence) // (v.n + {shrink}) AS fence
  FROM v JOIN lf ON v.depth = 2 AND lf.measure = v.measure AND lf.lang IS NOT DISTINCT FROM v.lang),
x AS (SELECT lang, source, {fences} FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {fine}, false) AS kept, {measures}, {limits}
FROM m LEFT JOIN x ON m.lang IS NOT DISTINCT FROM x.lang AND m.source IS NOT DISTINCT FROM x.source
""".format(
    least_spread=LEAST, shrink=SHRINK, names=", ".join([*MEASURES, *SIZES]), measures=", ".join(MEASURES), limits=", ".join(f"fence_{k}" for k in MEASURES),
    ratios=", ".join(f"coalesce({c} * {scale} // nullif({SIZES[size]}, 0), 0)::BIGINT AS {k}" for k, (c, size, scale, *_) in MEASURES.items()),
    least=", ".join(f"('{k}', '{size}', {EVENTS * scale * harmless}, {quantiles is TAIL})" for k, (_, size, scale, harmless, quantiles) in MEASURES.items()),
    fences=", ".join(f"max(fence) FILTER (WHERE measure = '{k}')::BIGINT AS fence_{k}" for k in MEASURES), fine=" AND ".join(f"{k} <= fence_{k}" for k in MEASURES),
)
