"""Keyword search over a stored posting table: groups of literals, phrases, negation, cover density.

The table is written once per corpus. A posting's impact is the number of places of its token in the paragraph; the postings of a token with one
impact are a block, and a second table holds the number of postings of each block. No paragraph can score more for a group than its rarest token's impact
allows, so the blocks of that token are read from the highest impact down: first enough of them to fill the k best, then only those whose bound reaches the k-th score.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import numbered
from ..registry import query
from ..session import ship, staged, stored
from .tokens import postings, tokens

K = 5
#: Postings that are read before the k-th score is taken as a floor, as a multiple of k; slack for rounding.
FIRST_READ, SLACK = 8, 1e-9


class KeywordIndex(NamedTuple):
    """postings: token, impact, paragraph_id, positions, sorted; blocks: token, impact, n."""

    postings: DataFrame
    blocks: DataFrame


def keyword_index(rows: DataFrame, key: str = "paragraph_id", text: str = "content") -> KeywordIndex:
    """The stored index of ``rows``, built when first asked for."""
    return KeywordIndex(*stored(rows.select(F.col(key).alias("paragraph_id"), F.col(text).alias("content")), "keywords", _build))


def _build(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = postings(rows, "paragraph_id", "content").select("token", F.size("positions").alias("impact"), "paragraph_id", "positions")
    order = ["token", F.desc("impact"), "paragraph_id"]  # a frequent token spreads over many files
    table = staged(found.repartitionByRange(*order).sortWithinPartitions(*order), "keyword-postings")
    return table, staged(table.groupBy("token", "impact").agg(F.count("*").alias("n")), "keyword-blocks")


def score_bound(impact: Column, literals: Column) -> Column:
    """No group scores more: each place of a token is in one minimal cover per literal at most, and a cover gives 0.1 at most."""
    x = 0.1 * impact * literals
    return x / (x + 1)


def cover_density(lists: list[list[int]]) -> float:
    """0.1 for each minimal cover of all terms, less for the gaps inside it; x / (x + 1) of the sum."""
    if len(lists) == 1:
        x = 0.1 * len(lists[0])
        return x / (x + 1)
    at = sorted((p, i) for i, ps in enumerate(lists) for p in ps)
    last, total, begin = {}, 0.0, -1
    for p, i in at:
        last[i] = p
        if len(last) == len(lists):
            lo = min(last.values())
            if lo > begin:
                total += 0.1 / (1 + max(0, p - lo + 1 - len(lists)))
                begin = lo
    return total / (total + 1)


def literals(queries: DataFrame) -> DataFrame:
    """query_id, grp, lit, neg, size, seq, token: a query is groups joined by OR; a group is literals that must all hold; a literal is a token or a
    phrase (in quotes, or several tokens without white space between), negated by a leading minus. A literal that is repeated in its group counts once.
    Only OR in capitals joins groups; "or" is a word, as queries are made of lower-cased words of texts.
    """
    rows = queries.select("query_id", F.regexp_extract_all("query", F.lit(r'-*"[^"]*"|[^\s"]+'), F.lit(0)).alias("parts"))
    either = lambda p: p == "OR"
    rows = rows.select("query_id", "parts", F.posexplode("parts").alias("lit", "part")).where(~either(F.col("part")))
    grp = F.size(F.filter(F.slice("parts", F.lit(1), F.col("lit") + 1), either))
    found = rows.select("query_id", grp.alias("grp"), "lit", F.col("part").startswith("-").alias("neg"), tokens("part").alias("toks")).where(F.size("toks") > 0)
    once = found.groupBy("query_id", "grp", "neg", "toks").agg(F.min("lit").alias("lit"))
    return once.select("query_id", "grp", "lit", "neg", F.size("toks").alias("size"), F.posexplode("toks").alias("seq", "token"))


def _scored(met: DataFrame, lits: DataFrame, own: DataFrame) -> DataFrame:
    """query_id, paragraph_id, score of the best group that holds. ``met``: query_id, grp, paragraph_id to look at."""
    met = met.join(lits, ["query_id", "grp"]).join(own, ["paragraph_id", "token"])
    held = met.groupBy("query_id", "grp", "lit", "neg", "size", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("seq", "positions"))).alias("l")).where(F.size("l") == F.col("size"))
    spots = F.filter(F.get("l", F.lit(0))["positions"], lambda p: F.forall("l", lambda x: F.array_contains(x["positions"], p + x["seq"])))
    held = held.withColumn("spots", spots).where(F.size("spots") > 0)
    wanted = lits.where("NOT neg").groupBy("query_id", "grp").agg(F.count_distinct("lit").alias("wanted"))
    groups = held.groupBy("query_id", "grp", "paragraph_id").agg(F.count_if(~F.col("neg")).alias("found"), F.bool_or("neg").alias("out"), F.array_sort(F.collect_list(F.when(~F.col("neg"), F.struct("lit", "spots")))).alias("l"))
    groups = groups.join(wanted, ["query_id", "grp"]).where("found = wanted AND NOT out").select("query_id", "paragraph_id", F.transform("l", lambda x: x["spots"]).alias("lists"))
    dense = F.pandas_udf(lambda s: s.map(lambda lists: cover_density([list(x) for x in lists])), "double")
    return groups.withColumn("score", dense("lists")).groupBy("query_id", "paragraph_id").agg(F.max("score").alias("score"))


def read_order(index: KeywordIndex, lits: DataFrame) -> DataFrame:
    """query_id, grp, token, impact, n, earlier (postings in blocks before), bound: the blocks of each group's rarest token."""
    mine = index.blocks.join(F.broadcast(lits.select("token").distinct()), "token", "left_semi") if lits.select("token").distinct().limit(10_001).count() <= 10_000 else index.blocks.join(lits.select("token").distinct(), "token", "left_semi")
    sizes = mine.groupBy("token").agg(F.sum("n").alias("df"))
    rare = lits.where("NOT neg").join(sizes, "token").groupBy("query_id", "grp").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.count_distinct("lit").alias("literals"))
    down = W.partitionBy("query_id", "grp").orderBy(F.desc("impact")).rowsBetween(W.unboundedPreceding, 0)
    return rare.join(mine, "token").select("query_id", "grp", "token", "impact", "n", (F.sum("n").over(down) - F.col("n")).alias("earlier"), score_bound(F.col("impact"), F.col("literals")).alias("bound"))


def keyword_search(index: KeywordIndex, queries: DataFrame, k: int | None = K, threshold: float = 0.0) -> DataFrame:
    """query_id, paragraph_id, score, rank: paragraphs for which a group of the query holds; the cover density of its best group is the score.

    ``queries``: query_id, query. A group is looked up by its rarest token, so frequent tokens are only met in paragraphs that hold the rarest. A phrase
    stands at the place of its first token. Without ``k`` all hits above the threshold are returned.
    """
    ship(index.postings.sparkSession)
    lits = staged(literals(queries), "keyword-literals")
    blocks = staged(read_order(index, lits).where(F.col("bound") + SLACK > threshold), "keyword-blocks-asked")
    own = staged(index.postings.join(lits.select("token").distinct(), "token", "left_semi"), "keyword-asked")
    places = own.select("token", "impact", "paragraph_id")
    own = own.select("token", "paragraph_id", "positions")
    met = lambda some: places.join(some.select("query_id", "grp", "token", "impact"), ["token", "impact"]).select("query_id", "grp", "paragraph_id")
    if k is None:
        scored = _scored(met(blocks), lits, own)
    else:
        first = staged(_scored(met(blocks.where(F.col("earlier") < FIRST_READ * k)), lits, own), "keyword-first")
        floor = first.withColumn("r", numbered("query_id", order=[F.desc("score")])).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
        rest = blocks.where(F.col("earlier") >= FIRST_READ * k).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
        scored = first.unionByName(_scored(met(rest), lits, own)).groupBy("query_id", "paragraph_id").agg(F.max("score").alias("score"))
    ranked = scored.where(F.col("score") > threshold).withColumn("rank", numbered("query_id", order=[F.desc(F.round("score", 12)), "paragraph_id"]))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


TOKENS_SQL = "regexp_extract_all(lower({c}), '[\\p{{Latin}}\\p{{Nd}}]+')"


def keyword_sql(table: str, key: str, text: str, factor: int = 1) -> str:
    """CTEs up to ``x`` (query_id, paragraph_id, score): all literals of all queries against the token list of every text."""
    ends = ", ".join(f"max(CASE WHEN j = {i} THEN pos END) OVER w AS m{i}" for i in range(1, 7))
    return f"""kw AS (SELECT item_id * {factor} AS query_id, item_id % 4 AS kind, {TOKENS_SQL.format(c='text')} AS w FROM benchmark), kr AS (SELECT query_id, 0 AS grp, false AS neg, unnest(list_transform(w[1:6], lambda t: [t])) AS toks FROM kw WHERE kind = 0 AND len(w) > 5
    UNION ALL SELECT query_id, 0, false, unnest([w[1:2], w[3:3]]) FROM kw WHERE kind = 1 AND len(w) > 5 UNION ALL SELECT query_id, 0, false, unnest([w[1:1], w[2:2]]) FROM kw WHERE kind = 2 AND len(w) > 5 UNION ALL SELECT query_id, 0, true, w[6:6] FROM kw WHERE kind = 2 AND len(w) > 5
    UNION ALL SELECT query_id, 0, false, unnest([w[1:1], w[2:2]]) FROM kw WHERE kind = 3 AND len(w) > 5 UNION ALL SELECT query_id, 1, false, unnest([w[3:3], w[4:4]]) FROM kw WHERE kind = 3 AND len(w) > 5),
    kl AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp, neg ORDER BY toks) AS j, count(*) OVER (PARTITION BY query_id, grp, neg) AS n FROM (SELECT DISTINCT * FROM kr)), kt AS (SELECT {key} AS pid, {TOKENS_SQL.format(c=text)} AS a FROM {table}),
    kp AS (SELECT query_id, grp, neg, j, n, pid, list_filter(range(1, len(a) + 1), lambda i: a[i] = toks[1] AND (len(toks) = 1 OR a[i + 1] = toks[2])) AS spots FROM kl JOIN kt ON list_contains(a, toks[1])),
    kg AS (SELECT query_id, grp, pid FROM kp WHERE len(spots) > 0 GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE NOT neg) = max(n) FILTER (WHERE NOT neg) AND NOT bool_or(neg)),
    ke AS (SELECT query_id, grp, pid, j, n, unnest(spots) AS pos FROM kp JOIN kg USING (query_id, grp, pid) WHERE NOT neg), km AS (SELECT *, {ends} FROM ke WINDOW w AS (PARTITION BY query_id, grp, pid ORDER BY pos, j ROWS UNBOUNDED PRECEDING)),
    kc AS (SELECT query_id, grp, pid, n, least(m1, m2, m3, m4, m5, m6) AS lo, min(pos) AS hi FROM km WHERE len(list_filter([m1, m2, m3, m4, m5, m6], lambda m: m IS NOT NULL)) = n GROUP BY ALL),
    ks AS (SELECT query_id, grp, pid, sum(0.1::DOUBLE / (1 + greatest(0, hi - lo + 1 - n))) AS x FROM kc GROUP BY 1, 2, 3), x AS (SELECT query_id, pid AS paragraph_id, max(x / (x + 1)) AS score FROM ks GROUP BY 1, 2)"""


RANKED_SQL = "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, paragraph_id) AS rank FROM x)"
_SQL = keyword_sql("v_paragraph", "paragraph_id", "content")


@query("v02_keyword_search", "v_paragraph", "v_keyword_query", sql=f"WITH {_SQL}, {RANKED_SQL} SELECT query_id, paragraph_id, round(score, 6) AS score, rank FROM k WHERE rank <= 5")
def v02(paragraphs: DataFrame, queries: DataFrame) -> DataFrame:
    return keyword_search(keyword_index(paragraphs), queries).withColumn("score", F.round("score", 6))


@query("v02b_keyword_search_all_hits", "v_paragraph", "v_keyword_query", sql=f"WITH {_SQL} SELECT query_id, paragraph_id, round(score, 6) AS score FROM x WHERE score > 0.1")
def v02b(paragraphs: DataFrame, queries: DataFrame) -> DataFrame:
    return keyword_search(keyword_index(paragraphs), queries, None, 0.1).select("query_id", "paragraph_id", F.round("score", 6).alias("score"))


@query("v22_retrieval_log", "v_paragraph", "v_keyword_query", sql=f"WITH {_SQL} SELECT query_id, length(any_value(query)) AS query_length, 5 AS k, 'phrase' AS mode, count(paragraph_id) AS hits, round(max(score), 6) AS best FROM v_keyword_query LEFT JOIN x USING (query_id) GROUP BY 1")
def retrieval_log(paragraphs: DataFrame, queries: DataFrame, k: int = K, mode: str = "phrase") -> DataFrame:
    """Length, settings, hits and best score, never the text of the query."""
    hits = keyword_search(keyword_index(paragraphs), queries, None).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))
    return queries.select("query_id", F.char_length("query").cast("bigint").alias("query_length"), F.lit(k).alias("k"), F.lit(mode).alias("mode")).join(hits, "query_id", "left").fillna(0, ["hits"])
