"""Retrieval jobs: a table of queries against a corpus in one plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import numbered
from ..registry import query
from ..session import ship, staged
from .cells import ROW_PART, exact_candidates, indexed
from .keywords import RANKED_SQL, TOKENS_SQL, keyword_index, keyword_search, keyword_sql
from .tokens import tokens

K, THRESHOLD, CAP = 5, 0.2, 500


def dense_search(rows: DataFrame, queries: DataFrame, k: int = K, threshold: float = THRESHOLD, cap: bool = True, allowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per query and knowledge base: the nearest min(10k, 500) rows, the best of each paragraph, above the threshold, the first k.

    Exact, by the stored cells of ``rows`` (see cells.py): cells that cannot hold a hit are skipped. Without ``cap`` all rows are candidates. ``allowed`` filters the
    rows; the bounds of the cells hold for any part of them.
    """
    index = indexed(rows)
    if allowed:
        index = index._replace(placed=allowed(index.placed))
    most = min(10 * k, CAP)
    near, _ = exact_candidates(index, queries, k, most if cap else k, None if cap else "paragraph_id", threshold)
    if cap:
        near = near.withColumn("n", numbered("query_id", "knowledge_id", order=[F.desc("score"), "id"])).where(F.col("n") <= most).drop("n")
    best = near.groupBy("query_id", "knowledge_id", "paragraph_id").agg(F.max_by(F.struct("document_id", "id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    best = best.select("query_id", "knowledge_id", "paragraph_id", "b.*").where(F.col("score") > threshold)
    rank = numbered("query_id", "knowledge_id", order=[F.desc("score"), "paragraph_id"])
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def merged(hits: DataFrame, k: int = K) -> DataFrame:
    """The best k of all knowledge bases per query."""
    return hits.withColumn("rank", numbered("query_id", order=[F.desc("score"), "paragraph_id", "knowledge_id"])).where(F.col("rank") <= k)


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "knowledge_id", "paragraph_id", F.round("score", 6).alias("score"), "rank")


_DENSE = """c AS (SELECT query_id, knowledge_id, id, paragraph_id, document_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM v_embedding e, v_query_vec q {where}),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, knowledge_id ORDER BY score DESC, id) AS n FROM c) WHERE n <= {cap}),
    b AS (SELECT query_id, knowledge_id, paragraph_id, any_value(document_id) AS document_id, max(score) AS score FROM n GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, knowledge_id ORDER BY score DESC, paragraph_id) AS rank FROM b WHERE score > 0.2), h AS (SELECT * FROM r WHERE rank <= 5)"""
_SHOW = "SELECT query_id, knowledge_id, paragraph_id, round(score, 6) AS score, rank FROM h"


def _dense_sql(cap: int = 50, where: str = "") -> str:
    return "WITH " + _DENSE.format(cap=cap, where=where)


@query("v01_dense_search", "v_embedding", "v_query_vec", sql=f"{_dense_sql()} {_SHOW}")
def v01(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return _out(dense_search(rows, queries))


@query("v04_exact_scan", "v_embedding", "v_query_vec", sql=f"{_dense_sql(10**9)} {_SHOW}")
def v04(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return _out(dense_search(rows, queries, cap=False))


@query("t01_two_phase_topk", "v_embedding", "v_query_vec", sql=f"{_dense_sql(20)[:-len('h AS (SELECT * FROM r WHERE rank <= 5)')]} h AS (SELECT * FROM r WHERE rank <= 2) {_SHOW}")
def t01(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return _out(dense_search(rows, queries, k=2))


_MERGED = "m AS (SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paragraph_id, knowledge_id) AS rank FROM h) WHERE rank <= 5)"
_SHOW_M = "SELECT query_id, knowledge_id, paragraph_id, round(score, 6) AS score, rank FROM m"


@query("t02_merge_knowledge_bases", "v_embedding", "v_query_vec", sql=f"{_dense_sql()}, {_MERGED} {_SHOW_M}")
def t02(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return _out(merged(dense_search(rows, queries)))


@query("v05_fan_out_with_exclusions", "v_embedding", "v_query_vec", "v_document", sql=f"{_dense_sql(where='WHERE e.is_active AND e.knowledge_id IN (1, 2, 5) AND document_id NOT IN (SELECT document_id FROM v_document WHERE NOT is_active)')}, {_MERGED} {_SHOW_M}")
def v05(rows: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    allowed = lambda r: r.where("is_active AND knowledge_id IN (1, 2, 5)").join(documents.where("NOT is_active"), "document_id", "left_anti")
    return _out(merged(dense_search(rows, queries, allowed=allowed)))


@query("v06_hit_test_report", "v_embedding", "v_query_vec", "v_document", sql=f"{_dense_sql()}, {_MERGED} SELECT query_id, rank, m.paragraph_id, d.name, d.knowledge_id AS base FROM m LEFT JOIN v_document d USING (document_id)")
def v06(rows: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    hits = merged(dense_search(rows, queries))
    return hits.join(documents.select("document_id", "name", F.col("knowledge_id").alias("base")), "document_id", "left").select("query_id", "rank", "paragraph_id", "name", "base")


def blended(dense: DataFrame, sparse: DataFrame, k: int = K) -> DataFrame:
    """Dense candidates only; a keyword score is added where there is one."""
    both = dense.select("query_id", "paragraph_id", "score").join(sparse.select("query_id", "paragraph_id", F.col("score").alias("extra")), ["query_id", "paragraph_id"], "left")
    both = both.withColumn("score", F.col("score") + F.coalesce("extra", F.lit(0.0)))
    return both.withColumn("rank", numbered("query_id", order=[F.desc("score"), "paragraph_id"])).where(F.col("rank") <= k).select("query_id", "paragraph_id", F.round("score", 6).alias("score"), "rank")


# the keyword leg over the same ids as the vectors: the document whose number a paragraph has is its text; query 20 * i asks for benchmark item i
_LEG = keyword_sql("v_document", "document_id", "content", 20)


def _leg(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, paragraph_id, score of the keyword search over whole documents."""
    return keyword_search(keyword_index(documents, "document_id"), asked.select((F.col("query_id") * 20).cast("bigint").alias("query_id"), "query"), None)


#: Terms, or rows that follow their number, that are sent to all tasks (more are joined by shuffle); words that a task remembers.
MOST_SENT, MOST_WORDS = 100_000, 200_000


def term_places(rows: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """(keys, term), possibly repeated: rows whose ``text`` contains a term of ``terms`` (column term, no white space inside).

    Such a term lies within one word, so the test runs once per distinct word of a task and term, not per text. A word meets only terms that begin with three (for
    short terms one or two) characters found in it. Terms are sent to the tasks, so no word is shuffled; where they are too many, words and terms meet by an equality join.
    """
    wanted = terms.select("term").distinct().where("term <> ''")
    known = [r["term"] for r in wanted.limit(MOST_SENT + 1).collect()]
    if len(known) > MOST_SENT:
        return _term_join(rows, keys, text, wanted)
    ship(rows.sparkSession)
    asked = rows.select(*keys, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{k}` {asked.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, words, find = {}, {}, re.compile(r"[^ \t\n\x0b\f\r]+").findall  # the white space of Spark's \s
        for n, term in enumerate(known):
            heads.setdefault(term[:3], []).append((n, term))
        names = pa.array(known, pa.string())
        for batch in batches:
            at, found = [], []
            for row, content in enumerate(batch.column(len(keys)).to_pylist()):
                held = set()
                for word in set(find(content or "")):
                    own = words.get(word)
                    if own is None:
                        if len(words) >= MOST_WORDS:
                            words.clear()
                        pieces = {word[i : i + n] for i in range(len(word)) for n in (1, 2, 3)}
                        own = words[word] = tuple(n for piece in pieces if piece in heads for n, term in heads[piece] if term in word)
                    held.update(own)
                at += [row] * len(held)
                found += held
            own = batch.select(range(len(keys))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, names.take(pa.array(found, pa.int64()))], names=[*keys, "term"])

    return asked.mapInArrow(run, f"{kinds}, term string")


def _term_join(rows: DataFrame, keys: list[str], text: str, wanted: DataFrame) -> DataFrame:
    words = rows.select(*keys, F.explode(F.array_distinct(F.split(text, r"\s"))).alias("word")).where("word <> ''")
    at = F.sequence(F.lit(1), F.char_length("word"))
    heads = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(F.col("word"), i, F.lit(n)) for n in (1, 2, 3)]))))
    match = words.select("word").distinct().select("word", F.explode(heads).alias("head")).join(wanted.withColumn("head", F.left("term", F.lit(3))), "head").where(F.col("word").contains(F.col("term"))).select("word", "term").distinct()
    return words.join(match, "word").select(*keys, "term")


def term_hits(rows: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """``term_places``, each once."""
    return term_places(rows, keys, text, terms).distinct()


@query("v03_blend", "v_embedding", "v_query_vec", "v_document", "v_keyword_query", sql=f"""{_dense_sql()}, {_LEG}, y AS (SELECT h.query_id, h.paragraph_id, h.score + coalesce(x.score, 0) AS score FROM h LEFT JOIN x USING (query_id, paragraph_id)),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paragraph_id) AS rank FROM y) SELECT query_id, paragraph_id, round(score, 6) AS score, rank FROM z WHERE rank <= 5""")
def v03(rows: DataFrame, queries: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    return blended(dense_search(rows, queries), _leg(documents, asked))


def fused(legs: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) with ranks from 1 (0-based rank + 1). Scores that differ by rounding errors only are ties."""
    ranked = [leg.select("query_id", "paragraph_id", F.lit(name).alias("leg"), "score", numbered("query_id", order=[F.desc(F.round("score", 12)), "paragraph_id"]).alias("rn")) for name, leg in zip(("dense", "sparse"), legs, strict=False)]
    both = ranked[0]
    for leg in ranked[1:]:
        both = both.unionByName(leg)
    return both.groupBy("query_id", "paragraph_id").agg(F.sum(1 / (k + F.col("rn"))).alias("rrf"), F.max(F.when(F.col("leg") == "dense", F.col("score"))).alias("dense"), F.max(F.when(F.col("leg") == "sparse", F.col("score"))).alias("sparse"))


_RRF = f"""{_LEG}, d1 AS (SELECT query_id, paragraph_id, max(score) AS score FROM h GROUP BY 1, 2), f AS (SELECT query_id, paragraph_id, sum(1 / (60 + rn)) AS rrf, max(CASE WHEN leg = 'dense' THEN score END) AS dense, max(CASE WHEN leg = 'sparse' THEN score END) AS sparse FROM (
    SELECT *, 'dense' AS leg, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, paragraph_id) AS rn FROM d1 UNION ALL SELECT *, 'sparse', row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, paragraph_id) FROM x) GROUP BY 1, 2)"""


def _fused(rows: DataFrame, queries: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    dense = dense_search(rows, queries).groupBy("query_id", "paragraph_id").agg(F.max("score").alias("score"))
    return fused([dense, _leg(documents, asked)])


@query("v07_rank_fusion", "v_embedding", "v_query_vec", "v_document", "v_keyword_query", sql=f"{_dense_sql()}, {_RRF} SELECT query_id, paragraph_id, round(rrf, 6) AS rrf, round(dense, 6) AS dense, round(sparse, 6) AS sparse FROM f")
def v07(rows: DataFrame, queries: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _fused(rows, queries, documents, asked).select("query_id", "paragraph_id", r("rrf"), r("dense"), r("sparse"))


@query("w06_rank_as_score", "v_embedding", "v_query_vec", sql=f"{_dense_sql()} SELECT query_id, knowledge_id, paragraph_id, round(1 / (60 + rank), 9) AS score FROM h")
def w06(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return dense_search(rows, queries).select("query_id", "knowledge_id", "paragraph_id", F.round(1 / (60 + F.col("rank")), 9).alias("score"))


def overlap_score(pairs: pd.DataFrame) -> pd.Series:
    """Default scorer: share of the query's words that the passage holds."""
    return pd.Series([len(set(q.split()) & set(p.split())) / max(1, len(set(q.split()))) for q, p in zip(pairs["query"], pairs["passage"], strict=True)], dtype="float64")


def reranked(hits: DataFrame, scorer=overlap_score) -> DataFrame:
    """``hits`` with columns query, passage and rrf; a scorer that fails keeps the fused order."""
    ship(hits.sparkSession)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield batch.assign(rerank=scorer(batch))
            except Exception:  # noqa: BLE001  any failure of a plugged-in model
                yield batch.assign(rerank=0.0)

    scored = hits.mapInPandas(run, f"{fields}, rerank double")
    final = F.when(F.col("rerank") > 0, F.col("rerank")).otherwise(F.col("rrf"))
    return scored.withColumn("final", final).withColumn("rank", numbered("query_id", order=[F.desc("final"), "paragraph_id"]))


@query("v08_rerank", "v_paragraph", "v_keyword_query", sql=f"""WITH {keyword_sql('v_paragraph', 'paragraph_id', 'content')}, {RANKED_SQL}, t AS (SELECT query_id, paragraph_id, 1 / (60 + rank) AS rrf, list_distinct(list_filter(regexp_split_to_array(query, '\\s+'), lambda s: s <> '')) AS q, list_distinct(regexp_split_to_array(content, '\\s+')) AS p
    FROM k JOIN v_keyword_query USING (query_id) JOIN v_paragraph USING (paragraph_id) WHERE rank <= 5), o AS (SELECT query_id, paragraph_id, rrf, len(list_intersect(q, p)) / len(q) AS s FROM t), f AS (SELECT *, CASE WHEN s > 0 THEN s ELSE rrf END AS final FROM o)
    SELECT query_id, paragraph_id, round(final, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, paragraph_id) AS rank FROM f""")
def v08(paragraphs: DataFrame, queries: DataFrame) -> DataFrame:
    hits = keyword_search(keyword_index(paragraphs), queries).withColumn("rrf", 1 / (60 + F.col("rank"))).drop("score", "rank")
    texts = hits.join(queries.select("query_id", "query"), "query_id").join(paragraphs.select("paragraph_id", F.col("content").alias("passage")), "paragraph_id")
    return reranked(texts).select("query_id", "paragraph_id", F.round("final", 6).alias("final"), "rank")


@query("v09_document_scores", "v_embedding", "v_query_vec", sql=f"{_dense_sql()} SELECT query_id, document_id, round(0.7 * max(score) + 0.3 * avg(score), 6) AS score, count(*) AS hits FROM h GROUP BY 1, 2")
def document_scores(rows: DataFrame, queries: DataFrame, weight: float = 0.0) -> DataFrame:
    """0.7 best + 0.3 mean + weight * log2(1 + hits) per document."""
    hits = dense_search(rows, queries).where("document_id IS NOT NULL")
    score = 0.7 * F.max("score") + 0.3 * F.avg("score") + weight * F.log2(1 + F.count("*"))
    return hits.groupBy("query_id", "document_id").agg(F.round(score, 6).alias("score"), F.count("*").alias("hits"))


@query("v11_sparse_query", "v_query_text", sql=f"SELECT query_id, array_to_string(list_filter({TOKENS_SQL.format(c='text')}, lambda x: length(x) > 1 AND x NOT IN ('the', 'of', 'and'))[1:6], ' ') AS terms FROM v_query_text")
def sparse_query(queries: DataFrame, most: int = 6, stop: tuple[str, ...] = ("the", "of", "and")) -> DataFrame:
    kept = F.filter(tokens("text"), lambda t: (F.char_length(t) > 1) & ~t.isin(*stop))
    return queries.select("query_id", F.array_join(F.slice(kept, 1, most), " ").alias("terms"))


@query("v12_dual_recall", "v_embedding", "v_query_vec", "v_document", "v_keyword_query", sql=f"""{_dense_sql(where='WHERE document_id NOT IN (SELECT document_id FROM v_document WHERE NOT is_active)')}, {_LEG} SELECT query_id, paragraph_id, 'dense' AS leg, round(max(score), 6) AS score FROM h GROUP BY 1, 2
    UNION ALL SELECT query_id, paragraph_id, 'sparse', round(score, 6) FROM x WHERE score > 0.01 AND paragraph_id NOT IN (SELECT document_id FROM v_document WHERE NOT is_active)""")
def dual_recall(rows: DataFrame, queries: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Both legs over active documents only, the keyword leg from 0.01 on."""
    gone = documents.where("NOT is_active").select("document_id")
    dense = dense_search(rows, queries, allowed=lambda r: r.join(gone, "document_id", "left_anti")).groupBy("query_id", "paragraph_id").agg(F.round(F.max("score"), 6).alias("score"))
    sparse = _leg(documents, asked).where("score > 0.01").join(gone.select(F.col("document_id").alias("paragraph_id")), "paragraph_id", "left_anti")
    return dense.select("query_id", "paragraph_id", F.lit("dense").alias("leg"), "score").unionByName(sparse.select("query_id", "paragraph_id", F.lit("sparse").alias("leg"), F.round("score", 6).alias("score")))


_SKILLED = """q AS (SELECT job_id, i - 1 AS i, skills[i] AS skill FROM (SELECT job_id, skills, unnest(range(1, len(skills) + 1)) AS i FROM v_job WHERE job_id % 20 = 0)), t AS (SELECT DISTINCT skill FROM q), w AS (SELECT DISTINCT document_id, unnest(regexp_split_to_array(lower(content), '\\s')) AS word FROM v_document),
    m AS (SELECT DISTINCT document_id, skill FROM w JOIN t ON contains(word, skill)), d AS (SELECT query_id, document_id, max(s) AS score, arg_max(paragraph_id, (s, -paragraph_id)) AS paragraph_id FROM (SELECT q.query_id, e.document_id, e.paragraph_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM v_embedding e, v_query_vec q) GROUP BY 1, 2),
    c AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM d), n AS (SELECT query_id, document_id, score, paragraph_id FROM c WHERE score >= greatest(0.2, 0.75 * top)),
    h AS (SELECT job_id, i, document_id, 0.0::DOUBLE AS score, NULL AS paragraph_id FROM q JOIN m USING (skill) UNION ALL SELECT job_id, i, document_id, score, paragraph_id FROM q JOIN n ON query_id = (job_id + i * 20) % 400)"""


class Skilled(NamedTuple):
    """classes: class, skills, at (job modulo 400), jobs of one class have the same answer; jobs: job_id, class; held: document_id, terms; close: class, document_id, is (places of the
    skills whose vectors come near), score, paragraph_id."""

    classes: DataFrame
    jobs: DataFrame
    held: DataFrame
    close: DataFrame


def skill_hits(documents: DataFrame, jobs: DataFrame, rows: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, relative: float = 0.75) -> Skilled:
    """Documents by the ordered skills of each asked job, in text and by vector.

    Hits are documents whose text has the skill (score 0), and those whose vectors come near enough to the skill's: at least the threshold and ``relative`` times
    its best. The vector of skill i of job j is query (j + 20 i) mod 400, so jobs with the same skills and remainder are answered once.
    """
    asked = jobs.where("job_id % 20 = 0 AND size(skills) > 0").select("job_id", "skills", (F.col("job_id") % 400).alias("at"))
    classes = staged(asked.groupBy("skills", "at").agg(F.min("job_id").alias("class")), "skill-classes")
    each = classes.select("class", "at", F.posexplode("skills").alias("i", "term"))
    held = term_hits(documents.select("document_id", F.lower("content").alias("t")), ["document_id"], "t", each)
    held = staged(held.groupBy("document_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "skills-held")
    wanted = each.select("class", "i", ((F.col("at") + F.col("i") * 20) % 400).alias("query_id"))
    index = indexed(rows.withColumn("knowledge_id", F.lit(0)))
    near, _ = exact_candidates(index, queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi"), 1, ROW_PART, "document_id", threshold, "document_id", relative)
    near = staged(near.groupBy("query_id", "document_id").agg(F.max("score").alias("score"), F.max_by("paragraph_id", F.struct("score", -F.col("paragraph_id"))).alias("paragraph_id")), "skills-near")
    best = near.groupBy("query_id").agg(F.max("score").alias("top"))
    close = near.join(best, "query_id").where(F.col("score") >= F.greatest(F.lit(threshold), relative * F.col("top"))).drop("top")
    close = wanted.join(close, "query_id").groupBy("class", "document_id").agg(F.collect_set("i").alias("is"), F.max("score").alias("score"), F.max_by("paragraph_id", F.struct("score", -F.col("paragraph_id"))).alias("paragraph_id"))
    return Skilled(classes, asked.join(classes, ["skills", "at"]).select("job_id", "class"), held, close)


def by_text(found: Skilled, order: Callable[[str, str], Column], limit: int) -> DataFrame:
    """class, document_id, worth: the first ``limit`` documents that hold a skill of the class, by ``order`` of its skills and the document's terms.

    Documents that hold the same terms are alike, so only the first ones of each set of terms meet the distinct lists of skills.
    """
    few = found.held.withColumn("n", numbered("terms", order=["document_id"])).where(F.col("n") <= limit).drop("n")
    lists = found.classes.select("skills").distinct()
    sets = few.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
    met = lists.select("skills", F.explode(F.array_distinct("skills")).alias("term")).join(sets, "term").select("skills", "terms").distinct().withColumn("worth", order("skills", "terms"))
    first = met.join(few, "terms").withColumn("n", numbered("skills", order=[F.desc("worth"), "document_id"])).where(F.col("n") <= limit)
    return first.join(found.classes, "skills").select("class", "document_id", "worth")


@query("v13_skill_and", "v_document", "v_job", "v_embedding", "v_query_vec", sql=f"""WITH {_SKILLED}, g AS (SELECT job_id, document_id, list(DISTINCT i) AS s, max(score) AS score, arg_max(paragraph_id, (score, -paragraph_id)) AS paragraph_id FROM h GROUP BY 1, 2), z AS (SELECT job_id, max(i) AS last FROM q GROUP BY 1),
    b AS (SELECT job_id, document_id, paragraph_id, array_to_string(list_transform(range(0, last + 1), lambda x: CASE WHEN list_contains(s, x) THEN 1 ELSE 0 END), '') AS bits, score FROM g JOIN z USING (job_id))
    SELECT job_id, document_id, paragraph_id, bits, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY paragraph_id IS NULL, bits DESC, round(score, 9) DESC, document_id) AS rank FROM b) WHERE rank <= 20""")
def skill_and(documents: DataFrame, jobs: DataFrame, rows: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Ordered skills of each asked job as a bit vector per document, by text or by vector: earlier skills weigh more, then the best score.

    A document that a vector found stands with its best paragraph; places that are left go to documents found by their text alone.
    """
    found = skill_hits(documents, jobs, rows, queries)
    bits = lambda skills, terms: F.transform(skills, lambda s: F.array_contains(terms, s).cast("int"))
    # the first ``limit`` by text are enough: of these, only documents that a vector found, too, are left out, and they stand before
    text = by_text(found, bits, limit).join(found.close, ["class", "document_id"], "left_anti").select("class", "document_id", F.lit(None).cast("bigint").alias("paragraph_id"), F.col("worth").alias("bits"), F.lit(0.0).alias("score"))
    both = F.transform("skills", lambda s, i: (F.array_contains("is", i) | F.coalesce(F.array_contains("terms", s), F.lit(False))).cast("int"))
    close = found.close.join(found.held, "document_id", "left").join(found.classes, "class").select("class", "document_id", "paragraph_id", both.alias("bits"), "score")
    ranked = text.unionByName(close).withColumn("rank", numbered("class", order=[F.col("paragraph_id").isNull(), F.desc("bits"), F.desc(F.round("score", 9)), "document_id"])).where(F.col("rank") <= limit)
    return found.jobs.join(ranked, "class").select("job_id", "document_id", "paragraph_id", F.array_join("bits", "").alias("bits"), F.round("score", 6).alias("score"), "rank")


@query("v17_direct_return", "v_embedding", "v_query_vec", sql=f"{_dense_sql()}, {_MERGED}, d AS (SELECT query_id, max(CASE WHEN document_id % 2 = 0 THEN score END) >= 0.5 AS direct FROM m GROUP BY 1), o AS (SELECT m.*, direct, row_number() OVER (PARTITION BY m.query_id ORDER BY CASE WHEN document_id % 2 = 0 THEN score END DESC NULLS LAST, paragraph_id) AS best FROM m JOIN d USING (query_id)) SELECT query_id, paragraph_id FROM o WHERE NOT coalesce(direct, false) OR best = 1")
def direct_return(rows: DataFrame, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents with even ids return directly: when one of their hits reaches the threshold only the best stays."""
    own = F.when(F.col("document_id") % 2 == 0, F.col("score"))
    hits = merged(dense_search(rows, queries)).withColumns({"own": own, "direct": F.max(own).over(W.partitionBy("query_id")) >= threshold, "best": numbered("query_id", order=[F.desc_nulls_last(own), "paragraph_id"])})
    return hits.where(~F.coalesce("direct", F.lit(False)) | (F.col("best") == 1)).select("query_id", "paragraph_id")


@query("v18_prompt_context", "v_paragraph", sql="""WITH r AS (SELECT document_id, content, position, coalesce(sum(length(content)) OVER (PARTITION BY document_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM v_paragraph)
    SELECT document_id, 'Context: ' || string_agg(substring(content, 1, CAST(800 - used AS INT)), chr(10) ORDER BY position) AS prompt FROM r WHERE used < 800 GROUP BY 1""")
def prompt_context(paragraphs: DataFrame, budget: int = 800) -> DataFrame:
    from ..operators.windows import character_budget

    cut = character_budget(paragraphs, budget).join(paragraphs.select("paragraph_id", "document_id", "position"), "paragraph_id")
    nested = cut.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("l"))
    return nested.select("document_id", F.replace(F.lit("Context: {data}"), F.lit("{data}"), F.array_join(F.transform("l", lambda x: x["content"]), "\n")).alias("prompt"))


@query("v19_job_candidate_match", "v_document", "v_job", "v_embedding", "v_query_vec", sql=f"""WITH {_SKILLED}, k AS (SELECT job_id, document_id, 2 * count(DISTINCT skill) AS points, 0.0::DOUBLE AS score FROM (SELECT DISTINCT job_id, skill FROM q) JOIN m USING (skill) GROUP BY 1, 2),
    e AS (SELECT job_id, document_id, CAST(least(2, greatest(1, round_even(6 * max(score), 0))) AS BIGINT) AS points, max(score) AS score FROM q JOIN n ON query_id = (job_id + i * 20) % 400 WHERE (job_id, document_id) NOT IN (SELECT (job_id, document_id) FROM k) GROUP BY 1, 2), u AS (SELECT *, 'text' AS kind FROM k UNION ALL SELECT *, 'semantic' FROM e)
    SELECT job_id, document_id, points, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY points DESC, round(score, 9) DESC, document_id) AS rank FROM u) WHERE rank <= 10""")
def job_candidate_match(documents: DataFrame, jobs: DataFrame, rows: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Two points for each required skill found in the text; documents that have none but come near get one or two for it."""
    found = skill_hits(documents, jobs, rows, queries)
    points = lambda skills, terms: (2 * F.size(F.array_intersect(skills, terms))).cast("bigint")
    text = by_text(found, points, limit).select("class", "document_id", F.col("worth").alias("points"), F.lit(0.0).alias("score"), F.lit("text").alias("kind"))
    close = found.close.join(found.held, "document_id", "left").join(found.classes, "class").where(~F.coalesce(F.arrays_overlap("skills", "terms"), F.lit(False)))
    extra = close.select("class", "document_id", F.least(F.lit(2), F.greatest(F.lit(1), F.bround(6 * F.col("score"), 0))).cast("bigint").alias("points"), "score", F.lit("semantic").alias("kind"))
    ranked = text.unionByName(extra).withColumn("rank", numbered("class", order=[F.desc("points"), F.desc(F.round("score", 9)), "document_id"])).where(F.col("rank") <= limit)
    return found.jobs.join(ranked, "class").select("job_id", "document_id", "points", "kind", "rank")


@query("v24_reask_exclusion", "conversations", "v_paragraph", sql="""SELECT c.conv_id, c.turn, p.paragraph_id FROM conversations c JOIN v_paragraph p ON p.document_id = c.conv_id WHERE c.role = 'user' AND p.position <= 3
    AND NOT (p.position <= 2 AND EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'user' AND o.turn < c.turn AND o.text = c.text))""")
def reask_exclusion(turns: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs shown before (the first two) for the same question of a conversation are left out when it is asked again."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    again = F.row_number().over(W.partitionBy("conv_id", "text").orderBy("turn")) > 1
    offered = asked.withColumn("again", again).join(paragraphs.where("position <= 3").select(F.col("document_id").alias("conv_id"), "paragraph_id", "position"), "conv_id")
    return offered.where("NOT (again AND position <= 2)").select("conv_id", "turn", "paragraph_id")
