"""Evaluation: retrieval metrics, agreement rates, splitter quality, decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.windows import numbered
from ..registry import query
from ..session import staged, stored
from ..functions.queries import MASKED_SQL
from .chunking import SUPPLIED_SQL, joined_lines, supplied_ranges
from .cells import ROW_PART, exact_candidates, indexed
from .keywords import keyword_index, keyword_search, keyword_sql
from .models import CRC_SQL, HASHED_SQL, embedded
from .retrieval import K
from .tokens import tokens

_TEXTS = "dt AS (SELECT document_id AS id, content AS text FROM v_document), qt AS (SELECT item_id AS id, text FROM benchmark)"
_MODES = f"""{_TEXTS}, hw AS (SELECT w, {CRC_SQL} AS h FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM (SELECT text FROM dt UNION ALL SELECT text FROM qt))), {HASHED_SQL.format(name='de', table='dt')}, {HASHED_SQL.format(name='qe', table='qt')},
    dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rn FROM (SELECT q.id AS query_id, d.id AS document_id, round(list_cosine_similarity(q.e::DOUBLE[], d.e::DOUBLE[]), 9) AS score FROM qe q, de d) WHERE score > 0) WHERE rn <= 15),
    {keyword_sql('v_document', 'document_id', 'content', 1)}, sl AS (SELECT query_id, paragraph_id AS document_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paragraph_id) AS rn FROM x WHERE score > 0.01),
    a AS (SELECT 'dense' AS mode, query_id, document_id, rn AS rank FROM dl UNION ALL SELECT 'sparse', query_id, document_id, rn FROM sl UNION ALL SELECT 'fused', query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, document_id) FROM
      (SELECT query_id, document_id, sum(1 / (60 + rn)) AS rrf FROM (SELECT query_id, document_id, rn FROM dl UNION ALL SELECT query_id, document_id, rn FROM sl) GROUP BY 1, 2)),
    t AS (SELECT mode, q.item_id AS query_id, d.document_id AS target FROM benchmark q JOIN v_document d ON contains(d.content, q.text), (SELECT unnest(['dense', 'sparse', 'fused']) AS mode)),
    g AS (SELECT t.mode, t.query_id, target, min(rank) AS rank FROM t LEFT JOIN a ON a.mode = t.mode AND a.query_id = t.query_id AND a.document_id = target AND rank <= 5 GROUP BY 1, 2, 3),
    o AS (SELECT mode, query_id, min(rank) AS first, coalesce(sum(1.0::DOUBLE / rank), 0) / count(*) AS mrr FROM g GROUP BY 1, 2)"""
_METRICS = """count(*) AS queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall5, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS recall3,
    round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(mrr), 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS first_mrr"""


def target_ranks(hits: DataFrame, targets: DataFrame, k: int = K) -> DataFrame:
    """mode, query_id, first (rank of the first target found among the first k) and mrr (mean of 1 / rank over all targets of the query, 0 for a missing one).

    ``hits``: mode, query_id, target, rank; ``targets``: mode, query_id, target.
    """
    found = targets.join(hits.where(F.col("rank") <= k), ["mode", "query_id", "target"], "left").groupBy("mode", "query_id", "target").agg(F.min("rank").alias("rank"))
    return found.groupBy("mode", "query_id").agg(F.min("rank").alias("first"), (F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / F.count("*")).alias("mrr"))


def grounded(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, document_id, is_active of the documents that hold the whole passage (text) of a query.

    A passage is looked up as a phrase, without its first and last word, which other characters may touch; what is found is then compared character by character.
    """
    words = tokens("text")
    phrase = F.concat(F.lit('"'), F.array_join(F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(words), " "), F.lit('"'))
    near = keyword_search(keyword_index(documents, "document_id"), queries.select("query_id", phrase.alias("query")), None).select("query_id", F.col("paragraph_id").alias("document_id"))
    held = near.join(queries.select("query_id", "text"), "query_id").join(documents.select("document_id", "content", "is_active"), "document_id")
    return held.where(F.col("content").contains(F.col("text"))).select("query_id", "document_id", "is_active")


def ranked_modes(documents: DataFrame, queries: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """``target_ranks`` of the dense, the keyword and the fused mode on grounded targets.

    Documents and queries (query_id, text) are embedded by the model of models.py, so both legs find documents; the keyword leg asks ``asked`` (query_id, query). The
    targets of a query are the documents that hold its whole passage; a query without one is not counted. Each leg recalls clamp(3 k, 5, 60) documents
    (the keyword leg all above 0.01).
    """
    recall = min(60, max(5, 3 * k))
    vectors = lambda df, key: embedded(df, key, "content")
    (stored_vectors,) = stored(documents.select("document_id", "content"), "document vectors", lambda d: (staged(vectors(d, "document_id"), "document-vectors"),))
    rows = stored_vectors.select(F.col("document_id").alias("id"), F.lit(0).alias("knowledge_id"), F.col("document_id").alias("paragraph_id"), "document_id", "embedding")
    wanted = staged(vectors(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("text").alias("content")), "query_id"), "query-vectors")
    near, _ = exact_candidates(indexed(rows), wanted, recall, ROW_PART, None, 0.0)
    score = F.round("score", 9)
    ranked = lambda df: df.withColumn("rank", numbered("query_id", order=[F.desc("score"), "document_id"]))
    dense = staged(ranked(near.select("query_id", "document_id", score.alias("score")).where("score > 0")).where(F.col("rank") <= recall), "dense-leg")
    sparse = keyword_search(keyword_index(documents, "document_id"), asked.select(F.col("query_id").cast("bigint").alias("query_id"), "query"), None, 0.01)
    sparse = staged(ranked(sparse.select("query_id", F.col("paragraph_id").alias("document_id"), score.alias("score"))), "sparse-leg")
    both = dense.unionByName(sparse).groupBy("query_id", "document_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 12).alias("score"))
    legs = {"dense": dense, "sparse": sparse, "fused": ranked(both)}
    hits = [leg.where(F.col("rank") <= k).select(F.lit(mode).alias("mode"), "query_id", F.col("document_id").alias("target"), "rank") for mode, leg in legs.items()]
    targets = grounded(queries, documents).select(F.explode(F.array(*[F.lit(m) for m in legs])).alias("mode"), "query_id", F.col("document_id").alias("target"))
    return target_ranks(hits[0].unionByName(hits[1]).unionByName(hits[2]), targets, k)


def metrics() -> list:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    first = F.col("first")
    return [F.count("*").alias("queries"), share(first <= 5).alias("recall5"), share(first <= 3).alias("recall3"), share(first == 1).alias("top1"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg(F.coalesce(1 / first, F.lit(0.0))), 6).alias("first_mrr")]


@query("e01_retrieval_metrics", "v_document", "v_query_text", "v_keyword_query", sql=f"WITH {_MODES} SELECT mode, {_METRICS} FROM o GROUP BY 1")
def e01(documents: DataFrame, queries: DataFrame, asked: DataFrame) -> DataFrame:
    return ranked_modes(documents, queries, asked).groupBy("mode").agg(*metrics())


_KIND = "CASE query_id % 4 WHEN 0 THEN 'words' WHEN 1 THEN 'phrase' WHEN 2 THEN 'exclusion' ELSE 'alternatives' END"


@query("e02_metrics_by_type", "v_document", "v_query_text", "v_keyword_query", sql=f"WITH {_MODES} SELECT mode, {_KIND} AS kind, {_METRICS} FROM o GROUP BY 1, 2")
def e02(documents: DataFrame, queries: DataFrame, asked: DataFrame) -> DataFrame:
    """By what the query asks for (see v_keyword_query)."""
    return ranked_modes(documents, queries, asked).groupBy("mode", F.expr(_KIND).alias("kind")).agg(*metrics())


@query("e03_structured_baseline", "v_job", sql="""WITH q AS (SELECT job_id, department, city FROM v_job), r AS (SELECT q.job_id, j.city = q.city AS ok FROM q JOIN v_job j ON j.department = q.department AND j.job_id <> q.job_id)
    SELECT job_id, count(*) AS returned, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS condition_precision FROM r GROUP BY 1""")
def structured_baseline(jobs: DataFrame) -> DataFrame:
    """A pure filter on the department as the baseline: the share of returned rows that satisfy the second condition.

    Counts per department and city answer every asked job without pairing jobs.
    """
    cities = jobs.groupBy("department", "city").agg(F.count("*").alias("same"))
    totals = cities.groupBy("department").agg((F.sum("same") - 1).alias("returned")).where("returned > 0")
    asked = jobs.join(cities, ["department", "city"]).join(totals, "department")
    return asked.select("job_id", "returned", F.round((F.col("same") - 1) / F.col("returned"), 6).alias("condition_precision"))


@query("e04_anchor_grounding", "v_query_text", "v_document", sql="SELECT q.query_id, count(d.document_id) AS targets, coalesce(bool_or(d.is_active), false) AS active FROM v_query_text q LEFT JOIN v_document d ON contains(d.content, q.text) GROUP BY 1")
def anchor_grounding(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Anchors with the number of documents that hold their whole passage, and whether one of those is active; 0 means not grounded."""
    held = grounded(queries, documents)
    counts = held.groupBy("query_id").agg(F.count("*").alias("targets"), F.bool_or("is_active").alias("active"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("active", F.lit(False)).alias("active"))


@query("e05_latency_percentiles", "v_agent_run", sql="""SELECT agent_type, list_sort(list(duration_ms))[greatest(1, CAST(floor(0.5 * count(*)) AS INT))] AS p50, list_sort(list(duration_ms))[greatest(1, CAST(floor(0.95 * count(*)) AS INT))] AS p95, max(duration_ms) AS longest FROM v_agent_run GROUP BY 1""")
def latency_percentiles(runs: DataFrame) -> DataFrame:
    """The element with index floor(p * n) - 1 of the sorted values, found by counting per value instead of sorting all of them in one row."""
    from pyspark.sql import Window as W

    counts = runs.groupBy("agent_type", "duration_ms").agg(F.count("*").alias("c"))
    w = W.partitionBy("agent_type")
    ranked = counts.withColumns({"upto": F.sum("c").over(w.orderBy("duration_ms")), "n": F.sum("c").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(p * F.col("n"))), F.col("duration_ms")))
    return ranked.groupBy("agent_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("duration_ms").alias("longest"))


@query("e06_seeded_sample", "v_document", sql="SELECT document_id, knowledge_id FROM v_document ORDER BY md5(concat(document_id, '-7')), document_id LIMIT 100")
def seeded_sample(documents: DataFrame, seed: int = 7, n: int = 100) -> DataFrame:
    """The n rows with the least seeded digest: the same rows in every run and engine."""
    return documents.orderBy(F.md5(F.concat(F.col("document_id").cast("string"), F.lit(f"-{seed}")).cast("binary")), "document_id").limit(n).select("document_id", "knowledge_id")


@query("e07_splitter_quality", "v_resume_line", sql=f"""WITH {SUPPLIED_SQL}, k AS (SELECT document_id, n, string_agg(content, chr(10) ORDER BY position) AS t FROM v_resume_line l JOIN r USING (document_id) WHERE position BETWEEN start_line AND end_line GROUP BY 1, 2),
    c AS (SELECT document_id, string_agg(t, '' ORDER BY n) AS again, count(*) AS chunks, max(length(t)) AS longest, round(avg(length(t)), 6) AS mean_length, sum((length(m) - length(replace(m, '{T.MASK}', ''))) // {len(T.MASK)}) AS mask_hits FROM (SELECT *, {MASKED_SQL.replace('content', 't')} AS m FROM k) GROUP BY 1),
    w AS (SELECT document_id, string_agg(content, '' ORDER BY position) AS source, count(*) FILTER (WHERE regexp_matches(content, '[^{T.BLANK}]')) AS ink, count(*) FILTER (WHERE regexp_matches(content, '[^{T.BLANK}]') AND EXISTS (SELECT 1 FROM r WHERE r.document_id = l.document_id AND l.position BETWEEN start_line AND end_line)) AS inside FROM v_resume_line l GROUP BY 1)
    SELECT document_id, regexp_replace(again, '[{T.BLANK}]', '', 'g') = regexp_replace(source, '[{T.BLANK}]', '', 'g') AS verbatim, round(inside / nullif(ink, 0), 6) AS coverage, mask_hits::BIGINT AS mask_hits, chunks, longest, mean_length FROM c JOIN w USING (document_id)""")
def splitter_quality(lines: DataFrame) -> DataFrame:
    """Per document: whether the chunks joined again equal the source without white space, the share of written lines inside a range, masks applied, number and lengths of chunks."""
    ranges = supplied_ranges(lines)
    chunks = joined_lines(lines, ranges, "n").withColumn("m", T.masked("chunk"))
    bare = lambda c: F.regexp_replace(c, f"[{T.BLANK}]", "")
    text = lambda name, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, name))), lambda x: x[name]), "")
    hits = ((F.char_length("m") - F.char_length(F.replace("m", F.lit(T.MASK), F.lit("")))) / len(T.MASK)).cast("bigint")
    again = chunks.groupBy("document_id").agg(bare(text("chunk", "n")).alias("again"), F.count("*").alias("chunks"), F.max(F.char_length("chunk")).cast("bigint").alias("longest"), F.round(F.avg(F.char_length("chunk")), 6).alias("mean_length"), F.sum(hits).alias("mask_hits"))
    written = lines.where(F.col("content").rlike(f"[^{T.BLANK}]"))
    inside = written.join(ranges.select("document_id", "start_line", "end_line"), "document_id").where("position BETWEEN start_line AND end_line").select("document_id", "position").distinct().groupBy("document_id").agg(F.count("*").alias("inside"))
    whole = lines.groupBy("document_id").agg(bare(text("content", "position")).alias("source")).join(written.groupBy("document_id").agg(F.count("*").alias("ink")), "document_id", "left").join(inside, "document_id", "left")
    coverage = F.round(F.coalesce("inside", F.lit(0)) / F.col("ink"), 6)
    return again.join(whole, "document_id").select("document_id", (F.col("again") == F.col("source")).alias("verbatim"), coverage.alias("coverage"), "mask_hits", "chunks", "longest", "mean_length")


@query("e08_decision_derivation", "v_job", sql="""WITH f AS (SELECT job_id, level, [(p, least(1.0, greatest(0.0, level / 40.0 + p / 10.0)), CASE WHEN (level + p) % 4 = 0 THEN 0 ELSE least(1.0, 0.6 + 0.05 * ((level + p) % 4 - 1)) END) FOR p IN [0, 1, 2]] AS facts FROM v_job),
    s AS (SELECT job_id, CAST(round_even(100 * list_avg(list_transform(facts, lambda x: x[2] * x[3])), 0) AS BIGINT) AS score, list_bool_and(list_transform(facts, lambda x: x[3] > 0)) AS evidence_ok, level FROM f)
    SELECT job_id, score, evidence_ok, CASE WHEN NOT evidence_ok THEN 'HOLD' WHEN score >= 80 THEN 'ADVANCE' WHEN score < 48 THEN 'DECLINE' ELSE 'HOLD' END AS action FROM s""")
def decision_derivation(jobs: DataFrame, high: int = 80, low: int = 48) -> DataFrame:
    """Facts on white-listed dimensions: score = round half even(100 * mean(confidence * strength)); bands give the action."""
    dims = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for p, n in enumerate(("skills", "years", "degree", "gossip"))])
    facts = F.transform(dims, lambda d: F.struct(d["name"].alias("name"), (F.col("level") / 40.0 + d["p"] / 10.0).alias("confidence"), F.array_repeat(F.lit(0.6), ((F.col("level") + d["p"]) % 4).cast("int")).alias("relevances")))
    listed = F.filter(facts, lambda f: f["name"].isin("skills", "years", "degree"))
    rated = F.transform(listed, lambda f: F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), f["confidence"])).alias("c"), T.evidence_strength(f["relevances"]).alias("s")))
    rows = jobs.select("job_id", rated.alias("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["c"] * x["s"]) / F.size("r")
    rows = rows.select("job_id", F.bround(100 * mean, 0).cast("bigint").alias("score"), F.forall("r", lambda x: x["s"] > 0).alias("evidence_ok"))
    return rows.withColumn("action", F.when(~F.col("evidence_ok"), "HOLD").when(F.col("score") >= high, "ADVANCE").when(F.col("score") < low, "DECLINE").otherwise("HOLD"))


_JUDGED = """p AS (SELECT target, arg_max(action, id) AS action, arg_max(CASE WHEN score IS NULL THEN -1 ELSE score END, id) AS score FROM v_proposal GROUP BY 1), j AS (SELECT quality, action, CASE WHEN score < 0 THEN 'none' WHEN score >= 80 THEN 'high' WHEN score >= 48 THEN 'middle' ELSE 'low' END AS band,
    CASE WHEN quality = 1 THEN action <> 'DECLINE' ELSE action <> 'ADVANCE' END AS loose, CASE WHEN quality = 1 THEN action = 'ADVANCE' ELSE action = 'DECLINE' END AS strict FROM labels JOIN p ON target = doc_id)"""


def judged_pairs(labels: DataFrame, proposals: DataFrame, high: int = 80, low: int = 48) -> DataFrame:
    """quality, action, band, loose, strict of each labelled pair by its last proposal. Loose: no opposite decision; strict: the same decision; band none: no evidence, so no score."""
    last = proposals.groupBy(F.col("target").alias("doc_id")).agg(F.max_by(F.struct("action", "score"), "id").alias("p")).select("doc_id", "p.*")
    good, a = F.col("quality") == 1, F.col("action")
    band = F.when(F.col("score").isNull(), "none").when(F.col("score") >= high, "high").when(F.col("score") >= low, "middle").otherwise("low")
    return labels.join(last, "doc_id").select("quality", "action", band.alias("band"), F.when(good, a != "DECLINE").otherwise(a != "ADVANCE").alias("loose"), F.when(good, a == "ADVANCE").otherwise(a == "DECLINE").alias("strict"))


@query("e09_screening_agreement", "labels", "v_proposal", sql=f"""WITH {_JUDGED} SELECT quality, count(*) AS pairs, round(avg(CASE WHEN loose THEN 1.0 ELSE 0 END), 6) AS loose, round(avg(CASE WHEN strict THEN 1.0 ELSE 0 END), 6) AS strict, round(avg(CASE WHEN band = 'none' THEN 1.0 ELSE 0 END), 6) AS no_evidence FROM j GROUP BY 1""")
def screening_agreement(labels: DataFrame, proposals: DataFrame) -> DataFrame:
    """Agreement rates, each from its own flag, and the share of pairs without evidence."""
    rate = lambda yes: F.round(F.avg(F.when(yes, 1.0).otherwise(0.0)), 6)
    return judged_pairs(labels, proposals).groupBy("quality").agg(F.count("*").alias("pairs"), rate(F.col("loose")).alias("loose"), rate(F.col("strict")).alias("strict"), rate(F.col("band") == "none").alias("no_evidence"))


@query("e09b_action_matrix", "labels", "v_proposal", sql=f"WITH {_JUDGED} SELECT quality, action, band, count(*) AS pairs FROM j GROUP BY 1, 2, 3")
def action_matrix(labels: DataFrame, proposals: DataFrame) -> DataFrame:
    return judged_pairs(labels, proposals).groupBy("quality", "action", "band").agg(F.count("*").alias("pairs"))


@query("e10_pair_building", "v_job", sql="""WITH o AS (SELECT a.job_id, max_by(b.job_id, (len(list_intersect(a.skills, b.skills)), -b.job_id)) AS positive_id FROM v_job a JOIN v_job b ON a.job_id <> b.job_id AND a.department = b.department WHERE a.job_id % 20 = 0 GROUP BY 1),
    n AS (SELECT a.job_id, min(b.job_id) AS negative_id FROM v_job a JOIN v_job b ON a.job_id <> b.job_id AND len(list_intersect(a.skills, b.skills)) = 0 WHERE a.job_id % 20 = 0 GROUP BY 1) SELECT job_id, positive_id, negative_id FROM o LEFT JOIN n USING (job_id)""")
def pair_building(jobs: DataFrame) -> DataFrame:
    """For each asked job the job of the same department with the best skill overlap, and the first job of all without any common skill; lower ids first.

    Jobs are first reduced to their least two ids per department and skill set, so what is paired grows with the vocabulary, not with the jobs.
    """
    from ..operators.joins import first_disjoint

    sets = jobs.withColumn("s", F.array_sort(F.array_distinct("skills")))
    least = sets.groupBy("department", "s").agg(F.min("job_id").alias("first"))
    second = sets.join(least, ["department", "s"]).where("job_id > first").groupBy("department", "s").agg(F.min("job_id").alias("second"))
    two = least.join(second, ["department", "s"], "left").select("department", F.col("s").alias("other"), F.explode(F.array_compact(F.array("first", "second"))).alias("id"))
    asked = sets.where("job_id % 20 = 0").select("job_id", "department", "s")
    pairs = asked.select("department", "s").distinct().join(two, "department").select("department", "s", "id", F.size(F.array_intersect("s", "other")).alias("n"))
    # the best two of each set are enough: one of them may be the asked job itself
    best = pairs.withColumn("place", numbered("department", "s", order=[F.desc("n"), "id"])).where("place <= 3")
    positive = asked.join(best, ["department", "s"]).where("id <> job_id").groupBy("job_id").agg(F.min_by("id", "place").alias("positive_id"))
    return positive.join(first_disjoint(jobs), "job_id", "left").select("job_id", "positive_id", "negative_id")
