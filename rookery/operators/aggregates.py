"""Aggregations: usage trends, rankings, feedback and inventory statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .windows import global_numbers

def tokens() -> Column:
    return F.col("message_tokens") + F.col("answer_tokens")


@query("a01_daily_trend", "v_usage", sql="""SELECT CAST(create_time AS DATE) AS day, sum(CASE WHEN vote_status = 0 THEN 1 ELSE 0 END)::BIGINT AS star_num,
    sum(CASE WHEN vote_status = 1 THEN 1 ELSE 0 END)::BIGINT AS trample_num, sum(message_tokens + answer_tokens)::BIGINT AS tokens, count(*) AS records,
    count(DISTINCT chat_user_id) AS users FROM v_usage GROUP BY 1""")
def daily_trend(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("create_time").alias("day")).agg(
        F.count_if(F.col("vote_status") == 0).alias("star_num"), F.count_if(F.col("vote_status") == 1).alias("trample_num"),
        F.sum(tokens()).alias("tokens"), F.count("*").alias("records"), F.count_distinct("chat_user_id").alias("users"))


_FIRST = "SELECT chat_user_id, min(CAST(create_time AS DATE)) AS day FROM v_usage WHERE chat_user_id IS NOT NULL GROUP BY 1"


@query("a02_daily_new_users", "v_usage", sql=f"SELECT day, count(*) AS new_users FROM ({_FIRST}) GROUP BY 1")
def daily_new_users(usage: DataFrame) -> DataFrame:
    first = usage.where("chat_user_id IS NOT NULL").groupBy("chat_user_id").agg(F.min(F.to_date("create_time")).alias("day"))
    return first.groupBy("day").agg(F.count("*").alias("new_users"))


@query("a03_trend_with_gaps_filled", "v_usage", sql=f"""WITH b AS (SELECT min(CAST(create_time AS DATE)) - 2 AS lo, max(CAST(create_time AS DATE)) + 2 AS hi FROM v_usage),
    s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
    r AS (SELECT CAST(create_time AS DATE) AS day, count(*) AS records FROM v_usage GROUP BY 1), n AS (SELECT day, count(*) AS c FROM ({_FIRST}) GROUP BY 1)
    SELECT s.day, coalesce(records, 0) AS records, coalesce(c, 0) AS new_users FROM s LEFT JOIN r USING (day) LEFT JOIN n USING (day)""")
def trend_with_gaps(usage: DataFrame, margin: int = 2) -> DataFrame:
    """One row per calendar day; each side has its own zero default."""
    days = usage.agg(F.min(F.to_date("create_time")).alias("lo"), F.max(F.to_date("create_time")).alias("hi"))
    spine = days.select(F.explode(F.sequence(F.date_sub("lo", margin), F.date_add("hi", margin))).alias("day"))
    records = daily_trend(usage).select("day", "records")
    return spine.join(records, "day", "left").join(daily_new_users(usage), "day", "left").fillna(0, ["records", "new_users"])


@query("a04_tokens_per_user", "v_usage", sql="""SELECT chat_user_id, max(coalesce(asker, 'guest')) AS label, sum(message_tokens + answer_tokens)::BIGINT AS tokens FROM v_usage GROUP BY 1""")
def tokens_per_user(usage: DataFrame) -> DataFrame:
    return usage.groupBy("chat_user_id").agg(F.max(F.coalesce("asker", F.lit("guest"))).alias("label"), F.sum(tokens()).alias("tokens")).orderBy(F.desc("tokens"), "chat_user_id")


@query("a05_questions_per_user", "v_usage", sql="SELECT chat_user_id, max(coalesce(asker, 'guest')) AS label, count(*) AS questions FROM v_usage GROUP BY 1")
def questions_per_user(usage: DataFrame) -> DataFrame:
    return usage.groupBy("chat_user_id").agg(F.max(F.coalesce("asker", F.lit("guest"))).alias("label"), F.count("*").alias("questions")).orderBy(F.desc("questions"), "label")


@query("a06_conversation_counters", "v_usage", sql="""SELECT chat_id, count(*) AS records, count(*) FILTER (vote_status = 0) AS star_num, count(*) FILTER (vote_status = 1) AS trample_num,
    sum(CASE WHEN id % 3 = 0 THEN id % 4 ELSE 0 END)::BIGINT AS marked FROM v_usage GROUP BY 1""")
def conversation_counters(usage: DataFrame) -> DataFrame:
    """Marked paragraphs are an array column (null for two records of three)."""
    marks = F.when(F.col("id") % 3 == 0, F.array_repeat("id", (F.col("id") % 4).cast("int")))
    return usage.groupBy("chat_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("vote_status") == 0).alias("star_num"), F.count_if(F.col("vote_status") == 1).alias("trample_num"),
        F.sum(F.coalesce(F.when(marks.isNotNull(), F.size(marks)), F.lit(0))).alias("marked"))


@query("a07_user_token_ranking", "v_usage", sql="""WITH l AS (SELECT chat_user_id, chat_user_type, coalesce(asker, 'guest') AS label FROM (SELECT *, row_number() OVER (PARTITION BY chat_user_id, chat_user_type ORDER BY create_time DESC, id DESC) AS k FROM v_usage WHERE chat_user_id IS NOT NULL) WHERE k = 1),
    t AS (SELECT chat_user_id, chat_user_type, sum(message_tokens + answer_tokens)::BIGINT AS tokens, count(DISTINCT id) AS records FROM v_usage WHERE chat_user_id IS NOT NULL GROUP BY 1, 2)
    SELECT t.*, label FROM t JOIN l USING (chat_user_id, chat_user_type)""")
def user_token_ranking(usage: DataFrame) -> DataFrame:
    known = usage.where("chat_user_id IS NOT NULL")
    return known.groupBy("chat_user_id", "chat_user_type").agg(
        F.sum(tokens()).alias("tokens"), F.count_distinct("id").alias("records"),
        F.max_by(F.coalesce("asker", F.lit("guest")), F.struct("create_time", "id")).alias("label"))


_APPS = "SELECT CAST(p_partkey AS BIGINT) AS application_id FROM part"


@query("a08_application_question_ranking", "v_usage", "part", sql=f"""SELECT a.application_id, count(u.id) AS records, count(DISTINCT chat_user_id) AS users
    FROM ({_APPS}) a LEFT JOIN v_usage u USING (application_id) GROUP BY 1""")
def application_question_ranking(usage: DataFrame, apps: DataFrame) -> DataFrame:
    """Applications without records stay with zeros."""
    counts = usage.groupBy("application_id").agg(F.count("*").alias("records"), F.count_distinct("chat_user_id").alias("users"))
    return apps.select(F.col("p_partkey").alias("application_id")).join(counts, "application_id", "left").fillna(0, ["records", "users"])


@query("a09_application_token_ranking", "v_usage", "part", sql=f"""SELECT a.application_id, coalesce(sum(message_tokens + answer_tokens), 0)::BIGINT AS tokens, count(u.id) AS records
    FROM ({_APPS}) a LEFT JOIN v_usage u USING (application_id) GROUP BY 1""")
def application_token_ranking(usage: DataFrame, apps: DataFrame) -> DataFrame:
    sums = usage.groupBy("application_id").agg(F.sum(tokens()).alias("tokens"), F.count("*").alias("records"))
    return apps.select(F.col("p_partkey").alias("application_id")).join(sums, "application_id", "left").fillna(0, ["tokens", "records"])


@query("a10_ranking_export", "v_usage", sql="""WITH t AS (SELECT application_id, sum(message_tokens + answer_tokens)::BIGINT AS tokens, count(*) AS records FROM v_usage GROUP BY 1),
    g AS (SELECT sum(tokens) AS total FROM t)
    SELECT row_number() OVER (ORDER BY tokens DESC, application_id) AS rank, application_id, tokens, records, round(CASE WHEN total > 0 THEN tokens / total ELSE 0 END, 6) AS share,
    round(CASE WHEN records > 0 THEN tokens / records ELSE 0 END, 6) AS per_record FROM t, g""")
def ranking_export(usage: DataFrame) -> DataFrame:
    """Rank, share of the overall total and mean per record; applications are few, records are aggregated first."""
    sums = usage.groupBy("application_id").agg(F.sum(tokens()).alias("tokens"), F.count("*").alias("records"))
    ranked = global_numbers(sums, [F.desc("tokens"), "application_id"], "place")
    total = ranked.agg(F.sum("tokens")).first()[0] or 0
    return ranked.select(
        (F.col("place") + 1).alias("rank"), "application_id", "tokens", "records", F.round(F.col("tokens") / total if total > 0 else F.lit(0.0), 6).alias("share"),
        F.round(F.when(F.col("records") > 0, F.col("tokens") / F.col("records")).otherwise(0.0), 6).alias("per_record"))


@query("a11_window_totals", "v_usage", sql="""SELECT count(*) AS records, coalesce(sum(message_tokens + answer_tokens), 0)::BIGINT AS tokens FROM v_usage
    WHERE create_time >= TIMESTAMP '2024-01-05 00:00:00' AND create_time < TIMESTAMP '2024-01-20 00:00:00'""")
def window_totals(usage: DataFrame, start: str = "2024-01-05", end: str = "2024-01-19") -> DataFrame:
    """Totals of whole days, both ends included."""
    inside = (F.col("create_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("create_time") < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    return usage.where(inside).agg(F.count("*").alias("records"), F.coalesce(F.sum(tokens()), F.lit(0)).alias("tokens"))


@query("a07b_permitted_token_ranking", "v_usage", "v_grant", sql="""SELECT chat_user_id, chat_user_type, sum(message_tokens + answer_tokens)::BIGINT AS tokens, count(DISTINCT id) AS records FROM v_usage WHERE chat_user_id IS NOT NULL AND create_time >= TIMESTAMP '2024-01-05 00:00:00' AND create_time < TIMESTAMP '2024-01-20 00:00:00'
    AND application_id IN (SELECT target FROM v_grant WHERE list_contains(permission_list, 'VIEW')) GROUP BY 1, 2""")
def permitted_token_ranking(usage: DataFrame, grants: DataFrame, since: str = "2024-01-05", until: str = "2024-01-20") -> DataFrame:
    """Tokens and records per user and type in a window of record time, of the applications that may be viewed."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    seen = grants.where(F.array_contains("permission_list", "VIEW")).select(F.col("target").alias("application_id"))
    rows = usage.where(F.col("chat_user_id").isNotNull() & (F.col("create_time") >= day(since)) & (F.col("create_time") < day(until))).join(seen, "application_id", "left_semi")
    return rows.groupBy("chat_user_id", "chat_user_type").agg(F.sum(tokens()).alias("tokens"), F.count_distinct("id").alias("records"))


@query("a12b_models_by_kind", "part", sql="SELECT p_type AS kind, count(*) AS total, count(*) FILTER (p_size > 10) AS published, count(*) FILTER (NOT p_size > 10) AS unpublished FROM part GROUP BY 1")
def models_by_kind(models: DataFrame) -> DataFrame:
    published = F.col("p_size") > 10
    return models.groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("total"), F.count_if(published).alias("published"), F.count_if(~published).alias("unpublished"))


@query("a12_resource_kpi", "v_application", "v_document", sql="""SELECT 'application' AS kind, count(*) AS total, count(*) FILTER (status = 'HIRED') AS marked, count(DISTINCT job_id) AS groups FROM v_application
    UNION ALL SELECT 'document', count(*), count(*) FILTER (contains(status, '3')), count(DISTINCT knowledge_id) FROM v_document""")
def resource_kpi(applications: DataFrame, documents: DataFrame) -> DataFrame:
    one = applications.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "HIRED").alias("marked"), F.count_distinct("job_id").alias("groups"))
    two = documents.agg(F.count("*").alias("total"), F.count_if(F.col("status").contains("3")).alias("marked"), F.count_distinct("knowledge_id").alias("groups"))
    return one.select(F.lit("application").alias("kind"), "*").unionByName(two.select(F.lit("document").alias("kind"), "*"))


@query("a13_library_stats", "v_membership", "v_application", sql="""SELECT library_id, count(DISTINCT m.candidate_id) AS candidates, count(DISTINCT application_id) AS resumes,
    count(DISTINCT CASE WHEN status = 'ACTIVE' THEN application_id END) AS pending FROM v_membership m LEFT JOIN v_application a ON a.candidate_id = m.candidate_id GROUP BY 1""")
def library_stats(membership: DataFrame, applications: DataFrame) -> DataFrame:
    return membership.join(applications, "candidate_id", "left").groupBy("library_id").agg(
        F.count_distinct("candidate_id").alias("candidates"), F.count_distinct("application_id").alias("resumes"),
        F.count_distinct(F.when(F.col("status") == "ACTIVE", F.col("application_id"))).alias("pending"))


@query("a14_status_histogram", "v_document", sql="""SELECT knowledge_id, string_agg(status || ':' || c, ',' ORDER BY status) AS histogram FROM (SELECT knowledge_id, status, count(*) AS c FROM v_document GROUP BY 1, 2) GROUP BY 1""")
def status_histogram(documents: DataFrame) -> DataFrame:
    """Counts per status, nested per knowledge base."""
    counts = documents.groupBy("knowledge_id", "status").agg(F.count("*").alias("c"))
    nested = counts.groupBy("knowledge_id").agg(F.array_sort(F.collect_list(F.struct("status", "c"))).alias("h"))
    return nested.select("knowledge_id", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["status"], x["c"])), ",").alias("histogram"))


@query("a15_document_char_length", "v_document", "v_paragraph", sql="""SELECT d.document_id, coalesce(sum(length(p.content)), 0)::BIGINT AS char_length FROM v_document d LEFT JOIN v_paragraph p USING (document_id) GROUP BY 1""")
def document_char_length(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    sums = paragraphs.groupBy("document_id").agg(F.sum(F.char_length("content").cast("bigint")).alias("char_length"))
    return documents.select("document_id").join(sums, "document_id", "left").fillna(0, ["char_length"])


@query("a16_agent_run_ledger", "v_agent_run", sql="""SELECT agent_type, count(*) AS total, count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed,
    count(*) FILTER (status = 'SKIPPED') AS skipped FROM v_agent_run GROUP BY 1""")
def agent_run_ledger(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent_type").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCEEDED", "FAILED", "SKIPPED")])


_RATE = "round(CASE WHEN accepted + dismissed > 0 THEN accepted / (accepted + dismissed) END, 6)"


@query("a17_proposal_decisions", "v_proposal", "v_agent_run", sql=f"""WITH t AS (SELECT agent_type, action, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'DISMISSED') AS dismissed,
    count(*) FILTER (status = 'EXPIRED') AS expired, count(*) FILTER (status = 'PENDING') AS pending FROM v_proposal GROUP BY 1, 2), r AS (SELECT CASE agent_type WHEN 'click' THEN 'SCREENING' WHEN 'view' THEN 'SOURCING' ELSE agent_type END AS agent_type, count(*) AS runs FROM v_agent_run GROUP BY 1),
    j AS (SELECT agent_type, action, coalesce(accepted, 0) AS accepted, coalesce(dismissed, 0) AS dismissed, coalesce(expired, 0) AS expired, coalesce(pending, 0) AS pending, coalesce(runs, 0) AS runs FROM t FULL JOIN r USING (agent_type)) SELECT *, {_RATE} AS accept_rate FROM j""")
def a17(proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """Clicks and views stand for runs of two types; other types have runs only, and one has proposals only."""
    kind = F.when(F.col("agent_type") == "click", "SCREENING").when(F.col("agent_type") == "view", "SOURCING").otherwise(F.col("agent_type"))
    return proposal_decisions(proposals, runs.select(kind.alias("agent_type")))


def proposal_decisions(proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """Per type and action the proposals by state and the runs of the type; types with runs or proposals only are there too. Expired ones are not decided; no decision gives a null rate."""
    states = ["ACCEPTED", "DISMISSED", "EXPIRED", "PENDING"]
    wide = proposals.groupBy("agent_type", "action").pivot("status", states).count()
    both = wide.join(runs.groupBy("agent_type").agg(F.count("*").alias("runs")), "agent_type", "full").fillna(0, [*states, "runs"])
    both = both.select("agent_type", "action", *[F.col(s).alias(s.lower()) for s in states], "runs")
    return both.withColumn("accept_rate", F.expr(_RATE))


@query("a18_score_bands", "v_proposal", sql=f"""WITH t AS (SELECT CASE WHEN score IS NULL THEN 'no-score' WHEN score < 60 THEN '0-59' WHEN score < 80 THEN '60-79' ELSE '80-100' END AS band,
    count(*) AS total, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'DISMISSED') AS dismissed FROM v_proposal WHERE action IN ('ADVANCE', 'DECLINE', 'HOLD') GROUP BY 1)
    SELECT *, {_RATE} AS accept_rate FROM t""")
def score_bands(proposals: DataFrame) -> DataFrame:
    s = F.col("score")
    band = F.when(s.isNull(), "no-score").when(s < 60, "0-59").when(s < 80, "60-79").otherwise("80-100")
    return proposals.where(F.col("action").isin("ADVANCE", "DECLINE", "HOLD")).groupBy(band.alias("band")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ACCEPTED").alias("accepted"), F.count_if(F.col("status") == "DISMISSED").alias("dismissed")
    ).withColumn("accept_rate", F.expr(_RATE))


@query("a19_run_summary", "v_agent_run", sql="""SELECT string_agg(status || '=' || c, ',' ORDER BY status) AS by_status, sum(c)::BIGINT AS total, sum(t)::BIGINT AS tokens, sum(d)::BIGINT AS duration_ms
    FROM (SELECT status, count(*) AS c, sum(tokens) AS t, sum(duration_ms) AS d FROM v_agent_run GROUP BY 1)""")
def run_summary(runs: DataFrame) -> DataFrame:
    by = runs.groupBy("status").agg(F.count("*").alias("c"), F.sum("tokens").alias("t"), F.sum("duration_ms").alias("d"))
    return by.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "c"))), ",").alias("by_status"), F.sum("c").alias("total"), F.sum("t").alias("tokens"), F.sum("d").alias("duration_ms"))


@query("a20_tags_by_key", "v_tag", sql="""SELECT key, string_agg(value || ':' || c, ',' ORDER BY value) AS tag_values, sum(c)::BIGINT AS documents FROM (SELECT key, value, count(DISTINCT document_id) AS c FROM v_tag GROUP BY 1, 2) GROUP BY 1""")
def tags_by_key(tags: DataFrame) -> DataFrame:
    counts = tags.groupBy("key", "value").agg(F.count_distinct("document_id").alias("c"))
    return counts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "c"))), lambda x: F.concat_ws(":", x["value"], x["c"])), ",").alias("tag_values"), F.sum("c").alias("documents"))


@query("a21_active_applications_per_job", "v_job", "v_application", sql="""SELECT j.job_id, count(a.application_id) FILTER (a.status = 'ACTIVE') AS active FROM v_job j LEFT JOIN v_application a USING (job_id) GROUP BY 1""")
def active_applications(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    counts = applications.groupBy("job_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active"))
    return jobs.select("job_id").join(counts, "job_id", "left").fillna(0, ["active"])


@query("a22_reference_counts", "v_grant", sql="SELECT target, count(*) AS uses, count(DISTINCT user_id) AS users FROM v_grant GROUP BY 1")
def reference_counts(grants: DataFrame) -> DataFrame:
    return grants.groupBy("target").agg(F.count("*").alias("uses"), F.count_distinct("user_id").alias("users"))


@query("a23_tenant_inventory", "v_document", "v_paragraph", "v_candidate", sql="""SELECT 'document' AS tab, knowledge_id AS workspace, count(*) AS n FROM v_document GROUP BY 2
    UNION ALL SELECT 'paragraph', knowledge_id, count(*) FROM v_paragraph GROUP BY 2 UNION ALL SELECT 'candidate', CAST(library_id AS STRING), count(*) FROM v_candidate GROUP BY 2""")
def tenant_inventory(documents: DataFrame, paragraphs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Row counts of every table for all tenants at once."""
    count = lambda df, name, key: df.groupBy(F.col(key).cast("string").alias("workspace")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "workspace", "n")
    return count(documents, "document", "knowledge_id").unionByName(count(paragraphs, "paragraph", "knowledge_id")).unionByName(count(candidates, "candidate", "library_id"))


@query("a24_close_preview", "v_application", sql="""SELECT job_id, count(*) AS active, string_agg(CAST(application_id AS STRING), ',' ORDER BY application_id) AS applications FROM v_application WHERE status = 'ACTIVE' GROUP BY 1""")
def close_preview(applications: DataFrame) -> DataFrame:
    active = applications.where("status = 'ACTIVE'").groupBy("job_id")
    return active.agg(F.count("*").alias("active"), F.array_join(F.array_sort(F.collect_list("application_id")), ",").alias("applications"))


@query("a25_distinct_texts", "v_paragraph", sql="SELECT DISTINCT knowledge_id, content FROM v_paragraph")
def distinct_texts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("knowledge_id", "content").distinct()
