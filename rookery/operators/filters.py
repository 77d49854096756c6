"""Predicates and list filters. Text tests are literal substrings (contains), never patterns, so user text needs no escaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from .cascades import MAPPED_SQL, mapped


def has(column: str | Column, term: str) -> Column:
    """Case-insensitive literal substring."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(c).contains(term.lower())


@query("p01_literal_substring", "v_document", sql="SELECT document_id, contains(lower(content), '%%%') AS percent, contains(lower(content), 'ation') AS word FROM v_document")
def literal_substring(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", has("content", "%%%").alias("percent"), has("content", "ATION").alias("word"))


@query("p02_any_column", "v_candidate", sql="SELECT candidate_id FROM v_candidate WHERE contains(lower(name), '42') OR contains(lower(phone), '42') OR contains(lower(email), '42')")
def any_column(candidates: DataFrame, term: str = "42", columns: tuple[str, ...] = ("name", "phone", "email")) -> DataFrame:
    return candidates.where(reduce(lambda a, b: a | b, [has(c, term) for c in columns])).select("candidate_id")


@query("p03_all_terms_anywhere", "v_paragraph", sql="""SELECT document_id FROM v_paragraph WHERE document_id IN (SELECT document_id FROM v_paragraph WHERE contains(lower(content), 'with'))
    AND document_id IN (SELECT document_id FROM v_paragraph WHERE contains(lower(content), 'from')) GROUP BY 1""")
def all_terms(paragraphs: DataFrame, terms: tuple[str, ...] = ("with", "from")) -> DataFrame:
    """Documents in which each term occurs in some paragraph: one pass, one flag per term."""
    flags = paragraphs.groupBy("document_id").agg(*[F.bool_or(has("content", t)).alias(f"t{i}") for i, t in enumerate(terms)])
    return flags.where(" AND ".join(f"t{i}" for i in range(len(terms)))).select("document_id")


@query("p04_document_filter", "v_document", "v_tag", sql="""SELECT document_id FROM v_document d WHERE is_active AND contains(lower(name), 'src1') AND creator <> 4 AND
    (document_id IN (SELECT document_id FROM v_tag WHERE key = 'quality' AND value = '1') OR document_id NOT IN (SELECT document_id FROM v_tag))""")
def document_filter(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """Name, state, creator, and: tagged with a value, or without any tag."""
    base = documents.where(F.col("is_active") & has("name", "src1") & (F.col("creator") != 4))
    wanted = tags.where("key = 'quality' AND value = '1'")
    return base.join(wanted, "document_id", "left_semi").unionByName(base.join(tags, "document_id", "left_anti")).select("document_id").distinct()


@query("p04b_untagged_by_method", "v_document", "v_tag", sql="""SELECT document_id FROM v_document WHERE document_id % 3 = 0 AND document_id NOT IN (SELECT document_id FROM v_tag) UNION ALL SELECT document_id FROM v_document WHERE document_id % 3 = 1 AND document_id NOT IN (SELECT document_id FROM v_tag WHERE key = 'toxic' AND value = '1')""")
def untagged_by_method(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """Of one hit method (the number modulo 3 stands for it) those without any tag; of another those without one of the excluded tags."""
    method = F.col("document_id") % 3
    excluded = tags.where("key = 'toxic' AND value = '1'")
    return documents.where(method == 0).join(tags, "document_id", "left_anti").select("document_id").unionByName(documents.where(method == 1).join(excluded, "document_id", "left_anti").select("document_id"))


@query("p05_task_state", "v_document", sql="""SELECT document_id, CASE WHEN length(status) >= 1 THEN substring(reverse(status), 1, 1) ELSE 'n' END AS task1, CASE WHEN length(status) >= 2 THEN substring(reverse(status), 2, 1) ELSE 'n' END AS task2,
    regexp_full_match(status, '[2n]*') AS all_done FROM v_document""")
def task_states(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.task_state("status", 1).alias("task1"), T.task_state("status", 2).alias("task2"), F.col("status").rlike("^[2n]*$").alias("all_done"))


@query("p06_conversation_filter", "v_usage", sql="""SELECT chat_id, star, trample FROM (SELECT chat_id, max(create_time) AS t, count(*) FILTER (vote_status = 0) AS star, count(*) FILTER (vote_status = 1) AS trample, bool_or(contains(lower(asker), 'user1')) AS named FROM v_usage GROUP BY 1)
    WHERE t >= TIMESTAMP '2024-01-03 00:00:00' AND coalesce(named, false) AND (star >= 2 OR trample >= 3)""")
def conversation_filter(usage: DataFrame, either: bool = True) -> DataFrame:
    """Minimum likes and minimum dislikes are combined by OR (``either``) or AND."""
    chats = usage.groupBy("chat_id").agg(F.max("create_time").alias("t"), F.count_if(F.col("vote_status") == 0).alias("star"), F.count_if(F.col("vote_status") == 1).alias("trample"), F.bool_or(has("asker", "user1")).alias("named"))
    liked, disliked = F.col("star") >= 2, F.col("trample") >= 3
    return chats.where((F.col("t") >= F.lit("2024-01-03").cast("timestamp_ntz")) & F.col("named") & ((liked | disliked) if either else (liked & disliked))).select("chat_id", "star", "trample")


@query("p06b_conversation_abstract", "v_turn", sql="SELECT conv_id, min(turn) AS turn FROM v_turn WHERE contains(lower(substring(question, 1, 256)), 'the ') GROUP BY 1")
def conversation_abstract(turns: DataFrame, text: str = "the ") -> DataFrame:
    """Conversations with the searched text in an abstract, which is the beginning of a question; the first such turn."""
    return turns.where(has(F.left("question", F.lit(256)), text)).groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("p07_local_day_range", "v_usage", sql="SELECT id FROM v_usage WHERE CAST(create_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'")
def day_range(usage: DataFrame, start: str = "2024-01-03", end: str = "2024-01-09") -> DataFrame:
    """Half-open on the column itself, so the bounds reach the Parquet scan."""
    t = F.col("create_time")
    return usage.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))).select("id")


@query("p08_json_field", "v_usage", sql="SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.hr_protected') IS NULL AS open FROM v_usage WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_field(usage: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return usage.where(k > 50).select("id", k.alias("k"), F.get_json_object("props", "$.hr_protected").isNull().alias("open"))


@query("p09_array_overlap", "v_grant", sql="SELECT grant_id, list_has_any(permission_list, ['MANAGE', 'ROLE']) AS strong, list_contains(permission_list, 'VIEW') AS can_view FROM v_grant")
def array_overlap(grants: DataFrame) -> DataFrame:
    return grants.select("grant_id", F.arrays_overlap("permission_list", F.array(F.lit("MANAGE"), F.lit("ROLE"))).alias("strong"), F.array_contains("permission_list", "VIEW").alias("can_view"))


@query("p10_permission_level", "v_job", "v_grant", sql="""WITH g AS (SELECT target, bool_or(list_contains(permission_list, 'ROLE')) AS r, bool_or(list_contains(permission_list, 'MANAGE')) AS m, bool_or(list_contains(permission_list, 'VIEW')) AS v FROM v_grant WHERE user_id % 4 = 1 GROUP BY 1)
    SELECT job_id, CASE WHEN r THEN 'ROLE' WHEN m THEN 'MANAGE' WHEN v THEN 'VIEW' ELSE 'NOT_AUTH' END AS level FROM v_job LEFT JOIN g ON target = job_id""")
def permission_level(jobs: DataFrame, grants: DataFrame) -> DataFrame:
    held = lambda p: F.bool_or(F.array_contains("permission_list", p))
    levels = grants.where("user_id % 4 = 1").groupBy(F.col("target").alias("job_id")).agg(F.when(held("ROLE"), "ROLE").when(held("MANAGE"), "MANAGE").when(held("VIEW"), "VIEW").otherwise("NOT_AUTH").alias("level"))
    return jobs.select("job_id").join(levels, "job_id", "left").fillna("NOT_AUTH", ["level"])


@query("p11_role_masking", "v_candidate", sql="SELECT candidate_id, substring(phone, 1, 3) || '****' || right(phone, 4) AS phone, CASE WHEN position('@' IN email) > 3 THEN substring(email, 1, 2) || '***' || substring(email, position('@' IN email)) ELSE '***' || substring(email, position('@' IN email)) END AS email FROM v_candidate")
def role_masking(candidates: DataFrame, role: str = "viewer") -> DataFrame:
    if role in ("admin", "owner"):
        return candidates.select("candidate_id", "phone", "email")
    return candidates.select("candidate_id", T.masked_phone("phone").alias("phone"), T.masked_email("email").alias("email"))


@query("p12_audit_log", "v_usage", "v_candidate", sql="SELECT id, c.name, create_time FROM v_usage u LEFT JOIN v_candidate c ON c.candidate_id = u.chat_user_id WHERE vote_status >= 0 AND create_time < TIMESTAMP '2024-01-15 00:00:00'")
def audit_log(log: DataFrame, users: DataFrame) -> DataFrame:
    rows = log.where((F.col("vote_status") >= 0) & (F.col("create_time") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return rows.join(users, rows["chat_user_id"] == users["candidate_id"], "left").select("id", "name", "create_time")


@query("p13_application_list", "v_application", "v_candidate", "v_job", sql="""SELECT application_id, c.name, j.title FROM v_application a JOIN v_candidate c USING (candidate_id) LEFT JOIN v_job j USING (job_id)
    WHERE a.status = 'ACTIVE' AND channel = 'REFERRAL' AND owner_id IN (1, 2, 3) AND stage <> '5' AND contains(lower(c.name), '1')""")
def application_list(applications: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    rows = applications.where("status = 'ACTIVE' AND channel = 'REFERRAL' AND owner_id IN (1, 2, 3) AND stage <> '5'")
    return rows.join(candidates.where(has("name", "1")).select("candidate_id", "name"), "candidate_id").join(jobs.select("job_id", "title"), "job_id", "left").select("application_id", "name", "title")


@query("p14_overdue", "v_application", sql="SELECT application_id, status = 'ACTIVE' AND create_time + INTERVAL 30 DAY < TIMESTAMP '1999-06-01 00:00:00' AS is_overdue FROM v_application")
def overdue(applications: DataFrame, now: str = "1999-06-01", days: int = 30) -> DataFrame:
    """``now`` is a parameter, so a run can be repeated."""
    deadline = F.col("create_time") + F.make_interval(days=F.lit(days))
    return applications.select("application_id", ((F.col("status") == "ACTIVE") & (deadline < F.lit(now).cast("timestamp_ntz"))).alias("is_overdue"))


@query("p15_run_list", "v_agent_run", sql="SELECT id, agent_type, status FROM v_agent_run WHERE status <> 'SKIPPED' AND contains(lower(props), '\"k\": 7')")
def run_list(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") != "SKIPPED") & has("props", '"k": 7')).select("id", "agent_type", "status")


@query("p17_knowledge_filter", "v_document", sql="SELECT knowledge_id, count(*) AS documents FROM v_document WHERE creator IN (1, 2, 5) AND NOT contains(name, '7') GROUP BY 1 HAVING count(*) > 1")
def knowledge_filter(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("creator").isin(1, 2, 5) & ~F.col("name").contains("7")).groupBy("knowledge_id").agg(F.count("*").alias("documents")).where("documents > 1")


@query("p18_paragraph_list", "v_paragraph", sql="SELECT paragraph_id, document_id, position FROM v_paragraph WHERE contains(lower(content), 'the')")
def paragraph_list(paragraphs: DataFrame, term: str = "the") -> DataFrame:
    return paragraphs.where(has("content", term)).select("paragraph_id", "document_id", "position").orderBy("document_id", "position")


@query("p19_question_list", "v_query_text", "v_document", sql=f"WITH {MAPPED_SQL}, n AS (SELECT query_id, count(*) AS documents FROM mp GROUP BY 1) SELECT query_id, query, coalesce(documents, 0) AS documents FROM v_query_text LEFT JOIN n USING (query_id) WHERE contains(lower(query), 'th')")
def question_list(questions: DataFrame, documents: DataFrame, term: str = "th") -> DataFrame:
    """Questions that hold the text, with the number of documents they are mapped to, newest first."""
    maps = mapped(questions, documents).groupBy("query_id").agg(F.count("*").alias("documents"))
    return questions.where(has("query", term)).select("query_id", "query").join(maps, "query_id", "left").fillna(0, ["documents"]).orderBy(F.desc("query_id"))


@query("p19b_term_list", "v_kb_term", sql="SELECT knowledge_id, term, count(*) AS entries FROM v_kb_term WHERE contains(term, 'th') GROUP BY 1, 2")
def term_list(terms: DataFrame, term: str = "th") -> DataFrame:
    return terms.where(has("term", term)).groupBy("knowledge_id", "term").agg(F.count("*").alias("entries")).orderBy("knowledge_id", "term")


@query("p20_proposal_list", "v_proposal", "v_job", sql="SELECT id, p.action, p.agent_type, j.title, p.create_time FROM v_proposal p LEFT JOIN v_job j ON j.job_id = p.part WHERE p.status = 'PENDING' AND action = 'ADVANCE'")
def proposal_list(proposals: DataFrame, jobs: DataFrame, status: str = "PENDING", action: str = "ADVANCE") -> DataFrame:
    """Proposals of one state and action with the job's title, newest first."""
    rows = proposals.where((F.col("status") == status) & (F.col("action") == action))
    return rows.join(jobs, rows["part"] == jobs["job_id"], "left").select("id", "action", "agent_type", "title", "create_time").orderBy(F.desc("create_time"), "id")


@query("p20b_offer_list", "v_application", "v_candidate", "v_job", sql="SELECT application_id, a.channel, c.name, j.title, a.create_time FROM v_application a LEFT JOIN v_candidate c USING (candidate_id) LEFT JOIN v_job j USING (job_id) WHERE a.status = 'HIRED' AND a.channel = 'REFERRAL'")
def offer_list(offers: DataFrame, candidates: DataFrame, jobs: DataFrame, status: str = "HIRED", channel: str = "REFERRAL") -> DataFrame:
    """Offers of one state and type with the names of candidate and job, newest first."""
    rows = offers.where((F.col("status") == status) & (F.col("channel") == channel))
    named = rows.join(candidates.select("candidate_id", "name"), "candidate_id", "left").join(jobs.select("job_id", "title"), "job_id", "left")
    return named.select("application_id", "channel", "name", "title", "create_time").orderBy(F.desc("create_time"), "application_id")


@query("p21_state_lookup", "v_document", "labels", sql="SELECT document_id, status, CASE WHEN contains(status, '3') THEN 'hidden' END AS error FROM v_document WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def state_lookup(documents: DataFrame, asked: DataFrame, role: str = "viewer") -> DataFrame:
    rows = documents.join(asked.where("quality = 0").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return rows.select("document_id", "status", F.when(F.col("status").contains("3"), "hidden" if role == "viewer" else F.col("status")).alias("error"))


MOST_LIBRARIES = 50
_CHOSEN = "ch AS (SELECT candidate_id, unnest([candidate_id % 30, candidate_id % 7, candidate_id % 7]) AS library_id FROM v_candidate WHERE candidate_id % 2 = 0), bad AS (SELECT DISTINCT candidate_id, library_id FROM ch WHERE library_id NOT IN (SELECT library_id FROM v_library WHERE region_id <> 4))"


def chosen(candidates: DataFrame) -> DataFrame:
    """Requests of every second candidate that name libraries, some of them twice, unknown or archived."""
    c = F.col("candidate_id")
    return candidates.where(c % 2 == 0).select("candidate_id", F.array((c % 30).cast("int"), (c % 7).cast("int"), (c % 7).cast("int")).alias("libraries"))


def scope_violations(requests: DataFrame, libraries: DataFrame, most: int = MOST_LIBRARIES) -> DataFrame:
    """candidate_id, library_id: named libraries that are unknown or archived; null for a request that names too many."""
    each = requests.select("candidate_id", F.array_distinct("libraries").alias("l"))
    unknown = each.select("candidate_id", F.explode("l").alias("library_id")).join(libraries.select("library_id"), "library_id", "left_anti")
    return unknown.select("candidate_id", "library_id").unionByName(each.where(F.size("l") > most).select("candidate_id", F.lit(None).cast("int").alias("library_id")))


def owner_scope(requests: DataFrame, documents: DataFrame, membership: DataFrame, libraries: DataFrame) -> DataFrame:
    """candidate_id, application_id: the documents (here applications) of the owner for requests without a violation, if the owner is in a chosen library; each once."""
    fine = requests.join(scope_violations(requests, libraries).select("candidate_id").distinct(), "candidate_id", "left_anti")
    inside = fine.select("candidate_id", F.explode(F.array_distinct(F.col("libraries").cast("array<bigint>"))).alias("library_id")).join(membership, ["candidate_id", "library_id"], "left_semi")
    return documents.join(inside, "candidate_id", "left_semi").select("candidate_id", "application_id").distinct()


@query("p22_owner_scope", "v_candidate", "v_application", "v_membership", "v_library", sql=f"WITH {_CHOSEN} SELECT DISTINCT candidate_id, application_id FROM v_application JOIN ch USING (candidate_id) WHERE candidate_id NOT IN (SELECT candidate_id FROM bad) AND (candidate_id, ch.library_id) IN (SELECT (candidate_id, library_id) FROM v_membership)")
def p22(candidates: DataFrame, applications: DataFrame, membership: DataFrame, libraries: DataFrame) -> DataFrame:
    return owner_scope(chosen(candidates), applications, membership, libraries.where("region_id <> 4"))


@query("p22b_scope_violations", "v_candidate", "v_library", sql=f"WITH {_CHOSEN} SELECT * FROM bad")
def p22b(candidates: DataFrame, libraries: DataFrame) -> DataFrame:
    """Libraries of region 4 are archived."""
    return scope_violations(chosen(candidates), libraries.where("region_id <> 4"))
