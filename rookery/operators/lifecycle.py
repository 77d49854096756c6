"""Bulk upkeep: every job returns a new snapshot or its change rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import staged
from .windows import numbered


@query("m01_content_dedupe", "v_document", sql="""SELECT document_id, min(document_id) OVER (PARTITION BY sha256(content)) AS kept_id, row_number() OVER (PARTITION BY sha256(content) ORDER BY document_id) > 1 AS is_duplicate FROM v_document""")
def content_dedupe(documents: DataFrame) -> DataFrame:
    """First document of each content hash; aggregated per hash, so a hash with many copies is not one task's window."""
    rows = documents.select("document_id", F.sha2("content", 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("document_id").alias("kept_id"))
    return rows.join(first, "digest").select("document_id", "kept_id", (F.col("document_id") != F.col("kept_id")).alias("is_duplicate"))


@query("m02_membership_upsert", "v_candidate", "v_membership", sql="""SELECT library_id, candidate_id FROM v_membership UNION SELECT 5, candidate_id FROM v_candidate WHERE candidate_id % 10 = 0 UNION SELECT -1, candidate_id FROM v_candidate WHERE candidate_id % 10 = 0""")
def membership_upsert(candidates: DataFrame, membership: DataFrame, library: int = 5, system: int = -1) -> DataFrame:
    new = candidates.where("candidate_id % 10 = 0").select(F.explode(F.array(F.lit(library), F.lit(system)).cast("array<bigint>")).alias("library_id"), "candidate_id")
    return membership.select("library_id", "candidate_id").unionByName(new).distinct()


@query("m03_get_or_create_questions", "v_query_text", "v_turn", sql="""WITH n AS (SELECT DISTINCT question FROM v_turn UNION SELECT DISTINCT query FROM v_query_text) SELECT sha256(question) AS problem_id, question, question IN (SELECT query FROM v_query_text) AS stored FROM n""")
def get_or_create(stored: DataFrame, turns: DataFrame) -> DataFrame:
    """New ids come from the content, so a repeated run gives the same rows."""
    old = stored.select(F.col("query").alias("question"), F.lit(True).alias("stored")).distinct()
    new = turns.select("question").distinct()
    return new.join(old, "question", "full").select(F.sha2("question", 256).alias("problem_id"), "question", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("m04_document_migration", "v_document", "v_embedding", sql="""SELECT e.id, CASE WHEN d.knowledge_id = 'src1' THEN 'src2' ELSE d.knowledge_id END AS knowledge_id, d.knowledge_id = 'src1' AND e.knowledge_id <> 2 AS rebuild FROM v_embedding e JOIN v_document d USING (document_id)""")
def document_migration(documents: DataFrame, embeddings: DataFrame, source: str = "src1", target: str = "src2", model: int = 2) -> DataFrame:
    """Rows of the moved documents change their knowledge base; they are rebuilt when the model differs."""
    moved = F.col("d.knowledge_id") == source
    return embeddings.alias("e").join(documents.alias("d"), "document_id").select("e.id", F.when(moved, target).otherwise(F.col("d.knowledge_id")).alias("knowledge_id"), (moved & (F.col("e.knowledge_id") != model)).alias("rebuild"))


@query("m05_paragraph_migration", "v_paragraph", sql="""WITH t AS (SELECT *, document_id - document_id % 10 AS target FROM v_paragraph), m AS (SELECT paragraph_id, target AS document_id, row_number() OVER (PARTITION BY target ORDER BY document_id, position) AS position FROM t WHERE document_id % 10 IN (1, 2)),
    n AS (SELECT document_id, count(*) AS c FROM m GROUP BY 1) SELECT paragraph_id, document_id, position FROM m UNION ALL SELECT paragraph_id, p.document_id, position + coalesce(c, 0) FROM v_paragraph p LEFT JOIN n USING (document_id) WHERE document_id % 10 NOT IN (1, 2)""")
def paragraph_migration(paragraphs: DataFrame) -> DataFrame:
    """Moved rows get 1..n in the target, whose own rows shift by n."""
    target = F.col("document_id") - F.col("document_id") % 10
    moving = (F.col("document_id") % 10).isin(1, 2)
    moved = paragraphs.where(moving).select("paragraph_id", target.alias("target"), "document_id", "position")
    moved = moved.select("paragraph_id", F.col("target").alias("document_id"), numbered("target", order=["document_id", "position"]).alias("position"))
    shift = moved.groupBy("document_id").agg(F.count("*").alias("c"))
    stay = paragraphs.where(~moving).join(shift, "document_id", "left").select("paragraph_id", "document_id", (F.col("position") + F.coalesce("c", F.lit(0))).alias("position"))
    return moved.unionByName(stay)


@query("m06_tag_rename_and_delete", "v_tag", sql="SELECT document_id, CASE WHEN key = 'quality' THEN 'grade' ELSE key END AS key, value FROM v_tag WHERE NOT (key = 'toxic' AND value = '0') UNION SELECT document_id, 'grade', 'new' FROM v_tag WHERE document_id % 50 = 0")
def tag_changes(tags: DataFrame) -> DataFrame:
    """A key is renamed in all rows, a value deleted with its links, and a batch of tags added without duplicates."""
    kept = tags.where("NOT (key = 'toxic' AND value = '0')").select("document_id", F.when(F.col("key") == "quality", "grade").otherwise(F.col("key")).alias("key"), "value")
    return kept.unionByName(tags.where("document_id % 50 = 0").select("document_id", F.lit("grade").alias("key"), F.lit("new").alias("value"))).distinct()


_MERGE = "SELECT candidate_id AS secondary, candidate_id - candidate_id % 10 AS primary_id FROM v_candidate WHERE candidate_id % 10 = 3"


@query("m07_candidate_merge", "v_candidate", "v_application", sql=f"""WITH m AS ({_MERGE}) SELECT application_id, coalesce(primary_id, candidate_id) AS candidate_id, EXISTS (SELECT 1 FROM v_application b WHERE b.candidate_id = primary_id AND b.job_id = a.job_id AND b.status = 'ACTIVE' AND a.status = 'ACTIVE') AS conflict
    FROM v_application a LEFT JOIN m ON secondary = candidate_id""")
def candidate_merge(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Children follow to the primary; a conflict is an active row of both on one job."""
    mapping = candidates.where("candidate_id % 10 = 3").select("candidate_id", (F.col("candidate_id") - F.col("candidate_id") % 10).alias("primary_id"))
    rows = applications.join(mapping, "candidate_id", "left")
    active = applications.where("status = 'ACTIVE'").select(F.col("candidate_id").alias("primary_id"), "job_id", F.lit("ACTIVE").alias("status"), F.lit(True).alias("clash")).distinct()
    return rows.join(active, ["primary_id", "job_id", "status"], "left").select("application_id", F.coalesce("primary_id", "candidate_id").alias("candidate_id"), F.coalesce("clash", F.lit(False)).alias("conflict"))


@query("m08_erasure", "v_candidate", "v_application", sql="""SELECT candidate_id, CASE WHEN g THEN '' ELSE name END AS name, CASE WHEN NOT g THEN phone END AS phone, g AS erased FROM (SELECT c.*, candidate_id % 5 = 0 AND candidate_id NOT IN (SELECT candidate_id FROM v_application WHERE status IN ('ACTIVE', 'HIRED')) AS g FROM v_candidate c)""")
def erasure(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Requested candidates (every fifth) are blanked unless an active or hired application guards them."""
    guard = applications.where("status IN ('ACTIVE', 'HIRED')").select("candidate_id", F.lit(True).alias("held")).distinct()
    rows = candidates.join(guard, "candidate_id", "left").withColumn("g", (F.col("candidate_id") % 5 == 0) & F.col("held").isNull())
    return rows.select("candidate_id", F.when(F.col("g"), "").otherwise(F.col("name")).alias("name"), F.when(~F.col("g"), F.col("phone")).alias("phone"), F.col("g").alias("erased"))


@query("m09_archive_flow", "v_candidate", "v_embedding", sql="SELECT e.id, e.is_active AND c.status = 'ACTIVE' AS is_active FROM v_embedding e JOIN v_candidate c ON c.candidate_id = e.document_id")
def archive_flow(candidates: DataFrame, embeddings: DataFrame) -> DataFrame:
    owner = candidates.select(F.col("candidate_id").alias("document_id"), "status")
    return embeddings.join(owner, "document_id").select("id", (F.col("is_active") & (F.col("status") == "ACTIVE")).alias("is_active"))


@query("m10_job_close", "v_application", sql="SELECT application_id, CASE WHEN job_id % 10 = 0 AND status = 'ACTIVE' THEN 'CLOSED' ELSE status END AS status, CASE WHEN job_id % 10 = 0 AND status = 'ACTIVE' THEN 'close-' || job_id || '-' || application_id END AS event_key FROM v_application")
def job_close(applications: DataFrame) -> DataFrame:
    """Active applications of the closed jobs end, each with an event of a deterministic key."""
    hit = (F.col("job_id") % 10 == 0) & (F.col("status") == "ACTIVE")
    return applications.select("application_id", F.when(hit, "CLOSED").otherwise(F.col("status")).alias("status"), F.when(hit, F.concat_ws("-", F.lit("close"), "job_id", "application_id")).alias("event_key"))


@query("m11_transitions", "v_application", "v_proposal", sql="""WITH c AS (SELECT target AS application_id, action, min(id) AS command_id FROM v_proposal WHERE status <> 'EXPIRED' GROUP BY 1, 2)
    SELECT command_id, c.application_id, action, CASE WHEN a.application_id IS NULL THEN 'MISSING' WHEN a.status <> 'ACTIVE' AND action <> 'HOLD' THEN 'REJECTED' ELSE 'APPLIED' END AS outcome FROM c LEFT JOIN v_application a USING (application_id)""")
def transitions(applications: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands are idempotent per application and action; those a state does not allow are rejects."""
    unique = commands.where("status <> 'EXPIRED'").groupBy(F.col("target").alias("application_id"), "action").agg(F.min("id").alias("command_id"))
    rows = unique.join(applications.select("application_id", "status"), "application_id", "left")
    outcome = F.when(F.col("status").isNull(), "MISSING").when((F.col("status") != "ACTIVE") & (F.col("action") != "HOLD"), "REJECTED").otherwise("APPLIED")
    return rows.select("command_id", "application_id", "action", outcome.alias("outcome"))


@query("m12_retention", "v_usage", sql="""WITH k AS (SELECT * FROM v_usage WHERE create_time >= TIMESTAMP '2024-01-31 00:00:00' - (CASE WHEN application_id % 2 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 20 DAY END)) SELECT chat_id, count(*) AS records, count(*) FILTER (vote_status = 0) AS star_num FROM k GROUP BY 1""")
def retention(usage: DataFrame, now: str = "2024-01-31") -> DataFrame:
    """Each application has its own cut-off; kept chats are counted again, empty ones disappear."""
    days = F.when(F.col("application_id") % 2 == 0, 10).otherwise(20)
    kept = usage.where(F.col("create_time") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(days=days))
    return kept.groupBy("chat_id").agg(F.count("*").alias("records"), F.count_if(F.col("vote_status") == 0).alias("star_num"))


@query("m13_file_ttl", "v_usage", sql="SELECT id FROM v_usage WHERE NOT (create_time < TIMESTAMP '2024-01-10 00:00:00' - (CASE chat_user_type WHEN 0 THEN INTERVAL 30 MINUTE WHEN 1 THEN INTERVAL 120 MINUTE ELSE INTERVAL 1 DAY END))")
def file_ttl(files: DataFrame, now: str = "2024-01-10") -> DataFrame:
    minutes = F.when(F.col("chat_user_type") == 0, 30).when(F.col("chat_user_type") == 1, 120).otherwise(1440)
    return files.where(~(F.col("create_time") < F.lit(now).cast("timestamp_ntz") - F.make_interval(mins=minutes))).select("id")


ORPHANS_SQL = """o AS (SELECT d.document_id FROM v_document d JOIN v_agent_run r ON r.id = d.document_id WHERE r.create_time < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 30 DAY AND document_id NOT IN (SELECT candidate_id * 3 FROM v_candidate))"""


def orphans(documents: DataFrame, uploads: DataFrame, owners: DataFrame, now: str = "2024-02-01", days: int = 30) -> DataFrame:
    """document_id of documents that were uploaded more than ``days`` ago and have no owner."""
    old = uploads.where(F.col("create_time") < F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))).select(F.col("id").alias("document_id"))
    return documents.select("document_id").join(old, "document_id", "left_semi").join(owners.select((F.col("candidate_id") * 3).alias("document_id")), "document_id", "left_anti")


@query("m14_orphan_purge", "v_document", "v_agent_run", "v_candidate", sql=f"WITH {ORPHANS_SQL} SELECT document_id FROM v_document WHERE document_id NOT IN (SELECT * FROM o)")
def orphan_purge(documents: DataFrame, uploads: DataFrame, owners: DataFrame) -> DataFrame:
    """The documents that stay; the first log entry of a document (the run with its number) tells when it came."""
    return documents.join(orphans(documents, uploads, owners), "document_id", "left_anti").select("document_id")


def orphan_questions(questions: DataFrame, maps: DataFrame, gone: DataFrame) -> DataFrame:
    """The questions that stay when paragraphs (``gone``) are deleted: those that never had one of them, and those that are still mapped to another.

    ``maps``: query_id and the key of ``gone``.
    """
    key = gone.columns[0]
    touched = maps.join(gone, key, "left_semi").select("query_id").distinct()
    left = maps.join(gone, key, "left_anti").select("query_id").distinct()
    return questions.join(touched.join(left, "query_id", "left_anti"), "query_id", "left_anti")


@query("m15_orphan_questions", "v_query_text", "v_document", "v_paragraph", sql="""WITH mp AS (SELECT query_id, paragraph_id FROM v_query_text JOIN v_paragraph ON document_id IN (query_id, query_id + 40) AND position % 3 = query_id % 3), g AS (SELECT paragraph_id FROM v_paragraph WHERE document_id IN (SELECT document_id FROM v_document WHERE creator < 5)),
    t AS (SELECT query_id FROM mp WHERE paragraph_id IN (SELECT * FROM g)), l AS (SELECT query_id FROM mp WHERE paragraph_id NOT IN (SELECT * FROM g)) SELECT query_id FROM v_query_text WHERE query_id NOT IN (SELECT * FROM t) OR query_id IN (SELECT * FROM l)""")
def m15(questions: DataFrame, documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A question is mapped to every third paragraph of two documents; the paragraphs of the documents of some creators are deleted."""
    each = questions.select("query_id", F.explode(F.array(F.col("query_id").cast("bigint"), F.col("query_id").cast("bigint") + 40)).alias("document_id"))
    maps = each.join(paragraphs, "document_id").where(F.col("position") % 3 == F.col("query_id") % 3).select("query_id", "paragraph_id")
    gone = paragraphs.join(documents.where("creator < 5"), "document_id", "left_semi").select("paragraph_id")
    return orphan_questions(questions, maps, gone).select("query_id")


@query("m16_web_sync", "pages", "v_page_next", sql="""SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NULL THEN 'remove' WHEN o.url IS NULL THEN 'insert' WHEN o.h <> n.h THEN 'update' ELSE 'keep' END AS change
    FROM (SELECT url, sha256(min(html)) AS h FROM pages GROUP BY 1) o FULL JOIN (SELECT url, sha256(min(html)) AS h FROM v_page_next GROUP BY 1) n ON o.url = n.url""")
def web_sync(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda df, name: df.groupBy("url").agg(F.sha2(F.min("html"), 256).alias(name))
    change = F.when(F.col("b").isNull(), "remove").when(F.col("a").isNull(), "insert").when(F.col("a") != F.col("b"), "update").otherwise("keep")
    return side(old, "a").join(side(new, "b"), "url", "full").select("url", change.alias("change"))


@query("m17_offboarding_plan", "v_candidate", "v_application", sql="""SELECT a.application_id, c.library_id = 7 AS drop_row, c.library_id = 7 AND a.status = 'ACTIVE' AS blocker FROM v_application a JOIN v_candidate c USING (candidate_id)""")
def offboarding_plan(candidates: DataFrame, applications: DataFrame, tenant: int = 7) -> DataFrame:
    gone = F.col("library_id") == tenant
    rows = applications.join(candidates.select("candidate_id", "library_id"), "candidate_id")
    return rows.select("application_id", gone.alias("drop_row"), (gone & (F.col("status") == "ACTIVE")).alias("blocker"))


@query("m18_proposal_expiry", "v_proposal", "v_application", sql="SELECT p.id, CASE WHEN p.status = 'PENDING' AND (a.application_id IS NULL OR a.status <> 'ACTIVE') THEN 'EXPIRED' ELSE p.status END AS status FROM v_proposal p LEFT JOIN v_application a ON a.application_id = p.target")
def proposal_expiry(proposals: DataFrame, applications: DataFrame) -> DataFrame:
    state = applications.select(F.col("application_id").alias("target"), F.col("status").alias("now"))
    stale = (F.col("status") == "PENDING") & (F.coalesce("now", F.lit("-")) != "ACTIVE")
    return proposals.join(state, "target", "left").select("id", F.when(stale, "EXPIRED").otherwise(F.col("status")).alias("status"))


@query("m18b_stale_targets", "v_proposal", "v_application", "v_job", sql="""SELECT p.id, CASE WHEN p.status <> 'PENDING' THEN p.status WHEN agent_type = 'SCREENING' AND (a.application_id IS NULL OR a.stage <> '1') THEN 'EXPIRED' WHEN agent_type = 'SOURCING' AND (j.job_id IS NULL OR j.level > 40) THEN 'EXPIRED'
    WHEN agent_type = 'COPILOT' AND create_time_p < TIMESTAMP '1997-01-01 00:00:00' THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM (SELECT id, status, agent_type, target, part, create_time AS create_time_p FROM v_proposal) p LEFT JOIN v_application a ON a.application_id = p.target LEFT JOIN v_job j ON j.job_id = p.part""")
def stale_targets(proposals: DataFrame, applications: DataFrame, jobs: DataFrame, now: str = "1997-01-01") -> DataFrame:
    """Pending proposals of three kinds of targets: an application that is gone or has moved on from its stage, a job that is gone or closed (a level above 40 stands for it), an interview that is over."""
    rows = proposals.join(applications.select(F.col("application_id").alias("target"), "stage"), "target", "left").join(jobs.select(F.col("job_id").alias("part"), "level"), "part", "left")
    kind = F.col("agent_type")
    stale = F.when(kind == "SCREENING", F.coalesce(F.col("stage") != "1", F.lit(True))).when(kind == "SOURCING", F.coalesce(F.col("level") > 40, F.lit(True))).otherwise(F.col("create_time") < F.lit(now).cast("timestamp_ntz"))
    return rows.select("id", F.when(F.col("status") != "PENDING", F.col("status")).when(stale, "EXPIRED").otherwise("PENDING").alias("status"))


@query("m19_feedback_to_knowledge", "v_turn", "v_paragraph", sql="""WITH n AS (SELECT conv_id AS document_id, turn, answer AS content, sha256(question) AS problem_id FROM v_turn WHERE length(answer) > 200), c AS (SELECT document_id, count(*) AS c FROM n GROUP BY 1)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY turn) AS position, content, problem_id FROM n UNION ALL SELECT p.document_id, position + coalesce(c, 0), content, NULL FROM v_paragraph p LEFT JOIN c USING (document_id)""")
def feedback_to_knowledge(turns: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Chosen answers are prepended as paragraphs with their question; existing positions shift."""
    chosen = turns.where(F.char_length("answer") > 200).select(F.col("conv_id").alias("document_id"), "turn", F.col("answer").alias("content"), F.sha2("question", 256).alias("problem_id"))
    count = chosen.groupBy("document_id").agg(F.count("*").alias("c"))
    new = chosen.select("document_id", numbered("document_id", order=["turn"]).alias("position"), "content", "problem_id")
    old = paragraphs.join(count, "document_id", "left").select("document_id", (F.col("position") + F.coalesce("c", F.lit(0))).alias("position"), "content", F.lit(None).cast("string").alias("problem_id"))
    return new.unionByName(old)


@query("m20_folder_closure", "v_folder", sql="""WITH RECURSIVE t AS (SELECT id, id AS ancestor, 0 AS depth FROM v_folder UNION ALL SELECT t.id, f.parent_id, depth + 1 FROM t JOIN v_folder f ON f.id = t.ancestor WHERE f.parent_id IS NOT NULL) SELECT id, ancestor, depth::BIGINT AS depth FROM t""")
def folder_closure(folders: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of a parent-pointer tree by doubling: after k rounds all ancestors nearer than 2^k are known, so the joins are log2 of the depth.

    A folder with an ancestor further away than there are folders lies on or below a cycle, which is an error.
    """
    folders = staged(folders.select("id", "parent_id"), "folders")
    count = folders.count()
    jump = folders.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up"))
    every = folders.select("id").unionByName(jump.select(F.col("up").alias("id"))).distinct()
    known, reach = every.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")), 1
    while not jump.isEmpty():
        if reach > count:
            raise ValueError(f"folders in a cycle, or below one: {[r['id'] for r in jump.orderBy('id').limit(5).collect()]}")
        beyond = jump.join(known.select(F.col("id").alias("up"), "ancestor", "depth"), "up").select("id", "ancestor", (F.col("depth") + reach).alias("depth"))
        known = staged(known.unionByName(beyond), "folder-closure")
        jump = staged(jump.alias("a").join(jump.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")), "folder-jumps")
        reach *= 2
    return known.join(folders.select("id"), "id", "left_semi")


@query("m21_permission_union", "v_job", "v_grant", sql="SELECT job_id, user_id, coalesce(granted, 'ROLE') AS granted FROM v_job LEFT JOIN (SELECT target, min(user_id) AS user_id, CASE WHEN bool_or(list_contains(permission_list, 'MANAGE')) THEN 'MANAGE' ELSE 'VIEW' END AS granted FROM v_grant WHERE user_id % 3 = 0 GROUP BY 1) ON target = job_id")
def permission_union(jobs: DataFrame, grants: DataFrame) -> DataFrame:
    held = grants.where("user_id % 3 = 0").groupBy(F.col("target").alias("job_id")).agg(F.min("user_id").alias("user_id"), F.when(F.bool_or(F.array_contains("permission_list", "MANAGE")), "MANAGE").otherwise("VIEW").alias("granted"))
    return jobs.select("job_id").join(held, "job_id", "left").fillna("ROLE", ["granted"])


@query("m22_daily_access", "v_usage", sql="SELECT chat_user_id, application_id, CAST(create_time AS DATE) AS day, count(*) AS uses, count(*) > 3 AS over_quota FROM v_usage GROUP BY 1, 2, 3")
def daily_access(usage: DataFrame, quota: int = 3) -> DataFrame:
    """Counters are derived per user, application and day, so there is nothing to reset."""
    counts = usage.groupBy("chat_user_id", "application_id", F.to_date("create_time").alias("day")).agg(F.count("*").alias("uses"))
    return counts.withColumn("over_quota", F.col("uses") > quota)


@query("m23_bulk_cancel", "v_document", sql="""WITH s AS (SELECT document_id, lpad(status, 4, 'n') AS s FROM v_document) SELECT document_id, substring(s, 1, 3) || CASE WHEN right(s, 1) IN ('0', '1') THEN '4' ELSE right(s, 1) END AS status FROM s""")
def bulk_cancel(documents: DataFrame) -> DataFrame:
    """Task 1: pending (0) and started (1) become revoked (4)."""
    from ..functions.text import task_state, with_task_state

    return documents.select("document_id", F.when(task_state("status", 1).isin("0", "1"), with_task_state("status", 1, "4")).otherwise(F.lpad("status", 4, "n")).alias("status"))


@query("m24_bulk_edit", "v_usage", sql="SELECT id, CASE WHEN id % 3 = 0 THEN 'direct' ELSE 'model' END AS handling, CASE WHEN id % 3 = 0 THEN '0.9' ELSE json_extract_string(props, '$.k') END AS k FROM v_usage")
def bulk_edit(rows: DataFrame) -> DataFrame:
    """A column and one key inside a JSON column, for the chosen ids."""
    hit = F.col("id") % 3 == 0
    parsed = F.from_json("props", "map<string,string>")
    edited = F.to_json(F.map_concat(F.map_filter(parsed, lambda k, v: k != "k"), F.create_map(F.lit("k"), F.lit("0.9"))))
    out = rows.select("id", F.when(hit, "direct").otherwise("model").alias("handling"), F.when(hit, edited).otherwise(F.col("props")).alias("props"))
    return out.select("id", "handling", F.get_json_object("props", "$.k").alias("k"))


@query("m25_cascade_delete", "v_document", "v_paragraph", "v_embedding", sql="""WITH k AS (SELECT document_id FROM v_document WHERE NOT (creator = 3 AND knowledge_id <> 'src0')) SELECT 'document' AS tab, document_id AS id FROM k UNION ALL SELECT 'paragraph', paragraph_id FROM v_paragraph WHERE document_id IN (SELECT * FROM k) UNION ALL SELECT 'embedding', id FROM v_embedding WHERE document_id IN (SELECT * FROM k)""")
def cascade_delete(documents: DataFrame, paragraphs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """What stays of each table; a protected base (src0) is refused."""
    gone = documents.where("creator = 3 AND knowledge_id <> 'src0'").select("document_id")
    kept = documents.join(gone, "document_id", "left_anti").select("document_id")
    stay = lambda df, name, key: df.join(kept, "document_id", "left_semi").select(F.lit(name).alias("tab"), F.col(key).alias("id"))
    return kept.select(F.lit("document").alias("tab"), F.col("document_id").alias("id")).unionByName(stay(paragraphs, "paragraph", "paragraph_id")).unionByName(stay(embeddings, "embedding", "id"))


@query("m26_move_to_folder", "v_document", "v_tag", sql="SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM v_tag WHERE key = 'toxic' AND value = '1') THEN 'quarantine' ELSE knowledge_id END AS folder FROM v_document")
def move_to_folder(documents: DataFrame, tags: DataFrame) -> DataFrame:
    chosen = tags.where("key = 'toxic' AND value = '1'").select("document_id", F.lit("quarantine").alias("to")).distinct()
    return documents.join(chosen, "document_id", "left").select("document_id", F.coalesce("to", "knowledge_id").alias("folder"))


@query("m27_grant_upsert", "v_grant", sql="""WITH c AS (SELECT user_id, target, arg_max(array_to_string(permission_list, ','), grant_id) AS level, max(grant_id) AS g FROM v_grant GROUP BY 1, 2) SELECT user_id, target, level FROM c WHERE level <> 'ROLE'""")
def grant_upsert(commands: DataFrame) -> DataFrame:
    """The last command per user and target wins; ROLE stands for revoke and deletes the row."""
    last = commands.groupBy("user_id", "target").agg(F.max_by("permission_list", "grant_id").alias("p"))
    return last.select("user_id", "target", F.array_join("p", ",").alias("level")).where("level <> 'ROLE'")


@query("m28_lineage_rebuild", "v_grant", sql="SELECT DISTINCT user_id, target FROM v_grant WHERE user_id <> 5 UNION SELECT 5, target FROM v_grant WHERE user_id = 6")
def lineage_rebuild(edges: DataFrame, source: int = 5) -> DataFrame:
    """All edges of one source are replaced by a new distinct set."""
    new = edges.where(F.col("user_id") == source + 1).select(F.lit(source).cast("bigint").alias("user_id"), "target")
    return edges.where(F.col("user_id") != source).select("user_id", "target").unionByName(new).distinct()


@query("m29_bundle_import", "v_document", "v_paragraph", sql="SELECT sha256('b1:' || d.document_id) AS document_key, sha256('b1:' || p.paragraph_id) AS paragraph_key, position FROM v_paragraph p JOIN v_document d USING (document_id)")
def bundle_import(documents: DataFrame, paragraphs: DataFrame, bundle: str = "b1") -> DataFrame:
    """Every id is made anew from the bundle's name and the old id, in children and parents alike."""
    key = lambda c: F.sha2(F.concat(F.lit(f"{bundle}:"), F.col(c).cast("string")), 256)
    ids = documents.select("document_id", key("document_id").alias("document_key"))
    return paragraphs.join(ids, "document_id").select("document_key", key("paragraph_id").alias("paragraph_key"), "position")
