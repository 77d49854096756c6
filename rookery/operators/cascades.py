"""Follow-on effects of lifecycle operations: what is mapped, withdrawn, re-keyed or dropped with the main rows. Each returns the rows that stay or are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .lifecycle import ORPHANS_SQL, orphans


def tagged(name: str, df: DataFrame, key: str) -> DataFrame:
    return df.select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("id"))


def together(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# questions are mapped to the documents whose number leaves the question's number when divided by 40
MAPPED_SQL = "mp AS (SELECT q.query_id, q.query, d.document_id, d.knowledge_id FROM v_query_text q JOIN v_document d ON d.document_id % 40 = q.query_id)"


def mapped(questions: DataFrame, documents: DataFrame) -> DataFrame:
    return questions.select("query_id", "query").join(documents.select("document_id", "knowledge_id", (F.col("document_id") % 40).alias("query_id")), "query_id")


@query("m03b_question_mapping", "v_query_text", "v_document", sql=f"WITH {MAPPED_SQL} SELECT DISTINCT sha256(knowledge_id || ':' || query) AS problem_id, document_id FROM mp")
def question_mapping(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """One question per knowledge base and content; a row for each document it is mapped to, made once however often it is asked for."""
    return mapped(questions, documents).select(F.sha2(F.concat_ws(":", "knowledge_id", "query"), 256).alias("problem_id"), "document_id").distinct()


@query("m04b_migrated_questions", "v_query_text", "v_document", sql=f"WITH {MAPPED_SQL} SELECT DISTINCT sha256(CASE WHEN knowledge_id = 'src1' THEN 'src2' ELSE knowledge_id END || ':' || query) AS problem_id, document_id, knowledge_id = 'src1' AND sha256('src2:' || query) NOT IN (SELECT sha256(knowledge_id || ':' || query) FROM mp WHERE knowledge_id = 'src2') AS created FROM mp")
def migrated_questions(questions: DataFrame, documents: DataFrame, source: str = "src1", target: str = "src2") -> DataFrame:
    """Questions of the moved documents are keyed anew by content in the target, where one that is there already is used."""
    rows = mapped(questions, documents)
    key = lambda kb: F.sha2(F.concat_ws(":", kb, F.col("query")), 256)
    there = rows.where(F.col("knowledge_id") == target).select(key(F.lit(target)).alias("problem_id"), F.lit(True).alias("there")).distinct()
    moved = rows.select(key(F.when(F.col("knowledge_id") == source, target).otherwise(F.col("knowledge_id"))).alias("problem_id"), "document_id", (F.col("knowledge_id") == source).alias("moved")).distinct()
    return moved.join(there, "problem_id", "left").select("problem_id", "document_id", (F.col("moved") & F.col("there").isNull()).alias("created"))


@query("m07b_filled_blanks", "v_candidate", sql="""WITH c AS (SELECT candidate_id, CASE WHEN candidate_id % 20 = 0 THEN ' ' ELSE phone END AS phone, CASE WHEN candidate_id % 30 = 0 THEN NULL ELSE email END AS email FROM v_candidate)
    SELECT p.candidate_id, coalesce(nullif(trim(p.phone), ''), s.phone, '') AS phone, coalesce(nullif(trim(p.email), ''), s.email, '') AS email FROM c p JOIN c s ON s.candidate_id = p.candidate_id + 3 WHERE p.candidate_id % 10 = 0""")
def filled_blanks(candidates: DataFrame) -> DataFrame:
    """Blank fields of the primary are filled from the secondary, others stay."""
    c = F.col("candidate_id")
    rows = candidates.select("candidate_id", F.when(c % 20 == 0, " ").otherwise(F.col("phone")).alias("phone"), F.when(c % 30 != 0, F.col("email")).alias("email"))
    second = rows.select((c - 3).alias("candidate_id"), F.col("phone").alias("phone2"), F.col("email").alias("email2"))
    fill = lambda f: F.coalesce(F.nullif(F.trim(f), F.lit("")), F.col(f"{f}2"), F.lit("")).alias(f)
    return rows.where(c % 10 == 0).join(second, "candidate_id").select("candidate_id", fill("phone"), fill("email"))


@query("m08b_erased_traces", "v_candidate", "v_application", "v_embedding", "v_agent_run", sql="""WITH g AS (SELECT candidate_id FROM v_candidate WHERE candidate_id % 5 = 0 AND candidate_id NOT IN (SELECT candidate_id FROM v_application WHERE status IN ('ACTIVE', 'HIRED')))
    SELECT 'index' AS tab, CAST(id AS STRING) AS id FROM v_embedding WHERE document_id NOT IN (SELECT * FROM g) UNION ALL SELECT 'log', CAST(id AS STRING) FROM v_agent_run WHERE id % 1000 NOT IN (SELECT * FROM g)""")
def erased_traces(candidates: DataFrame, applications: DataFrame, index: DataFrame, log: DataFrame) -> DataFrame:
    """Index and log rows that stay: those of erased candidates go with them."""
    held = applications.where("status IN ('ACTIVE', 'HIRED')").select("candidate_id")
    gone = candidates.where("candidate_id % 5 = 0").join(held, "candidate_id", "left_anti").select(F.col("candidate_id").alias("owner"))
    stay = lambda df, owner: df.withColumn("owner", owner).join(gone, "owner", "left_anti")
    return together(tagged("index", stay(index, F.col("document_id")), "id"), tagged("log", stay(log, F.col("id") % 1000), "id"))


@query("m10b_job_close_effects", "v_application", "v_proposal", sql="""WITH a AS (SELECT * FROM v_application WHERE job_id % 10 = 0), b AS (SELECT DISTINCT job_id FROM a WHERE status = 'ACTIVE' AND amount > 300000)
    SELECT 'event' AS tab, 'close-' || job_id || '-' || application_id AS id FROM a WHERE status = 'ACTIVE' UNION ALL SELECT 'offer', CAST(p.id AS STRING) FROM v_proposal p JOIN a ON target = application_id WHERE p.status = 'PENDING' UNION ALL SELECT 'blocker', CAST(job_id AS STRING) FROM b""")
def job_close_effects(applications: DataFrame, offers: DataFrame, large: float = 300_000) -> DataFrame:
    """Of the closed jobs: an event of a deterministic key for every active application, the open offers that are withdrawn, and, for the strict mode, the jobs that large active applications block."""
    closing = applications.where("job_id % 10 = 0")
    active = closing.where("status = 'ACTIVE'")
    events = active.select(F.concat_ws("-", F.lit("close"), "job_id", "application_id").alias("id"))
    withdrawn = offers.where("status = 'PENDING'").join(closing.select(F.col("application_id").alias("target")), "target", "left_semi")
    return together(tagged("event", events, "id"), tagged("offer", withdrawn, "id"), tagged("blocker", active.where(F.col("amount") > large).select("job_id").distinct(), "job_id"))


REASONS = {"REJECT": ["SKILLS", "CULTURE"], "WITHDRAW": ["OFFER", "PRIVATE"], "RESTORE": ["MISTAKE"]}


@query("m11b_terminal_commands", "v_application", "v_proposal", sql="""WITH c AS (SELECT id, target AS application_id, CASE action WHEN 'ADVANCE' THEN 'RESTORE' WHEN 'HOLD' THEN 'WITHDRAW' ELSE 'REJECT' END AS command, CASE id % 4 WHEN 0 THEN 'SKILLS' WHEN 1 THEN 'OFFER' WHEN 2 THEN 'MISTAKE' ELSE 'WEATHER' END AS reason FROM v_proposal),
    o AS (SELECT *, (command = 'REJECT' AND reason IN ('SKILLS', 'CULTURE')) OR (command = 'WITHDRAW' AND reason IN ('OFFER', 'PRIVATE')) OR (command = 'RESTORE' AND reason = 'MISTAKE') AS allowed FROM c), u AS (SELECT application_id, command, arg_min(reason, id) AS reason, arg_min(allowed, id) AS allowed FROM o GROUP BY 1, 2)
    SELECT application_id, command, CASE WHEN NOT allowed THEN 'REASON' WHEN a.application_id IS NULL THEN 'MISSING' WHEN (command = 'RESTORE') = (a.status = 'ACTIVE') OR a.status = 'HIRED' THEN 'STATE' ELSE 'APPLIED' END AS outcome,
    CASE WHEN NOT allowed OR a.application_id IS NULL OR (command = 'RESTORE') = (a.status = 'ACTIVE') OR a.status = 'HIRED' THEN a.status WHEN command = 'RESTORE' THEN 'ACTIVE' WHEN command = 'WITHDRAW' THEN 'WITHDRAWN' ELSE 'REJECTED' END AS status FROM u LEFT JOIN v_application a USING (application_id)""")
def terminal_commands(applications: DataFrame, commands: DataFrame) -> DataFrame:
    """Rejections, withdrawals and restores with their sets of allowed reasons: the first command per application and kind counts; only active rows can end, only ended ones be restored, hired ones stay."""
    command = F.when(F.col("action") == "ADVANCE", "RESTORE").when(F.col("action") == "HOLD", "WITHDRAW").otherwise("REJECT")
    reason = F.element_at(F.array(*[F.lit(r) for r in ("SKILLS", "OFFER", "MISTAKE", "WEATHER")]), (F.col("id") % 4 + 1).cast("int"))
    first = commands.select(F.col("target").alias("application_id"), command.alias("command"), reason.alias("reason"), "id").groupBy("application_id", "command").agg(F.min_by("reason", "id").alias("reason"))
    allowed = F.lit(False)
    for name, reasons in REASONS.items():
        allowed = allowed | ((F.col("command") == name) & F.col("reason").isin(*reasons))
    rows = first.withColumn("allowed", allowed).join(applications.select("application_id", F.col("status").alias("was")), "application_id", "left")
    wrong = ((F.col("command") == "RESTORE") == (F.col("was") == "ACTIVE")) | (F.col("was") == "HIRED")
    outcome = F.when(~F.col("allowed"), "REASON").when(F.col("was").isNull(), "MISSING").when(wrong, "STATE").otherwise("APPLIED")
    new = F.when(F.col("command") == "RESTORE", "ACTIVE").when(F.col("command") == "WITHDRAW", "WITHDRAWN").otherwise("REJECTED")
    return rows.select("application_id", "command", outcome.alias("outcome"), F.when(outcome == "APPLIED", new).otherwise(F.col("was")).alias("status"))


@query("m12b_retained_users", "v_usage", sql="""WITH k AS (SELECT * FROM v_usage WHERE create_time >= TIMESTAMP '2024-01-31 00:00:00' - (CASE WHEN application_id % 2 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 20 DAY END))
    SELECT 'user' AS tab, CAST(chat_user_id AS STRING) || '-' || application_id AS id FROM k WHERE chat_user_id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'file', CAST(id AS STRING) FROM v_usage WHERE id % 4 = 0 AND chat_id IN (SELECT chat_id FROM k)""")
def retained_users(usage: DataFrame, now: str = "2024-01-31") -> DataFrame:
    """Statistics of users and files that stay: those of chats without a record inside the cut-off of its application go. Every fourth record has a file."""
    days = F.when(F.col("application_id") % 2 == 0, 10).otherwise(20)
    kept = usage.where(F.col("create_time") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(days=days))
    users = kept.where("chat_user_id IS NOT NULL").select(F.concat_ws("-", "chat_user_id", "application_id").alias("id")).distinct()
    return together(tagged("user", users, "id"), tagged("file", usage.where("id % 4 = 0").join(kept.select("chat_id").distinct(), "chat_id", "left_semi"), "id"))


@query("m14b_orphan_traces", "v_document", "v_agent_run", "v_candidate", "v_embedding", sql=f"""WITH {ORPHANS_SQL} SELECT 'document' AS tab, CAST(document_id AS STRING) AS id FROM v_document WHERE document_id NOT IN (SELECT * FROM o)
    UNION ALL SELECT 'index', CAST(id AS STRING) FROM v_embedding WHERE document_id NOT IN (SELECT * FROM o) UNION ALL SELECT 'log', CAST(id AS STRING) FROM v_agent_run WHERE id // 2 NOT IN (SELECT * FROM o)
    UNION ALL SELECT 'audit', CAST(document_id AS STRING) FROM o""")
def orphan_traces(documents: DataFrame, log: DataFrame, owners: DataFrame, index: DataFrame) -> DataFrame:
    """Documents, index rows and log entries (two for each document) that stay when orphans go, and an audit entry for each orphan."""
    gone = orphans(documents, log, owners)
    entries = log.withColumn("document_id", F.floor(F.col("id") / 2))
    return together(*[tagged(tab, df.join(gone, "document_id", "left_anti"), key) for tab, df, key in (("document", documents, "document_id"), ("index", index, "id"), ("log", entries, "id"))], tagged("audit", gone, "document_id"))


@query("m16b_full_reset", "pages", "v_page_next", sql="SELECT url, 'remove' AS change FROM pages GROUP BY 1 UNION ALL SELECT url, 'insert' FROM v_page_next GROUP BY 1")
def full_reset(old: DataFrame, new: DataFrame) -> DataFrame:
    """All stored pages go, all pages of the new snapshot are inserted."""
    side = lambda df, change: df.select("url").distinct().withColumn("change", F.lit(change))
    return side(old, "remove").unionByName(side(new, "insert"))


@query("m17b_offboarding_order", "v_candidate", "v_application", "v_proposal", sql="""WITH c AS (SELECT candidate_id FROM v_candidate WHERE library_id = 7), a AS (SELECT application_id, status FROM v_application WHERE candidate_id IN (SELECT * FROM c)), p AS (SELECT id FROM v_proposal WHERE target IN (SELECT application_id FROM a))
    SELECT step, tab, ids, blockers FROM (SELECT 1 AS step, 'proposal' AS tab, (SELECT count(*) FROM p) AS ids, 0 AS blockers UNION ALL SELECT 2, 'application', (SELECT count(*) FROM a), (SELECT count(*) FROM a WHERE status = 'ACTIVE') UNION ALL SELECT 3, 'candidate', (SELECT count(*) FROM c), 0)""")
def offboarding_order(candidates: DataFrame, applications: DataFrame, proposals: DataFrame, tenant: int = 7) -> DataFrame:
    """Children before parents: for each table of the tenant its place in the order of deletion, the number of its rows and of those that block."""
    own = candidates.where(F.col("library_id") == tenant)
    rows = applications.join(own, "candidate_id", "left_semi")
    offers = proposals.join(rows.select(F.col("application_id").alias("target")), "target", "left_semi")
    row = lambda step, tab, df, blocked: df.agg(F.count("*").alias("ids"), F.count_if(blocked).alias("blockers")).select(F.lit(step).alias("step"), F.lit(tab).alias("tab"), "ids", "blockers")
    return together(row(1, "proposal", offers, F.lit(False)), row(2, "application", rows, F.col("status") == "ACTIVE"), row(3, "candidate", own, F.lit(False)))


@query("m17c_offboarding_frames", "v_candidate", "v_application", "v_proposal", "v_membership", sql="""WITH c AS (SELECT candidate_id FROM v_candidate WHERE library_id = 7), a AS (SELECT application_id FROM v_application WHERE candidate_id IN (SELECT * FROM c)), p AS (SELECT id FROM v_proposal WHERE target IN (SELECT * FROM a))
    SELECT 'candidate' AS tab, CAST(candidate_id AS STRING) AS id, CASE WHEN library_id = 7 THEN 'delete' ELSE 'keep' END AS fate FROM v_candidate UNION ALL SELECT 'application', CAST(application_id AS STRING), CASE WHEN application_id IN (SELECT * FROM a) THEN 'delete' ELSE 'keep' END FROM v_application
    UNION ALL SELECT 'proposal', CAST(id AS STRING), CASE WHEN id IN (SELECT * FROM p) THEN 'delete' ELSE 'keep' END FROM v_proposal UNION ALL SELECT 'membership', library_id || '-' || candidate_id, CASE WHEN candidate_id IN (SELECT * FROM c) THEN 'delete' ELSE 'keep' END FROM v_membership""")
def m17c(candidates: DataFrame, applications: DataFrame, proposals: DataFrame, membership: DataFrame) -> DataFrame:
    frames = offboarding_frames(candidates, applications, proposals, membership)
    return together(*[tagged(tab, df.withColumn("fate", F.lit(fate)), key).withColumn("fate", F.lit(fate)) for (tab, fate), (df, key) in frames.items()])


def offboarding_frames(candidates: DataFrame, applications: DataFrame, proposals: DataFrame, membership: DataFrame, tenant: int = 7) -> dict[tuple[str, str], tuple[DataFrame, str]]:
    """(table, delete or keep): its rows and key. The rows of a tenant are the closure of its candidates; what is deleted and what is kept make up each table."""
    own = candidates.where(F.col("library_id") == tenant)
    applied = applications.join(own, "candidate_id", "left_semi").select(F.col("application_id").alias("target"))
    member = membership.withColumn("member", F.concat_ws("-", F.col("library_id").cast("string"), F.col("candidate_id").cast("string")))
    sides = {
        "candidate": (candidates, own.select("candidate_id"), "candidate_id", "candidate_id"), "application": (applications, own.select("candidate_id"), "candidate_id", "application_id"),
        "proposal": (proposals, applied, "target", "id"), "membership": (member, own.select("candidate_id"), "candidate_id", "member"),
    }
    return {(tab, fate): (df.join(ids, on, how), key) for tab, (df, ids, on, key) in sides.items() for fate, how in (("delete", "left_semi"), ("keep", "left_anti"))}


@query("m20b_pruned_tree", "v_folder", "v_grant", sql="""WITH RECURSIVE t AS (SELECT id, id AS ancestor FROM v_folder UNION ALL SELECT t.id, f.parent_id FROM t JOIN v_folder f ON f.id = t.ancestor WHERE f.parent_id IS NOT NULL), g AS (SELECT DISTINCT 's' || user_id AS id FROM v_grant WHERE list_contains(permission_list, 'MANAGE') AND user_id % 3 = 0),
    d AS (SELECT id FROM t WHERE ancestor IN ('n3', 'n4')) SELECT DISTINCT ancestor AS id FROM t WHERE id IN (SELECT id FROM g) AND ancestor NOT IN (SELECT id FROM d) AND id NOT IN (SELECT id FROM d)""")
def pruned_tree(folders: DataFrame, grants: DataFrame, deleted: tuple[str, ...] = ("n3", "n4")) -> DataFrame:
    """Folders that a user may see: those granted to the user and all above them; deleted folders are gone with everything below."""
    from .lifecycle import folder_closure

    closure = folder_closure(folders)
    gone = closure.where(F.col("ancestor").isin(*deleted)).select("id").distinct()
    seen = grants.where(F.array_contains("permission_list", "MANAGE") & (F.col("user_id") % 3 == 0)).select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id")).distinct()
    return closure.join(seen, "id", "left_semi").join(gone, "id", "left_anti").select(F.col("ancestor").alias("id")).distinct().join(gone, "id", "left_anti")


@query("m25b_cascade_orphans", "v_document", "v_query_text", "v_tag", "v_grant", sql=f"""WITH {MAPPED_SQL}, k AS (SELECT document_id FROM v_document WHERE NOT (creator = 3 AND knowledge_id <> 'src0')) SELECT 'map' AS tab, query_id || '-' || document_id AS id FROM mp WHERE document_id IN (SELECT * FROM k)
    UNION ALL SELECT DISTINCT 'question', CAST(query_id AS STRING) FROM mp WHERE document_id IN (SELECT * FROM k) UNION ALL SELECT 'tag', CAST(tag_id AS STRING) FROM v_tag WHERE document_id IN (SELECT * FROM k)
    UNION ALL SELECT 'grant', CAST(grant_id AS STRING) FROM v_grant WHERE target NOT IN (SELECT document_id FROM v_document) OR target IN (SELECT * FROM k)""")
def cascade_orphans(documents: DataFrame, questions: DataFrame, tags: DataFrame, grants: DataFrame) -> DataFrame:
    """What stays beside the documents: mappings, questions that still have one, tags, and grants (those on objects that are no documents are not touched)."""
    gone = documents.where("creator = 3 AND knowledge_id <> 'src0'").select("document_id")
    maps = mapped(questions, documents).join(gone, "document_id", "left_anti")
    live = documents.join(gone, "document_id", "left_anti").select("document_id")
    return together(
        tagged("map", maps.select(F.concat_ws("-", "query_id", "document_id").alias("id")), "id"), tagged("question", maps.select("query_id").distinct(), "query_id"), tagged("tag", tags.join(live, "document_id", "left_semi"), "tag_id"),
        tagged("grant", grants.join(gone.select(F.col("document_id").alias("target")), "target", "left_anti"), "grant_id"))


@query("m29b_bundle_links", "v_document", "v_query_text", "v_tag", sql=f"""WITH {MAPPED_SQL} SELECT 'tag' AS tab, sha256('b1:' || document_id) AS document_key, sha256('b1:' || key || '=' || value) AS id FROM v_tag WHERE document_id IN (SELECT document_id FROM v_document)
    UNION ALL SELECT 'question', sha256('b1:' || document_id), sha256('b1:' || query) FROM mp""")
def bundle_links(documents: DataFrame, questions: DataFrame, tags: DataFrame, bundle: str = "b1") -> DataFrame:
    """Tags and questions of an imported bundle, re-linked to the new keys; equal ones share a key."""
    key = lambda c: F.sha2(F.concat(F.lit(f"{bundle}:"), c.cast("string")), 256)
    document = key(F.col("document_id")).alias("document_key")
    own = tags.join(documents.select("document_id"), "document_id", "left_semi").select(F.lit("tag").alias("tab"), document, key(F.concat_ws("=", "key", "value")).alias("id"))
    return own.unionByName(mapped(questions, documents).select(F.lit("question").alias("tab"), document, key(F.col("query")).alias("id")))
