"""Sinks and export shapes. Writers say where they wrote; the registered queries read the files back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.windows import global_numbers, numbered
from ..registry import query
from .files import csv_read, csv_written, fresh, placed, written


def write_in_key_order(df: DataFrame, key: str, path: str, partitions: int | None = None) -> None:
    """Full export in key order, in parallel: ranges of the key, each sorted."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.parquet(path)


@query("s03_key_order_export", "v_application", sql="SELECT application_id, candidate_id, status, row_number() OVER (ORDER BY application_id) - 1 AS position FROM v_application")
def key_order(applications: DataFrame) -> DataFrame:
    """The rows of the written files with the place that each has in them."""
    spark = applications.sparkSession
    path = fresh(spark, "applications")
    write_in_key_order(applications.select("application_id", "candidate_id", "status"), "application_id", path)
    rows = spark.read.parquet(path).select("application_id", "candidate_id", "status", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return placed(rows).select("application_id", "candidate_id", "status", "position")


# Labels of votes, and what stands between referenced paragraphs and between the nodes they come from.
VOTES = {"-1": "未投票", "0": "赞同", "1": "反对"}
BETWEEN_PARAGRAPHS, BETWEEN_NODES = "\n**********\n", "\n----------\n"
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
PARAGRAPHS = "array<struct<title: string, content: string>>"
DETAILS = f"array<struct<id: string, type: string, step_type: string, name: string, answer: string, paragraph_list: {PARAGRAPHS}>>"


def conversation_rows(records: DataFrame) -> DataFrame:
    """The 17 columns of the export, one row per record, all safe to open in a spreadsheet.

    ``records``: chat_id, abstract, problem_text, answer_text, vote_status, vote_reason, vote_other, details (JSON list of nodes), improved (JSON list of
    paragraphs), asker (JSON), message_tokens, answer_tokens, ip_address, source (JSON), run_time, create_time.
    """
    nodes = F.from_json("details", DETAILS)
    search = F.filter(nodes, lambda n: n["type"].isin("search-dataset-node", "search-knowledge-node") | (F.coalesce(n["step_type"], F.lit("")) == "search_step"))
    named = lambda n, value, glue: F.when(n["id"] == "search_step", value).otherwise(F.concat(n["name"], F.lit(glue), value))
    paragraphs = lambda n: F.coalesce(n["paragraph_list"], F.array().cast(PARAGRAPHS))
    listed = lambda n: F.array_join(F.transform(paragraphs(n), lambda p: F.concat(p["title"], F.lit(":\n"), p["content"])), BETWEEN_PARAGRAPHS)
    asked = F.transform(F.filter(nodes, lambda n: n["type"] == "question-node"), lambda n: F.coalesce(n["answer"], F.lit("")))
    improved = F.transform(F.from_json("improved", PARAGRAPHS), lambda p: F.concat(p["title"], F.lit("\n"), p["content"]))
    votes = F.create_map(*[F.lit(x) for kv in VOTES.items() for x in kv])
    columns = {
        "conversation": F.col("chat_id").cast("string"), "summary": F.col("abstract"), "question": F.col("problem_text"), "optimised": F.array_join(asked, " "), "answer": F.col("answer_text"),
        "feedback": F.try_element_at(votes, F.col("vote_status").cast("string")), "reason": F.col("vote_reason"), "other_reason": F.col("vote_other"),
        "reference_counts": F.array_join(F.transform(search, lambda n: named(n, F.size(paragraphs(n)).cast("string"), ":")), "\n"),
        "references": F.array_join(F.transform(search, lambda n: named(n, listed(n), ":\n")), BETWEEN_NODES), "annotation": F.array_join(F.coalesce(improved, F.array().cast("array<string>")), "\n"),
        "user": F.get_json_object("asker", "$.username"), "tokens": F.coalesce("message_tokens", F.lit(0)) + F.coalesce("answer_tokens", F.lit(0)), "ip_address": F.coalesce("ip_address", F.lit("-")),
        "source": F.coalesce(F.get_json_object("source", "$.type"), F.lit("-")), "run_time": F.col("run_time"), "asked_at": F.date_format("create_time", "yyyy-MM-dd HH:mm:ss"),
    }
    safe = lambda name, c: c if name in ("tokens", "run_time") else T.guarded_cell(F.regexp_replace(c, ILLEGAL, ""))
    return records.select(*[safe(name, c).alias(name) for name, c in columns.items()])


@query("s16_conversation_export", "v_turn", "v_usage", sql="""WITH u AS (SELECT id, any_value(vote_status) AS vote_status, any_value(message_tokens) AS mt, any_value(answer_tokens) AS ant, any_value(asker) AS asker, any_value(create_time) AS ct FROM v_usage GROUP BY 1),
    r AS (SELECT t.*, u.*, CASE turn % 4 WHEN 0 THEN '=' || question WHEN 1 THEN '-' || question ELSE question END AS q FROM v_turn t LEFT JOIN u ON u.id = t.conv_id * 7 + t.turn)
    SELECT CAST(conv_id AS STRING) AS conversation, substring(answer, 1, 20) AS summary, CASE WHEN regexp_matches(q, '^[=+@-]') THEN chr(39) || q ELSE q END AS question, CASE WHEN turn % 2 = 0 THEN 'better ' || conv_id ELSE '' END AS optimised, answer,
    CASE vote_status WHEN -1 THEN '未投票' WHEN 0 THEN '赞同' WHEN 1 THEN '反对' END AS feedback, CASE WHEN vote_status = 1 THEN 'other' END AS reason, CASE WHEN vote_status = 1 THEN chr(39) || '@none' END AS other_reason,
    '2' || CASE WHEN turn % 3 = 0 THEN chr(10) || 'base:1' WHEN turn % 3 = 1 THEN chr(10) || 'base:0' ELSE '' END AS reference_counts,
    't1:' || chr(10) || conv_id || chr(10) || '**********' || chr(10) || 't2:' || chr(10) || turn || CASE WHEN turn % 3 = 0 THEN chr(10) || '----------' || chr(10) || 'base:' || chr(10) || 't3:' || chr(10) || 'c' WHEN turn % 3 = 1 THEN chr(10) || '----------' || chr(10) || 'base:' || chr(10) ELSE '' END AS "references",
    CASE WHEN turn % 4 = 2 THEN 'i1' || chr(10) || conv_id || chr(10) || 'i2' || chr(10) || 'x' ELSE '' END AS annotation, asker AS user, coalesce(mt, 0) + coalesce(ant, 0) AS tokens, CASE WHEN turn % 2 = 0 THEN '10.0.0.1' ELSE chr(39) || '-' END AS ip_address, CASE WHEN turn % 5 = 0 THEN chr(39) || '-' ELSE 'ONLINE' END AS source,
    turn / 2.0::DOUBLE AS run_time, strftime(ct, '%Y-%m-%d %H:%M:%S') AS asked_at FROM r""")
def conversation_export(turns: DataFrame, usage: DataFrame) -> DataFrame:
    """Records with details of several kinds, exported to CSV files and read back."""
    use = usage.select("id", "vote_status", "message_tokens", "answer_tokens", F.col("asker").alias("who"), "create_time")
    t, text = F.col("turn"), lambda c: F.col(c).cast("string")
    node = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    paragraphs = lambda *pairs: F.array(*[F.struct(a.alias("title"), b.alias("content")) for a, b in pairs])
    step = node(id=F.lit("search_step"), type=F.lit(""), step_type=F.lit("search_step"), paragraph_list=paragraphs((F.lit("t1"), text("conv_id")), (F.lit("t2"), text("turn"))))
    base = node(id=F.lit("n2"), type=F.lit("search-knowledge-node"), name=F.lit("base"), paragraph_list=F.when(t % 3 == 0, paragraphs((F.lit("t3"), F.lit("c")))))
    asked = node(id=F.lit("n3"), type=F.lit("question-node"), answer=F.concat(F.lit("better "), text("conv_id")))
    details = F.concat(F.lit("["), F.concat_ws(",", step, F.when(t % 3 < 2, base), F.when(t % 2 == 0, asked)), F.lit("]"))
    records = turns.join(use, F.col("id") == F.col("conv_id") * 7 + t, "left").select(
        F.col("conv_id").alias("chat_id"), F.left("answer", F.lit(20)).alias("abstract"), F.concat(F.when(t % 4 == 0, "=").when(t % 4 == 1, "-").otherwise(""), "question").alias("problem_text"), F.col("answer").alias("answer_text"),
        "vote_status", F.when(F.col("vote_status") == 1, "other").alias("vote_reason"), F.when(F.col("vote_status") == 1, "@none").alias("vote_other"), details.alias("details"),
        F.when(t % 4 == 2, F.to_json(paragraphs((F.lit("i1"), text("conv_id")), (F.lit("i2"), F.lit("x"))))).alias("improved"), F.to_json(F.struct(F.col("who").alias("username"))).alias("asker"), "message_tokens", "answer_tokens",
        F.when(t % 2 == 0, "10.0.0.1").alias("ip_address"), F.when(t % 5 != 0, '{"type":"ONLINE"}').alias("source"), (t / 2.0).cast("double").alias("run_time"), "create_time")
    rows = conversation_rows(records)
    read = csv_read(turns.sparkSession, csv_written(rows, "conversations"), rows.columns)
    return read.withColumns({"tokens": F.col("tokens").cast("bigint"), "run_time": F.col("run_time").cast("double")})


#: Folders that exported sheets are dealt into.
FOLDERS = 64


def sheet_names(documents: DataFrame, longest: int = 29) -> DataFrame:
    """document_id and a sheet name of its own: the trimmed name, cut, or Sheet where it cannot be one; a repeated one gets a number from 1."""
    name = F.left(F.trim(F.coalesce("name", F.lit(""))), F.lit(longest))
    name = F.when((name == "") | name.rlike(r"[\[\]:*?/\\]"), "Sheet").otherwise(F.trim(name))
    placed = global_numbers(documents.select("document_id", name.alias("base")), ["base", "document_id"], "place")  # many documents may share a name
    named = placed.join(placed.groupBy("base").agg(F.min("place").alias("first")), "base").withColumn("k", F.col("place") - F.col("first") + 1)
    return named.select("document_id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", (F.col("k") - 1).cast("string"))).alias("sheet"))


@query("s17_knowledge_export", "v_document", "v_paragraph", "v_query_text", sql="""WITH b AS (SELECT document_id, CASE WHEN document_id % 7 = 0 THEN 'Sheet' WHEN document_id % 5 = 0 THEN 'same name' ELSE substring(name, 1, 29) END AS base FROM v_document),
    u AS (SELECT document_id, base, row_number() OVER (PARTITION BY base ORDER BY document_id) AS k FROM b), s AS (SELECT document_id, CASE WHEN k = 1 THEN base ELSE base || (k - 1) END AS sheet FROM u),
    q AS (SELECT paragraph_id, string_agg(query, chr(10) ORDER BY query_id) AS questions FROM v_query_text JOIN v_paragraph ON document_id % 40 = query_id AND position % 3 = 1 GROUP BY 1)
    SELECT s.sheet, coalesce(p.position, 0) AS position, CASE WHEN p.position % 2 = 0 THEN chr(65279) || '=' || p.content ELSE coalesce(CASE WHEN regexp_matches(p.content, '^[=+@-]') THEN chr(65279) || p.content ELSE p.content END, '') END AS content, coalesce(questions, '') AS questions
    FROM s LEFT JOIN v_paragraph p USING (document_id) LEFT JOIN q ON q.paragraph_id = p.paragraph_id""")
def knowledge_export(documents: DataFrame, paragraphs: DataFrame, questions: DataFrame) -> DataFrame:
    """Paragraphs with their newline-joined questions, by document under its sheet name, dealt into FOLDERS folders; documents without paragraphs stay."""
    d = F.col("document_id")
    named = sheet_names(documents.select("document_id", F.when(d % 7 == 0, "a/b").when(d % 5 == 0, "  same name ").otherwise(F.col("name")).alias("name")))
    asked = questions.join(paragraphs.where("position % 3 = 1"), F.col("query_id") == d % 40).groupBy("paragraph_id").agg(F.array_sort(F.collect_list(F.struct("query_id", "query"))).alias("l"))
    cells = paragraphs.withColumn("content", F.when(F.col("position") % 2 == 0, F.concat(F.lit("="), "content")).otherwise(F.col("content")))
    rows = named.join(cells.select("document_id", "paragraph_id", "position", "content"), "document_id", "left").join(asked, "paragraph_id", "left")
    guarded = F.when(F.col("content").rlike(r"^[=+\-@]"), F.concat(F.lit("﻿"), "content")).otherwise(F.coalesce("content", F.lit("")))
    out = rows.select("sheet", F.coalesce("position", F.lit(0)).alias("position"), F.regexp_replace(guarded, ILLEGAL, "").alias("content"), F.coalesce(F.array_join(F.transform("l", lambda x: x["query"]), "\n"), F.lit("")).alias("questions"))
    folder = F.pmod(F.xxhash64("sheet"), F.lit(FOLDERS)).cast("int")
    path = written(out.withColumn("folder", folder).repartition("folder", "sheet").sortWithinPartitions("folder", "sheet", "position"), "json", "sheets", ["folder"])
    return documents.sparkSession.read.schema("position bigint, content string, questions string, sheet string").json(path).select("sheet", "position", "content", "questions")


def workspace_tables(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Every table of a tenant as JSON lines in a folder of its own: secrets are redacted by the name of their column, times are ISO texts."""
    paths = {}
    for name, rows in tables.items():
        columns = []
        for f in rows.schema:
            c = F.col(f.name)
            if f.name.lower() in T.SECRET_KEYS:
                c = F.when((c != "") & c.isNotNull(), F.lit(T.REDACTED)).otherwise(c.cast("string"))
            elif f.dataType.typeName() in ("timestamp", "timestamp_ntz"):
                c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            elif f.dataType.typeName() in ("date", "decimal"):
                c = c.cast("string")
            columns.append(c.alias(f.name))
        paths[name] = written(rows.select(*columns), "json", f"workspace-{name}")
    return paths


@query("s18_workspace_export", "v_candidate", "v_application", "v_library", "v_membership", "v_proposal", sql="""SELECT 'candidate' AS tab, candidate_id AS id, name, CASE WHEN candidate_id % 3 = 0 THEN '' ELSE '***REDACTED***' END AS api_key, NULL AS created FROM v_candidate WHERE library_id = 7
    UNION ALL SELECT 'application', application_id, a.status, NULL, strftime(create_time, '%Y-%m-%dT%H:%M:%S') FROM v_application a WHERE candidate_id IN (SELECT candidate_id FROM v_candidate WHERE library_id = 7)
    UNION ALL SELECT 'candidate_label', candidate_id, segment, NULL, NULL FROM v_candidate WHERE library_id = 7 UNION ALL SELECT 'library', library_id, name, NULL, NULL FROM v_library WHERE library_id = 7 UNION ALL SELECT 'membership', candidate_id, CAST(library_id AS STRING), NULL, NULL FROM v_membership WHERE candidate_id IN (SELECT candidate_id FROM v_candidate WHERE library_id = 7)
    UNION ALL SELECT 'proposal', id, action, NULL, strftime(create_time, '%Y-%m-%dT%H:%M:%S') FROM v_proposal WHERE target IN (SELECT application_id FROM v_application WHERE candidate_id IN (SELECT candidate_id FROM v_candidate WHERE library_id = 7))""")
def workspace_export(candidates: DataFrame, applications: DataFrame, libraries: DataFrame, membership: DataFrame, proposals: DataFrame, tenant: int = 7) -> DataFrame:
    """All tables that hold rows of one tenant, written and read back."""
    spark, own = candidates.sparkSession, candidates.where(F.col("library_id") == tenant)
    keys = own.withColumn("api_key", F.when(F.col("candidate_id") % 3 == 0, "").otherwise(F.col("phone")))
    applied = applications.join(own, "candidate_id", "left_semi")
    paths = workspace_tables({
        "candidate": keys.select(F.col("candidate_id").alias("id"), "name", "api_key"), "candidate_label": own.select(F.col("candidate_id").alias("id"), F.col("segment").alias("name")),
        "application": applied.select(F.col("application_id").alias("id"), F.col("status").alias("name"), F.col("create_time").alias("created")), "library": libraries.where(F.col("library_id") == tenant).select(F.col("library_id").alias("id"), "name"),
        "membership": membership.join(own, "candidate_id", "left_semi").select(F.col("candidate_id").alias("id"), F.col("library_id").cast("string").alias("name")),
        "proposal": proposals.join(applied.select(F.col("application_id").alias("target")), "target", "left_semi").select("id", F.col("action").alias("name"), F.col("create_time").alias("created")),
    })
    parts = [spark.read.schema("id bigint, name string, api_key string, created string").json(path).select(F.lit(tab).alias("tab"), "id", "name", "api_key", "created") for tab, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def logged(entries: DataFrame, path: str | None = None) -> str:
    """Appends entries to a log, a new one where none is named."""
    return written(entries, "parquet", "flow-log", append_to=path)


@query("s19_flow_log", "v_agent_run", sql="SELECT id, agent_type, status FROM (SELECT *, row_number() OVER (PARTITION BY agent_type ORDER BY create_time, id) AS n FROM v_agent_run) WHERE n <= 200")
def flow_log(log: DataFrame, limit: int = 200) -> DataFrame:
    """The log is written in two appends; read are the first entries of each object in time order."""
    entries = log.select("id", "agent_type", "status", "create_time")
    path = logged(entries.where("id % 2 = 1"), logged(entries.where("id % 2 = 0")))
    rows = log.sparkSession.read.schema(entries.schema).parquet(path)
    return rows.withColumn("n", numbered("agent_type", order=["create_time", "id"])).where(F.col("n") <= limit).select("id", "agent_type", "status")


@query("s20_candidate_export", "v_candidate", sql="SELECT name, status, round(balance, 2) AS balance FROM v_candidate")
def candidate_export(candidates: DataFrame) -> DataFrame:
    """Columns without personal data only, as CSV files."""
    path = csv_written(candidates.select("name", "status", F.round("balance", 2).alias("balance")), "candidate-export")
    return csv_read(candidates.sparkSession, path, ["name", "status", "balance"]).withColumn("balance", F.col("balance").cast("double"))


@query("s21_term_export", "v_query_text", sql="SELECT DISTINCT trim(l) AS content FROM (SELECT unnest(string_split(t, chr(10))) AS l FROM (SELECT unnest(string_split(query, ' ')) AS t FROM v_query_text)) WHERE trim(l) <> ''")
def term_export(texts: DataFrame) -> DataFrame:
    """One term a line, last first, as text files; the import reads lines, trims them, and leaves out blank and repeated ones."""
    terms = texts.select(F.explode(F.split("query", " ")).alias("value")).distinct().repartitionByRange(F.desc("value")).sortWithinPartitions(F.desc("value"))
    read = texts.sparkSession.read.text(written(terms, "text", "terms"))
    return read.select(F.trim("value").alias("content")).where("content <> ''").distinct()


@query("s22_run_manifest", "v_agent_run", sql="SELECT agent_type, count(*) AS runs, count(*) FILTER (status = 'FAILED') AS failed FROM v_agent_run GROUP BY 1")
def run_manifest(runs: DataFrame) -> DataFrame:
    """A report as one JSON file, read back."""
    report = runs.groupBy("agent_type").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    path = written(report.coalesce(1), "json", "manifest")
    return runs.sparkSession.read.schema("agent_type string, runs bigint, failed bigint").json(path)
