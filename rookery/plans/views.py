"""Views over the driver's tables that stand for documents, paragraphs, usage records, candidates and so on.

Spark and DuckDB share the text where their dialects agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_BOTH = {
    # status: a state digit per task, right-aligned (task 1 is the last digit); short strings lack the higher tasks
    "v_document": """SELECT d.doc_id AS document_id, d.source AS knowledge_id, concat(d.source, '-', d.doc_id) AS name, d.text AS content, d.lang,
        coalesce(l.toxic, 0) <> 1 AS is_active, d.doc_id % 9 AS creator, CASE WHEN d.doc_id % 4 = 0 THEN CAST(d.doc_id % 6 AS STRING)
        ELSE concat(CAST(d.doc_id % 5 AS STRING), CAST(d.doc_id % 4 AS STRING), CAST(d.doc_id % 6 AS STRING)) END AS status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_embedding": """SELECT vec_id AS id, label AS knowledge_id, CAST(floor(vec_id / 4) AS BIGINT) AS paragraph_id,
        CAST(floor(vec_id / 16) AS BIGINT) AS document_id, vec_id % 2 AS source_type, embedding, vec_id % 11 <> 0 AS is_active FROM embeddings""",
    "v_query_vec": "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0",
    "v_tag": "SELECT doc_id AS document_id, 'quality' AS key, CAST(quality AS STRING) AS value, doc_id * 2 AS tag_id FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS STRING), doc_id * 2 + 1 FROM labels",
    "v_turn": """SELECT conv_id, turn, text AS question, answer FROM (SELECT conv_id, turn, role, text,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) t
        WHERE role = 'user' AND next_role = 'assistant'""",
    "v_usage": """SELECT event_id AS id, user_id * 100 + day(ts) AS chat_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS chat_user_id, event_id % 3 AS chat_user_type,
        event_id % 20 AS application_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE -1 END AS vote_status,
        CAST(floor(value) AS BIGINT) AS message_tokens, event_id % 50 AS answer_tokens, ts AS create_time, props,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('user', user_id) END AS asker FROM events""",
    "v_agent_run": """SELECT event_id AS id, event_type AS agent_type, CASE event_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'SKIPPED' ELSE 'SUCCEEDED' END AS status,
        CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(floor(value) AS BIGINT) AS tokens, ts AS create_time, props FROM events""",
    "v_proposal": """SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_orderkey AS target, l_partkey AS part, CASE l_returnflag WHEN 'A' THEN 'ADVANCE' WHEN 'N' THEN 'HOLD' ELSE 'DECLINE' END AS action,
        CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN 'PENDING' WHEN l_linestatus = 'O' THEN 'ACCEPTED' WHEN l_linenumber % 3 = 0 THEN 'EXPIRED' ELSE 'DISMISSED' END AS status,
        CASE l_linenumber % 3 WHEN 0 THEN 'SCREENING' WHEN 1 THEN 'SOURCING' ELSE 'COPILOT' END AS agent_type,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_quantity * 2) AS BIGINT) END AS score, l_shipdate AS create_time FROM lineitem""",
    "v_candidate": """SELECT c_custkey AS candidate_id, c_name AS name, concat('138', lpad(CAST(c_custkey % 140 AS STRING), 8, '0')) AS phone,
        CASE WHEN c_custkey % 2 = 0 THEN concat('u', c_custkey % 120, '@example.org') ELSE concat('U', c_custkey % 120, '@Example.org') END AS email,
        c_nationkey AS library_id, CASE WHEN c_custkey % 13 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, c_acctbal AS balance, c_mktsegment AS segment FROM customer""",
    "v_application": """SELECT o_orderkey AS application_id, o_custkey AS candidate_id, o_orderkey % 200 AS job_id,
        CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'REJECTED' ELSE 'HIRED' END AS status, substring(o_orderpriority, 1, 1) AS stage,
        CASE WHEN o_orderkey % 3 = 0 THEN 'REFERRAL' ELSE 'SITE' END AS channel, o_orderkey % 7 AS owner_id, o_totalprice AS amount, o_orderdate AS create_time FROM orders""",
    "v_library": "SELECT n_nationkey AS library_id, n_name AS name, n_regionkey AS region_id FROM nation",
    "v_membership": "SELECT CAST(c_nationkey AS BIGINT) AS library_id, c_custkey AS candidate_id FROM customer UNION ALL SELECT CAST(-1 AS BIGINT), c_custkey FROM customer",
    "v_folder": """SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name FROM region
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation
        UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name FROM supplier""",
    "v_resume_text": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('姓名： ', right(c_name, 4), '；phone +86-1380000', right(c_name, 4), ' mail u', c_custkey, '@mail.example.org')
        WHEN 1 THEN concat('王小明', chr(10), '1390000', right(c_name, 4)) WHEN 2 THEN concat('contact: a.b+', c_custkey, '@x-y.org, none') ELSE '' END AS text FROM customer""",
    "v_slot_query": """SELECT p_partkey AS query_id, concat(CASE p_size % 3 WHEN 0 THEN concat(p_size, ' 年以上') WHEN 1 THEN concat('20', lpad(CAST(p_size AS STRING), 2, '0'), '年毕业 ') ELSE '' END,
        CASE p_partkey % 5 WHEN 0 THEN '本科' WHEN 1 THEN '硕士' WHEN 2 THEN '大专' WHEN 3 THEN '硕士博士' ELSE '' END, '  ', p_name, ' ',
        CASE p_partkey % 4 WHEN 0 THEN 'NIGERIA' WHEN 1 THEN 'NIGER市 CHINA' WHEN 2 THEN 'PERU' ELSE '' END) AS query FROM part""",
    "v_secret_json": """SELECT event_id AS id, concat(chr(123), '"', CASE event_id % 4 WHEN 0 THEN 'api_key' WHEN 1 THEN 'Password' WHEN 2 THEN 'note' ELSE 'token' END, '":"', CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END,
        '","text":"', repeat(event_type, CAST(event_id % 90 AS INT)), '"', chr(125)) AS body FROM events""",
    "v_page_next": """SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN concat(html, '<!-- edited -->') ELSE html END AS html FROM pages WHERE page_id % 7 <> 0
        UNION ALL SELECT page_id + 1000000000, concat(url, '&new=', page_id), html FROM pages WHERE page_id % 11 = 0""",
}
# lines of a text as a resume has them: bracket headings, bullets, blank lines
_LINE = """CASE WHEN i % 9 = 4 THEN concat('【', substring(line, 1, 10), '】') WHEN i % 11 = 0 OR (i = 1 AND doc_id % 3 = 0) THEN '' WHEN position(', ' IN line) > 0 THEN concat('- ', line) ELSE line END AS content"""
_SPARK = {
    "v_resume_line": rf"""SELECT doc_id AS document_id, CAST(i AS BIGINT) AS position, {_LINE} FROM (SELECT doc_id, pos + 1 AS i, line FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM documents) u) t""",
    # documents with headings of two levels among their lines
    "v_headed_document": r"""SELECT doc_id AS document_id, array_join(transform(filter(split(text, '\n'), x -> trim(x) <> ''), (x, i) -> CASE WHEN i % 9 = 4 THEN concat('# ', left(x, 10)) WHEN i % 5 = 2 THEN concat('## ', left(x, 12)) ELSE x END), '\n') AS content FROM documents""",
    "v_skill_list": """SELECT p_partkey AS id, concat(split(p_name, ' '), array(upper(p_name), concat(' ', p_name, '， '), 'x', concat('熟悉', p_type), p_type, p_brand, concat('"', p_brand, '"')),
        CASE WHEN p_partkey % 10 = 0 THEN transform(sequence(1, 20), i -> concat('skill', i)) ELSE CAST(array() AS array<string>) END) AS skills FROM part""",
    "v_keyword_query": r"""SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN array_join(slice(w, 1, 6), ' ') WHEN 1 THEN concat('"', w[0], ' ', w[1], '" ', w[2]) WHEN 2 THEN concat(w[0], ' ', w[1], ' --', w[5])
        ELSE concat(w[0], ' ', w[1], ' OR ', w[2], ' ', w[3]) END AS query FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-zß-öø-ÿ0-9]+', 0) AS w FROM benchmark) t WHERE size(w) > 5""",
    "v_term": "SELECT explode(split(p_name, ' ')) AS term FROM part",
    "v_kb_term": "SELECT concat('src', item_id % 20) AS knowledge_id, lower(array_join(slice(split(text, ' '), 1, 2), ' ')) AS term FROM benchmark",
    "v_paragraph": r"""SELECT doc_id * 10000000 + pos + 1 AS paragraph_id, doc_id AS document_id, source AS knowledge_id, CAST(pos + 1 AS BIGINT) AS position, line AS content
        FROM (SELECT doc_id, source, posexplode(split(text, '\n')) AS (pos, line) FROM documents) t WHERE trim(line) <> ''""",
    "v_query_text": "SELECT item_id AS query_id, array_join(slice(split(text, ' '), 1, 6), ' ') AS query, text FROM benchmark",
    "v_job": "SELECT p_partkey AS job_id, split(p_name, ' ') AS skills, p_brand AS department, p_type AS city, p_size AS level, p_name AS title FROM part",
    "v_grant": """SELECT l_suppkey AS user_id, l_partkey AS target, CASE l_returnflag WHEN 'A' THEN array('VIEW') WHEN 'N' THEN array('VIEW', 'MANAGE') ELSE array('ROLE') END AS permission_list,
        (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS grant_id FROM lineitem""",
}
_DUCKDB = {
    "v_resume_line": f"""SELECT doc_id AS document_id, i AS position, {_LINE} FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "v_headed_document": """SELECT doc_id AS document_id, i, CASE WHEN i % 9 = 4 THEN 0 WHEN i % 5 = 2 THEN 1 END AS level, CASE WHEN i % 9 = 4 THEN substring(x, 1, 10) WHEN i % 5 = 2 THEN substring(x, 1, 12) ELSE x END AS line FROM (
        SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))""",
    "v_skill_list": """SELECT p_partkey AS id, list_concat(list_concat(string_split(p_name, ' '), [upper(p_name), ' ' || p_name || '， ', 'x', '熟悉' || p_type, p_type, p_brand, '"' || p_brand || '"']),
        CASE WHEN p_partkey % 10 = 0 THEN list_transform(range(1, 21), lambda i: 'skill' || i) ELSE [] END) AS skills FROM part""",
    "v_keyword_query": r"""SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN array_to_string(w[1:6], ' ') WHEN 1 THEN '"' || w[1] || ' ' || w[2] || '" ' || w[3] WHEN 2 THEN w[1] || ' ' || w[2] || ' --' || w[6]
        ELSE w[1] || ' ' || w[2] || ' OR ' || w[3] || ' ' || w[4] END AS query FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-zß-öø-ÿ0-9]+') AS w FROM benchmark) WHERE len(w) > 5""",
    "v_term": "SELECT unnest(string_split(p_name, ' ')) AS term FROM part",
    "v_kb_term": "SELECT 'src' || item_id % 20 AS knowledge_id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS term FROM benchmark",
    "v_paragraph": """SELECT doc_id * 10000000 + i AS paragraph_id, doc_id AS document_id, source AS knowledge_id, i AS position, line AS content
        FROM (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''""",
    "v_query_text": "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query, text FROM benchmark",
    "v_job": "SELECT p_partkey AS job_id, string_split(p_name, ' ') AS skills, p_brand AS department, p_type AS city, p_size AS level, p_name AS title FROM part",
    "v_grant": """SELECT l_suppkey AS user_id, l_partkey AS target, CASE l_returnflag WHEN 'A' THEN ['VIEW'] WHEN 'N' THEN ['VIEW', 'MANAGE'] ELSE ['ROLE'] END AS permission_list,
        (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS grant_id FROM lineitem""",
}
DUCKDB: dict[str, str] = _BOTH | _DUCKDB
SPARK: dict[str, str] = _BOTH | _SPARK


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame; ``name`` may be "@dir" or "@spark" for the folder and the session themselves."""
    if name == "@dir":
        return sf_dir
    if name == "@spark":
        return spark
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})
