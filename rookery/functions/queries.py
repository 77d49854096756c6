"""The scalar functions applied to whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from . import text as T


@query("f01_normalise_for_embedding", "v_document", sql="SELECT document_id, trim(regexp_replace(regexp_replace(content, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0E}\\x{FE0F}]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM v_document")
def f01(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.normalise_for_embedding("content").alias("text"))


@query("f02_sanitised", "v_document", sql="""SELECT document_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS text FROM v_document""")
def f02(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.sanitised("content").alias("text"))


@query("f03_ocr_lines", "v_document", sql=rf"""SELECT document_id, CASE WHEN length(s) - length(replace(s, '；', '')) >= 5 AND length(s) - length(replace(s, chr(10), '')) < 3
    THEN regexp_replace(regexp_replace(regexp_replace(s, '；+', chr(10), 'g'), '\n+', chr(10), 'g'), '\A[{T.BLANK}]+|[{T.BLANK}]+\z', '', 'g') ELSE s END AS text FROM (SELECT document_id, replace(replace(content, '. ', '；'), ', ', '；；') AS s FROM v_document)""")
def f03(documents: DataFrame) -> DataFrame:
    """Sentence ends and commas are turned into full-width semicolons first, as the tables have no OCR text."""
    s = F.replace(F.replace("content", F.lit(". "), F.lit(T.FULL_SEMICOLON)), F.lit(", "), F.lit(T.FULL_SEMICOLON * 2))
    return documents.select("document_id", s.alias("s")).select("document_id", T.ocr_lines("s").alias("text"))


# RE2, DuckDB's engine, has no lookaround: neighbours are captured, twice, so that adjacent matches are found as well.
_ID = f"(^|[^{T.WORD}])[0-9]{{17}}[0-9Xx]($|[^{T.WORD}])"
MASKED_SQL = f"regexp_replace(regexp_replace(content, '{T.PHONE}', '{T.MASK}', 'g'), '{T.EMAIL}', '{T.MASK}', 'g')"
MASKED_SQL = f"regexp_replace(regexp_replace({MASKED_SQL}, '{_ID}', '\\1{T.MASK}\\2', 'g'), '{_ID}', '\\1{T.MASK}\\2', 'g')"


def residual_sql(c: str) -> str:
    edge = f"(^|[^{T.WORD}]){{}}($|[^{T.WORD}])".replace("{}", "%s")
    return f"(regexp_matches({c}, '{T.STRICT_PHONE}') OR regexp_matches({c}, '{edge % '[0-9]{15}'}') OR regexp_matches({c}, '{edge % '[0-9]{16,19}'}'))"


@query("f04_masked", "v_document", sql=f"SELECT document_id, {MASKED_SQL} AS text FROM v_document")
def f04(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.masked("content").alias("text"))


@query("f05_residual_pii", "v_document", sql=f"SELECT document_id, {residual_sql('content')} AS residual FROM v_document")
def f05(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.residual_pii("content").alias("residual"))


@query("f06_partly_masked", "v_candidate", sql="SELECT candidate_id, 'call ' || substring(phone, 1, 3) || '****' || right(phone, 4) || ' or ' || substring(email, 1, 2) || '***@' || split_part(email, '@', 2) AS text FROM v_candidate")
def f06(candidates: DataFrame) -> DataFrame:
    line = F.concat(F.lit("call "), "phone", F.lit(" or "), "email")
    return candidates.select("candidate_id", T.partly_masked(line).alias("text"))


@query("f07_section_cleaned", "v_document", sql="SELECT document_id, trim(regexp_replace(regexp_replace(regexp_replace(content, '[ \\t]+', ' ', 'g'), '#+ ?', '', 'g'), '\\n{2,}', chr(10), 'g')) AS text FROM v_document")
def f07(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.section_cleaned("content").alias("text"))


def _plain_sql(c: str) -> str:
    for pattern, replacement in T.PLAIN:
        c = f"regexp_replace({c}, '{re.sub('^..d(m?)[)]', lambda m: '(?m)' if m[1] else '', pattern)}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({c}, '\\A[{T.BLANK}]+|[{T.BLANK}]+\\z', '', 'g')"


@query("f08_plain_text", "v_document", sql=f"SELECT document_id, {_plain_sql('content')} AS text FROM v_document")
def f08(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", T.plain_text("content").alias("text"))


@query("f09_markdown_links", "pages", sql="""WITH m AS (SELECT page_id, '![' || url || '](' || url || ') and [file](' || url || ')' AS md FROM pages)
    SELECT page_id, array_to_string(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1), ' ') AS images, array_to_string(regexp_extract_all(md, '\\]\\(([^)]*)\\)', 1), ' ') AS links FROM m""")
def f09(pages: DataFrame) -> DataFrame:
    md = F.concat(F.lit("!["), "url", F.lit("]("), "url", F.lit(") and [file]("), "url", F.lit(")"))
    found = lambda p: F.array_join(F.regexp_extract_all(md, F.lit(p), F.lit(1)), " ")
    return pages.select("page_id", found(r"!\[[^\]]*\]\(([^)]*)\)").alias("images"), found(r"\]\(([^)]*)\)").alias("links"))


@query("f10_identity_fields", "v_resume_text", sql=rf"""WITH n AS (SELECT id, text, trim(trim(regexp_extract(text, '{T.NAMES[0]}', 1)), '{T.NAME_EDGES}') AS a, regexp_extract(text, '(?m)^([\x{{4E00}}-\x{{9FA5}}]{{2,4}})$', 1) AS b FROM v_resume_text)
    SELECT id, CASE WHEN a <> '' THEN a ELSE b END AS name, regexp_extract(text, '{T.EMAIL}') AS email, regexp_extract(text, '{T.PLAIN_PHONE}') AS phone FROM n""")
def f10(texts: DataFrame) -> DataFrame:
    name, email, phone = T.identity_fields("text")
    return texts.select("id", name.alias("name"), email.alias("email"), phone.alias("phone"))


CITIES = ["ALGERIA市", "CHINA", "NIGER市", "NIGERIA", "PERU市"]
_SLOT_REST = "CASE WHEN y <> '' THEN replace(query, y, ' ') ELSE query END"
for _w in ("大专", "专科", "本科", "硕士", "博士"):
    _SLOT_REST = f"replace({_SLOT_REST}, '{_w}', ' ')"
_SLOT_CITIES, _CITY_REST = [], "rest"
for _short, _city in (("ALGERIA", "ALGERIA市"), ("NIGERIA", "NIGERIA"), ("NIGER", "NIGER市"), ("CHINA", "CHINA"), ("PERU", "PERU市")):
    _SLOT_CITIES.append(f"CASE WHEN contains({_CITY_REST}, '{_short}') THEN '{_city}' END")
    _CITY_REST = f"replace(replace({_CITY_REST}, '{_short}市', ' '), '{_short}', ' ')"


@query("f11_query_slots", "v_slot_query", sql=f"""WITH y AS (SELECT query_id, query, regexp_extract(query, '(?:^|[^0-9])([0-9]{{1,2}}[{T.BLANK}]*年(?:以上)?)(?:$|[^0-9])', 1) AS y FROM v_slot_query),
    d AS (SELECT *, {_SLOT_REST} AS rest, CASE WHEN y <> '' THEN replace(query, y, ' ') ELSE query END AS s FROM y)
    SELECT query_id, CAST(nullif(regexp_extract(y, '^[0-9]+'), '') AS BIGINT) AS years, CASE WHEN contains(s, '博士') THEN 4 WHEN contains(s, '硕士') THEN 3 WHEN contains(s, '本科') THEN 2 WHEN contains(s, '专科') OR contains(s, '大专') THEN 1 END AS degree,
    concat_ws(',', {', '.join(_SLOT_CITIES)}) AS cities, trim(regexp_replace({_CITY_REST}, '[{T.BLANK}]+', ' ', 'g')) AS rest FROM d""")
def f11(questions: DataFrame, cities: list[str] | None = None) -> DataFrame:
    years, degree, found, rest = T.query_slots("query", CITIES if cities is None else cities)
    return questions.select("query_id", years.alias("years"), degree.alias("degree"), F.array_join(found, ",").alias("cities"), rest.alias("rest"))


@query("f12_normalised_skill", "v_job", sql="SELECT job_id, CASE lower(regexp_replace(upper(title), '\\s+', ' ', 'g')) WHEN 'red bolt' THEN 'crimson bolt' ELSE lower(title) END AS skill FROM v_job")
def f12(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", T.normalised_skill(F.concat(F.lit("  "), F.upper("title"), F.lit(" ")), {"red bolt": "crimson bolt"}).alias("skill"))


@query("f13_clean_skills", "v_skill_list", sql="""WITH u AS (SELECT id, i, trim(trim(skills[i]), '"''，。；') AS skill FROM (SELECT id, skills, unnest(range(1, len(skills) + 1)) AS i FROM v_skill_list)),
    k AS (SELECT * FROM u WHERE length(skill) BETWEEN 2 AND 30 AND NOT contains(skill, chr(10)) AND NOT contains(skill, '：') AND NOT contains(skill, '负责') AND NOT contains(skill, '熟悉')),
    f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(skill) ORDER BY i) AS n FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM f WHERE n = 1)
    SELECT v.id, coalesce(string_agg(skill, ',' ORDER BY place) FILTER (WHERE place <= 15), '') AS skills FROM v_skill_list v LEFT JOIN r USING (id) GROUP BY 1""")
def f13(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.array_join(T.clean_skills("skills"), ",").alias("skills"))


@query("f14_dictionary_skills", "v_document", "v_term", sql="""WITH t AS (SELECT DISTINCT lower(trim(term)) AS term FROM v_term WHERE length(trim(term)) > 2), w AS (SELECT DISTINCT document_id, unnest(regexp_split_to_array(lower(content), '\\s')) AS word FROM v_document),
    m AS (SELECT DISTINCT document_id, term FROM w JOIN t ON contains(word, term)) SELECT document_id, count(*) AS skills, string_agg(term, ',' ORDER BY term) AS names FROM m GROUP BY 1""")
def f14(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Dictionary terms that occur anywhere in a text, normalised, each once; terms hold no white space, so each lies within one word."""
    from ..plans.retrieval import term_hits

    wanted = terms.select(T.normalised_skill("term").alias("term")).where(F.char_length("term") > 2).distinct()
    hits = term_hits(documents.select("document_id", F.lower("content").alias("text")), ["document_id"], "text", wanted)
    return hits.groupBy("document_id").agg(F.count("*").alias("skills"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("names"))


_SPLIT_STATUS = "reverse(substring(reverse(lpad(status, 4, 'n')), 1, 1) || '4' || substring(reverse(lpad(status, 4, 'n')), 3))"


@query("f16_set_task_state", "v_document", sql=f"""SELECT document_id, {_SPLIT_STATUS} AS status, CASE WHEN document_id % 3 = 0 THEN '1:0=t0 2:1=t1,4=now' WHEN document_id % 3 = 1 THEN '2:4=now,5=t5' ELSE '2:4=now' END AS times FROM v_document""")
def f16(documents: DataFrame) -> DataFrame:
    """State digit of task 2 set to 4, and the time of that state noted under the task; other tasks and states keep theirs."""
    none = F.lit(None).cast("map<string,map<string,string>>")
    kept = F.when(F.col("document_id") % 3 == 0, F.from_json(F.lit('{"1":{"0":"t0"},"2":{"1":"t1"}}'), "map<string,map<string,string>>")).when(F.col("document_id") % 3 == 1, F.from_json(F.lit('{"2":{"4":"old","5":"t5"}}'), "map<string,map<string,string>>")).otherwise(none)
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    rows = documents.select("document_id", T.with_task_state("status", 2, "4").alias("status"), T.noted_time(kept, 2, "4", F.lit("now")).alias("m"))
    return rows.select("document_id", "status", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), shown(e["value"])))), " ").alias("times"))


@query("f17_question_tags", "v_query_text", sql="SELECT query_id, unnest([query, text]) AS question FROM v_query_text")
def f17(questions: DataFrame) -> DataFrame:
    answer = F.concat(F.lit("1. <question>"), "query", F.lit("</question>\n2. <question>"), "text", F.lit("</question>"))
    found = F.regexp_extract_all(F.regexp_replace(answer, r"(?m)^\d+\.\s*", ""), F.lit(r"(?s)<question>(.*?)</question>"), F.lit(1))
    return questions.select("query_id", F.explode(found).alias("question"))


@query("f18_fingerprint", "v_document", sql="SELECT document_id, sha256(content) AS digest FROM v_document")
def f18(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.sha2("content", 256).alias("digest"))


@query("f19_evidence_strength", "v_job", sql="SELECT job_id, round(CASE WHEN level % 4 = 0 THEN 0 ELSE least(1.0, level / 50.0 + 0.05 * (level % 4 - 1)) END, 6) AS strength FROM v_job")
def f19(jobs: DataFrame) -> DataFrame:
    relevances = F.array_repeat(F.col("level") / 50.0, (F.col("level") % 4).cast("int"))
    return jobs.select("job_id", F.round(T.evidence_strength(relevances), 6).alias("strength"))


@query("f20_source_label", "v_usage", sql="SELECT id, CASE chat_user_type WHEN 0 THEN 'anonymous' WHEN 1 THEN 'member' ELSE '2' END AS label FROM v_usage")
def f20(usage: DataFrame) -> DataFrame:
    labels = F.create_map(F.lit("0"), F.lit("anonymous"), F.lit("1"), F.lit("member"))
    kind = F.col("chat_user_type").cast("string")
    return usage.select("id", F.coalesce(F.try_element_at(labels, kind), kind, F.lit("-")).alias("label"))


@query("f21_redacted_json", "v_secret_json", sql="""WITH e AS (SELECT id, unnest(json_keys(body)) AS k, body FROM v_secret_json), v AS (SELECT id, k, json_extract_string(body, '$.' || k) AS v FROM e)
    SELECT id, string_agg(k || '=' || CASE WHEN lower(k) IN ('credential', 'secret_key', 'access_token', 'password', 'token', 'api_key', 'webhook_url') AND coalesce(v, '') <> '' THEN '***REDACTED***' ELSE coalesce(v, '') END, ' ' ORDER BY k) AS body,
    string_agg(k || '=' || substring(coalesce(v, ''), 1, 200), ' ' ORDER BY k) AS trace FROM v GROUP BY 1""")
def f21(rows: DataFrame) -> DataFrame:
    """Non-empty values under secret names are blanked; traces are cut to 200 characters (lists keep five items, see ``traced_items``)."""
    values = F.from_json("body", "map<string,string>")
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), " ")
    return rows.select("id", shown(T.redacted(values)).alias("body"), shown(T.traced(values)).alias("trace"))


@query("f22_cosine", "v_embedding", sql="""SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x, i: x * i)), 6) AS cosine FROM v_embedding""")
def f22(rows: DataFrame) -> DataFrame:
    """Each vector against itself with rising weights on its coordinates."""
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return rows.select("id", F.round(T.cosine("embedding", weighted), 6).alias("cosine"))
