"""Set operations and merges of result legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .windows import global_numbers


@query("u01_embedding_texts", "v_paragraph", "v_query_text", sql="SELECT content AS text FROM v_paragraph UNION SELECT query FROM v_query_text")
def embedding_texts(paragraphs: DataFrame, questions: DataFrame) -> DataFrame:
    return paragraphs.select(F.col("content").alias("text")).union(questions.select("query")).distinct()


@query("u02_resources_in_one_shape", "part", "supplier", sql="SELECT CAST(p_partkey AS BIGINT) AS id, 'part' AS kind, p_name AS name FROM part UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier")
def one_shape(parts: DataFrame, suppliers: DataFrame) -> DataFrame:
    return parts.select(F.col("p_partkey").cast("bigint").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name")).union(suppliers.select("s_suppkey", F.lit("supplier"), "s_name"))


@query("u03_own_and_granted", "v_job", "v_grant", sql="SELECT job_id FROM v_job WHERE job_id % 100 = 3 UNION SELECT target FROM v_grant WHERE user_id = 3")
def own_and_granted(jobs: DataFrame, grants: DataFrame, user: int = 3) -> DataFrame:
    return jobs.where(F.col("job_id") % 100 == user).select("job_id").union(grants.where(F.col("user_id") == user).select("target")).distinct()


@query("u04_terms_to_add", "v_query_text", "v_job", sql="SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM v_query_text EXCEPT SELECT DISTINCT unnest(skills) FROM v_job")
def terms_to_add(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    terms = wanted.select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    return terms.join(stored.select(F.explode("skills").alias("term")), "term", "left_anti")


@query("u05_common_skills", "v_job", sql="SELECT job_id, len(list_intersect(skills, ['red', 'bolt', 'small', 'ring']))::BIGINT AS common FROM v_job")
def common_skills(jobs: DataFrame, asked: tuple[str, ...] = ("red", "bolt", "small", "ring")) -> DataFrame:
    return jobs.select("job_id", F.size(F.array_intersect("skills", F.array(*[F.lit(s) for s in asked]))).cast("bigint").alias("common"))


@query("u06_merge_legs", "v_application", sql="""WITH a AS (SELECT candidate_id, row_number() OVER (ORDER BY max(amount) DESC, candidate_id) AS r FROM v_application WHERE job_id = 5 GROUP BY 1),
    b AS (SELECT candidate_id, count(*) AS hits FROM v_application WHERE job_id IN (5, 6, 7) GROUP BY 1), n AS (SELECT count(*) AS c FROM a)
    SELECT candidate_id, r AS rank, b.candidate_id IS NOT NULL AS in_both FROM a LEFT JOIN b USING (candidate_id)
    UNION ALL SELECT candidate_id, c + row_number() OVER (ORDER BY hits DESC, candidate_id), false FROM b, n WHERE candidate_id NOT IN (SELECT candidate_id FROM a)""")
def merge_legs(applications: DataFrame) -> DataFrame:
    """The first leg keeps its ranks and marks what both found; the second appends only what is missing."""
    first = applications.where("job_id = 5").groupBy("candidate_id").agg(F.max("amount").alias("amount"))
    first = global_numbers(first, [F.desc("amount"), "candidate_id"], "place").select("candidate_id", (F.col("place") + 1).alias("rank"))
    second = applications.where("job_id IN (5, 6, 7)").groupBy("candidate_id").agg(F.count("*").alias("hits"))
    extra = global_numbers(second.join(first, "candidate_id", "left_anti"), [F.desc("hits"), "candidate_id"], "place").select("candidate_id", (F.col("place") + 1 + first.count()).alias("rank"), F.lit(False).alias("in_both"))
    marked = first.join(second.select("candidate_id", F.lit(True).alias("hit")), "candidate_id", "left")
    return marked.select("candidate_id", "rank", F.coalesce("hit", F.lit(False)).alias("in_both")).unionByName(extra)
