"""Ordered limits: one pass per group by row_number (planned as a group limit) or max_by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .windows import numbered


@query("s02_page", "v_application", sql="SELECT application_id, status, amount, (SELECT count(*) FROM v_application WHERE status <> 'HIRED') AS total FROM v_application WHERE status <> 'HIRED' ORDER BY create_time DESC, application_id LIMIT 20 OFFSET 40")
def page(applications: DataFrame, number: int = 3, size: int = 20) -> DataFrame:
    """A page in a total order with the number of all matching rows."""
    rows = applications.where("status <> 'HIRED'")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("create_time"), "application_id").offset((number - 1) * size).limit(size).select("application_id", "status", "amount").crossJoin(F.broadcast(total))


@query("s01_filtered_scan", "orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def filtered_scan(orders: DataFrame, predicate: str = "o_orderstatus = 'O' AND o_totalprice > 200000", columns: tuple[str, ...] = ("o_orderkey", "o_totalprice")) -> DataFrame:
    return orders.where(predicate).select(*columns)


@query("t03_bit_vector_order", "v_document", sql="""SELECT document_id, row_number() OVER (ORDER BY a DESC, b DESC, c DESC, document_id) AS rank FROM (SELECT document_id, contains(lower(content), 'ation') AS a, contains(lower(content), 'with') AS b, contains(lower(content), 'heit') AS c FROM v_document) WHERE a OR b OR c ORDER BY rank LIMIT 50""")
def bit_vector_order(documents: DataFrame, terms: tuple[str, ...] = ("ation", "with", "heit"), limit: int = 50) -> DataFrame:
    """Earlier terms weigh more: arrays compare element by element. Top-k first, ranks on the k rows only."""
    bits = F.array(*[F.lower("content").contains(t).cast("int") for t in terms])
    top = documents.select("document_id", bits.alias("bits")).where(F.array_max("bits") > 0).orderBy(F.desc("bits"), "document_id").limit(limit)
    from pyspark.sql import Window as W

    return top.select("document_id", F.row_number().over(W.orderBy(F.desc("bits"), "document_id")).cast("bigint").alias("rank"))


@query("t04_matched_terms_order", "v_document", sql="""SELECT document_id, n FROM (SELECT document_id, (CASE WHEN contains(lower(content), 'with') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'from') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'under') THEN 1 ELSE 0 END)::BIGINT AS n FROM v_document) WHERE n > 0 ORDER BY n DESC, document_id LIMIT 100""")
def matched_terms_order(documents: DataFrame, terms: tuple[str, ...] = ("with", "from", "under"), limit: int = 100) -> DataFrame:
    n = sum((F.lower("content").contains(t).cast("bigint") for t in terms), F.lit(0).cast("bigint"))
    return documents.select("document_id", n.alias("n")).where("n > 0").orderBy(F.desc("n"), "document_id").limit(limit)


@query("t05_match_order", "v_proposal", sql="SELECT target, id, rank FROM (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, create_time DESC NULLS LAST, id) AS rank FROM v_proposal) WHERE rank <= 3")
def match_order(proposals: DataFrame, n: int = 3) -> DataFrame:
    rank = numbered("target", order=[F.desc_nulls_last("score"), F.desc_nulls_last("create_time"), "id"])
    return proposals.withColumn("rank", rank).where(F.col("rank") <= n).select("target", "id", "rank")


@query("t06_direct_return", "v_proposal", sql="""WITH b AS (SELECT target, max(score) AS m FROM v_proposal GROUP BY 1), k AS (SELECT p.*, m, row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, id) AS r FROM v_proposal p JOIN b USING (target))
    SELECT target, id FROM k WHERE coalesce(m, -1) < 90 OR r = 1""")
def direct_return(proposals: DataFrame, threshold: int = 90) -> DataFrame:
    """Only the best row of a group in which any row meets the threshold, else all rows."""
    from pyspark.sql import Window as W

    best = F.max("score").over(W.partitionBy("target"))
    r = numbered("target", order=[F.desc_nulls_last("score"), "id"])
    return proposals.withColumns({"m": best, "r": r}).where((F.coalesce("m", F.lit(-1)) < threshold) | (F.col("r") == 1)).select("target", "id")
