"""Evidence lists at any depth of open JSON, by VARIANT values that are opened level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import numbered
from ..registry import query
from ..session import staged

MOST, EXCERPT = 100, 1200


def _opened(rows: DataFrame) -> DataFrame:
    """(key, path, at, named, pos, field, value) for every member of the objects and lists in ``v`` (key, path, at, named, v)."""
    return rows.sparkSession.sql("SELECT r._key, r.path, r.at, r.named, e.pos, e.key AS field, e.value FROM {rows} r, LATERAL variant_explode(r.v) e", rows=rows)


def extracted(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, paragraph_id, excerpt, relevance of the items of every list named ``evidence`` that are objects with an excerpt.

    From the JSON texts in ``column``, depth first (members of an object by name), the items of a list before what is inside them, MOST of a row at most. A text that is
    not JSON holds no evidence. Every round opens one level of all rows; what cannot hold anything is left behind, and a round without containers is the last.
    """
    start = rows.select(F.col(key).alias("_key"), F.lit("").alias("path"), F.array().cast("array<int>").alias("at"), F.lit(False).alias("named"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    level, found = start, None
    while True:
        opened = staged(_opened(level), "evidence-level")
        if opened.isEmpty():
            break
        text = lambda name: F.try_variant_get("value", f"$.{name}", "string")
        excerpt = F.trim(text("excerpt"))
        kind = F.schema_of_variant("value")
        items = opened.where("named AND field IS NULL").where(kind.startswith("OBJECT")).where(excerpt != "")
        items = items.select("_key", "path", "at", "pos", text("paragraph_id").alias("paragraph_id"), F.left(excerpt, F.lit(EXCERPT)).alias("excerpt"), _number("relevance").alias("relevance"))
        found = items if found is None else found.unionByName(items)
        path = F.when(F.col("field").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("field")).otherwise(F.concat_ws(".", "path", "field"))
        level = opened.where(kind.rlike("^(OBJECT|ARRAY)")).select("_key", path.alias("path"), F.array_append("at", F.col("pos")).alias("at"), (F.col("field") == "evidence").alias("named"), F.col("value").alias("v"))
        level = level.withColumn("named", F.coalesce("named", F.lit(False)))
    if found is None:
        return start.select(F.col("_key").alias(key), "path", F.lit("").alias("paragraph_id"), F.lit("").alias("excerpt"), F.lit(0.0).alias("relevance")).limit(0)
    first = found.withColumn("n", numbered("_key", order=["at", "pos"])).where(F.col("n") <= MOST)
    return first.select(F.col("_key").alias(key), "path", "paragraph_id", "excerpt", "relevance")


def _number(name: str) -> Column:
    """The value of a member that is a number."""
    of = F.schema_of_variant(F.try_variant_get("value", f"$.{name}", "variant"))
    return F.when(of.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("value", f"$.{name}", "double"))


@query("p16_nested_evidence", "v_agent_run", sql="""SELECT id, 'a[0].evidence' AS path, CAST(id AS STRING) AS paragraph_id, agent_type AS excerpt, (id % 10) / 10.0::DOUBLE AS relevance FROM v_agent_run
    UNION ALL SELECT id, 'a[0].evidence', NULL, trim(status), NULL FROM v_agent_run WHERE id % 3 = 0 UNION ALL SELECT id, 'a[0].evidence[2].evidence', NULL, 'deep', NULL FROM v_agent_run WHERE id % 3 = 0
    UNION ALL SELECT id, 'b.c.evidence', NULL, agent_type, NULL FROM v_agent_run WHERE id % 2 = 0""")
def nested_evidence(runs: DataFrame) -> DataFrame:
    """Payloads with blank excerpts, bare strings, evidence inside evidence and branches that some rows lack."""
    n, item = F.col("id").cast("string"), F.concat(F.lit('{"excerpt":"'), "agent_type", F.lit('"'))
    own = F.concat(item, F.lit(',"paragraph_id":'), n, F.lit(',"relevance":'), ((F.col("id") % 10) / 10.0).cast("string"), F.lit("}"))
    deep = F.concat(F.lit(',{"excerpt":" '), F.when(F.col("id") % 3 == 0, F.col("status")).otherwise(" "), F.lit(' "'), F.when(F.col("id") % 3 == 0, ',"evidence":[{"excerpt":"deep"}]').otherwise(""), F.lit("}"))
    other = F.when(F.col("id") % 2 == 0, F.concat(F.lit(',"b":{"c":{"evidence":['), item, F.lit("}]}}"))).otherwise("")
    payload = F.concat(F.lit('{"a":[{"evidence":['), own, F.lit(',"bare"'), deep, F.lit("]}]"), other, F.lit("}"))
    return extracted(runs.select("id", payload.alias("payload")), "id", "payload")
