"""Window functions: latest rows, sequence numbers, positions, running budgets, greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..session import staged


def numbered(*keys: str, order: list) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")


def global_numbers(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``df`` with its place in the order from 0: places in sorted ranges plus the rows of earlier ranges (one count per range)."""
    at = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbers")
    at = at.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = at.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_at", "_range", "_place", "_before")


@query("w01_latest_label", "v_usage", sql="""SELECT chat_user_id, chat_user_type, asker FROM (SELECT *, row_number() OVER (PARTITION BY chat_user_id, chat_user_type ORDER BY create_time DESC, id) AS k
    FROM v_usage WHERE chat_user_id IS NOT NULL) WHERE k = 1""")
def latest_label(usage: DataFrame) -> DataFrame:
    last = numbered("chat_user_id", "chat_user_type", order=[F.desc("create_time"), "id"])
    return usage.where("chat_user_id IS NOT NULL").withColumn("k", last).where("k = 1").select("chat_user_id", "chat_user_type", "asker")


@query("w02_best_row_per_paragraph", "v_embedding", sql="""SELECT paragraph_id, id, score FROM (SELECT paragraph_id, id, round(embedding[1]::DOUBLE, 6) AS score,
    row_number() OVER (PARTITION BY paragraph_id ORDER BY embedding[1] DESC, id) AS k FROM v_embedding) WHERE k = 1""")
def best_row(rows: DataFrame) -> DataFrame:
    """The row with the highest score of each paragraph (here the first coordinate stands for a score)."""
    score = F.get("embedding", F.lit(0))
    best = rows.groupBy("paragraph_id").agg(F.max_by(F.struct("id", score.alias("s")), F.struct(score, -F.col("id"))).alias("b"))
    return best.select("paragraph_id", "b.id", F.round(F.col("b.s").cast("double"), 6).alias("score"))


@query("w03_latest_proposal", "v_proposal", sql="""SELECT target, id, action, status FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY create_time DESC, id DESC) AS k FROM v_proposal) WHERE k = 1""")
def latest_proposal(proposals: DataFrame) -> DataFrame:
    best = proposals.groupBy("target").agg(F.max_by(F.struct("id", "action", "status"), F.struct("create_time", "id")).alias("p"))
    return best.select("target", "p.*")


@query("w04_reapply_number", "v_application", sql="""WITH o AS (SELECT candidate_id, job_id, count(*) AS m FROM v_application WHERE create_time < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2)
    SELECT a.application_id, coalesce(m, 0) + row_number() OVER (PARTITION BY a.candidate_id, a.job_id ORDER BY create_time, application_id) AS reapply_no
    FROM v_application a LEFT JOIN o USING (candidate_id, job_id) WHERE create_time >= TIMESTAMP '1998-01-01 00:00:00'""")
def reapply_number(applications: DataFrame, since: str = "1998-01-01") -> DataFrame:
    """New rows continue after the highest number already given for the same candidate and job."""
    day = F.lit(since).cast("timestamp_ntz")
    old = applications.where(F.col("create_time") < day).groupBy("candidate_id", "job_id").agg(F.count("*").alias("m"))
    new = applications.where(F.col("create_time") >= day).join(old, ["candidate_id", "job_id"], "left")
    return new.select("application_id", (F.coalesce("m", F.lit(0)) + numbered("candidate_id", "job_id", order=["create_time", "application_id"])).alias("reapply_no"))


@query("w04b_round_and_version", "v_proposal", sql="""SELECT id, 'round' AS kind, row_number() OVER (PARTITION BY target ORDER BY create_time, id) + 2 AS number FROM v_proposal WHERE action = 'ADVANCE' UNION ALL SELECT id, 'version', row_number() OVER (PARTITION BY target, part ORDER BY create_time, id) FROM v_proposal WHERE action = 'HOLD'""")
def round_and_version(proposals: DataFrame, rounds: int = 2) -> DataFrame:
    """Interview rounds go on after those held already (two per application), offer versions start at one per application and part."""
    held = proposals.where("action = 'ADVANCE'").select("id", F.lit("round").alias("kind"), (numbered("target", order=["create_time", "id"]) + rounds).alias("number"))
    return held.unionByName(proposals.where("action = 'HOLD'").select("id", F.lit("version").alias("kind"), numbered("target", "part", order=["create_time", "id"]).alias("number")))


@query("w05_prepend_and_renumber", "v_paragraph", sql="""SELECT paragraph_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN position % 5 = 0 THEN 0 ELSE 1 END, position) AS new_position FROM v_paragraph""")
def prepend(paragraphs: DataFrame, is_new: str = "position % 5 = 0") -> DataFrame:
    """Rows that count as new come first; all positions are given again."""
    return paragraphs.select("paragraph_id", "document_id", numbered("document_id", order=[F.when(F.expr(is_new), 0).otherwise(1), "position"]).alias("new_position"))


@query("w05b_move_within_range", "v_paragraph", sql="""WITH p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position) AS n FROM v_paragraph)
    SELECT paragraph_id, CASE WHEN n = 4 THEN 2 WHEN n BETWEEN 2 AND 3 THEN n + 1 ELSE n END AS new_position FROM p""")
def move_within(paragraphs: DataFrame, old: int = 4, new: int = 2) -> DataFrame:
    n = F.col("n")
    step, lo, hi = (1, new, old - 1) if new < old else (-1, old + 1, new)
    rows = paragraphs.withColumn("n", numbered("document_id", order=["position"]))
    return rows.select("paragraph_id", F.when(n == old, new).when(n.between(lo, hi), n + step).otherwise(n).alias("new_position"))


@query("w07_last_turns", "conversations", sql="""SELECT conv_id, turn, role, k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4""")
def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    return turns.withColumn("k", numbered("conv_id", order=[F.desc("turn")])).where(F.col("k") <= n).select("conv_id", "turn", "role", "k")


@query("w08_question_answer_pairs", "conversations", sql="SELECT conv_id, turn, question, answer FROM v_turn")
def question_answer_pairs(turns: DataFrame) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("w09_character_budget", "v_paragraph", sql="""WITH r AS (SELECT paragraph_id, document_id, content, position, coalesce(sum(length(content)) OVER (PARTITION BY document_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM v_paragraph)
    SELECT paragraph_id, substring(content, 1, CAST(1000 - used AS INT)) AS content FROM r WHERE used < 1000""")
def character_budget(paragraphs: DataFrame, budget: int = 1000) -> DataFrame:
    """Paragraphs in order until the budget is spent; the last is cut."""
    before = W.partitionBy("document_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    rows = paragraphs.withColumn("used", F.coalesce(F.sum(F.char_length("content")).over(before), F.lit(0)))
    return rows.where(F.col("used") < budget).select("paragraph_id", F.substring("content", F.lit(1), (budget - F.col("used")).cast("int")).alias("content"))


def packed_pieces(pieces: Column, limit: int, glue: str) -> Column:
    """Greedy fold: pieces are joined by ``glue`` while the result is shorter than ``limit``; array of strings."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        joined = F.concat(state["open"], F.lit(glue), piece)
        return F.when(state["open"].isNull(), F.struct(state["done"].alias("done"), piece.alias("open"))).when(
            F.char_length(joined) <= limit, F.struct(state["done"].alias("done"), joined.alias("open"))
        ).otherwise(F.struct(F.array_append(state["done"], state["open"]).alias("done"), piece.alias("open")))

    return F.reduce(pieces, start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


@query("w10_greedy_packing", "documents", sql="""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM documents),
    f AS (SELECT doc_id, a, 1 AS i, 1 AS g, a[1] AS open FROM l WHERE len(a) > 0
      UNION ALL SELECT doc_id, a, i + 1, CASE WHEN length(open) + 1 + length(a[i + 1]) <= 500 THEN g ELSE g + 1 END,
        CASE WHEN length(open) + 1 + length(a[i + 1]) <= 500 THEN open || chr(10) || a[i + 1] ELSE a[i + 1] END FROM f WHERE i < len(a))
    SELECT doc_id, g::BIGINT AS chunk_no, arg_max(open, i) AS chunk FROM f GROUP BY 1, 2""")
def greedy_packing(documents: DataFrame, limit: int = 500) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    chunks = documents.select("doc_id", F.posexplode(packed_pieces(lines, limit, "\n")).alias("n", "chunk"))
    return chunks.select("doc_id", (F.col("n") + 1).cast("bigint").alias("chunk_no"), "chunk")


#: Runs of a type at a time and in an hour before further ones are skipped.
MOST_RUNNING, MOST_IN_AN_HOUR = 3, 20
HOUR = 3_600_000_000


@query("w11_rate_guard", "v_agent_run", sql="""WITH r AS (SELECT id, agent_type, status, create_time AS s, create_time + INTERVAL 1 SECOND * duration_ms AS e FROM v_agent_run), l AS (SELECT id, agent_type, count(*) FILTER (status <> 'SKIPPED') OVER (PARTITION BY agent_type ORDER BY s RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM r),
    c AS (SELECT a.id, count(b.id) AS running FROM r a LEFT JOIN r b ON a.agent_type = b.agent_type AND a.id <> b.id AND b.status <> 'SKIPPED' AND b.s <= a.s AND b.e > a.s GROUP BY 1) SELECT id, agent_type, last_hour, running, CASE WHEN running >= 3 THEN 'concurrent' WHEN last_hour > 20 THEN 'rate' END AS reason FROM l JOIN c USING (id)""")
def w11(runs: DataFrame) -> DataFrame:
    """A run lasts as many seconds as its duration counts."""
    start = F.unix_micros(F.col("create_time").cast("timestamp"))
    return rate_guard(runs.select("id", "agent_type", "status", start.alias("t"), (start + F.col("duration_ms") * 1_000_000).alias("e")))


def rate_guard(runs: DataFrame) -> DataFrame:
    """id, agent_type, last_hour (runs of the type in the hour up to this one), running (others that had begun and not ended) and the reason to skip it.

    ``runs``: id, agent_type, status, t and e (begin and end in microseconds); skipped runs count for neither. A run stands in its own hour and in the next, so
    the trailing window sees one type and hour. Running ones are a sweep: begins less ends inside the hour, plus the sum over all hours before, which are
    added up per type and hour first; so no type is one group.
    """
    rows = runs.withColumn("own", F.floor(F.col("t") / HOUR))
    counts = F.col("status") != "SKIPPED"
    dealt = rows.select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("bucket"))
    trailing = W.partitionBy("agent_type", "bucket").orderBy("t").rangeBetween(-HOUR, 0)
    recent = dealt.withColumn("last_hour", F.count(F.when(counts, 1)).over(trailing)).where("own = bucket").select("id", "agent_type", "last_hour")
    marks = rows.select("agent_type", F.inline(F.array(*[F.struct(at.alias("at"), step.alias("step"), who.alias("id"), own.alias("mine")) for at, step, who, own in (
        (F.col("t"), counts.cast("int"), F.col("id"), (counts & (F.col("e") > F.col("t"))).cast("int")), (F.col("e"), -counts.cast("int"), F.lit(None).cast("long"), F.lit(0)))])))
    marks = marks.withColumn("hour", F.floor(F.col("at") / HOUR))
    hours = marks.groupBy("agent_type", "hour").agg(F.sum("step").alias("net"))
    before = hours.select("agent_type", "hour", (F.sum("net").over(W.partitionBy("agent_type").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)) - F.col("net")).alias("before"))
    sweep = W.partitionBy("agent_type", "hour").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    running = marks.withColumn("inside", F.sum("step").over(sweep)).where("id IS NOT NULL").join(before, ["agent_type", "hour"])
    found = recent.join(running.select("id", (F.col("before") + F.col("inside") - F.col("mine")).alias("running")), "id")
    return found.withColumn("reason", F.when(F.col("running") >= MOST_RUNNING, "concurrent").when(F.col("last_hour") > MOST_IN_AN_HOUR, "rate"))


@query("w12_first_stage", "v_application", sql="SELECT job_id, arg_min(stage, (stage, application_id)) AS first_stage FROM v_application GROUP BY 1")
def first_stage(applications: DataFrame) -> DataFrame:
    return applications.groupBy("job_id").agg(F.min_by("stage", F.struct("stage", "application_id")).alias("first_stage"))
