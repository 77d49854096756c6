"""Structured Streaming jobs over record files. Each takes a streaming (or batch) frame and returns one;
the registered queries run them once over all files (trigger availableNow) into a table and read that back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..functions.queries import MASKED_SQL, residual_sql
from ..registry import query
from ..operators.windows import HOUR
from ..session import delete_at_end, shared_dir


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share; it goes when the driver ends."""
    return delete_at_end(spark, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; event time as TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there, then stop. ``complete`` keeps the last full result, ``append`` all emitted rows."""
    spark = stream.sparkSession
    where = scratch(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{where}/out").outputMode("append")
    else:
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _id: df.write.mode("overwrite").parquet(f"{where}/out"))
    writer.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def live_trend(stream: DataFrame) -> DataFrame:
    """Daily counters and tokens; rows later than a day behind the newest are dropped."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", "1 day").groupBy(day).agg(
        F.count_if(F.col("event_type") == "click").alias("star_num"), F.count_if(F.col("event_type") == "error").alias("trample_num"), F.count("*").alias("records"),
        F.sum(F.floor("value").cast("bigint") + F.col("event_id") % 50).alias("tokens"),
    ).select(F.to_date("window.start").alias("day"), "star_num", "trample_num", "records", "tokens")


def live_users(stream: DataFrame) -> DataFrame:
    """Each user of a day once; two days of watermark keep all records of a day together."""
    rows = stream.select("ts", F.to_date("ts").alias("day"), "user_id").withWatermark("ts", "2 days")
    return rows.dropDuplicatesWithinWatermark(["day", "user_id"]).select("day", "user_id")


@query("st01_live_trend", "@spark", "@dir", sql="SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS star_num, count(*) FILTER (event_type = 'error') AS trample_num, count(*) AS records, sum(CAST(floor(value) AS BIGINT) + event_id % 50)::BIGINT AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def st01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters and the users are two streams, so neither holds the users of a day in one row."""
    users = run_once(live_users(records(spark, sf_dir)), "append").groupBy("day").agg(F.count_distinct("user_id").alias("users"))
    return run_once(live_trend(records(spark, sf_dir)), "complete").join(users, "day", "left").fillna(0, ["users"])


def daily_quota(stream: DataFrame, quota: int = 2) -> DataFrame:
    """Uses per user and application in tumbling days, with breaches marked."""
    counts = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "user_id", (F.col("event_id") % 20).alias("application_id")).agg(F.count("*").alias("uses"))
    return counts.select(F.to_date("window.start").alias("day"), "user_id", "application_id", "uses", (F.col("uses") > quota).alias("breach"))


@query("st02_daily_quota", "@spark", "@dir", sql="SELECT CAST(ts AS DATE) AS day, user_id, event_id % 20 AS application_id, count(*) AS uses, count(*) > 2 AS breach FROM events GROUP BY 1, 2, 3")
def st02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(daily_quota(records(spark, sf_dir)), "complete")


GUARDED = "id bigint, event_type string, last_hour bigint, running bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def swept(rows: list[tuple[int, int, int, bool]], begin: int, end: int) -> list[tuple[int, int, int]]:
    """(id, last_hour, running) of the runs (begin, end, id, skipped) that begin in [begin, end): a sweep over begins and ends; all times in microseconds."""
    live = [r for r in rows if not r[3]]
    starts, ends = np.sort([r[0] for r in live]), np.sort([r[1] for r in live])
    out = []
    for t, e, i, skipped in rows:
        if begin <= t < end:
            upto = np.searchsorted(starts, t, "right")
            running = upto - np.searchsorted(ends, t, "right") - (not skipped and e > t)
            out.append((i, int(upto - np.searchsorted(starts, t - HOUR, "left")), int(running)))
    return out


class HourGuard(StatefulProcessor):
    """State of one type and hour: the runs that can matter in it, by id, so a run that comes again changes nothing. A timer at its end writes the results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "id bigint", "t bigint, e bigint, skipped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer((int(key[1]) + 1) * HOUR // 1000)
        for batch in rows:
            for i, t, e, skipped in zip(batch["id"], batch["t"], batch["e"], batch["skipped"], strict=True):
                self.runs.updateValue((int(i),), (int(t), int(e), bool(skipped)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [(v[0], v[1], k[0], v[2]) for k, v in self.runs.iterator()]
        self.runs.clear()
        found = swept(held, int(key[1]) * HOUR, (int(key[1]) + 1) * HOUR)
        yield pd.DataFrame({"id": [f[0] for f in found], "event_type": key[0], "last_hour": [f[1] for f in found], "running": [f[2] for f in found]})

    def close(self) -> None:
        pass


def live_guard(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """id, event_type, last_hour, running of every run once its hour is over. ``stream``: id, event_type, ts, t, e, skipped.

    A run goes to every hour that it can matter in: from its own to the one after its begin and the one of its end. So a state is one type and hour.
    """
    own = F.floor(F.col("t") / HOUR)
    last = F.greatest(own + 1, F.floor(F.col("e") / HOUR))
    rows = stream.withWatermark("ts", late).select("ts", "event_type", "id", "t", "e", "skipped", F.explode(F.sequence(own, last)).alias("hour"))
    return rows.groupBy("event_type", "hour").transformWithStateInPandas(HourGuard(), GUARDED, "Append", "EventTime")


def runs_of(stream: DataFrame) -> DataFrame:
    """The records as runs that last ten seconds for each unit of their value; every fifth is skipped."""
    t = F.unix_micros("ts")
    return stream.select("ts", F.col("event_id").alias("id"), "event_type", t.alias("t"), (t + F.floor("value").cast("bigint") * 10_000_000).alias("e"), (F.col("event_id") % 5 == 1).alias("skipped"))


@query("st03_rate_windows", "@spark", "@dir", sql="""WITH r AS (SELECT event_id AS id, event_type, event_id % 5 = 1 AS skipped, ts AS s, ts + INTERVAL 10 SECOND * CAST(floor(value) AS BIGINT) AS e FROM events), w AS (SELECT * FROM r WHERE date_trunc('hour', s) + INTERVAL 1 HOUR <= (SELECT max(s) FROM r)),
    c AS (SELECT a.id, count(b.id) AS running FROM w a LEFT JOIN r b ON a.event_type = b.event_type AND a.id <> b.id AND NOT b.skipped AND b.s <= a.s AND b.e > a.s GROUP BY 1), h AS (SELECT id, event_type, count(*) FILTER (NOT skipped) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM r)
    SELECT id, event_type, last_hour, running FROM c JOIN h USING (id)""")
def st03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours that are over; the last one waits for its end."""
    from ..session import ship

    ship(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what this kind of state needs
    try:
        return run_once(live_guard(runs_of(records(spark, sf_dir))), "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def ledger(stream: DataFrame) -> DataFrame:
    """One row per user, type and key: repeats within the watermark are dropped."""
    keyed = stream.select("ts", "user_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("key"), "event_id")
    return keyed.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "key"]).select("user_id", "event_type", "key")


@query("st04_idempotent_ledger", "@spark", "@dir", sql="SELECT DISTINCT user_id, event_type, strftime(ts, '%Y%m%d') AS key FROM events")
def st04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(ledger(records(spark, sf_dir)), "append")


def current_state(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """The last event of each user and type, kept up by every micro-batch: the batch is merged into the state before it, under the number of the batch, so a replay changes nothing."""
    kept = "user_id bigint, event_type string, event_id bigint, ts timestamp"

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", "event_type", "event_id", "ts")
        if number > 0:
            new = new.unionByName(spark.read.schema(kept).parquet(f"{path}/state/batch={number - 1}"))
        last = new.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("e")).select("user_id", "event_type", "e.*")
        last.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        spark.createDataFrame([(number,)], "number bigint").write.mode("overwrite").parquet(f"{path}/last")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    number = spark.read.schema("number bigint").parquet(f"{path}/last").first()[0]
    return spark.read.schema(kept).parquet(f"{path}/state/batch={number}")


@query("st04b_current_state", "@spark", "@dir", sql="SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def st04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_state(spark, records(spark, sf_dir), scratch(spark)).select("user_id", "event_type", "event_id")


def ingest_batch(documents: DataFrame, path: str, batch: int) -> None:
    """One micro-batch through the nodes extract, mask, split, gate and index, with a log row per document and node.

    Everything is written below the number of the batch and replaces what an earlier try of the same batch left, so a replay changes nothing.
    """
    from ..plans.chunking import boundary_chunks
    from ..plans.tokens import postings

    spark = documents.sparkSession

    def put(name: str, df: DataFrame) -> DataFrame:
        target = f"{path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)

    clean = documents.select("doc_id", T.sanitised("text").alias("extracted"))
    masked = T.masked("extracted")
    texts = put("texts", clean.select("doc_id", F.char_length("extracted").cast("bigint").alias("characters"), masked.alias("text"), T.residual_pii(masked).alias("rejected")))
    chunks = put("chunks", texts.select("doc_id", "rejected", F.posexplode(boundary_chunks("text")).alias("n", "chunk")))
    index = put("index", postings(chunks.where("NOT rejected"), ["doc_id", "n"], "chunk"))
    masks = ((F.char_length("text") - F.char_length(F.replace("text", F.lit(T.MASK), F.lit("")))) / len(T.MASK)).cast("bigint")
    entry = lambda df, node, outcome, n: df.select("doc_id", F.lit(node).alias("node"), outcome.alias("outcome"), n.alias("n"))
    counted = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("c"))
    done = F.lit("done")
    log = entry(texts, "extract", done, F.col("characters")).unionByName(entry(texts, "mask", done, masks)).unionByName(entry(counted(chunks), "split", done, F.col("c")))
    log = log.unionByName(entry(texts, "gate", F.when(F.col("rejected"), "rejected").otherwise("accepted"), F.lit(1).cast("bigint"))).unionByName(entry(counted(index), "index", done, F.col("c")))
    put("log", log)


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))"
_CUT = "'(?s).{1,256}[!?.;\\n。！？；]'"


@query("st05_continuous_ingest", "@spark", "@dir", sql=f"""WITH e AS (SELECT doc_id, {_CLEAN} AS content FROM documents), m AS (SELECT doc_id, length(content) AS characters, {MASKED_SQL} AS t FROM e), g AS (SELECT *, {residual_sql('t')} AS rejected FROM m),
    k AS (SELECT doc_id, rejected, list_filter(list_concat(regexp_extract_all(t, {_CUT}), list_filter(flatten(list_transform(regexp_split_to_array(t, {_CUT}), lambda x: regexp_extract_all(x, '(?s).{{1,256}}'))), lambda x: x <> '')), lambda x: trim(x) <> '') AS c FROM g),
    i AS (SELECT doc_id, sum(len(list_distinct(regexp_extract_all(lower(chunk), '[\\p{{Latin}}\\p{{Nd}}]+|[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]'))))::BIGINT AS n FROM (SELECT doc_id, unnest(c) AS chunk FROM k WHERE NOT rejected) GROUP BY 1)
    SELECT doc_id, 'extract' AS node, 'done' AS outcome, characters AS n FROM g UNION ALL SELECT doc_id, 'mask', 'done', ((length(t) - length(replace(t, '{T.MASK}', ''))) // {len(T.MASK)})::BIGINT FROM g UNION ALL SELECT doc_id, 'split', 'done', len(c) FROM k WHERE len(c) > 0
    UNION ALL SELECT doc_id, 'gate', CASE WHEN rejected THEN 'rejected' ELSE 'accepted' END, 1 FROM g UNION ALL SELECT doc_id, 'index', 'done', n FROM i WHERE n > 0""")
def st05(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/documents.parquet*")
    writer = stream.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, where, batch)).option("checkpointLocation", f"{where}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, node string, outcome string, n bigint").parquet(f"{where}/log").select("doc_id", "node", "outcome", "n")


@query("st06_scheduled_expiry", "@spark", "@dir", sql="SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-10 00:00:00' - (CASE event_id % 3 WHEN 0 THEN INTERVAL 30 MINUTE WHEN 1 THEN INTERVAL 120 MINUTE ELSE INTERVAL 1 DAY END))")
def st06(spark: SparkSession, sf_dir: str, now: str = "2024-01-10") -> DataFrame:
    minutes = F.when(F.col("event_id") % 3 == 0, 30).when(F.col("event_id") % 3 == 1, 120).otherwise(1440)
    kept = records(spark, sf_dir).where(~(F.col("ts").cast("timestamp_ntz") < F.lit(now).cast("timestamp_ntz") - F.make_interval(mins=minutes)))
    return run_once(kept.select("event_id"), "append")


def orphan_expiry(objects: DataFrame, owners: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """object_id of objects (object_id, ts) that no owner (object_id, ts) took within ``days`` of their upload; an owner that comes later finds them expired.

    Both are streams. An object waits in the state of the join until the watermark has passed its days.
    """
    left, right = objects.withWatermark("ts", late).alias("o"), owners.withWatermark("ts", late).alias("w")
    inside = (F.col("w.ts") >= F.col("o.ts")) & (F.col("w.ts") <= F.col("o.ts") + F.expr(f"INTERVAL {days} DAYS"))
    met = left.join(right, (F.col("o.object_id") == F.col("w.object_id")) & inside, "left_outer")
    return met.where("w.object_id IS NULL").select(F.col("o.object_id").alias("object_id"))


@query("st06b_orphan_expiry", "@spark", "@dir", sql="""WITH o AS (SELECT event_id AS object_id, ts FROM events WHERE event_id % 3 = 0), w AS (SELECT event_id - CASE WHEN event_id % 4 = 0 THEN 4 ELSE 3 * (event_id // 6) + 1 END AS object_id, ts FROM events WHERE event_id % 3 = 1 AND event_id % 5 <> 0),
    m AS (SELECT least((SELECT max(ts) FROM o), (SELECT max(ts) FROM w)) - INTERVAL 1 HOUR AS mark) SELECT object_id FROM o, m WHERE ts + INTERVAL 7 DAY < mark AND NOT EXISTS (SELECT 1 FROM w WHERE w.object_id = o.object_id AND w.ts BETWEEN o.ts AND o.ts + INTERVAL 7 DAY)""")
def st06b(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """Every third record is an upload; owners claim the one four records before, or one from half the table's length ago, which is too late for most."""
    n = F.col("event_id")
    objects = records(spark, sf_dir).where(n % 3 == 0).select(n.alias("object_id"), "ts")
    claimed = n - F.when(n % 4 == 0, F.lit(4)).otherwise(3 * F.floor(n / 6) + 1)
    owners = records(spark, sf_dir).where((n % 3 == 1) & (n % 5 != 0)).select(claimed.alias("object_id"), "ts")
    return run_once(orphan_expiry(objects, owners, days), "append")
