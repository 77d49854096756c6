"""Proportional stratified interleaving: shards of equal row counts that all carry the corpus mixture.

Rows are shuffled by a seeded hash inside their source, ranked there, and given the fractional rank
(2 * rank - 1) / (2 * rows of the source). Sorting by that number interleaves the sources in proportion,
so cutting the order into equal runs gives every shard the same mixture.

Neither ranking is done in one task: a source is split by the leading bits of the shuffle hash and the
global order by the value of the fractional rank; row numbers inside a piece plus the count of all earlier
pieces are the exact ranks, so a source that holds a third of the corpus spreads over many tasks.

The number of pieces grows with the row count, so a piece holds about PIECE_ROWS rows at most.

Law: ``rows`` (shard sizes at most one apart). Defined cases: a null source is a stratum of its own, a null
text has no bytes (size 1, crc32 0), rows with a null doc_id are shuffled by their place in the table, repeated rows are separate rows with slots of their own, rows that tie in
the hash go by doc_id and size (equal ones in any order), very long texts only give their size and checksum, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import documents, staged

SEED = 20240229
#: Rows in a piece of a source or of the global order, and the least number of pieces (a power of two).
PIECE_ROWS, LEAST_BITS = 1 << 20, 8


def interleaved(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source, fraction, position (0-based), shard, slot for every row of ``docs``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    ).select(
        "*",
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("stratum"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))), "text_crc32").alias("dice"),
    )
    rows = staged(rows, "shard-rows")  # the texts are read once
    bits = max(LEAST_BITS, (rows.count() // PIECE_ROWS).bit_length())
    rows, pieces = rows.withColumn("piece", F.shiftright("dice", 64 - bits)), 1 << bits
    whole = Window.partitionBy("stratum")
    counts = rows.groupBy("stratum", "piece").agg(F.count("*").alias("n")).select(
        "stratum", "piece",
        (F.sum("n").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("stratum_rows"),
    )
    order = ["dice", "doc_id", "size"]
    ranked = rows.join(counts, ["stratum", "piece"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("stratum", "piece").orderBy(*order))
    ).withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("stratum_rows"))).withColumn(
        "slice", F.floor(F.col("fraction") * pieces).cast("int")
    )
    # one row per PIECE_ROWS rows: the unpartitioned window and the broadcast stay small
    slices = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    all_before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.select(
        "slice", (F.sum("n").over(all_before) - F.col("n")).alias("earlier"),
        F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    placed = ranked.join(F.broadcast(slices), "slice").withColumn(
        "position",
        F.col("earlier") + F.row_number().over(Window.partitionBy("slice").orderBy("fraction", "stratum", *order)) - 1,
    )
    # shard s holds positions from ceil(s * total / shards) on
    shard = F.expr(f"CAST((position * {shards}) DIV total AS INT)")
    first = F.expr(f"((CAST((position * {shards}) DIV total AS BIGINT)) * total + {shards - 1}) DIV {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", "source", "fraction", "position", shard.alias("shard"),
        (F.col("position") - first).cast("long").alias("slot"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "position",
    )
