"""Files in and out: every sink writes below a folder that driver and executors share and tells where."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import delete_at_end, shared_dir

#: CSV as spreadsheets write it: quotes are doubled, cells may hold line breaks, empty cells are not nulls.
CSV = {"header": True, "quote": '"', "escape": '"', "quoteAll": True, "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder; what is written there goes when the driver ends."""
    return delete_at_end(spark, f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, kind: str, name: str, partition_by: list[str] | None = None, append_to: str | None = None, **options) -> str:
    """The folder that ``df`` was written to, in parallel; ``append_to``: an existing one."""
    path = append_to or fresh(df.sparkSession, name)
    writer = df.write.format(kind).mode("append" if append_to else "error").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def csv_written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    return written(df, "csv", name, partition_by, **CSV)


def csv_read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as texts, by the names in the header."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.options(**CSV, multiLine=True).schema(schema).csv(path)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (file, row, ...) with the 0-based position in a folder of files written range by range: rows of earlier files, then the row's own place.

    Only the counts of the files are summed over all of them.
    """
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", (F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(before, "file").withColumn("position", F.col("before") + F.col("row"))
