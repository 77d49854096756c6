"""Small helpers shared by the corpus operators: tables, staging, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.session import discard, ship, staged, table  # noqa: F401

#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, limit: int = 4 << 20) -> Iterator[tuple[list, ...]]:
    """Lists of the named columns, cut so that the texts of one piece stay near ``limit`` characters.

    The last name is the text column.
    """
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        start = 0
        while start < batch.num_rows:
            size, end, texts = 0, start, []
            while end < batch.num_rows and (end == start or size < limit):
                value = columns[-1][end].as_py()
                texts.append(value)
                size += len(value or "")
                end += 1
            yield (*(c.slice(start, end - start).to_pylist() for c in columns[:-1]), texts)
            start = end


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
