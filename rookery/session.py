"""What every job needs from its session: tables by name and the package on the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as spark-submit --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_rookery_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="rookery-"), "rookery"), "zip", root_dir=root, base_dir="rookery")
    context.addPyFile(archive)
    context._rookery_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    Where neither is set, a local master gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rookery-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the driver's JVM ends."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str, compression: str = "snappy", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors. It goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = delete_at_end(spark, f"{shared_dir(spark)}/rookery/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (what was made of them has been stored)."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_STORED: list[tuple] = []


def _there(df: DataFrame) -> bool:
    """Whether the files of a stored table still exist (its first one stands for all; an empty table has none)."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    some = df.inputFiles()[:1]
    return all((path := jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) for f in some)


def stored(rows: DataFrame, name: str, build: Callable[[DataFrame], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The tables that ``build`` makes of ``rows``, made once per application, name and plan of ``rows``: an index as of the time it was built."""
    context = rows.sparkSession.sparkContext
    for owner, kind, of, made in _STORED:
        if owner == context.applicationId and kind == name and of.sameSemantics(rows) and all(_there(df) for df in made):
            return made
    made = build(rows)
    _STORED.append((context.applicationId, name, rows, made))
    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
