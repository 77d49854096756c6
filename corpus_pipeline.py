"""Corpus pipeline: language ID, quality rules, n-gram Jaccard join, best-fit packing.

Every stage takes all that the stage before kept, written as Parquet and read again.

Defined cases, for every stage: nulls may stand in any column; an empty table gives no rows; very long texts are taken whole; other columns,
whatever their names, are kept (the last stage leaves them out).

- language_id: texts that are null or without a letter go; rows that repeat stay; a tie of languages goes to the one that sorts first.
- quality_rules: null, empty and short texts fail the base rules and go; null lang and source are groups of their own; rows that repeat are
  judged alike.
- jaccard_join: one row of each class stays, the one with the least doc_id (rows without one come last, ties go to the least text digest);
  rows that repeat are one; rows with equal doc_ids and other texts are other documents; texts without a word are linked to equal texts only.
- best_fit_packing: null and empty texts are one piece of length 1; rows that repeat are separate pieces; ties go to the bin found first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import jaccard, langid, packing, quality
from rookery.llm._util import documents, ship, staged

#: A document whose strongest language makes up less than this share (see the score in langid) is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = langid.identified(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("best_fit_packing", best_fit_packing)]

#: SQL expresses neither the language mixtures nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
