"""Operators and stages run by themselves in a session that was started elsewhere, on workers that lack the package."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
JOB = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).config("spark.executor.memory", "1g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, {root!r})
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
{body}
"""
BODIES = {
    "jaccard": "from rookery.llm import jaccard; out = jaccard.classes(docs)",
    "packing": "from rookery.llm import packing; out = packing.pack(docs)",
    "stage jaccard_join": "import corpus_pipeline; out = dict(corpus_pipeline.STAGES)['jaccard_join'](spark, docs, None)",
    "stage best_fit_packing": "import corpus_pipeline; out = dict(corpus_pipeline.STAGES)['best_fit_packing'](spark, docs, None)",
    "bpe": "from rookery.llm import bpe; out = bpe.digests(docs, bpe.load())",
    "wordpiece": "from rookery.llm import wordpiece as w; out = w.counted(docs, w.LongestMatch(*w.vocabulary(), fallback=True))",
    "langid": "from rookery.llm import langid; out = langid.identified(docs)",
    "simhash": "from rookery.llm import simhash; out = simhash.with_successor(docs)",
    "merkle": "from rookery.llm import merkle; out = merkle.manifest(docs)",
}


@pytest.mark.parametrize("name", ["jaccard", "stage best_fit_packing", "merkle"])
def test_runs_alone(tmp_path, name):
    job = JOB.format(root=ROOT, folder=f"file://{tmp_path}/shared", body=BODIES[name] + "\nprint('rows', out.count())")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in done.stdout, done.stderr[-3000:]
