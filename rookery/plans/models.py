"""Embedding jobs with pluggable models, and approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import ship
from .cells import approximate_search, coded_index

WIDTH = 64


def feature_hashing(texts: pd.Series) -> list[list[float]]:
    """Deterministic default model: word counts hashed to WIDTH signed dimensions, unit length."""
    import zlib

    out = []
    for text in texts:
        v = np.zeros(WIDTH)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % WIDTH] += 1 if h & 0x10000 else -1
        out.append((v / max(1e-9, np.linalg.norm(v))).tolist())
    return out


# The default model in SQL: words counted into 64 signed numbers, unit length, single precision.
HASHED_SQL = """{name} AS (SELECT id, list(CAST(v / greatest(1e-9, norm) AS FLOAT) ORDER BY k) AS e FROM (SELECT id, k, coalesce(sum(sgn * n), 0)::DOUBLE AS v, sqrt(sum(coalesce(sum(sgn * n), 0)::DOUBLE ** 2) OVER (PARTITION BY id)) AS norm FROM (SELECT id, unnest(range(64)) AS k FROM {table}) g
    LEFT JOIN (SELECT id, h % 64 AS k, CASE WHEN (h // 65536) % 2 = 1 THEN 1 ELSE -1 END AS sgn, count(*) AS n FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM {table}) JOIN hw USING (w) GROUP BY 1, 2, 3) USING (id, k) GROUP BY 1, 2) GROUP BY 1)"""
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: CAST(get_bit_byte AS BIGINT))), lambda s, x: list_reduce(list_prepend(xor(s, x), CAST(range(8) AS BIGINT[])), lambda a, j: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)".replace(
    "CAST(get_bit_byte AS BIGINT)", "CAST('0x' || hex(encode(w))[2 * i + 1:2 * i + 2] AS BIGINT)")


def embedded(rows: DataFrame, key: str, text: str, model: Callable[[pd.Series], list[list[float]]] = feature_hashing, size: int = 10) -> DataFrame:
    """key, embedding for every row; the model sees ``size`` texts at a time."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = (batch[text].iloc[a : a + size] for a in range(0, len(batch), size))
            yield pd.DataFrame({key: batch[key], "embedding": [v for part in parts for v in model(part)]})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An index after some paragraphs were embedded again: their old rows go, all new ones come."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


@query("t34b_replaced_vectors", "v_embedding", sql="SELECT paragraph_id, count(*) AS n, count(*) FILTER (WHERE paragraph_id % 4 = 0) AS made FROM (SELECT paragraph_id FROM v_embedding WHERE paragraph_id % 4 <> 0 UNION ALL SELECT DISTINCT paragraph_id FROM v_embedding WHERE paragraph_id % 4 = 0) GROUP BY 1")
def replaced_vectors(rows: DataFrame) -> DataFrame:
    """Every fourth paragraph is embedded again as one row (here from its number as text)."""
    stored = rows.select("paragraph_id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(0).alias("made"))
    again = rows.where("paragraph_id % 4 = 0").select("paragraph_id", F.col("paragraph_id").cast("string").alias("content")).distinct()
    new = embedded(again, "paragraph_id", "content").withColumn("made", F.lit(1))
    return replaced(stored, new, "paragraph_id").groupBy("paragraph_id").agg(F.count("*").alias("n"), F.sum("made").alias("made"))


@query("t34_embedding_batch", "v_paragraph", sql=f"""WITH pt AS (SELECT paragraph_id AS id, content AS text FROM v_paragraph), hw AS (SELECT w, {CRC_SQL} AS h FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM pt)), {HASHED_SQL.format(name='pe', table='pt')}
    SELECT id AS paragraph_id, array_to_string(list_transform(e, lambda x: CAST(floor(x::DOUBLE * 1000000 + 0.5) AS BIGINT)), ',') AS millionths FROM pe""")
def t34(paragraphs: DataFrame) -> DataFrame:
    """Every component in millionths."""
    vectors = embedded(paragraphs, "paragraph_id", "content")
    return vectors.select("paragraph_id", F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1_000_000 + 0.5)), ",").alias("millionths"))


@query("t39_cell_index_search", "v_embedding", "v_query_vec")
def t39(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The five nearest rows per query and knowledge base by the stored index of quantised residuals (see cells.py)."""
    hits, _ = approximate_search(coded_index(rows), queries)
    return hits.select("query_id", "knowledge_id", "id", F.round("score", 6).alias("score"), "rank")
