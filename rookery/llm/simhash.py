"""SimHash fingerprints and the search of all fingerprints within a Hamming radius.

Terms are neighbouring word pairs of the lower-cased text, weighted by their length; their 64-bit hashes vote on 64 signed
bits. ``within`` finds every fingerprint within ``radius`` bits of a query: the bits are cut into ``blocks``, and
for every choice of blocks - radius blocks a permuted table is keyed by those blocks. Two fingerprints that differ in
at most radius bits agree on all blocks of at least one choice, so no neighbour is missed.

``op6`` also needs the next document: rows are dealt into ranges of doc_id, the first row of each range is sent
to the range before as well, and one pass over the sorted ranges sees each document with its successor. The texts
are shuffled once.

Defined cases: a null text is empty and has fingerprint 0; a null doc_id sorts before all others; rows with equal
doc_id are ordered by text; a table of one row is its own successor; votes that tie clear the bit;
very long texts are voted on whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, partitions, ship, staged

RADIUS, BLOCKS = 3, 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 64), 0x100000001B3, dtype=np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and length in bytes of each word (runs of anything but ASCII white space)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    ink = np.flatnonzero(~_SPACE[data])
    if not len(ink):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.diff(ink, prepend=-2) != 1)
    lengths = np.diff(np.append(starts, len(ink)))
    within = np.arange(len(ink)) - np.repeat(starts, lengths)
    values = (data[ink].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(values, starts)), lengths


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fingerprint(text: str) -> int:
    h, n = word_hashes(text.lower())
    if not len(h):
        return 0
    weight = np.minimum(n, 16)
    if len(h) > 1:
        h = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        weight = weight[:-1] + weight[1:]
    votes = np.zeros(64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weight[at : at + (1 << 15)].astype(np.float32) @ bits.astype(np.float32)
    return int(np.packbits(2 * votes > weight.sum(), bitorder="little").view(np.uint64)[0])


def _likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_successor(docs: DataFrame) -> DataFrame:
    """fingerprints of each text and of its text edited with the next document's beginning."""
    ship(docs.sparkSession)
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("bigint").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # n - 1 bounds from a mergeable quantile summary, and the least key of each range: both of a fixed size
    cuts = rows.select(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n) if n > 1 else F.lit(None)).first()[0]
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    heads = {r["range"]: r["least"] for r in rows.select(range_of("key").alias("range"), "key").groupBy("range").agg(F.min("key").alias("least")).collect()}
    order = sorted(heads)
    dense = {r: i for i, r in enumerate(order)}
    before = {heads[r]: (i - 1) % len(order) for i, r in enumerate(order)}

    @F.pandas_udf("array<int>")
    def ranges(key: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, key.to_numpy(), side="right")
        return pd.Series([[dense[a], before[k]] if k in before else [dense[a]] for a, k in zip(at.tolist(), key.tolist(), strict=True)])

    dealt = rows.select("doc_id", "key", "text", F.posexplode(ranges("key")).alias("copy", "range"))
    dealt = dealt.repartitionById(max(1, len(order)), F.col("range")).sortWithinPartitions("range", "copy", "key", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, done = None, False
        out: list[tuple] = []
        schema = None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()), ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            ids, texts, copies = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "copy"))
            for i in range(batch.num_rows):
                copy = copies[i].as_py()
                if done:
                    break  # further copies of the head stand for rows with the same doc_id
                text = texts[i].as_py()
                print_ = fingerprint(text)
                if previous is not None:
                    doc_id, old, own = previous
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    changed = fingerprint(edited)
                    out.append((doc_id, len(old), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), _signed(own), _signed(changed), _likeness(own, changed), _likeness(own, print_)))
                    if len(out) >= 2000:
                        yield flush()
                previous, done = (ids[i].as_py(), text, print_), copy > 0
        if out:
            yield flush()

    return dealt.select("doc_id", "text", "copy").mapInArrow(scan, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, near_edited double, near_next double")


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) for every fp of ``prints`` within ``radius`` bits of a query. Both: distinct bigints, column fp."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in c) for c in choices]
        tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
        return df.select(F.col("fp").alias(name), F.inline(tables))

    found = keyed(queries, "query").join(keyed(prints, "fp"), ["table", "bits"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return found.where(distance <= radius).select("query", "fp", distance.alias("distance")).distinct()


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness columns for all rows; ``n_near``, the number of other fingerprints within the radius, for every doc_id divisible by 20."""
    rows = staged(with_successor(documents(spark, sf_dir)), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = within(rows.select("fp").distinct(), rows.where(asked).select("fp").distinct())
    near = near.where("query <> fp").groupBy(F.col("query").alias("fp")).agg(F.count("*").alias("near"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(asked, F.coalesce("near", F.lit(0))).alias("n_near"),
    )
