"""Vector code compression: product quantisation in whole numbers, nearest entries by a geometric near-neighbour access tree (GNAT).

Every component x becomes floor(1024 * x); vectors are cut into equal consecutive parts with a codebook each. A GNAT over the entries of a codebook
picks split points, gives every other entry to the nearest split's child and stores, for each split and child, the range of distances from the split to
the child's entries. A query that is further from (or nearer to) a split than the range allows, by strictly more than its best distance so far,
skips the whole subtree; the bound is rounded towards keeping it. Distances that decide are squared whole numbers and ties go to the lower index, so
the codes are those of a full scan.

Each round is one pass over the vectors: every task adds up its parts per entry and emits at most parts * entries rows; Spark adds these; the new
codebooks (parts * entries rows, whatever the input) go through the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; the width is that of the kept row with the least vec_id, and vectors of
another width are dropped, as they cannot be cut alike; a width that the parts do not divide is an error; components beyond 65,536 count as 65,536; rows
with a null vec_id come last and rows with equal vec_id go by their vector where the first entries are chosen; repeated rows count once each; fewer rows than
entries give shorter codebooks; null labels are one label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batch, partitions, ship, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within this; products of two then sum up exactly in 64 bits for parts of up to 256 components.
LIMIT = 1 << 26
#: Up to this size of components, products in doubles are whole numbers.
DOUBLE_LIMIT = 1 << 21


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, exact."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= DOUBLE_LIMIT and x.shape[1] <= 256:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in y], axis=1)


class Gnat:
    """Nearest entry of a codebook for many queries at once."""

    def __init__(self, entries: np.ndarray, degree: int = 8, leaf: int = 12) -> None:
        self.entries, self.degree, self.leaf = entries, degree, leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray) -> tuple:
        """(entries,) of a leaf; (splits, children, lo, hi) of an inner node."""
        if len(ids) <= self.leaf:
            return (ids,)
        points = self.entries[ids]
        chosen, nearest = [0], squared(points, points[:1])[:, 0]
        while len(chosen) < self.degree:  # the point furthest from all splits so far
            nearest[chosen] = -1
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(points, points[chosen[-1:]])[:, 0])
        chosen = np.sort(chosen)
        distance = squared(points, points[chosen])
        owner = distance.argmin(1)
        owner[chosen] = -1
        far = np.sqrt(distance.astype(np.float64))
        groups = [np.flatnonzero(owner == j) for j in range(len(chosen))]
        lo = np.array([[far[g, i].min(initial=np.inf) for g in groups] for i in range(len(chosen))])
        hi = np.array([[far[g, i].max(initial=0) for g in groups] for i in range(len(chosen))])
        return ids[chosen], [self._node(ids[g]) if len(g) else None for g in groups], lo, hi

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance); ties go to the lower index."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        self.compared = 0
        if len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, best, index)
        return index, best

    def _take(self, ids: np.ndarray, at: np.ndarray, queries: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        distance = squared(queries[at], self.entries[ids])
        self.compared += distance.size
        first = distance.argmin(1)  # ids ascend: the lowest of the equal ones
        least, found = distance[np.arange(len(at)), first], ids[first]
        better = (least < best[at]) | ((least == best[at]) & (found < index[at]))
        best[at[better]], index[at[better]] = least[better], found[better]
        return distance

    def _visit(self, node: tuple, at: np.ndarray, queries: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        distance = self._take(node[0], at, queries, best, index)
        if len(node) == 1:
            return
        _, children, lo, hi = node
        far = np.sqrt(distance.astype(np.float64))
        own = np.where([c is not None for c in children], far, np.inf).argmin(1)
        for first in (True, False):  # the nearest split's child first: it makes the bound small
            for j, child in enumerate(children):
                if child is None:
                    continue
                mine = own == j
                if first:
                    go = np.flatnonzero(mine)
                else:
                    reach = np.sqrt(best[at].astype(np.float64))
                    # an entry of the child is at least this far, less what rounding may have added
                    gap = np.maximum(far - hi[:, j], lo[:, j] - far) - (far + hi[:, j] + lo[:, j]) * 2.0**-48
                    go = np.flatnonzero(~mine & ~(gap.max(1) > reach * (1 + 2.0**-48)))
                if len(go):
                    self._visit(child, at[go], queries, best, index)


def whole_numbers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept of a batch, their components as whole numbers)."""
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == width)
    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    finite = np.isfinite(values).all(1)  # a null component has become NaN
    return rows[finite], np.clip(np.floor(values[finite] * SCALE), -LIMIT, LIMIT).astype(np.int64)


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """The kept vectors of the least vec_ids, one row each."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    least = rows.where(F.col("embedding").isNotNull() & fine).orderBy(F.asc_nulls_last("vec_id"), "embedding")
    found = [r["embedding"] for r in least.select("embedding", "vec_id").limit(entries).collect()]
    found = [v for v in found if len(v) == len(found[0])]
    return np.clip(np.floor(np.array(found, dtype=np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64) if found else np.zeros((0, 0), np.int64)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One array (entries, width / parts) per part after ``rounds`` rounds; empty if no vector is kept."""
    ship(rows.sparkSession)
    first = first_entries(rows, entries)
    width = first.shape[1]
    if width == 0:
        return []
    if width % parts:
        raise ValueError(f"vectors of width {width} cannot be cut into {parts} equal parts")
    size, books = width // parts, np.split(first, parts, axis=1)
    schema = "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(size))
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            trees = [Gnat(b) for b in books]
            count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
            for batch in batches:
                _, x = whole_numbers(batch, width)
                for p, tree in enumerate(trees):
                    own = x[:, p * size : (p + 1) * size]
                    code, _ = tree.nearest(own)
                    count[p] += np.bincount(code, minlength=entries)
                    for k in range(size):  # sums of a batch are whole in doubles
                        total[p, :, k] += np.bincount(code, weights=own[:, k], minlength=entries).astype(np.int64)
            part, entry = np.nonzero(count)
            names = ["part", "entry", "n", *(f"s{k}" for k in range(size))]
            data = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), *(pa.array(total[part, entry, k]) for k in range(size))]
            yield pa.RecordBatch.from_arrays(data, names=names)

        added = rows.select("embedding").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(size)))
        books = [b.copy() for b in books]
        for r in added.collect():  # parts * entries rows at most
            books[r["part"]][r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(size)]
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error for every kept row."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not books:
        return rows.sparkSession.createDataFrame([], out)
    size = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            kept, x = whole_numbers(batch, size * len(books))
            error, codes = np.zeros(len(kept), np.int64), np.zeros((len(kept), len(books)), np.uint8)
            for p, tree in enumerate(trees):
                codes[:, p], d = tree.nearest(x[:, p * size : (p + 1) * size])
                error += d
            own = [batch.column(batch.schema.get_field_index(n)).take(pa.array(kept)) for n in ("vec_id", "label")]
            schema = pa.schema([("vec_id", own[0].type), ("label", own[1].type), ("code", pa.string()), ("error", pa.int64())])
            yield arrow_batch(schema, [*own, [c.tobytes().hex() for c in codes], error])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, out)


def decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Approximate vectors of rows of codes (n, parts)."""
    return np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1) / SCALE


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels.

    A label with more rows than a partition's share is one of as many labels as there are partitions at most: these sums are broadcast. The others are joined by
    label; rows of the first kind get keys of their own there, so no task meets a hot label.
    """
    n = partitions(rows.sparkSession)
    sums = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "pq-labels")
    share = F.lit(sums.agg(F.sum("n")).first()[0] or 0) / n
    hot = sums.where(F.col("n") > share).select(F.col("label").alias("hot_label"), F.col("label_error").alias("hot_error"))
    name = F.concat(F.lit("="), F.coalesce(F.col("label").cast("string"), F.lit("\0")))
    cold = sums.where(F.col("n") <= share).select(name.alias("key"), F.col("label_error").alias("cold_error"))
    found = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot_label")), "left")
    found = found.withColumn("key", F.when(F.col("hot_error").isNull(), name).otherwise(F.concat(F.lit("-"), F.xxhash64("vec_id", "code"))))
    return found.join(cold, "key", "left").select("vec_id", "label", "code", "error", F.coalesce("hot_error", "cold_error").alias("label_error"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = codebooks(rows)
    return with_label_error(staged(coded(rows, books), "pq-codes")).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """Full scans in place of trees."""
    assign = lambda k: f"""a{k} AS MATERIALIZED (SELECT x.id, x.part, arg_min(c.entry, struct_pack(d := x.q + c.q - 2 * CAST(list_dot_product(x.f, c.f) AS BIGINT), e := c.entry)) AS entry, min(x.q + c.q - 2 * CAST(list_dot_product(x.f, c.f) AS BIGINT)) AS d
        FROM x JOIN c{k} c ON x.part = c.part GROUP BY x.id, x.part)"""  # noqa: E731
    entry = "CAST(v AS DOUBLE[]) AS f, CAST(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) AS BIGINT) AS q"
    steps = [f"c0 AS MATERIALIZED (SELECT part, CAST(id AS INT) AS entry, v, f, q FROM x WHERE id < {entries})"]
    for k in range(rounds):
        steps.append(assign(k))
        steps.append(f"""s{k} AS (SELECT part, entry, k, CAST(sum(v[k]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT a.part, a.entry, x.v, unnest(range(1, len(x.v) + 1)) AS k FROM a{k} a JOIN x USING (id, part)) GROUP BY ALL),
            m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS v FROM s{k} GROUP BY ALL),
            c{k + 1} AS MATERIALIZED (SELECT part, entry, v, {entry} FROM (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry)))""")
    steps.append(assign(rounds))
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS w, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    x AS MATERIALIZED (SELECT id, part, v, {entry} FROM (SELECT id, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS v FROM (SELECT *, unnest(range({parts})) AS part FROM e))), {", ".join(steps)},
    r AS (SELECT id, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d) AS error FROM a{rounds} GROUP BY id)
    SELECT vec_id, lower(code) AS code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM e JOIN r USING (id)"""


SQL = _sql()
