"""Cells of vectors per knowledge base: k-means over all rows, bounds that make search exact, and an index of quantised residuals.

Rows of a base are dealt into about sqrt(n) cells. Centres are moved by rounds over all rows: a task adds up its rows per cell, Spark adds these sums, no row
passes through the driver. A cell that got more than its share is given a handicap, so sizes stay near each other.

Exact search: a row lies within its cell's widest angle of the centre, so a cell's best possible score for a query follows from the angle between query and centre. A first
pass looks into the nearest cells of each query and base; its k-th score is a floor; a second pass looks into the other cells that can beat the floor,
and only rows at or above it leave their task.

Approximate search: residuals from the centres are coded by small codebooks per slice of the vector; scores of coded rows are sums of looked-up products;
the best few per query and base are compared with the stored vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import numbered
from ..session import ship, staged, stored

#: Most cells of a base; rows that meet the centres in one task; rows and queries that meet in one task; cells that a block of queries meets in one task.
MOST_CELLS, FIT_PART, ROW_PART, QUERY_BLOCK, CELL_PART = 4096, 1 << 16, 1 << 13, 1024, 1 << 13
#: Handicap of a cell of twice the mean size, and slack for rounding.
BALANCE, SLACK, SEED = 0.02, 1e-9, 3
#: Quantised residuals: slices, entries of a slice's codebook, rows that the codebooks are fitted on, and folders that the bases are dealt into.
SLICES, ENTRIES, SAMPLE, SHELVES = 16, 128, 1 << 16, 64


class Index(NamedTuple):
    """placed: the rows with ``cell``; bounds: knowledge_id, cell, centre, n and the least dot product of centre and row."""

    placed: DataFrame
    bounds: DataFrame


def unit(vectors: list | np.ndarray) -> np.ndarray:
    v = np.stack(vectors).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _met(rows: DataFrame, centres: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` on each part of a base's rows and all its centres."""
    parts = rows.groupBy("knowledge_id").agg(F.ceil(F.count("*") / FIT_PART).cast("int").alias("parts"))
    dealt = rows.join(parts, "knowledge_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    each = centres.join(parts, "knowledge_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("knowledge_id", "part").cogroup(each.groupBy("knowledge_id", "part")).applyInPandas(run, schema)


def _own(rows: pd.DataFrame, centres: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit rows, unit centres, place of each row's centre, their dot product)."""
    x, c = unit(rows["embedding"].to_list()), unit(centres["centre"].to_list())
    dots = x @ c.T
    own = (dots - centres["handicap"].to_numpy()).argmax(1)
    return x, c, own, dots[np.arange(len(x)), own]


def fitted(rows: DataFrame, rounds: int = 3, most: int = MOST_CELLS) -> DataFrame:
    """knowledge_id, cell, centre, handicap."""
    ship(rows.sparkSession)
    kind = rows.schema["knowledge_id"].dataType.simpleString()
    sized = rows.groupBy("knowledge_id").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("cells", F.least(F.lit(most), F.ceil(F.sqrt("n"))))
    chosen = rows.join(sized, "knowledge_id").where((F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("n")) < F.col("cells")) | (F.col("id") == F.col("least")))
    first = chosen.select("knowledge_id", (numbered("knowledge_id", order=["id"]) - 1).cast("int").alias("cell"), F.col("embedding").cast("array<double>").alias("centre"), F.lit(0.0).alias("handicap"))
    centres = staged(first, "cells-first")
    one = centres.select(F.size("centre").alias("width")).first()
    if one is None:
        return centres

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["knowledge_id", "cell", "n", "v"])
        b = b.sort_values("cell", ignore_index=True)
        x, _, own, _ = _own(a, b)
        used = np.unique(own)
        return pd.DataFrame({"knowledge_id": a["knowledge_id"].iloc[0], "cell": b["cell"].to_numpy()[used], "n": [int((own == c).sum()) for c in used], "v": [x[own == c].sum(0).tolist() for c in used]})

    for _ in range(rounds):
        added = _met(rows, centres, sums, f"knowledge_id {kind}, cell int, n long, v array<double>").groupBy("knowledge_id", "cell").agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(one["width"])])
        mean = F.avg("n").over(W.partitionBy("knowledge_id"))  # one row per cell
        centres = staged(added.select("knowledge_id", "cell", F.array(*[f"v{i}" for i in range(one["width"])]).alias("centre"), (BALANCE * (F.col("n") / mean - 1)).alias("handicap")), "cells-round")
    return centres


def indexed(rows: DataFrame) -> Index:
    """The stored cells of ``rows`` (id, knowledge_id, embedding and more), built when first asked for."""
    return Index(*stored(rows, "cells", _build))


def _build(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.where("knowledge_id IS NOT NULL AND embedding IS NOT NULL")
    centres = fitted(rows)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return a.drop(columns="part").assign(cell=pd.Series(dtype="int32"), dot=pd.Series(dtype="float64"))
        b = b.sort_values("cell", ignore_index=True)
        _, _, own, dot = _own(a, b)
        return a.drop(columns="part").assign(cell=b["cell"].to_numpy()[own], dot=dot)

    placed = staged(_met(rows, centres, place, f"{fields}, cell int, dot double"), "cells-rows")
    sizes = placed.groupBy("knowledge_id", "cell").agg(F.count("*").alias("n"), F.min("dot").alias("reach"))
    return placed.drop("dot"), staged(sizes.join(centres.drop("handicap"), ["knowledge_id", "cell"]), "cells-bounds")


def _blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")), blocks


def _choices(index: Index, asked: DataFrame, blocks: int, choose: Callable, extra: str = "") -> DataFrame:
    """query_id, knowledge_id, cell, block for the cells that ``choose`` takes of each base. ``asked``: query_id, embedding, block and more.

    Bases are dealt into groups of about CELL_PART cells; each meets each block of queries.
    """
    groups = max(1, -(-index.bounds.count() // CELL_PART))
    kind = index.bounds.schema["knowledge_id"].dataType.simpleString()
    group = F.pmod(F.xxhash64("knowledge_id"), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.bounds.withColumn("grp", group).withColumn("block", every(blocks))
    right = asked.withColumn("grp", every(groups))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            if "floors" in b:
                b = b.assign(floors=[dict(f) if f is not None else {} for f in b["floors"]])
            q, names = unit(b["embedding"].to_list()), b["query_id"].to_numpy()
            for kb, own in a.sort_values("cell").groupby("knowledge_id"):
                dots = np.clip(q @ unit(own["centre"].to_list()).T, -1, 1)
                at, cell = np.nonzero(choose(dots, own, b, kb))
                out.append(pd.DataFrame({"query_id": names[at], "knowledge_id": kb, "cell": own["cell"].to_numpy()[cell], "block": b["block"].iloc[0]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "knowledge_id", "cell", "block"])

    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(run, f"query_id bigint, knowledge_id {kind}, cell int, block int")


def nearest_cells(enough: float, share: bool = False) -> Callable:
    """The nearest cells of each query until they hold ``enough`` rows (or that share of the base)."""

    def choose(dots: np.ndarray, own: pd.DataFrame, _asked: pd.DataFrame, _kb) -> np.ndarray:  # noqa: ANN001
        order = np.argsort(-dots, axis=1, kind="stable")
        sizes = own["n"].to_numpy()[order]
        before = np.cumsum(sizes, axis=1) - sizes
        take = np.zeros(dots.shape, dtype=bool)
        np.put_along_axis(take, order, before < (enough * own["n"].sum() if share else enough), axis=1)
        return take

    return choose


def can_beat(enough: float, threshold: float) -> Callable:
    """Cells that may hold a row above the floor of the query and base, less those of the first pass."""
    first = nearest_cells(enough)

    def choose(dots: np.ndarray, own: pd.DataFrame, asked: pd.DataFrame, kb) -> np.ndarray:  # noqa: ANN001
        reach = np.clip(own["reach"].to_numpy(), -1, 1)
        best = np.where(dots >= reach, 1.0, dots * reach + np.sqrt((1 - dots**2) * (1 - reach**2)))
        floor = np.array([max(threshold, f.get(kb, -1.0)) for f in asked["floors"]])
        return (best + SLACK >= floor[:, None]) & ~first(dots, own, asked, kb)

    return choose


HIT = "query_id bigint, knowledge_id {kind}, id bigint, paragraph_id bigint, document_id bigint, score double"
COLUMNS = ["query_id", "knowledge_id", "id", "paragraph_id", "document_id", "score"]


def best_rows(keep: int, by: str | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The ``keep`` best rows of a group per query, none below the query's floor; with ``by``, the best row of each of the ``keep`` best values of that column."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=COLUMNS)
        a = a.sort_values("id" if by is None else [by, "id"], ignore_index=True)
        x, out = unit(a["embedding"].to_list()), []
        starts = None if by is None else np.flatnonzero(np.r_[True, a[by].to_numpy()[1:] != a[by].to_numpy()[:-1]])
        for begin in range(0, len(b), QUERY_BLOCK):
            some = b.iloc[begin : begin + QUERY_BLOCK]
            scores = unit(some["embedding"].to_list()) @ x.T
            rows = np.arange(len(x))
            if by is not None:  # the first of the best rows of each value
                top = np.maximum.reduceat(scores, starts, axis=1)
                sizes = np.diff(np.r_[starts, len(x)])
                hit = np.where(scores == np.repeat(top, sizes, axis=1), rows, len(x))
                rows, scores = np.minimum.reduceat(hit, starts, axis=1), top
            order = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
            score = np.take_along_axis(scores, order, axis=1)
            at, place = np.nonzero(score >= some["floor"].to_numpy()[:, None] - SLACK)
            chosen = order[at, place]
            where = chosen if by is None else rows[at, chosen]
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[at], "score": score[at, place]} | {c: a[c].to_numpy()[where] for c in ("knowledge_id", "id", "paragraph_id", "document_id")}))
        return pd.concat(out)[COLUMNS]

    return best


def _own_columns(df: DataFrame) -> DataFrame:
    """``df`` with attributes of its own: both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _scanned(index: Index, visits: DataFrame, asked: DataFrame, keep: int, by: str | None) -> DataFrame:
    """Best rows of the visited cells. ``visits``: query_id, knowledge_id, cell, block, floor."""
    kind = index.bounds.schema["knowledge_id"].dataType.simpleString()
    parts = index.bounds.select("knowledge_id", "cell", F.ceil(F.col("n") / ROW_PART).cast("int").alias("parts"))
    met = visits.select("knowledge_id", "cell", "block").distinct().join(parts, ["knowledge_id", "cell"])
    rows = index.placed.select("id", "knowledge_id", "paragraph_id", "document_id", "embedding", "cell").join(met, ["knowledge_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    there = visits.join(asked.select("query_id", "embedding"), "query_id").join(parts, ["knowledge_id", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["knowledge_id", "cell", "part", "block"]
    return _own_columns(rows).groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(best_rows(keep, by), HIT.format(kind=kind))


def exact_candidates(index: Index, queries: DataFrame, k: int, keep: int, by: str | None = None, threshold: float = -1.0, need: str = "paragraph_id", relative: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(hits, visits): all rows that may be among the best k values of ``need`` per query and base, and the cells looked into.

    ``keep`` rows leave each part of a cell at most (with ``by``: best rows of that many values); scores below ``threshold`` are not wanted. With ``relative``, all
    rows that reach this share of the k-th best score are hits.
    """
    ship(index.placed.sparkSession)
    asked, blocks = _blocks(queries)
    enough = 4.0 * k
    first = staged(_choices(index, asked, blocks, nearest_cells(enough)), "dense-first")
    near = staged(_scanned(index, first.withColumn("floor", F.lit(threshold)), asked, keep, by), "dense-near")
    best = near.groupBy("query_id", "knowledge_id", need).agg(F.max("score").alias("score")).withColumn("r", numbered("query_id", "knowledge_id", order=[F.desc("score")]))
    floors = best.where(F.col("r") == k).select("query_id", "knowledge_id", (relative * F.col("score")).alias("score"))
    told = floors.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("knowledge_id", "score"))).alias("floors"))
    second = staged(_choices(index, asked.join(told, "query_id", "left"), blocks, can_beat(enough, threshold)), "dense-second")
    floor = F.greatest(F.lit(threshold), F.coalesce("score", F.lit(threshold)))
    rest = _scanned(index, second.join(floors, ["query_id", "knowledge_id"], "left").withColumn("floor", floor).drop("score"), asked, keep, by)
    return near.unionByName(rest), first.unionByName(second)


def compared(index: Index, visits: DataFrame) -> tuple[int, int]:
    """(pairs compared by these visits, pairs of a full grid of their queries)."""
    got = visits.join(index.bounds.select("knowledge_id", "cell", "n"), ["knowledge_id", "cell"]).agg(F.sum("n").alias("n"), F.count_distinct("query_id").alias("q")).first()
    return got["n"] or 0, (got["q"] or 0) * index.placed.count()


# The index of quantised residuals


class Coded(NamedTuple):
    """rows: placed rows with ``code`` (one byte per slice), stored by shelf and sorted by base and cell; bounds as in Index; books: slice, entry, v."""

    rows: DataFrame
    bounds: DataFrame
    books: DataFrame


def shelf(base: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(base), F.lit(SHELVES)).cast("int")


def coded_index(rows: DataFrame) -> Coded:
    return Coded(*stored(rows, "coded cells", _code))


def _residuals(placed: DataFrame, bounds: DataFrame, run: Callable, schema: str) -> DataFrame:
    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return run(a.iloc[:0], np.zeros((0, 1)))
        b = b.sort_values("cell", ignore_index=True)
        c = unit(b["centre"].to_list())
        return run(a, unit(a["embedding"].to_list()) - c[np.searchsorted(b["cell"].to_numpy(), a["cell"].to_numpy())])

    return _met(placed, bounds, each, schema)


def _code(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codebooks come from SAMPLE rows (least seeded hashes), one task per slice; every row is coded."""
    ship(rows.sparkSession)
    index = indexed(rows)
    n = index.placed.count()
    some = index.placed.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, n))) < SAMPLE)
    cut = lambda r: np.array_split(r, SLICES, axis=1)

    def slices(a: pd.DataFrame, r: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(i, row.tolist()) for i, part in enumerate(cut(r)) for row in part] if len(a) else [], columns=["slice", "v"])

    def book(a: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(a["v"].to_list())
        x = x[np.lexsort(x.T[::-1])]
        c = x[:: max(1, len(x) // ENTRIES)][:ENTRIES].copy()
        for _ in range(8):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            for e in np.unique(own):
                c[e] = x[own == e].mean(0)
        return pd.DataFrame({"slice": a["slice"].iloc[0], "entry": np.arange(len(c)), "v": c.tolist()})

    books = staged(_residuals(some, index.bounds, slices, "slice int, v array<double>").groupBy("slice").applyInPandas(book, "slice int, entry int, v array<double>"), "cells-books")
    known = _books(books)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.placed.schema)

    def code(a: pd.DataFrame, r: np.ndarray) -> pd.DataFrame:
        codes = np.stack([((c * c).sum(1) - 2 * x @ c.T).argmin(1) for x, c in zip(cut(r), known, strict=True)], axis=1).astype(np.uint8) if len(a) else ()
        return a.drop(columns="part", errors="ignore").assign(code=[x.tobytes() for x in codes])

    coded = _residuals(index.placed, index.bounds, code, f"{fields}, code binary").withColumn("shelf", shelf(F.col("knowledge_id")))
    kept = staged(coded.repartition("shelf", "knowledge_id", "cell").sortWithinPartitions("shelf", "knowledge_id", "cell"), "cells-coded", partition_by=("shelf",))
    return kept, index.bounds, books


def _books(books: DataFrame) -> list[np.ndarray]:
    """SLICES arrays of at most ENTRIES short vectors."""
    found = sorted((r["slice"], r["entry"], r["v"]) for r in books.collect())
    return [np.array([v for s, _, v in found if s == i]) for i in range(SLICES if found else 0)]


def approximate_search(index: Coded, queries: DataFrame, k: int = 5, probe: float = 0.75, closer: int = 4) -> tuple[DataFrame, DataFrame]:
    """(hits, candidates): the best k per query and base among the ``closer`` * k rows whose codes score best in the nearest cells that hold the share ``probe`` of the base."""
    ship(queries.sparkSession)
    books, keep = _books(index.books), closer * k
    asked, blocks = _blocks(queries)
    visits = _choices(Index(index.rows, index.bounds), asked, blocks, nearest_cells(probe, share=True))
    kind = index.bounds.schema["knowledge_id"].dataType.simpleString()
    parts = index.bounds.select("knowledge_id", "cell", "centre", F.ceil(F.col("n") / ROW_PART).cast("int").alias("parts"))
    there = visits.join(asked.select("query_id", "embedding"), "query_id").join(parts, ["knowledge_id", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    blocked = parts.drop("centre").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = index.rows.select("shelf", "knowledge_id", "cell", "id", "code").join(blocked, ["knowledge_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def look_up(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "knowledge_id", "cell", "id", "near"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        a = a.sort_values("id", ignore_index=True)
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in a["code"]])
        out = []
        for begin in range(0, len(b), 128):
            some = b.iloc[begin : begin + 128]
            q = unit(some["embedding"].to_list())
            score = np.repeat((q @ unit([some["centre"].iloc[0]]).T), len(a), axis=1)
            for s, (part, c) in enumerate(zip(np.array_split(q, SLICES, axis=1), books, strict=True)):
                score += (part @ c.T)[:, codes[:, s]]
            order = np.argsort(-score, axis=1, kind="stable")[:, :keep]
            out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), order.shape[1]), "id": a["id"].to_numpy()[order].ravel(), "near": np.take_along_axis(score, order, axis=1).ravel()}))
        return pd.concat(out).assign(knowledge_id=a["knowledge_id"].iloc[0], cell=a["cell"].iloc[0])[columns]

    keys = ["knowledge_id", "cell", "part", "block"]
    near = _own_columns(rows).groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(look_up, f"query_id bigint, knowledge_id {kind}, cell int, id bigint, near double")
    first = staged(near.withColumn("r", numbered("query_id", "knowledge_id", order=[F.desc("near"), "id"])).where(F.col("r") <= keep).drop("near", "r"), "cells-candidates")

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((unit(x.to_list()) * unit(y.to_list())).sum(1)) if len(x) else pd.Series([], dtype="float64")

    vectors = index.rows.select("shelf", "knowledge_id", "cell", "id", "paragraph_id", "document_id", F.col("embedding").alias("v"))
    pairs = first.withColumn("shelf", shelf(F.col("knowledge_id"))).join(vectors, ["shelf", "knowledge_id", "cell", "id"]).join(asked.select("query_id", "embedding"), "query_id")
    scored = pairs.withColumn("score", cosine("embedding", "v"))
    rank = numbered("query_id", "knowledge_id", order=[F.desc("score"), "id"])
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "knowledge_id", "id", "paragraph_id", "document_id", "score", "rank"), first


def in_bases(index: Coded, bases: list) -> Coded:
    """The index of some bases: only their shelves are read."""
    shelves = [r[0] for r in index.rows.sparkSession.createDataFrame([(b,) for b in bases], f"b {index.bounds.schema['knowledge_id'].dataType.simpleString()}").select(shelf(F.col("b"))).distinct().collect()]
    own = F.col("knowledge_id").isin(*bases)
    return Coded(index.rows.where(F.col("shelf").isin(*shelves) & own), index.bounds.where(own), index.books)


