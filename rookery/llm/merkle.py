"""Merkle manifest of a dataset with octopus multiproofs.

A leaf is the hash of a row. Per source the leaves, by doc_id, are the bottom of a tree of 16-ary runs; the subroots, by source, are the bottom
of another one. The leaves lie in blocks of consecutive leaves of one source. A block is the unit of proof: ``missing`` gives the least set of
node coordinates that the block lacks to fold all its leaves up to the root; these are fetched once for the block by one join; the interiors
above the leaves are derived inside the block, once for all its leaves; and every leaf's own proof is read off these.

Places of leaves in a source are places in a sorted run of rows plus counts of the runs before, so a source that holds a third of all rows is many
runs and many blocks. Nodes above the blocks are grouped 16 at a time, level by level; they are one for BLOCK leaves.

Defined cases: any null is hashed as ``-``; a null source is a source of its own and comes first; a null doc_id comes first in its source and is not
tampered with; rows with equal doc_ids go by their leaf, so repeated rows are neighbours with equal leaves and proofs of their own; very long texts are hashed
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import crc_mod, documents, partitions, ship, staged

#: Children of a node; leaves of a block, and the levels that a block holds.
ARITY, BLOCK, LEVELS = 16, 4096, 3
TOP = "top"


def sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def tampered_text() -> Column:
    """The text with A-Z lower-cased."""
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Coordinates of a tree


def sizes(n: int) -> list[int]:
    """Nodes on every level of a tree over ``n`` leaves, up to the one at the top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(held: Iterable[int], n: int, level: int = 0) -> list[tuple[int, int]]:
    """The least (level, index) set that, with the nodes ``held`` on ``level`` of a tree over ``n`` leaves, gives its top: siblings of held or derived nodes
    that are neither.
    """
    out, have = [], set(held)
    for at, count in list(enumerate(sizes(n)))[level:-1]:
        out += [(at, i) for run in sorted({i // ARITY for i in have}) for i in range(run * ARITY, min(count, (run + 1) * ARITY)) if i not in have]
        have = {i // ARITY for i in have}
    return out


def derived(nodes: dict[tuple[int, int], str], held: Iterable[int], n: int, level: int = 0) -> None:
    """Add every node above ``held`` to ``nodes``, which holds these and the missing ones."""
    have = set(held)
    for at, count in list(enumerate(sizes(n)))[level:-1]:
        have = {i // ARITY for i in have}
        for up in have:
            nodes[at + 1, up] = sha("".join(nodes[at, i] for i in range(up * ARITY, min(count, (up + 1) * ARITY))))


def path(index: int, n: int, level: int = 0) -> list[tuple[int, list[int], list[int]]]:
    """(level, siblings before, siblings behind) of a node and all nodes above it but the top."""
    out = []
    for at, count in list(enumerate(sizes(n)))[level:-1]:
        first = index - index % ARITY
        out.append((at, list(range(first, index)), list(range(index + 1, min(count, first + ARITY)))))
        index //= ARITY
    return out


def folded(digest: str, steps: Iterable[tuple[str, str]]) -> str:
    """The root from a leaf and its siblings (before, behind) level by level."""
    for before, behind in steps:
        digest = sha(before + digest + behind)
    return digest


# The manifest


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed (the leaf of the tampered row, or null)."""
    hit = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) == 0)
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(tampered_text())).alias("changed"))


def placed(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``index`` (from 0 in ``key``) and ``n`` (rows of ``key``)."""
    spark = rows.sparkSession
    ship(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, k = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            at = []
            for value in batch.column(batch.schema.get_field_index(key)).to_pylist():
                k = k + 1 if value == last else 0
                last = value
                at.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "run", "k"])

    runs = staged(rows.repartitionByRange(partitions(spark), key, *order).sortWithinPartitions(key, *order).mapInArrow(count, f"{schema}, run int, k long"), name)
    counts = runs.groupBy(F.col(key).alias("own"), F.col("run").alias("own_run")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy("own")
    counts = counts.select("own", "own_run", (F.sum("c").over(whole.orderBy("own_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    found = runs.join(counts, F.col(key).eqNullSafe(F.col("own")) & (F.col("run") == F.col("own_run")))
    return found.select(*rows.columns, (F.col("before") + F.col("k")).alias("index"), "n")


def tree_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def blocks(rows: DataFrame) -> DataFrame:
    """tree, source, block, n, ids, leaves, changed, digest: runs of BLOCK leaves with the node above them."""
    named = rows.withColumn("tree", tree_name(F.col("source"))).withColumn("block", F.floor(F.col("index") / BLOCK))
    item = F.struct("index", "doc_id", "leaf", "changed")
    own = named.groupBy("tree", "block").agg(F.first("source").alias("source"), F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("l"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"tree string, source string, block long, n long, ids array<{kinds['doc_id']}>, leaves array<string>, changed array<string>, digest string"

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for hashes, first, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaves", "block", "n")), strict=True):
                for _ in range(min(LEVELS, len(sizes(n)) - 1)):
                    hashes = [sha("".join(hashes[i : i + ARITY])) for i in range(0, len(hashes), ARITY)]
                digests += hashes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "digest"])

    flat = own.select("tree", "source", "block", "n", F.col("l.doc_id").alias("ids"), F.col("l.leaf").alias("leaves"), F.col("l.changed").alias("changed"))
    return flat.mapInArrow(top, schema)


def above(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All levels from ``nodes`` (tree, level, index, digest, count) to one node a tree; a level is a sixteenth of the one below."""
    out = [nodes]
    while True:
        more = out[-1].where("count > 1")
        if more.isEmpty():
            return out
        up = more.groupBy("tree", "level", "count", F.floor(F.col("index") / ARITY).alias("up")).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("l"))
        joined = F.sha2(F.array_join(F.transform("l", lambda x: x["digest"]), ""), 256)
        out.append(staged(up.select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("index"), joined.alias("digest"), F.ceil(F.col("count") / ARITY).alias("count")), name))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fetched(asking: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, index, siblings: for nodes (tree, index, n, level) of a tree over n leaves, what they lack of it, each fetched once."""
    lacking = F.udf(lambda index, n, level: missing([index], n, level), "array<struct<level:int,index:bigint>>")
    want = asking.select("tree", F.col("index").alias("asked"), F.explode(lacking("index", "n", "level")).alias("w")).select("tree", "asked", "w.level", "w.index")
    got = want.join(nodes.select("tree", "level", "index", "digest"), ["tree", "level", "index"])
    return got.groupBy("tree", F.col("asked").alias("index")).agg(F.collect_list(F.struct("level", F.col("index").alias("at"), "digest")).alias("siblings"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root for every row of ``docs``; a row of ``docs`` is tampered with where ``leaves`` says so."""
    rows = placed(leaves(docs), "source", ["doc_id", "leaf"], "merkle-leaves")
    spark = rows.sparkSession
    own = staged(blocks(rows), "merkle-blocks")
    height = F.when(F.col("n") > ARITY**2, 3).when(F.col("n") > ARITY, 2).when(F.col("n") > 1, 1).otherwise(0)
    bottom = own.select("tree", height.alias("level"), F.col("block").alias("index"), "digest", F.ceil(F.col("n") / BLOCK).alias("count"))
    levels = above(bottom, "merkle-nodes")
    subroots = union([f.where("count = 1").select("tree", "digest") for f in levels]).join(own.where("block = 0").select("tree", "source"), "tree")
    ordered = staged(placed(subroots.select("source", "digest").withColumn("all", F.lit(TOP)), "all", ["source"], "merkle-subroots"), "merkle-sources")
    tops = above(ordered.select(F.col("all").alias("tree"), F.lit(0).alias("level"), "index", "digest", F.col("n").alias("count")), "merkle-tops")
    root = tops[-1].first()
    if root is None:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    nodes = union(levels)
    below = fetched(own.select("tree", F.col("block").alias("index"), "n", F.lit(LEVELS).alias("level")).where(F.col("n") > BLOCK), nodes).select("tree", F.col("index").alias("block"), "siblings")
    over = fetched(ordered.select(F.col("all").alias("tree"), "index", "n", F.lit(0).alias("level")), union(tops)).select("index", F.col("siblings").alias("top_siblings"))
    sources = ordered.select(tree_name(F.col("source")).alias("tree"), F.col("digest").alias("subroot"), F.col("index").alias("place"), F.col("n").alias("n_sources"), "index").join(over, "index", "left").drop("index")
    ready = own.join(below, ["tree", "block"], "left").join(sources, "tree").withColumn("root", F.lit(root["digest"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.select("block", "n", "ids", "leaves", "changed", "siblings", "top_siblings", "subroot", "place", "n_sources", "root").mapInArrow(
        expanded, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )


def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proof of every leaf of a block from the block's own leaves and what it fetched."""
    for batch in batches:
        for b in batch.to_pylist():
            first, n, held = b["block"] * BLOCK, b["n"], b["leaves"]
            nodes = {(s["level"], s["at"]): s["digest"] for s in b["siblings"] or ()} | {(0, first + i): h for i, h in enumerate(held)}
            derived(nodes, range(first, first + len(held)), n)  # the interiors that all leaves share, once
            top = {(s["level"], s["at"]): s["digest"] for s in b["top_siblings"] or ()}
            shared = [_texts(nodes, s) for s in path(b["block"], n, LEVELS)] if n > BLOCK else []
            shared += [_texts(top, s) for s in path(b["place"], b["n_sources"])]
            inside: dict[int, list[tuple[str, str]]] = {}  # by the run of the leaf's parent: the steps from there to the block's top
            out = {c: [] for c in ("doc_id", "leaf", "proof_sha256", "folded_root")}
            for k, (doc_id, own, other) in enumerate(zip(b["ids"], held, b["changed"], strict=True)):
                index = first + k
                steps = path(index, n)[:LEVELS]
                parent = index // ARITY
                if parent not in inside:
                    inside[parent] = [_texts(nodes, s) for s in steps[1:]]
                steps = [*(_texts(nodes, s) for s in steps[:1]), *inside[parent], *shared]
                out["doc_id"].append(doc_id)
                out["leaf"].append(own)
                out["proof_sha256"].append(sha("".join(x + y for x, y in steps)))
                out["folded_root"].append(folded(other or own, steps))
            size = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], batch.schema.field("ids").type.value_type), pa.array(out["leaf"], pa.string()), pa.array([b["subroot"]] * size, pa.string()), pa.array([b["root"]] * size, pa.string()),
                 pa.array(out["proof_sha256"], pa.string()), pa.array(out["folded_root"], pa.string())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )


def _texts(nodes: dict[tuple[int, int], str], step: tuple[int, list[int], list[int]]) -> tuple[str, str]:
    at, before, behind = step
    return "".join(nodes[at, i] for i in before), "".join(nodes[at, i] for i in behind)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir)).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(source_levels: int = 5, top_levels: int = 4) -> str:
    """Level by level over all nodes; a tree that has one node left keeps it. Levels suffice for 16 ** source_levels rows of a source."""
    item = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    hashed = lambda text: "sha256(" + " || ".join([*(item(c) for c in ("doc_id", "source", "lang", "n_chars")), item(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"d AS (SELECT doc_id, source, {hashed('text')} AS leaf, {hashed(low)} AS low, "
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda s, x: list_reduce(list_prepend(xor(s, x), CAST(range(8) AS BIGINT[])), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc FROM documents)",
        "l0 AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS shown, coalesce('=' || source, '-') AS tree, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "s0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l0)",
    ]
    up = lambda a, k: f"{a}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (max(n) + 15) // 16 AS n FROM {a}{k} GROUP BY tree, i // 16)"
    steps += [up("s", k) for k in range(source_levels)]
    steps.append(f"t0 AS MATERIALIZED (SELECT 'top' AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, tree AS own FROM s{source_levels} JOIN (SELECT DISTINCT tree, source FROM l0) USING (tree))")
    steps += [up("t", k) for k in range(top_levels)]
    steps.append("p0 AS MATERIALIZED (SELECT l0.*, t0.i AS place, t0.h AS subroot, '' AS proof, shown AS fold FROM l0 JOIN t0 ON t0.own = l0.tree)")
    last = 0
    for a, levels, key, tree in (("s", source_levels, "p.i", "p.tree"), ("t", top_levels, "p.place", "'top'")):
        for k in range(levels):
            at = f"({key} // {16**k})"
            steps.append(
                f"r{last} AS MATERIALIZED (SELECT tree, i // 16 AS run, list(h ORDER BY i) AS hs, max(n) AS n FROM {a}{k} GROUP BY 1, 2), "
                f"p{last + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (proof, fold), CASE WHEN n > 1 THEN proof || array_to_string(hs[1:{at} % 16], '') || array_to_string(hs[{at} % 16 + 2:], '') ELSE proof END AS proof, "
                f"CASE WHEN n > 1 THEN sha256(array_to_string(hs[1:{at} % 16], '') || fold || array_to_string(hs[{at} % 16 + 2:], '')) ELSE fold END AS fold FROM p{last} p JOIN r{last} r ON r.tree = {tree} AND r.run = {at} // 16)"
            )
            last += 1
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified FROM p{last} CROSS JOIN t{top_levels} t"


SQL = _sql()
