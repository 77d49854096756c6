"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles (five words; a shorter text is one shingle). Documents with the same set form one
node, so copies are never paired. A node has HASHES MinHash values, cut into BANDS bands; nodes that share a band are
candidates. A candidate pair is compared STEP values at a time: from the matches so far, the posterior
probability that its similarity reaches the threshold (uniform prior) is read off a table, and the pair is dropped once
that falls below TOLERANCE. Pairs that stay are verified exactly on their shingles.

Bands that many nodes share are not expanded into all pairs. (1) Every member of a band is compared with the least
member, and with the least of a random part of about PART members; the pairs that stay give components. (2) Members of
one band that are still in different components are compared with each other: pair by pair in bands of up to SMALL
members, in blocks inside the tasks in larger ones, where the members of the largest component are not compared among
themselves. So every candidate pair is either compared or inside one component. (3) Each node with a candidate is shingled once
more; components are verified exactly on those hashed sets, in blocks of BLOCK nodes against blocks, which also counts each node's
links; components of the verified links are the classes. Of a component of several blocks, the nodes that lie within half the threshold's distance of one
node are linked to each other by the triangle inequality and are counted, not compared; so a million copies that differ in a few words form no pairs.

A node is named by the digest of its shingle set, never by a doc_id, so rows with equal doc_ids and other texts stay apart.

A pair at the threshold shares no band with probability below 1e-5, falling fast above it; shingles are compared by
64-bit hashes. Recall against brute force is tested.

Defined cases: texts without a word (null and empty ones too) have no shingles and are linked only to equal texts,
null texts to none (rows with null text and equal doc_ids are one class); a class is named by its least doc_id; where several classes
have the same least doc_id, the one whose texts hash lowest keeps it and the others, like classes without any doc_id, are named by a negative
number drawn from their texts; repeated rows count once as texts; a pair at exactly the threshold is linked; very long texts are shingled whole; an empty table gives no rows; other columns are ignored by ``classes`` and
kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batch, discard, documents, rows_of, ship, staged
from .simhash import mixed, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
HASHES, STEP, TOLERANCE, BLOCK = BANDS * ROWS, 12, 1e-6, 256
PART, SMALL, LANE, HEADS = 8, 32, 4096, 8
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    h, _ = word_hashes(text)
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minhashes(sets: np.ndarray) -> np.ndarray:
    """HASHES 16-bit MinHash values: the high half of the least 32-bit hash is mixed down, so all bits count."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sets), 1024):
        low = np.minimum(low, (sets[at : at + 1024, None] * _A + _B).min(axis=0))
    return (mixed(low) >> np.uint64(48)).astype("<u2")


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 * STEP, ... compared values: the fewest matches at which P(similarity >= threshold) >= tolerance."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the row pairs of ``a`` and ``b`` (MinHash values) that the posterior does not rule out."""
    left, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, least in enumerate(least_matches()):
        matches += (a[left, i * STEP : (i + 1) * STEP] == b[left, i * STEP : (i + 1) * STEP]).sum(axis=1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def text_key() -> Column:
    """Digest of the text; rows without a text are told apart by doc_id."""
    return F.md5(F.coalesce(F.concat(F.lit("+"), F.col("text")), F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).cast("binary"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key, n_shingles and signature of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("text_key", pa.string()), ("set_key", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.binary())])
            for ids, keys, texts in rows_of(iter([batch]), "doc_id", "text_key", "text"):
                sets, sizes, signatures = [], [], []
                for key, text in zip(keys, texts, strict=True):
                    s = shingles(text or "")
                    sets.append(hashlib.md5(s.tobytes()).digest() if len(s) else b"-" + key.encode())  # no shingles: only its equals
                    sizes.append(len(s))
                    signatures.append(minhashes(s).tobytes() if len(s) else None)
                yield arrow_batch(schema, [ids, keys, sets, sizes, signatures])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key string, set_key binary, n_shingles bigint, signature binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the least node of each connected component, for the nodes of ``edges`` (a, b).

    In a round every node follows its least neighbour twice; then the edges are carried over to the nodes reached, and repeated ones and
    loops drop out, so later rounds see a far smaller graph. Every round is a stored table.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, labels = staged(tidy(edges.select("a", "b")), f"{name}-edges"), None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = staged(up, f"{name}-up")
        reached = staged(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"), f"{name}-reached")
        if labels is None:
            labels = staged(reached.select("node", F.col("root").alias("comp")), f"{name}-labels")
        else:
            before, labels = labels, staged(labels.join(reached.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"{name}-labels")
            discard(before)
        at = lambda side: reached.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved = left.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        # a node reached may itself have somewhere to go
        further = reached.select("root").distinct().join(up.withColumnRenamed("node", "root"), "root").select(F.col("root").alias("a"), F.col("up").alias("b"))
        last, left = left, staged(tidy(moved.union(further)), f"{name}-edges")
        discard(last, up, reached)
        if left.isEmpty():
            return labels


def _pruned(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that the posterior keeps."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), dtype="<u2").reshape(-1, HASHES) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(survivors(a, b)))

    sides = pairs.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    kind = signatures.schema["node"].dataType.simpleString()
    return sides.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


class _Forest(dict):
    """Union-find over the keys it has met; the least key is the root."""

    def root(self, x: int) -> int:
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _block_links(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Links (a, b) between the components of large bands: (band, node, comp) of bands with several components.

    Members outside the band's largest component form minor blocks, those inside major blocks; minor blocks meet all blocks, major
    ones only minor ones. A group is a pair of blocks and returns links that join components, at most one per member.
    """
    ship(members.sparkSession)
    sizes = members.groupBy("band", "comp").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("major"), F.sum("n").alias("n"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    tops = tops.select("band", "top", blocks(F.col("n") - F.col("major")).alias("minors"), blocks(F.col("major")).alias("majors"))
    rows = members.join(tops, "band").withColumn("minor", F.col("comp") != F.col("top"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    p, none = F.col("p"), F.array().cast("array<struct<i:int,j:int>>")
    minor = F.concat(
        F.transform(F.sequence(F.lit(0), p), lambda i: pair(i, p)), F.transform(F.sequence(p, F.col("minors") - 1), lambda j: pair(p, j)),
        F.transform(F.sequence(F.col("minors"), F.col("minors") + F.col("majors") - 1), lambda j: pair(p, j)),
    )
    major = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: pair(i, F.col("minors") + p))
    own = F.when(F.col("minor"), p).otherwise(F.col("minors") + p)
    met = rows.select("band", "node", "comp", own.alias("own"), F.inline(F.array_distinct(F.when(F.col("minor"), minor).otherwise(F.coalesce(major, none)))))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = group[group["own"] == i], group[group["own"] == j]
        sign = lambda df: np.frombuffer(b"".join(df["signature"]), dtype="<u2").reshape(-1, HASHES)
        a, b, sa, sb = left["node"].tolist(), right["node"].tolist(), sign(left), sign(right)
        ca, cb = left["comp"].tolist(), right["comp"].tolist()
        forest, out = _Forest(), []
        for x in range(len(a)):
            root = [forest.root(c) for c in cb]
            others = np.flatnonzero(np.array(root) != forest.root(ca[x]))
            if not len(others):
                continue
            for y in others[survivors(np.broadcast_to(sa[x], (len(others), HASHES)), sb[others])]:
                if forest.join(ca[x], cb[y]):
                    out.append((min(a[x], b[y]), max(a[x], b[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    kind = signatures.schema["node"].dataType.simpleString()
    return met.join(signatures.select("node", "signature"), "node").groupBy("band", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _shingled(texts: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes, from node and text."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, some in rows_of(iter([batch]), "node", "text"):
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([shingles(t).tobytes() for t in some], pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles binary")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common shingles of a[i] and b[j] for arrays of pairs.

    Few pairs are intersected one by one; many, as among near copies, by products of 0/1 matrices over the shingles that
    both sides hold, LANE of them at a time.
    """
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([np.intersect1d(a[x], b[y], assume_unique=True).size for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.float64)

    def lanes(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        grid = np.zeros((len(sets), len(some)), dtype=np.float32)
        for row, s in zip(grid, sets, strict=True):
            at = np.searchsorted(some, s)
            row[at[(at < len(some)) & (some[np.minimum(at, len(some) - 1)] == s)]] = 1
        return grid

    for at in range(0, len(shared), LANE):
        some = shared[at : at + LANE]
        out += lanes(a, some) @ lanes(b, some).T
    return out[i, j].astype(np.int64)


def _core(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, head: of each component of several blocks, the nodes at half the threshold's distance or less from one of HEADS nodes drawn by hash, the one with most of them.

    Jaccard distance is a metric, so two such nodes are linked without looking at them.
    """
    large = sizes.where(F.col("n") > BLOCK).select("comp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = nodes.join(large, "comp").select(F.col("comp").alias("comp"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "shingles")  # attributes of its own on this side
    drawn = nodes.join(large, "comp").groupBy("comp", "blocks").agg(*[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(HEADS)])
    drawn = drawn.select("comp", "blocks", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("node"))
    heads = drawn.join(nodes.select("node", "shingles"), "node").select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("head"), "shingles")

    def near(group: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        sets = [np.frombuffer(t, dtype=np.uint64) for t in group["shingles"]]
        for head, shingled in zip(some["head"], some["shingles"], strict=True):
            own = np.frombuffer(shingled, dtype=np.uint64)
            common = np.array([np.intersect1d(own, t, assume_unique=True).size for t in sets], dtype=np.int64)
            union = len(own) + np.array(list(map(len, sets)), dtype=np.int64) - common
            close = 2 * (union - common) <= (1 - THRESHOLD) * union - 1e-9
            out.append(pd.DataFrame({"comp": group["comp"][close], "head": head, "node": group["node"][close]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["comp", "head", "node"])

    found = staged(dealt.groupBy("comp", "block").cogroup(heads.groupBy("comp", "block")).applyInPandas(near, "comp binary, head binary, node binary"), "core-heads")
    best = found.groupBy("comp", "head").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max_by("head", F.struct("n", "head")).alias("head"))
    return found.join(best, ["comp", "head"], "left_semi").select("node", "head")


def _verified(nodes: DataFrame) -> DataFrame:
    """node, links (linked texts), least linked node, from ``nodes`` (comp, node, n_texts, signature, shingles), stored.

    Nodes of the core of a large component are linked to all others of it; they meet only the rest. Rows meet in pairs of blocks of one
    component; a pair of blocks is one group of at most 2 * BLOCK rows.
    """
    ship(nodes.sparkSession)
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("n"))
    core = staged(_core(nodes, sizes), "core")
    marked = nodes.join(core, "node", "left").withColumn("core", F.col("head").isNotNull())
    counts = marked.groupBy("comp").agg(F.count_if("core").alias("majors"), F.count_if(~F.col("core")).alias("minors"), F.sum(F.when(F.col("core"), F.col("n_texts"))).alias("core_texts"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    counts = staged(counts.select("comp", blocks("majors").alias("majors"), blocks("minors").alias("minors"), "core_texts"), "core-counts")
    dealt = marked.join(counts, "comp")
    sure = dealt.where("core").select("node", (F.col("core_texts") - F.col("n_texts")).alias("links"), F.col("head").alias("least"))
    p, none = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("majors")).otherwise(F.col("minors"))).cast("int"), F.array().cast("array<struct<i:int,j:int>>")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    upto = lambda first, n, make: F.when(n > 0, F.transform(F.sequence(first, first + n - 1), make)).otherwise(none)
    dealt = dealt.withColumn("p", p)
    at, minors, majors = F.col("p"), F.col("minors"), F.col("majors")
    rest = F.concat(F.transform(F.sequence(F.lit(0), at), lambda i: pair(i, at)), F.transform(F.sequence(at, minors - 1), lambda j: pair(at, j)), upto(minors, majors, lambda j: pair(at, j)))
    inner = upto(F.lit(0), minors, lambda i: pair(i, minors + at))
    own = F.when(F.col("core"), minors + at).otherwise(at)
    met = dealt.select("comp", "node", "n_texts", "signature", "shingles", own.alias("block"), F.inline(F.array_distinct(F.when(F.col("core"), inner).otherwise(rest))))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        left = group[group["block"] == group["i"].iloc[0]]
        right = group[group["block"] == group["j"].iloc[0]]
        same = group["i"].iloc[0] == group["j"].iloc[0]
        get = lambda df: (df["node"].tolist(), df["n_texts"].to_numpy(), np.frombuffer(b"".join(df["signature"]), dtype="<u2").reshape(-1, HASHES), [np.frombuffer(t, dtype=np.uint64) for t in df["shingles"]])
        (na, ta, ga, sa), (nb, tb, gb, sb) = get(left), get(right)
        links, forest = {n: 0 for n in [*na, *nb]}, _Forest()
        if not na or not nb:
            return pd.DataFrame({"node": list(links), "links": list(links.values()), "least": list(links)})
        firsts, seconds = [], []
        for i in range(len(na)):
            others = np.arange(i + 1, len(nb)) if same else np.arange(len(nb))
            if len(others):
                stay = others[survivors(np.broadcast_to(ga[i], (len(others), HASHES)), gb[others])]
                firsts.append(np.full(len(stay), i))
                seconds.append(stay)
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (firsts, seconds))
        size_a, size_b = np.array(list(map(len, sa))), np.array(list(map(len, sb)))
        common = common_counts(sa, sb, i, j)
        linked = common >= THRESHOLD * (size_a[i] + size_b[j] - common) - 1e-9
        for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
            links[na[x]] += int(tb[y])
            links[nb[y]] += int(ta[x])
            forest.join(na[x], nb[y])  # says as much about classes as all links
        return pd.DataFrame({"node": list(links), "links": list(links.values()), "least": [forest.root(n) for n in links]})

    return met.groupBy("comp", "i", "j").applyInPandas(compare, "node binary, links bigint, least binary").unionByName(sure)


def _named(texts: DataFrame) -> DataFrame:
    """comp and class_id, from comp and the least doc_id of each text."""
    known = texts.groupBy("comp").agg(F.min("doc_id").alias("least"))
    first = known.where("least IS NOT NULL").groupBy("least").agg(F.min("comp").alias("first"))
    own = F.when(F.col("comp") == F.col("first"), F.col("least")).otherwise(F.xxhash64("comp").bitwiseOR(F.lit(-(1 << 63))))
    return known.join(first, "least", "left").select("comp", own.alias("class_id"))


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored signed rows of ``docs``, and set_key, comp, class_id and n_links of each shingle set."""
    rows = staged(signed(docs), "signed")
    texts = rows.groupBy("set_key", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    texts = staged(texts, "texts")
    nodes = texts.groupBy("set_key").agg(F.count("*").alias("n_texts"), F.max("n").alias("n"), F.min(F.struct("text_key", "doc_id")).alias("of"))
    nodes = staged(nodes.select(F.col("set_key").alias("node"), "n_texts", "n", F.col("of.text_key").alias("of_text"), F.col("of.doc_id").alias("of_doc")), "nodes")
    kept = nodes.where("n > 0").select("node", "n_texts", "of_text", "of_doc")
    one_row = (F.col("text_key") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))  # and its repetitions
    first = rows.select("doc_id", "text_key", "signature").join(kept, one_row).dropDuplicates(["node"])
    signatures = staged(first.select("node", "n_texts", "signature"), "signatures")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", (i * 2 * ROWS + 1), F.lit(2 * ROWS))))
    bands = signatures.select("node", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1")
    members = staged(bands.join(shared, "band"), "members")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("members") / PART))
    parts = members.where(F.col("members") > PART).select("band", "node", part.alias("part"))
    heads = parts.groupBy("band", "part").agg(F.min("node").alias("least"))
    star = lambda rows: rows.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    stars = staged(_pruned(star(members).unionByName(star(parts.join(heads, ["band", "part"]))).distinct(), signatures), "stars")
    comps = components(stars, "stars")
    placed = members.join(comps, "node", "left").select("band", "node", "members", F.coalesce("comp", "node").alias("comp"))
    spread = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    placed = staged(placed.join(spread, "band"), "placed")
    small = placed.where(F.col("members") <= SMALL)
    other = small.select("band", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    cross = small.select("band", F.col("node").alias("a"), "comp").join(other, "band").where("a < b AND comp <> comp_b").select("a", "b").distinct()
    large = _block_links(placed.where(F.col("members") > SMALL).select("band", "node", "comp"), signatures)
    links = staged(stars.unionByName(_pruned(cross, signatures).unionByName(large)), "links")
    discard(stars)
    first, comps = comps, components(links, "links")
    discard(first, members, placed, links)
    # one row of each node that has candidates is shingled
    asked = nodes.join(comps, "node").select("node", "of_text", "of_doc")
    sets = docs.select("doc_id", text_key().alias("text_key"), "text").join(asked, one_row).select("node", "text")
    sets = staged(_shingled(sets).dropDuplicates(["node"]).join(comps, "node").join(signatures, "node"), "shingled")
    discard(signatures)
    checked = staged(_verified(sets), "verified")
    discard(sets)
    final = components(checked.where("least <> node").select(F.col("node").alias("a"), F.col("least").alias("b")), "classes")
    totals = checked.groupBy("node").agg(F.sum("links").alias("links"))
    placed = texts.select(F.col("set_key").alias("node"), "doc_id").join(final, "node", "left").select(F.coalesce("comp", "node").alias("comp"), "doc_id")
    names = staged(_named(placed), "names")
    out = nodes.join(totals, "node", "left").join(final, "node", "left")
    out = out.select(F.col("node").alias("set_key"), F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"))
    return rows, out.join(names, "comp")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and n_links (other texts at or above the threshold) per row of ``docs``."""
    rows, found = classified(docs)
    return rows.select("doc_id", "set_key").join(found, "set_key").select("doc_id", "class_id", F.col("n_links").cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class: of its least doc_id (rows without one come last), then of its least text digest."""
    rows, found = classified(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("best")
    keep = rows.select("doc_id", "text_key", "set_key").join(found.select("set_key", "comp"), "set_key").groupBy("comp").agg(best)
    keep = staged(keep.select(F.col("best.doc_id").alias("keep_doc"), F.col("best.text_key").alias("keep_text")), "keep")
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]
    marked = docs.select(F.struct(*columns).alias("row"), "doc_id", text_key().alias("text_key"))
    kept = marked.join(keep, (F.col("text_key") == F.col("keep_text")) & F.col("doc_id").eqNullSafe(F.col("keep_doc")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
