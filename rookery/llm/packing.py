"""Best-fit packing with swap-based local search.

Documents become token ids; one longer than a sequence is cut into full pieces, its first piece taking the remainder.
Pieces are dealt by a hash of their place in the stored table into blocks of about BLOCK pieces, so that one task holds a block whatever the corpus
size. A block is packed best-fit in order of falling length; then documents are moved, exchanged one for one or one
for two between underfull bins as long as any such exchange raises the sum of squared fills, which empties bins. The sum is a whole number
that never exceeds the token count times the capacity and grows with every exchange, so the search ends by itself.
A block wastes at most a fraction of a sequence on its last bins.

Token ids are those of the tokenizer file. Texts of Latin characters are encoded by its vocabulary and merge order in the faster of
two libraries; texts with other characters, where the libraries' Unicode tables might differ, by the tokenizer itself.

Defined cases: null and empty texts are one piece of length 1 (the end id); repeated rows are separate pieces; ties go to
the bin found first; an empty table gives no rows; other columns are ignored by ``op7`` and kept by ``packed``.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batch, documents, rows_of, ship, staged

SEQUENCE, BLOCK = 2048, 16_384
_FOREIGN = regex.compile(r"[^\x00-ɏ‐-‧€]")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Little-endian 32-bit ids of texts. The file's vocabulary lists tokens in the order of their merges, so ids are ranks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        byte, special = _byte_of(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if _FOREIGN.search(text) else self.fast(text)
        return np.array(ids, dtype="<u4").tobytes()


def tokenised(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
            for ids, texts in rows_of(iter([batch]), "doc_id", "text"):
                out: list[tuple] = []
                for doc_id, text in zip(ids, texts, strict=True):
                    raw = tokens.encode(text or "") + b"\0\0\0\0"
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                    out += [(doc_id, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield arrow_batch(schema, list(zip(*out, strict=True)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.of = [0] * len(lengths)

    def best_fit(self) -> None:
        """Longest first, into the fullest bin that still holds it. A bit of ``some`` marks a gap size in use."""
        some, by_gap = 0, [[] for _ in range(self.capacity + 1)]
        for x in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[x]
            fits = some >> n
            if fits:
                gap = n + (fits & -fits).bit_length() - 1
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    some &= ~(1 << gap)
            else:
                gap, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(x)
            self.fill[b] += n
            self.of[x] = b
            if gap > n:
                by_gap[gap - n].append(b)
                some |= 1 << (gap - n)

    def _move(self, out: list[int], x: int, b: int) -> None:
        """Give bin ``b`` document x for the documents ``out``."""
        a = self.of[x]
        self.bins[a].remove(x)
        self.bins[b].append(x)
        self.of[x] = b
        for y in out:
            self.bins[b].remove(y)
            self.bins[a].append(y)
            self.of[y] = a
        change = self.lengths[x] - sum(self.lengths[y] for y in out)
        self.fill[a] -= change
        self.fill[b] += change

    def local_search(self, passes: int | None = None) -> None:
        """Raise the sum of squared fills until no move, one-for-one or two-for-one exchange between two bins does.

        Quick passes come first, in which a bin takes a longer document from an emptier bin for none, one or two of its own; then passes over all exchanges.
        """
        self._quick(passes)
        if passes is None:
            while self._exchanges():
                pass

    def _offers(self, b: int) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """By their sum: one document of bin b, two of its documents."""
        kinds: dict[int, list[int]] = {}
        for y in self.bins[b]:
            if len(kinds.setdefault(self.lengths[y], [])) < 2:
                kinds[self.lengths[y]].append(y)
        each, pairs = list(kinds.items()), {}
        for i, (n, ys) in enumerate(each):
            if len(ys) > 1:
                pairs.setdefault(2 * n, ys)
            for m, zs in each[:i]:
                pairs.setdefault(n + m, [ys[0], zs[0]])
        return {n: ys[:1] for n, ys in each}, pairs

    def _exchanges(self) -> bool:
        """One pass over all exchanges; whether any was made.

        Bin b gains d = given by a - given by b, which raises the sum of squares if d > fill of a - fill of b. For every sum that some bin can give, the two
        least filled bins are known, so the best partner of b is found by a minimum over the window of sums that fit its gap. A pass without
        an exchange has seen the fills as they are.
        """
        under = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b))
        top = 2 * self.capacity + 2
        able: list[tuple[np.ndarray, np.ndarray]] = []  # for one and for two documents: least filled bin and second by the sum they give
        kept = {b: self._offers(b) for b in under}
        for two in (0, 1):
            least, second = np.full(top, -1), np.full(top, -1)
            for b in under:  # emptier bins first
                sums = np.fromiter(kept[b][two], dtype=np.int64, count=len(kept[b][two]))
                second[sums] = np.where((least[sums] >= 0) & (second[sums] < 0), b, second[sums])
                least[sums] = np.where(least[sums] < 0, b, least[sums])
            able.append((least, second))
        fill, moved = np.array(self.fill), False
        for b in under:
            gap = self.capacity - self.fill[b]
            if gap <= 0 or not self.fill[b]:
                continue
            one, pairs = self._offers(b)
            for two, gives in ((0, {0: [], **one, **{t: p for t, p in pairs.items() if t not in one}}), (1, one)):
                least, second = able[two]
                partner = np.where(least == b, second, least)
                need = np.where(partner >= 0, fill[partner] - np.arange(top), np.iinfo(np.int64).max)  # must be below fill of b - given by b
                window, width = need, 1  # minima over [n, n + width)
                while 2 * width <= gap:
                    window = np.minimum(window, np.append(window[width:], np.full(width, np.iinfo(np.int64).max)))
                    width *= 2
                rest = gap - width
                if rest:
                    window = np.minimum(window, np.append(window[rest:], np.full(rest, np.iinfo(np.int64).max)))
                given = np.fromiter(gives, dtype=np.int64, count=len(gives))
                good = given[window[given + 1] < self.fill[b] - given]
                if not len(good):
                    continue
                t = int(good[0])
                n = t + 1 + int(need[t + 1 : t + 1 + gap].argmin())
                a = int(partner[n])
                out = self._offers(a)[two].get(n)
                d = n - t
                if out and d > self.fill[a] - self.fill[b]:  # else the table is behind an exchange of this pass
                    self._swap(a, out, b, gives[t])
                    moved = True
                    fill[[a, b]] = self.fill[a], self.fill[b]
                    break
        return moved

    def _swap(self, a: int, given: list[int], b: int, back: list[int]) -> None:
        for source, target, docs in ((a, b, given), (b, a, back)):
            for x in docs:
                self.bins[source].remove(x)
                self.bins[target].append(x)
                self.of[x] = target
                self.fill[source] -= self.lengths[x]
                self.fill[target] += self.lengths[x]

    def _quick(self, passes: int | None) -> None:
        for _ in itertools.count() if passes is None else range(passes):
            under = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
            have: list[list[int]] = [[] for _ in range(self.capacity + 1)]
            for b in reversed(under):  # emptier bins come last in each list, so first out
                for x in self.bins[b]:
                    have[self.lengths[x]].append(x)
            for lst in have:
                lst.reverse()
            some = sum(1 << n for n in range(1, self.capacity + 1) if have[n])
            moved = False
            for b in under:
                if not 0 < self.fill[b] < self.capacity:
                    continue
                gap, own = self.capacity - self.fill[b], self.bins[b]
                kinds: dict[int, list[int]] = {}  # two documents of each length are enough; distinct lengths of a bin are few
                for y in own:
                    if len(kinds.setdefault(self.lengths[y], [])) < 2:
                        kinds[self.lengths[y]].append(y)
                offers: dict[int, list[int]] = {0: [], **{n: ys[:1] for n, ys in kinds.items()}}
                each = list(kinds.items())
                for i, (n, ys) in enumerate(each):
                    if len(ys) > 1:
                        offers.setdefault(2 * n, ys)
                    for m, zs in each[:i]:
                        offers.setdefault(n + m, [ys[0], zs[0]])
                best, choice = 0, None
                for given, out in offers.items():
                    fits = some & ((1 << (min(self.capacity, given + gap) + 1)) - 1)
                    while (n := fits.bit_length() - 1) - given > best:
                        x = next((x for x in reversed(have[n]) if (a := self.of[x]) != b and self.fill[a] <= self.fill[b]), None)
                        if x is not None:
                            best, choice = n - given, (out, x)
                            break
                        fits &= ~(1 << n)  # no emptier bin holds this length
                    if best == gap:
                        break
                if choice:
                    out, x = choice
                    n = self.lengths[x]
                    have[n].remove(x)
                    if not have[n]:
                        some &= ~(1 << n)
                    for y in out:  # now in the emptier bin
                        have[self.lengths[y]].append(y)  # a second mention does no harm: its bin is looked up when it is used
                        some |= 1 << self.lengths[y]
                    self._move(out, x, b)
                    moved = True
            if not moved:
                return


def pack_block(lengths: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.local_search()
    sequence, offset, number = [0] * len(lengths), [0] * len(lengths), 0
    for own in bins.bins:
        at = 0
        for x in own:
            sequence[x], offset[x] = number, at
            at += lengths[x]
        number += bool(own)
    return sequence, offset


def packed(pieces: DataFrame, capacity: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset. ``pieces`` must be a stored table."""
    ship(pieces.sparkSession)
    part = pieces.where(F.col("length") < capacity)
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    blocks = max(1, -(-part.count() // block))
    dealt = part.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))  # by place: equal rows spread as well

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sequence, offset = pack_block(group["length"].tolist(), capacity)
        first = int(group["block"].iloc[0]) << 32 if len(group) else 0
        return group.drop(columns="block").assign(sequence_id=np.array(sequence, dtype=np.int64) + first, offset=np.array(offset, dtype=np.int64))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("block").applyInPandas(pack, f"{kinds}, sequence_id bigint, offset bigint").unionByName(whole)


def pack(docs: DataFrame) -> DataFrame:
    return packed(staged(tokenised(docs), "pieces"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
