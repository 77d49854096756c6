"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a token itself. Tier two: a
pre-token that is not goes through the merges, lowest rank first and leftmost among equals, with a heap over
doubly linked bytes, so a pre-token of n bytes costs O(n log n) however long it is. Results of both tiers are
kept in a dictionary of bounded size per task, so either tier is reached once per distinct pre-token and task.

Decoding joins the bytes of the tokens; it reads the ids only.

Defined cases: a null text is empty (no ids, hashes of the empty string); texts are encoded whole, special-token
strings are ordinary text; repeated rows and ties give the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ._util import arrow_batch, documents, rows_of, ship

#: Characters kept per task of pre-tokens already encoded, an entry counting as ENTRY more, and the longest pre-token that is kept.
MEMO, ENTRY, MEMO_PIECE = 1 << 26, 100, 64
_MASK, _MIX_A, _MIX_B = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class MinimalPerfectHash:
    """Maps n keys onto 0..n-1 without gaps: hash to a bucket, displace the bucket by its pilot."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        for self.seed in range(64):
            hashes = np.array([xxhash.xxh3_64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)
            if len(np.unique(hashes)) == self.n:
                break
        else:
            raise ValueError("keys are not distinct")
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        pilots, taken = np.zeros(self.buckets, dtype=np.uint64), np.zeros(self.n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            mine = hashes[order[starts[b] : starts[b + 1]]]
            if not len(mine):
                continue
            tried = 0
            while True:
                some = np.arange(tried, tried + (64 if tried < 512 else 8192), dtype=np.uint64)
                places = self._displaced(mine[:, None], some[None, :])
                fits = ~taken[places].any(axis=0)
                if len(mine) > 1 and fits.any():
                    held = np.sort(places[:, fits], axis=0)
                    fits[np.flatnonzero(fits)[(held[1:] == held[:-1]).any(axis=0)]] = False
                if fits.any():
                    at = int(np.argmax(fits))
                    pilots[b], taken[places[:, at]] = some[at], True
                    break
                tried += len(some)
        self.pilots = pilots.tolist()

    def _displaced(self, h: np.ndarray, pilot: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (pilot * np.uint64(_MIX_A))) * np.uint64(_MIX_B)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        pilot = self.pilots[(h >> 32) % self.buckets]
        return ((((h ^ ((pilot * _MIX_A) & _MASK)) * _MIX_B) & _MASK) >> 32) % self.n


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = MinimalPerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)  # in hash order, as the keys are
        for token, rank in ranks.items():
            slot = self.hash(token)
            self.keys[slot], self.ids[slot] = token, rank
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._find = None

    def __getstate__(self):
        return self.__dict__ | {"_find": None}

    def whole(self, piece: bytes) -> int | None:
        """The id of a piece that is a token, by the perfect hash."""
        slot = self.hash(piece)
        return self.ids[slot] if self.keys[slot] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """The ids of any piece by heap-ordered merges over linked bytes."""
        n, get, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        if n == 0:
            return []
        # part i ends before after[i]; -1: merged into another part. A heap entry packs rank, i and end of the pair.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = n.bit_length()
        low, twice = (1 << width) - 1, 2 * width
        heap = [r << twice | i << width | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, end = entry >> width & low, entry & low
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue  # one of the two parts has changed since
            after[j], after[i] = -1, end
            if end < n:
                before[end] = i
                far = after[end]
                if (r := get(piece[i:far])) is not None:
                    push(heap, r << twice | i << width | far)
            p = before[i]
            if p >= 0 and (r := get(piece[p:end])) is not None:
                push(heap, r << twice | p << width | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pieces(self, text: str) -> list[str]:
        if self._find is None:
            self._find = regex.compile(self.pattern).findall
        return self._find(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        one = self.whole(piece)
        return [one] if one is not None else self.merged(piece)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p.encode("utf-8", "replace"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """A tokenizer from a file of base64 tokens and ranks."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern or public_tokenizers.PATTERN)


class _Memo(dict):
    """Pre-token -> (number of ids, the ids as decimal text, their bytes decoded again)."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.used = bpe, 0

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.bpe.encode_piece(piece.encode("utf-8", "replace"))
        entry = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))
        if len(piece) <= MEMO_PIECE:
            self.used += ENTRY + len(piece)
            if self.used > MEMO:
                self.clear()
                self.used = ENTRY + len(piece)
            self[piece] = entry
        return entry


def digests(docs: DataFrame, bpe: ByteBPE) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of each text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bpe)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = _Memo(model)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
            for ids, texts in rows_of(iter([batch]), "doc_id", "text"):
                counts, a, b = [], [], []
                for text in texts:
                    found = [memo[p] for p in model.pieces(text)] if text else []
                    n, decimal, raw = zip(*found, strict=True) if found else ((), (), ())
                    counts.append(sum(n))
                    a.append(hashlib.sha256(" ".join(decimal).encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join(raw)).hexdigest())
                yield arrow_batch(schema, [ids, counts, a, b])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), load())
