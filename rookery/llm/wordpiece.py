"""Greedy longest-match word-piece lengths by a linear automaton that never builds a piece.

The vocabulary is a trie with two roots: one for the start of a word, one for its rest. Where a word leaves the trie,
the failure link names the node to go on from and the popped-token count says how many pieces were
finished on the way; both are precomputed. A word of n characters costs O(n) steps, however its pieces overlap.

The query uses the public 32k sentence-piece vocabulary as word pieces: an entry that begins with the word mark
starts words, any other continues them. A word that no such piece starts becomes the bare mark and continuations, and a
character that no piece covers counts as its UTF-8 bytes, as the vocabulary has a piece for each byte.

Defined cases: null and empty texts have no pieces; very long words are walked once; repeated rows and ties give the
same numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._util import arrow_batch, documents, rows_of, ship

#: Characters kept per task of words already counted, an entry counting as ENTRY more, and the longest word that is kept.
MEMO, ENTRY, MEMO_WORD = 1 << 25, 100, 64
_NONE = -1


class LongestMatch:
    """Nodes are numbers: 0 is the word's root, 1 the root of continuations.

    fallback: the bare word mark and a piece for each byte exist, so every word can be covered; without it, a word that
    cannot be covered counts as one unknown piece.
    """

    def __init__(self, starts: list[str], rests: list[str], fallback: bool = False):
        self.fallback = fallback
        self.edges: list[dict[str, int]] = [{}, {}]
        final: list[bool] = [False, False]
        for root, tokens in ((0, starts), (1, rests)):
            for token in tokens:
                node = root
                for ch in token:
                    nxt = self.edges[node].get(ch)
                    if nxt is None:
                        nxt = self.edges[node][ch] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    node = nxt
                if token:
                    final[node] = True
        n = len(self.edges)
        self.fail, self.pops = [_NONE] * n, [0] * n
        if fallback:  # the bare mark is a piece: leave the word's root for the continuations
            self.fail[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for ch, child in self.edges[node].items():
                if final[child]:  # the whole path is one piece; go on as a continuation
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    at, popped = self.fail[node], self.pops[node]
                    while at != _NONE and ch not in self.edges[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at != _NONE:
                        self.fail[child], self.pops[child] = self.edges[at][ch], popped
                    elif fallback:  # only bytes cover this character
                        self.fail[child], self.pops[child] = 1, popped + len(ch.encode())
                todo.append(child)

    def length(self, word: str) -> int:
        """Number of pieces of a word; 1 where it cannot be covered (never with fallback), 0 for the empty word."""
        node, count = 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for ch in word:
            nxt = edges[node].get(ch)
            while nxt is None:
                at = fail[node]
                if at == _NONE:
                    if not self.fallback:
                        return 1
                    count += len(ch.encode())
                    nxt = node
                    break
                count += pops[node]
                node = at
                nxt = edges[node].get(ch)
            node = nxt
        while node > 1:  # what is still open at the end
            if fail[node] == _NONE:
                return 1
            count += pops[node]
            node = fail[node]
        return count


class _Lengths(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton, self.used = automaton, 0

    def __missing__(self, word: str) -> int:
        n = self.automaton.length(word)
        if len(word) <= MEMO_WORD:
            self.used += ENTRY + len(word)
            if self.used > MEMO:
                self.clear()
                self.used = ENTRY + len(word)
            self[word] = n
        return n


def vocabulary(path: str | None = None) -> tuple[list[str], list[str]]:
    """Pieces that start a word, and pieces that continue one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in pieces if p.startswith("▁") and len(p) > 1], [p for p in pieces if not p.startswith("▁")]


def counted(docs: DataFrame, automaton: LongestMatch) -> DataFrame:
    """doc_id, n_words and n_pieces of each text; words are runs of anything but ASCII white space."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(shared.value)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_pieces", pa.int64())])
            for ids, texts in rows_of(iter([batch]), "doc_id", "text"):
                words = [[w.decode() for w in (t or "").encode("utf-8", "replace").split()] for t in texts]
                yield arrow_batch(schema, [ids, [len(w) for w in words], [sum(map(lengths.__getitem__, w)) for w in words]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_pieces bigint")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir), LongestMatch(*vocabulary(), fallback=True))
