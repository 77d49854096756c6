"""BPE, word pieces, packing."""

import collections
import hashlib
import math
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ROWS, SF, empty, frame
from tokenizers import Tokenizer

from rookery.llm import bpe, packing, wordpiece

PARTS = ["a", "B", " ", "  ", "\n", "é", "ß", "\xa0", "\x85", "'s", "12", "<|endoftext|>", "\x1c", " the", "_", "\t", "½", "日本", "🎉"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return bpe.load()


def test_perfect_hash(model):
    assert sorted(map(model.hash, model.ranks)) == list(range(len(model.ranks)))
    assert model.whole(b"not a token at all") is None


def test_bpe_equals_tiktoken(spark, model):
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    for t in [*texts(500), "ab" * 5000, "x" * 3000]:
        assert model.encode(t) == library.encode_ordinary(t)
        assert model.decode(model.encode(t)) == t.encode()
    got = bpe.digests(frame(spark), model).collect()
    assert len(got) == len(ROWS)
    want = set()
    for i, t, _, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in got} == want
    assert bpe.digests(empty(spark), model).count() == 0


def brute_pieces(word, starts, rests):
    i = n = 0
    while i < len(word):
        known = starts if i == 0 else rests
        j = next((j for j in range(len(word), i, -1) if word[i:j] in known), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_word_pieces_equal_greedy_search(spark):
    rng = random.Random(4)
    for _ in range(150):
        letters = "abc"[: rng.randint(1, 3)]
        make = lambda: {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))}  # noqa: E731, B023
        starts, rests = make(), make()
        automaton = wordpiece.LongestMatch(sorted(starts), sorted(rests))
        for _ in range(40):
            w = "".join(rng.choice(letters + "d" * (rng.random() < 0.1)) for _ in range(rng.randint(0, 14)))
            assert automaton.length(w) == brute_pieces(w, starts, rests)
    starts, rests = wordpiece.vocabulary()
    automaton, a, b = wordpiece.LongestMatch(starts, rests), set(starts), set(rests)
    got = {(r["doc_id"], r["n_words"], r["n_pieces"]) for r in wordpiece.counted(frame(spark), automaton).collect()}
    want = set()
    for i, t, _, _ in ROWS:
        words = [w.decode() for w in (t or "").encode().split()]
        want.add((i, len(words), sum(brute_pieces(w, a, b) if len(w) < 1000 else automaton.length(w) for w in words)))
    assert got == want
    assert wordpiece.counted(empty(spark), automaton).count() == 0


def test_word_pieces_cover_every_word(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    size = range(model.get_piece_size())
    full = {model.id_to_piece(i) for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    assert "▁" in full and sum(model.is_byte(i) for i in size) == 256

    def greedy(word, full):
        s, i, n = "▁" + word, 0, 0
        while i < len(s):
            j = next((j for j in range(len(s), i, -1) if s[i:j] in full and (i == 0 or s[i] != "▁")), None)
            n += 1 if j else len(s[i].encode())
            i = j or i + 1
        return n

    rng = random.Random(6)
    words = ["2024-01-31", "9" * 50, "日本語の文章", "中文文本没有空格" * 30, "½", "🎉x🎉", "don't", "Über2", "\U00020000a", "a▁b"]
    words += ["".join(rng.choice("0123abTheé日本語中ひカ½🎉\U00020000") for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    automaton = wordpiece.LongestMatch(*wordpiece.vocabulary(), fallback=True)
    assert [automaton.length(w) for w in words] == [greedy(w, full) for w in words]
    for _ in range(150):
        make = lambda: {"".join(rng.choice("ab½") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))}
        starts, rests = make(), make()
        automaton, own = wordpiece.LongestMatch(sorted(starts), sorted(rests), fallback=True), {"▁", *rests, *("▁" + x for x in starts)}
        for _ in range(40):
            w = "".join(rng.choice("ab½d") for _ in range(rng.randint(1, 14)))
            assert automaton.length(w) == greedy(w, own)
    got = {r["doc_id"]: r["n_pieces"] for r in wordpiece.op8(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50).collect()
    assert all(got[r["doc_id"]] == sum(greedy(w.decode(), full) for w in (r["text"] or "").encode().split()) for r in rows)


def test_token_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = packing.Tokens(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for t in texts(800):
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours = packing.Tokens(path)
    got = packing.pack(frame(spark)).collect()
    want = collections.Counter()
    for i, t, _, _ in ROWS:
        raw = ours.encode(t or "") + b"\0\0\0\0"
        n = len(raw) // 4
        first = n % 2048 or min(n, 2048)
        cuts = [0, *range(first, n + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 2048) + 2
    assert packing.pack(empty(spark)).count() == 0


def test_local_search_only_raises_squared_fill():
    rng = random.Random(1)
    for n, top in ((1, 2047), (40, 2047), (400, 900), (3000, 2047), (500, 1300)):
        lengths = [rng.randint(1, top) for _ in range(n)]
        bins = packing.Bins(lengths, 2048)
        bins.best_fit()
        before, count = sum(f * f for f in bins.fill), sum(map(bool, bins.bins))
        bins.local_search()
        assert sum(f * f for f in bins.fill) >= before and sum(map(bool, bins.bins)) <= count
        assert sorted(x for b in bins.bins for x in b) == list(range(n))
        assert all(sum(lengths[x] for x in b) == f <= 2048 for b, f in zip(bins.bins, bins.fill))
    bins = packing.Bins([1100, 1100, 900, 900, 600, 500, 400, 548], 2048)  # a swap is needed to fill bins
    bins.best_fit()
    bins.local_search()
    assert sum(map(bool, bins.bins)) == 3


def test_local_search_sees_all_exchanges():
    """Only the last two of fourteen documents of the fuller bin give a sum that makes room for the longer one."""
    few = packing.Bins([*range(101, 113), 200, 201, 402, 600], 2048)
    few.bins, few.fill, few.of = [list(range(14)), [14, 15]], [sum(few.lengths[:14]), 1002], [0] * 14 + [1, 1]
    few.capacity = few.fill[0] + 1
    few.local_search(1)
    assert few.fill[0] == few.capacity and 14 in few.bins[0] and {12, 13} <= set(few.bins[1])


def improving(bins):
    """An exchange (a, given, b, back) that raises the sum of squared fills, by trying all of them."""
    parts = lambda b, sizes: [c for k in sizes for c in itertools.combinations(bins.bins[b], k)]
    size = lambda docs: sum(bins.lengths[x] for x in docs)
    for a, b in itertools.permutations([b for b in range(len(bins.bins)) if 0 < bins.fill[b] < bins.capacity], 2):
        for given in parts(a, (1, 2)):
            for back in parts(b, (0, 1, 2) if len(given) == 1 else (1,)):
                d = size(given) - size(back)
                if 0 < d <= bins.capacity - bins.fill[b] and d > bins.fill[a] - bins.fill[b]:
                    return a, given, b, back
    return None


def test_no_exchange_is_left():
    rng = random.Random(3)
    for trial in range(60):
        n, top = rng.choice([(2, 2000), (30, 2047), (60, 1200), (60, 700), (25, 300)])
        bins = packing.Bins([rng.randint(1, top) for _ in range(n)], 2048)
        if trial % 2:
            bins.best_fit()
        else:  # from a bad start
            bins.bins = [[x] for x in range(n)]
            bins.fill, bins.of = list(bins.lengths), list(range(n))
        bins.local_search()
        assert improving(bins) is None
        assert sorted(x for b in bins.bins for x in b) == list(range(n))
        assert all(sum(bins.lengths[x] for x in b) == f <= 2048 for b, f in zip(bins.bins, bins.fill))
        assert all(bins.of[x] == i for i, b in enumerate(bins.bins) for x in b)


def test_exchanges_in_both_directions():
    two_for_one = packing.Bins([1000, 900, 520, 500], 2048)  # 520 + 500 of the emptier bin for 900
    two_for_one.bins, two_for_one.fill, two_for_one.of = [[0, 1], [2, 3]], [1900, 1020], [0, 0, 1, 1]
    two_for_one.local_search()
    assert sorted(two_for_one.fill, reverse=True)[0] == 2020
    to_the_emptier = packing.Bins([1900, 100, 148], 2048)  # the emptier bin of two ends up the fuller one
    to_the_emptier.bins, to_the_emptier.fill, to_the_emptier.of = [[0, 1], [2]], [2000, 148], [0, 0, 1]
    to_the_emptier.local_search()
    assert max(to_the_emptier.fill) == 2048
