"""SimHash, Jaccard join, the pipeline."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from helpers import ROWS, SF, empty, frame, near_classes

import corpus_pipeline
from rookery.llm import jaccard, langid, packing, quality, simhash


def check_next(rows, got):
    ordered = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: r[:2])
    want = collections.Counter()
    for k, (_, text, i) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        own, changed, other = map(simhash.fingerprint, (text, edited, nxt))
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        want[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(own, changed), like(own, other)] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == want


def test_simhash_successors(spark):
    check_next([r[:2] for r in ROWS], simhash.with_successor(frame(spark)).collect())
    check_next([(5, "only one")], simhash.with_successor(frame(spark, [(5, "only one", None, None)])).collect())
    assert simhash.with_successor(empty(spark)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.with_successor(docs).collect()
    check_next([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.1


def test_hamming_search_finds_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    near = np.array([int(x) ^ simhash._signed(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False))) for x in base], dtype=np.int64)
    prints = sorted({int(x) for x in [*base, *near]})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    asked = prints[::7]
    got = {(r["query"], r["fp"], r["distance"]) for r in simhash.within(df, df.where(df.fp.isin(asked))).collect()}
    want = {(a, b, d) for a in asked for b in prints if (d := ((a ^ b) & ((1 << 64) - 1)).bit_count()) <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.within(df, df, 5, 5)


@pytest.mark.parametrize("large", [False, True])
def test_jaccard_equals_all_pairs(spark, monkeypatch, large):
    if large:  # every band goes through the blocks
        monkeypatch.setattr(jaccard, "SMALL", 1)
        monkeypatch.setattr(jaccard, "PART", 1 << 20)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(9)
    base = [words[i] for i in rng.integers(0, 400, 90)]
    rows = []
    for k in range(60):  # a cloud of near copies around one text: many pairs close to the threshold
        copy = list(base)
        for p in rng.choice(90, int(rng.integers(0, 4)), replace=False):
            copy[p] = words[int(rng.integers(0, 400))]
        rows.append((1000 + k, " ".join(copy), None, None))
    rows += [r for r in ROWS if r[0] != 7]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(frame(spark, rows)).collect()}
    comp, links = near_classes([r[:2] for r in rows])
    for d, c in comp.items():
        assert got[d] == (c, links[d]), d
    assert got[None] == got[6]  # a row without doc_id is a text like any other


def test_near_identical_nodes_are_counted_not_compared(spark, monkeypatch):
    """A component of several blocks: most texts differ from its head in one word, some in more, some only through others."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"x{rng.randrange(10**9)}"
        return words

    texts = [changed(base, 1) for _ in range(90)] + [changed(base, n) for n in (2, 3, 4, 4, 5, 6, 8) for _ in range(6)] + [changed(changed(base, 3), 3) for _ in range(10)]
    texts += [texts[3], texts[3], texts[100]]  # copies
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)] + [(500, " ".join(f"v{i}" for i in range(60)), "en", "s")]
    df = frame(spark, rows)
    want_class, want_links = near_classes([r[:2] for r in rows])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(df).collect()}
    assert got == {d: (want_class[d], want_links[d]) for d in want_class}
    seen = []
    monkeypatch.setattr(jaccard, "staged", lambda d, name, *a, f=jaccard.staged, **k: (seen.append((name, out := f(d, name, *a, **k))), out)[1])
    jaccard.classes(df).count()
    assert dict(seen)["core"].count() > 60  # these form no pairs among themselves


def test_rows_with_equal_ids_and_other_texts_stay_apart(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one), (1, two), (2, two), (3, one), (None, one), (None, three), (None, three + " c30"), (None, None), (5, None), (5, None), (7, ""), (8, " ")]
    df = frame(spark, [(*r, None, None) for r in rows])
    got = jaccard.classes(df).collect()
    assert len(got) == len(rows)
    texts = spark.createDataFrame(got).groupBy("class_id").count().collect()
    sizes = sorted((r["count"] for r in texts), reverse=True)
    assert sizes == [3, 2, 2, 2, 1, 1, 1]
    by_class = collections.defaultdict(list)
    for r in got:
        by_class[r["class_id"]].append((r["doc_id"], r["n_links"]))
    assert sorted(by_class[5]) == [(5, 0), (5, 0)] and by_class[7] == [(7, 0)] and by_class[8] == [(8, 0)]
    own, other = sorted((sorted(x, key=repr) for c, x in by_class.items() if len(x) in (2, 3) and any(d == 1 for d, _ in x)), key=len)
    assert own == [(1, 0), (2, 0)] and other == [(1, 0), (3, 0), (None, 0)]
    assert [(None, 1), (None, 1)] in by_class.values() and sum(c < 0 for c in by_class) == 3
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    assert kept == collections.Counter([(1, one), (1, two), (None, min(three, three + " c30", key=lambda t: hashlib.md5(("+" + t).encode()).hexdigest())), (None, None), (5, None), (7, ""), (8, " ")])


def test_common_counts_by_products_and_by_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64) * np.uint64(1 << 57)) for n in rng.integers(1, 200, 40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(25), np.arange(15)))
    want = [np.intersect1d(sets[x], sets[25 + y]).size for x, y in zip(i, j)]
    assert jaccard.common_counts(sets[:25], sets[25:], i, j).tolist() == want
    assert jaccard.common_counts(sets[:25], sets[25:], i[:9], j[:9]).tolist() == want[:9]


def test_jaccard_recall_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    comp, links = near_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.op9(spark, sf).collect()}
    assert got == {d: (c, links[d]) for d, c in comp.items()}


def test_jaccard_on_the_table_and_odd_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    comp, links = near_classes(docs)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.op9(spark, SF).collect()} == {d: (c, links[d]) for d, c in comp.items()}
    assert jaccard.classes(empty(spark)).count() == 0
    kept = jaccard.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and None not in ids


def test_posterior_table_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (2000, jaccard.HASHES)).astype("<u2")
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype("<u2")
    assert len(jaccard.survivors(a, b)) >= 1990
    c = np.where(rng.random(a.shape) < 0.5, a, a + 1).astype("<u2")
    assert len(jaccard.survivors(a, c)) == 0


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    train = [d for d in rows if __import__("zlib").crc32(str(d).encode()) % 4 != 2]
    langs = sorted({rows[d]["lang"] for d in train})
    counts = np.stack([np.bincount(langid.trigrams([rows[d]["text"] for d in train if rows[d]["lang"] == x])[0], minlength=langid.BUCKETS) for x in langs]).astype(float)
    model = langid.LanguageModel(langs, counts)
    left = [d for d in rows if model.judged([rows[d]["text"]])[0][1] >= 0.5]
    con = duckdb.connect()
    documents = docs.toPandas()
    documents = documents[documents.doc_id.isin(left)]
    con.register("documents", documents)
    left = [r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()]
    comp, _ = near_classes([(d, rows[d]["text"]) for d in left])
    left = {d for d in left if comp[d] == d}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == left and len(left) > 50
    tokens = packing.Tokens(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    length = collections.Counter()
    for r in got:
        length[r["doc_id"]] += r["length"]
    assert length == {d: len(tokens.encode(rows[d]["text"])) // 4 + 1 for d in left}
    assert len({r["sequence_id"] for r in got}) <= -(-sum(length.values()) // 2048) * 1.05 + 1


LONG = " ".join(f"{a}{b}" for a in ("the", "house", "river", "stone", "winter", "garden", "letter", "window") for b in ("", "s", "ly", "er", "ing", "ed", "est", "en"))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, name, stage):
    assert stage(spark, empty(spark), SF).count() == 0
    rows = [*ROWS, (21, LONG, "en", "a"), (22, LONG, "en", "a"), (21, LONG, "en", "a")]
    out = stage(spark, frame(spark, rows), SF)
    ids = collections.Counter(r["doc_id"] for r in out.collect())
    every = collections.Counter(r[0] for r in rows)
    if name != "best_fit_packing":
        assert out.columns == frame(spark).columns
    if name == "language_id":  # nothing to judge: null, empty, blank, digits; repeated rows stay
        assert not {2, 3, 4, 5} & set(ids) and ids[7] == 2 and ids[21] == 2 and not ids - every
    elif name == "quality_rules":  # short or repetitive texts go
        assert ids == {21: 2, 22: 1, **({14: 1} if ids[14] else {})}
    elif name == "jaccard_join":  # one row of each text and each near copy
        assert ids == {i: 1 for i in every if i is not None and i not in (7, 8, 22)}
    else:
        assert set(ids) == set(every) and ids[21] == 2 and ids[22] == 1


def brute_fingerprint(text):
    """Signed votes of neighbouring word pairs, bit by bit."""
    mask = (1 << 64) - 1

    def mix(h):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h ^= h >> 33
            h = h * m & mask
        return h ^ h >> 33

    words = text.lower().encode().split()
    hashed = [mix(sum((c + 1) * (1 if i == 0 else pow(0x100000001B3, i, 1 << 64)) for i, c in enumerate(w)) & mask) for w in words]
    weights = [min(len(w), 16) for w in words]
    if len(words) > 1:
        hashed = [mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in zip(hashed, hashed[1:])]
        weights = [a + b for a, b in zip(weights, weights[1:])]
    return sum(1 << bit for bit in range(64) if sum(w if h >> bit & 1 else -w for h, w in zip(hashed, weights)) > 0)


def test_simhash_query_equals_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = {d: brute_fingerprint(t) for d, t in docs}
    got = {r["doc_id"]: r for r in simhash.op6(spark, SF).collect()}
    assert len(got) == len(docs)
    for k, (d, text) in enumerate(docs):
        half, following = len(text) // 2, docs[(k + 1) % len(docs)]
        edited = text[: len(text) - half] + following[1][:half]
        r = got[d]
        assert r["fingerprint"] == f"{prints[d]:016x}" and r["edited_fingerprint"] == f"{brute_fingerprint(edited):016x}"
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == 1 - (prints[d] ^ prints[following[0]]).bit_count() / 64
        near = sum((x ^ prints[d]).bit_count() <= simhash.RADIUS for x in set(prints.values()) - {prints[d]})
        assert r["n_near"] == (near if d % 20 == 0 else None)
