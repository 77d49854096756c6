"""The language model: its pieces by brute force, its scores end to end."""

import collections
import math
import zlib

import numpy as np
import pytest
from helpers import ROWS, empty, frame
from pyspark.sql import functions as F

from rookery.llm import lm


def small(seed=3, size=300):
    """A model of random weights in double precision over few ids."""
    model = lm.Attention(size, seed)
    rng = np.random.default_rng(seed)
    model.O = lm.outputs(rng.random((size, lm.PARTS)) * 50, np.full(size, 1 / size)).astype(np.float64)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    model.E, model.seen = model.E.astype(np.float64), model.seen.astype(np.float64)
    model.start()
    return model


def plain_logp(model, context, pair, target):
    """Natural log-probability of ``target`` after the ids ``context`` of its window, by loops over one position."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = [model.E[i].astype(np.float64) + w["P"][k] for k, i in enumerate(context)]
    query = x[-1] @ w["Q"]
    weight = [math.exp(min(30, float(query @ y))) for y in x]
    seen = sum(a * y for a, y in zip(weight, x)) / sum(weight)
    h = seen @ w["V"] + x[-1] + model.E[model.size + pair]
    part = [math.exp(v) for v in h @ w["U"] + w["u"]]
    return math.log(sum(p * float(o) for p, o in zip(part, model.O[target])) / sum(part))


def plain_score(model, ids):
    """log10 probability of a text's ids, window by window and id by id."""
    end = model.size - 1
    s = [end, *[int(i) for i in ids], end]
    out, first = 0.0, 0
    while True:
        for k in range(lm.WINDOW):
            at = first + k
            if at + 1 < len(s) and (first == 0 or k >= lm.WINDOW - lm.STRIDE):
                pair = int(lm.pair_slots(np.array([s[max(0, at - 1)]]), np.array([s[at]]))[0])
                out += plain_logp(model, s[first : at + 1], pair, s[at + 1])
        if first + lm.WINDOW >= len(s) - 1:
            return out / math.log(10)
        first += lm.STRIDE


def test_gradients():
    model, rng = small(), np.random.default_rng(1)
    ids = rng.integers(0, 300, (3, lm.WINDOW)).astype(np.int32)
    pairs = rng.integers(0, lm.PAIRS, ids.shape).astype(np.int32)
    target = rng.integers(0, 300, ids.shape).astype(np.int32)
    target[2, 5:] = -1

    def loss(change):
        moved = small()
        change(moved)
        return -moved.logp(ids, pairs, target).mean()

    own = small()
    own.step(ids, pairs, target, 0.0)
    for name, w in model.w.items():
        at = tuple(int(rng.integers(0, s)) for s in w.shape)
        up, down = (loss(lambda m, d=d: m.w[name].__setitem__(at, m.w[name][at] + d)) for d in (1e-5, -1e-5))
        assert own.moments[name][0][at] * 10 == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)
    for row in (int(ids[0, 3]), 300 + int(pairs[1, 2])):
        up, down = (loss(lambda m, d=d: m.E.__setitem__((row, 4), m.E[row, 4] + d)) for d in (1e-5, -1e-5))
        assert math.sqrt(own.seen[row, 4]) == pytest.approx(abs(up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_model_is_causal_and_a_distribution():
    model, rng = small(), np.random.default_rng(2)
    ids = rng.integers(0, 300, (1, lm.WINDOW)).astype(np.int32)
    pairs = rng.integers(0, lm.PAIRS, ids.shape).astype(np.int32)
    at = np.arange(lm.WINDOW) == 5
    every = np.concatenate([model.logp(ids, pairs, np.where(at, c, -1)[None]) for c in range(300)])
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-6)
    other, others = ids.copy(), pairs.copy()
    other[0, 6:], others[0, 6:] = 7, 9
    target = np.where(at, 7, -1)[None]
    assert model.logp(ids, pairs, target) == pytest.approx(model.logp(other, others, target), abs=1e-9)


def test_windows_score_each_id_once():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 255, n) for n in (2, 5, 16, 17, 18, 57, 300)]
    _, _, target, owner = lm.windows(sequences)
    for i, s in enumerate(sequences):
        assert [t for row in target[owner == i] for t in row if t >= 0] == s[1:].tolist()


def test_scores_equal_a_plain_loop():
    model, rng = small(), np.random.default_rng(4)
    texts = [rng.integers(0, 299, n) for n in (0, 1, 14, 15, 16, 17, 40, 100)]
    got = lm.log10_scores(model, [lm._framed(t, 299) for t in texts])
    assert got == pytest.approx([plain_score(model, t) for t in texts], rel=1e-6)


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(lm, "WARM_STEPS", 60)
    monkeypatch.setattr(lm, "GROUP", 30_000)


def test_scored_rows_equal_brute_force(spark, quick):
    docs = frame(spark).withColumn("train", F.coalesce(F.expr("doc_id > 0 AND doc_id % 2 = 1"), F.lit(False)))
    got = lm.scored(docs).collect()
    words = lambda t: (t or "").encode().lower().split()
    counts = collections.Counter(w for i, t, _, _ in ROWS if i is not None and i > 0 and i % 2 == 1 for w in words(t))
    n_docs = sum(i is not None and i > 0 and i % 2 == 1 for i, *_ in ROWS)
    total, distinct = sum(counts.values()) + n_docs, len(counts) + 1
    rows = lm.coded(docs.select("doc_id", "text", "train"))
    sub = lm.Subwords()
    by_id = collections.Counter(int(x) for i, t, _, _ in ROWS if i is not None and i > 0 and i % 2 == 1 for x in sub.ids(words(t)))
    assert {int(r["key"]): r["n"] for r in rows.where("kind = 'i'").groupBy("key").agg(F.sum("n").alias("n")).collect()} == by_id
    model = lm.learn(rows.where("train").select("doc_id", "ids"), rows.where("kind = 'i'").groupBy("key").agg(F.sum("n").alias("n")))
    want = {}
    for i, t, _, _ in ROWS:
        each = [counts[w] for w in words(t)] + [n_docs]
        score = plain_score(model, sub.ids(words(t))) if len(t or "") < 5000 else None
        want[i] = (len(each), sum(c > 0 for c in each), sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in each), score)
    assert len(got) == len(ROWS)
    for r in got:
        n, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        if score is not None:
            assert r["score"] == pytest.approx(score, rel=1e-4)
    assert lm.scored(empty(spark).selectExpr("*", "true AS train")).count() == 0
    assert lm.scored(frame(spark).selectExpr("*", "false AS train")).where("score < 0 AND train_tokens = 0").count() == len(ROWS)


def test_scores_do_not_depend_on_partitions(spark, quick):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("train", F.col("doc_id") % 5 != 0)
    one, many = ({r["doc_id"]: r["score"] for r in lm.scored(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == pytest.approx(many, rel=1e-6)  # rounding inside a batch of windows is left


def test_sums_of_runs_and_drawn_parts():
    rng = np.random.default_rng(6)
    for keys in (rng.integers(0, 40, 200), np.arange(200)[::-1], np.full(200, 65535)):
        values = rng.random((200, 5))
        order, first, key = lm._runs(keys)
        assert key.tolist() == sorted(set(keys.tolist()))
        assert lm._sums(values, order, first) == pytest.approx(np.stack([values[keys == k].sum(axis=0) for k in key]))
    r = rng.random(lm.PARTS).astype(np.float32) ** 8
    r[: lm.LANE] = r[-1] = 0
    drawn, n = lm.Drawn(3, 1), 200_000
    drawn(np.full(n, 2, dtype=np.int32), np.tile(r / r.sum(), (n, 1)))
    got = drawn.counts.reshape(3, -1)
    assert not got[:2].any() and got.sum() == n and not got[2][r == 0].any()
    assert got[2] / n == pytest.approx(r / r.sum(), abs=0.005)


def test_sums_where_few_or_most_rows_share_a_key():
    rng = np.random.default_rng(9)
    for keys in (np.concatenate([np.arange(150), np.full(60, 7), [90, 90]]), rng.integers(0, 9, 212)):
        values = rng.random((212, 5))
        order, first, key = lm._runs(keys)
        assert lm._sums(values, order, first) == pytest.approx(np.stack([values[keys == k].sum(axis=0) for k in key]))


def test_a_step_moves_weights_as_adam_does():
    model, rng = small(), np.random.default_rng(8)
    ids, target = (rng.integers(0, 300, (4, lm.WINDOW)).astype(np.int32) for _ in range(2))
    pairs = rng.integers(0, lm.PAIRS, ids.shape).astype(np.int32)
    before = {k: v.copy() for k, v in model.w.items()}
    model.step(ids, pairs, target, 0.01)
    for name, (m, s) in model.moments.items():
        assert m.shape == model.w[name].shape and (s > 0).any()
        assert model.w[name] == pytest.approx(before[name] - 0.01 * (m / 0.1) / (np.sqrt(s / 0.01) + 1e-8), rel=1e-9)


def test_every_window_is_trained_on():
    model, first = lm.Attention(300), lm.Attention(300)
    docs = [np.arange(n, dtype=np.uint16) % 299 for n in (602, 15, 16)]
    drawn, met, done = lm.trained(model, iter([d.tobytes() for d in docs]), 1000)
    assert done == 603 + 16 + 17 and drawn.counts.sum() == done
    ends = np.bincount(np.concatenate([[*d, 299] for d in docs]), minlength=300)
    assert (drawn.counts.reshape(-1, lm.PARTS).sum(axis=1) == ends).all()
    assert met[300:].sum() == done and (model.E[:300] != first.E[:300]).any(axis=1).all()


def test_beats_the_unigram_base_on_held_out_texts(spark):
    got = [r for r in lm.op10(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0}
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
