"""Quality rules, language ID, sharding, URL filters."""

import collections

import duckdb
import pytest
from helpers import ROWS, SF, empty, frame

from rookery.llm import _util, langid, quality, shard, urlfilter


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def brute_base(text):
    text = text or ""
    w = text.encode().split()
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().strip()]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base_on_odd_rows(spark):
    got = quality.judged(_util.staged(quality.measured(frame(spark)), "m")).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((i, *brute_base(t)) for i, t, _, _ in ROWS)
    assert collections.Counter((r["doc"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.keep(empty(spark)).count() == 0
    assert quality.keep(frame(spark)).columns == frame(spark).columns


def test_quality_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found, want = quality.op1(spark, SF), con.sql(quality.SQL)
    columns = sorted(found.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows_of(found, columns) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_quality_fences_follow_each_group(spark):
    """Texts without blanks pass where they are the rule and fail where they are not; small groups lean on their language."""
    words = lambda n, length: " ".join(f"{i:03d}" + "a" * (length - 3) for i in range(n))
    rows = [(i, words(80 + i % 7, 5 + i % 3), "aa", "x") for i in range(400)] + [(1000 + i, words(80 + i % 7, 400 + i % 90), "zz", "x") for i in range(400)]
    rows += [(2000, words(80, 300), "aa", "x"), (2001, words(80, 300), "zz", "x"), (2002, words(80, 6), "aa", "rare"), (2003, words(80, 300), "aa", "rare")]
    got = {r["doc"]["doc_id"]: r for r in quality.judged(_util.staged(quality.measured(frame(spark, rows)), "m")).collect()}
    fine = {i: r["m"]["long_words"] <= r["fence_long_words"] for i, r in got.items()}
    assert all(fine[i] for i in range(400)) and all(fine[1000 + i] for i in range(400))
    assert not fine[2000] and fine[2001] and fine[2002]
    limits = {(r["doc"]["lang"], r["doc"]["source"]): r["fence_long_words"] for r in got.values()}
    assert len(set(limits.values())) == 3 and limits["aa", "x"] < limits["zz", "x"]


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in langid.op2(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(got) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_mixture_and_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(base)
    texts = {x: base.where(f"lang = '{x}' AND n_chars > 1500").orderBy("doc_id").first()["text"][:1500] for x in ("en", "de")}
    mixed = dict(model.mixtures([texts["en"] + "\n" + texts["de"]])[0])
    assert set(mixed) == {"en", "de"} and abs(mixed["en"] - 0.5) < 0.1
    got = {(r["doc"]["doc_id"], r["lang_pred"]) for r in langid.identified(frame(spark)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (5, "und")} <= got
    assert langid.identified(empty(spark)).count() == 0


def test_language_mixture_of_all_languages(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(base)
    texts = [base.where((base["lang"] == x) & (base["n_chars"] > 1500)).orderBy("doc_id").first()["text"][:1500] for x in model.langs]
    assert len(texts) > 3
    mixed, alone = model.mixtures(["\n".join(texts), texts[0]])
    assert {x for x, _ in mixed} == set(model.langs) and all(abs(p - 1 / len(texts)) < 0.1 for _, p in mixed)
    assert [x for x, _ in alone] == [model.langs[0]]


def test_sharding(spark):
    df = shard.interleaved(frame(spark), 4)
    got = df.collect()
    assert len(got) == len(ROWS)
    assert all(r["size"] == len((t or "").encode()) + 1 for r in got for t in [next(x[1] for x in ROWS if x[0] == r["doc_id"])])
    # repeated rows and rows without doc_id have slots of their own
    assert len({(r["shard"], r["slot"]) for r in got}) == len(ROWS) and sorted(r["position"] for r in got) == list(range(len(ROWS)))
    assert shard.interleaved(empty(spark), 4).count() == 0
    rows = shard.op3(spark, "/root/testdata/sf0.01").collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    mix = collections.Counter((r["shard"], r["source"]) for r in rows)
    whole = collections.Counter(r["source"] for r in rows)
    assert all(abs(mix[s, x] - n / 16) <= 1.5 for x, n in whole.items() for s in sizes)


@pytest.mark.parametrize("piece_rows", [shard.PIECE_ROWS, 1])
def test_sharding_order_equals_brute_force(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(shard, "PIECE_ROWS", piece_rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dice = {r["doc_id"]: r["dice"] for r in docs.selectExpr("doc_id", f"xxhash64({shard.SEED}, cast(doc_id AS string), crc32(cast(coalesce(text, '') AS binary))) AS dice").collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    fraction = {}
    for x in set(source.values()):
        own = sorted((d for d in source if source[d] == x), key=dice.get)
        fraction |= {d: (2 * i + 1) / (2 * len(own)) for i, d in enumerate(own)}
    order = sorted(source, key=lambda d: (fraction[d], source[d] is not None, source[d] or "", dice[d]))
    got = {r["doc_id"]: (r["position"], r["shard"], r["slot"]) for r in shard.op3(spark, SF).collect()}
    shards = [k * 16 // len(order) for k in range(len(order))]
    assert got == {d: (k, shards[k], k - shards.index(shards[k])) for k, d in enumerate(order)}


def test_language_mixture_equals_plain_em(spark):
    """Expectation-maximisation by loops over runs, for every nested set of languages."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    k = len(model.langs)
    texts = [r["text"] for r in docs[:40]] + [docs[0]["text"][:300] + " " + docs[i]["text"][:300] for i in range(40, 60)] + [None, "", "a"]
    for text, (mixture, score) in zip(texts, model.judged(texts)):
        buckets, _ = langid.trigrams([text])
        if not len(buckets):
            assert (mixture, score) == ([], 0.0)
            continue
        runs = [[sum(float(model.logp[b, x]) for b in buckets[i : i + langid.RUN]) for x in range(k)] for i in range(0, len(buckets), langid.RUN)]

        def em(share, rounds):
            for _ in range(rounds):
                total = [0.0] * k
                for run in runs:
                    top = max(run)
                    joint = [math.exp(v - top) * s + 1e-300 for v, s in zip(run, share)]
                    total = [t + j / sum(joint) for t, j in zip(total, joint)]
                share = [t / len(runs) if s > 0 else 0 for t, s in zip(total, share)]
            return share, sum(max(run) + math.log(sum(math.exp(v - max(run)) * s for v, s in zip(run, share)) + 1e-300) for run in runs)

        first, _ = em([1 / k] * k, langid.ROUNDS)
        order = sorted(range(k), key=lambda x: -first[x])
        best, value = None, -math.inf
        for size in range(1, k + 1):
            share, likelihood = em([1 / size if x in order[:size] else 0 for x in range(k)], langid.ROUNDS if size > 1 else 0)
            if likelihood - (size - 1) * (2 + 0.5 * math.log(len(runs))) > value:
                best, value = share, likelihood - (size - 1) * (2 + 0.5 * math.log(len(runs)))
        assert dict(mixture) == pytest.approx({model.langs[x]: best[x] for x in range(k) if best[x] > 0}, rel=1e-3, abs=1e-6)
        top = max(range(k), key=lambda x: best[x])
        credit = [math.exp(run[top] - max(run)) * best[top] / sum(math.exp(v - max(run)) * s for v, s in zip(run, best)) for run in runs]
        total = [sum(c * run[x] for c, run in zip(credit, runs)) for x in range(k)]
        sure = 1 / sum(math.exp(min(700, v - total[top])) for v in total)
        assert mixture[0][0] == model.langs[top] and score == pytest.approx(best[top] * sure, rel=1e-3, abs=1e-6)


#: Typed from the contract: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/.
CONTRACT = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def brute_urls(urls, rules):
    """(host, path, rule, verdict) of each url: all rules tried in turn, then the share of blocked pages of its host."""
    rows = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((host, path, *(max(fits)[1:] if fits else (None, None))))
    pages, blocked = collections.Counter(r[0] for r in rows), collections.Counter(r[0] for r in rows if r[3] == "block")
    return [(*r[:3], r[3] or ("block" if 2 * blocked[r[0]] > pages[r[0]] else "allow")) for r in rows]


@pytest.mark.parametrize("keys_per_bucket", [urlfilter.KEYS, 1])
def test_url_filter(spark, keys_per_bucket):
    urls = [
        None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "https://a.b.com/en/", "http://com/en/1", "http://xcom/en/1", "http://q.example.net/de/8", "http://net?/de/", "http://.org/es/1", "http://a.org/es",
        "ftp://a.net/de/#f", "x://a\nb.com/en/", "http://a.net/de/1", "http://a.b.com/en/2", "http://a.b.com/fr/2", "http://a.org/es/2", "http://a.org/es/2", "http://q.example.net/de/81", "http://q.example.net/fr/1",
    ]
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string, bucket string, levels string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages, keys_per_bucket=keys_per_bucket).collect()}
    assert got == dict(enumerate(brute_urls(urls, CONTRACT)))
    assert got[14][2:] == ("net/de/", "allow") and got[16][2:] == (None, "block") and got[11][2:] == (None, "block") and got[0][2:] == (None, "allow")
    assert urlfilter.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urlfilter.judged(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize(("size", "per_bucket"), [(3000, None), (3000, 40), (3, 1), (0, 10)])
def test_cascade_is_exact(spark, size, per_bucket):
    listed = spark.range(0, size, 10).selectExpr("concat('k', id) AS key")
    universe = spark.range(3000).selectExpr("concat('k', id) AS key", "id")
    cascade = urlfilter.Cascade(listed, universe, per_bucket)
    assert cascade.buckets == (1 if per_bucket is None else max(1, -(-(-(-size // 10)) // per_bucket)))
    assert size < 100 or len(cascade.levels) > 3
    found = cascade.with_filters(universe, universe["key"]).select("id", cascade.contains(universe["key"]).alias("in")).where("in").collect()
    assert sorted(r["id"] for r in found) == list(range(0, size, 10))


def test_urlfilter_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = rows_of(urlfilter.op5(spark, SF), columns)
    assert got == sorted(con.sql(urlfilter.SQL).fetchall(), key=repr)
    pages = con.sql("SELECT page_id, url FROM pages").fetchall()
    assert got == sorted(((p, *r) for (p, _), r in zip(pages, brute_urls([u for _, u in pages], CONTRACT))), key=repr)
