"""The stored posting table: blocks by impact, bounds that hold, reads that stop."""

import pytest

from rookery.plans import keywords, retrieval, tokens


@pytest.fixture(scope="module")
def corpus(spark):
    """One paragraph in ten says `apple` many times, the others once; `pear` is everywhere."""
    rows = [(i, ("apple " * (1 + (i % 10 == 0) * (3 + i % 7))) + f"pear word{i} other{i % 3}") for i in range(2000)] + [(5000, "grape apple pear"), (5001, ""), (5002, None)]
    return spark.createDataFrame(rows, "paragraph_id long, content string")


def test_blocks_are_whole_and_by_impact(corpus):
    index = keywords.keyword_index(corpus)
    apple = {r["impact"]: r["n"] for r in index.blocks.where("token = 'apple'").collect()}
    assert sum(apple.values()) == 2001 and apple[1] == 1801 and max(apple) == 10
    assert keywords.keyword_index(corpus).postings is index.postings  # written once
    assert index.postings.where("paragraph_id IN (5001, 5002)").count() == 0


def test_reading_stops_when_the_bound_is_too_small(spark, corpus):
    index = keywords.keyword_index(corpus)
    asked = spark.createDataFrame([(1, "apple"), (2, "apple other1"), (3, "grape pear"), (4, "nowhere"), (5, "apple -pear")], "query_id long, query string")
    got, whole = keywords.keyword_search(index, asked).collect(), keywords.keyword_search(index, asked, None).collect()
    key = lambda r: (r["query_id"], r["rank"], r["paragraph_id"], round(r["score"], 12))
    assert sorted(map(key, got)) == sorted(key(r) for r in whole if r["rank"] <= keywords.K)
    assert {r["query_id"] for r in got} == {1, 2, 3}
    order = {(r["query_id"], r["impact"]): r for r in keywords.read_order(index, keywords.literals(asked)).collect()}
    fifth = min(r["score"] for r in got if r["query_id"] == 1)
    assert order[1, 1]["bound"] < fifth and order[1, 1]["earlier"] >= keywords.FIRST_READ * keywords.K  # 1,801 postings are never met
    most = {q: max(r["bound"] for (of, _), r in order.items() if of == q) for q in (1, 2, 3)}
    assert all(r["score"] <= most[r["query_id"]] + 1e-12 for r in whole)


def test_kernel_equals_the_tokenizer(spark):
    texts = ["Ärger & ÀÉ x1 x1", "中文 mixed中word", "", None, "a-b_c d.d", "İstanbul ΣΑΣ ß²", "x" * 5000 + " " + "y z " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("*", "array('mixed中', 'b_c', 'zz') AS terms")
    want = {}
    for r in rows.select("k", tokens.tokens("t", rows["terms"]).alias("w")).collect():
        for i, w in enumerate(r["w"] or []):
            want.setdefault((r["k"], w), []).append(i + 1)
    got = {(r["k"], r["token"]): r["positions"] for r in tokens.postings(rows, "k", "t", rows["terms"]).collect()}
    assert got == want


def test_only_or_in_capitals_joins_groups(spark):
    rows = spark.createDataFrame([(1, "or apple"), (2, "apple"), (3, "pear grape"), (4, "or"), (5, "pear or")], "paragraph_id long, content string")
    asked = spark.createDataFrame([(1, "or apple OR pear grape"), (2, "pear or"), (3, "apple OR or pear"), (4, "apple --or"), (5, "or")], "query_id long, query string")
    got = {}
    for r in keywords.keyword_search(keywords.keyword_index(rows), asked, None).collect():
        got.setdefault(r["query_id"], set()).add(r["paragraph_id"])
    assert got == {1: {1, 3}, 2: {5}, 3: {1, 2, 5}, 4: {2}, 5: {1, 4, 5}}


def test_fusion_ranks_equal_scores_by_id(spark):
    leg = lambda *rows: spark.createDataFrame([(1, p, s) for p, s in rows], "query_id long, paragraph_id long, score double")
    summed, other = 0.1 + 0.2, 0.3  # the same score, summed in another order
    got = {r["paragraph_id"]: r["rrf"] for r in retrieval.fused([leg((7, 0.5)), leg((2, summed), (1, other))]).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[2] == pytest.approx(1 / 62)
