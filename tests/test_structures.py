"""Disjoint sets by bitmaps, similar jobs by classes, folder closure by doubling: against brute force on small and skewed tables."""

import random

import pytest

from rookery.operators import joins, lifecycle, windows


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, skills array<string>, department string, city string, level int, title string")


def disjoint(rows):
    out = {}
    for i, s, *_ in rows:
        other = [j for j, t, *_ in rows if s and t and not set(s) & set(t)]
        if other:
            out[i] = min(other)
    return out


def test_first_disjoint(spark):
    rng = random.Random(2)
    rows = [(i, rng.sample("abcdefgh", rng.randint(0, 5)), "d", "c", 1, "t") for i in range(300)]
    got = {r["job_id"]: r["negative_id"] for r in joins.first_disjoint(jobs(spark, rows)).collect()}
    assert got == disjoint(rows)


def test_every_set_shares_one_skill(spark):
    rows = [(i, ["all", f"s{i}"], "d", "c", 1, "t") for i in range(200)]
    assert joins.first_disjoint(jobs(spark, rows)).count() == 0
    rows.append((999, ["z"], "d", "c", 1, "t"))
    got = {r["job_id"]: r["negative_id"] for r in joins.first_disjoint(jobs(spark, rows)).collect()}
    assert got == disjoint(rows)


def test_an_answer_behind_the_first_bucket(spark):
    """More sets than a bitmap has bits, all but the last with one skill in common."""
    n = joins.BUCKET + 10
    many = spark.range(n).selectExpr("id AS job_id", "array('all', concat('s', id)) AS skills", "'d' AS department", "'c' AS city", "1 AS level", "'t' AS title")
    last = jobs(spark, [(n + 5, ["z"], "d", "c", 1, "t")]).select(*many.columns)
    got = joins.first_disjoint(many.unionByName(last))
    assert got.where(f"negative_id = {n + 5}").count() == n and got.where(f"job_id = {n + 5}").first()["negative_id"] == 0


def similar(rows, limit=5):
    out = []
    for i, s, d, c, *_ in rows:
        if i % 20 == 0:
            scores = [(round((0.4 * len(set(s) & set(t)) / len(s) if s else 0) + 0.3 * (d == e) + 0.3 * (c == f), 6), j) for j, t, e, f, *_ in rows if j != i]
            out += [(i, j, x, k + 1) for k, (x, j) in enumerate(sorted((p for p in scores if p[0] > 0), key=lambda p: (-p[0], p[1]))[:limit])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_jobs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.sample("abcdefghij", rng.randint(1, 4)), rng.choice(["hot", "hot", "x", "y"]), rng.choice("pqrs"), 1, "t") for i in range(240)]
    rows += [(1000 + i, ["a", "b"], "hot", "p", 1, "t") for i in range(60)]  # a class of many equal jobs
    got = sorted((r["job_id"], r["other_id"], r["score"], r["k"]) for r in joins.similar_jobs(jobs(spark, rows)).collect())
    assert [(a, b, k) for a, b, _, k in got] == [(a, b, k) for a, b, _, k in similar(rows)]
    assert [x for *_, x, _ in got] == pytest.approx([x for *_, x, _ in similar(rows)])


def test_closure_of_a_deep_chain_and_a_cycle(spark):
    chain = [(f"f{i}", f"f{i - 1}" if i else None) for i in range(201)] + [("lost", "gone")]
    got = {(r["id"], r["ancestor"]): r["depth"] for r in lifecycle.folder_closure(spark.createDataFrame(chain, "id string, parent_id string")).collect()}
    assert got == {(f"f{i}", f"f{j}"): i - j for i in range(201) for j in range(i + 1)} | {("lost", "lost"): 0, ("lost", "gone"): 1}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        lifecycle.folder_closure(ring)


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 AS x")
    assert all(r["x"] == r["number"] for r in windows.global_numbers(rows, ["x"]).collect())


def test_fast_path_meets_each_name_once(spark):
    """A hundred queries for one name and two thousand owners of it: the pairs between are not made."""
    from rookery.plans import recruiting

    queries = spark.createDataFrame([(i, "王伟") for i in range(100)] + [(100, "李娜"), (101, "who else")], "query_id long, query string")
    owners = spark.createDataFrame([(i, "王伟") for i in range(2000, 0, -1)] + [(i, "小李娜") for i in (5001, 5002)], "candidate_id long, name string")
    hits = spark.createDataFrame([(q, c, float(c % 50)) for q in range(102) for c in (1, 5002, 6000, 6001, 6049)], "query_id long, candidate_id long, score double")
    out = recruiting.name_fast_path(queries, owners, hits)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["candidate_id"], r["pinned"]))
    assert all(got[q] == [(c, True) for c in range(1, 21)] for q in range(100))
    assert got[100] == [(5001, True), (5002, True), (6049, False), (1, False), (6001, False), (6000, False)] and [c for c, _ in got[101]] == [6049, 5002, 1, 6001, 6000]
    rows = []

    def walk(node):
        if node.nodeName().endswith("Join"):
            rows.append(node.metrics().get("numOutputRows").get().value())
        for child in (node.executedPlan(),) if node.nodeName() == "AdaptiveSparkPlan" else (node.plan(),) if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    out.collect()
    walk(out._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < 20_000


def test_jobs_with_the_same_skills_are_answered_once(spark):
    """Skills by text and by vector; a vector hit stands before, documents with the same terms are alike, copies of a job get its answer."""
    from pyspark.sql import functions as F

    from rookery.plans import retrieval

    docs = spark.createDataFrame([(i, "red bolt" if i % 3 == 0 else "a bolts" if i % 3 == 1 else "none") for i in range(300)], "document_id long, content string")
    jobs = spark.createDataFrame([(400 * j + at, s) for j in range(50) for at, s in ((20, ["red", "bolt"]), (40, ["bolt", "red"]))] + [(21, ["red"])], "job_id long, skills array<string>")
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    rows = spark.createDataFrame([(1, 10, 7, unit(0)), (2, 11, 1, unit(1)), (3, 12, 2, unit(3))], "id long, paragraph_id long, document_id long, embedding array<double>").withColumn("knowledge_id", F.lit(0))
    queries = spark.createDataFrame([(20, unit(0)), (40, unit(1)), (60, unit(2)), (80, unit(3)), (100, unit(3))], "query_id long, embedding array<double>")
    got = {}
    for r in retrieval.skill_and(docs, jobs, rows, queries).collect():
        got.setdefault(r["job_id"], {})[r["rank"]] = (r["document_id"], r["paragraph_id"], r["bits"])
    assert set(got) == {400 * j + at for j in range(50) for at in (20, 40)} and all(len(x) == 20 for x in got.values())
    assert [got[20][n] for n in (1, 2, 3, 20)] == [(7, 10, "11"), (1, 11, "01"), (0, None, "11"), (51, None, "11")] and all(got[400 * j + 20] == got[20] for j in range(50))
    assert [got[40][n] for n in (1, 2, 20)] == [(1, 11, "10"), (0, None, "11"), (54, None, "11")]
    match = [tuple(r) for r in retrieval.job_candidate_match(docs, jobs.where("job_id < 400"), rows, queries).orderBy("job_id", "rank").collect()]
    assert match[:10] == [(20, 3 * i, 4, "text", i + 1) for i in range(10)] and len(match) == 20
    found = retrieval.skill_hits(docs, jobs, rows, queries)
    assert found.classes.count() == 2 and found.jobs.count() == 100 and found.held.count() == 200


def test_evidence_keeps_no_postings_and_no_excerpts(spark, monkeypatch):
    from rookery.plans import recruiting

    kept = []
    monkeypatch.setattr(recruiting, "keyword_index", lambda *a: pytest.fail("a posting table of all paragraphs"))
    monkeypatch.setattr(recruiting, "staged", lambda df, name, real=recruiting.staged: kept.append(df.columns) or real(df, name))
    applications = spark.createDataFrame([(1, 5, 3), (2, 5, 43), (3, 6, 3), (4, 9, 3), (5, 5, 4)], "application_id long, candidate_id long, job_id long")
    texts = {50: (5, "red red fish"), 51: (5, "blue fish in red"), 52: (5, "nothing"), 53: (5, "RED blue fish"), 54: (5, "blue"), 60: (6, "fish 13812345678")}
    paragraphs = spark.createDataFrame([(p, d, t) for p, (d, t) in texts.items()], "paragraph_id long, document_id long, content string")
    queries = spark.createDataFrame([(3, "Red blue fish fish"), (4, "blue")], "query_id long, text string")
    rows = {(r["application_id"], r["rank"]): (r["paragraph_id"], r["relevance"]) for r in recruiting.evidence_bundle(applications, paragraphs, queries).collect()}
    best = {1: (51, 1.0), 2: (53, 1.0), 3: (50, 0.666667)}
    assert rows == {(a, n): x for a in (1, 2) for n, x in best.items()} | {(3, 1): (60, 0.333333), (5, 1): (51, 1.0), (5, 2): (53, 1.0), (5, 3): (54, 1.0)}
    assert {tuple(r) for r in recruiting.v23(applications, paragraphs, queries).collect()} == {(1, 52), (2, 52), (3, 61), (5, 52)}
    assert kept and not any("excerpt" in columns for columns in kept)


def test_words_stay_in_their_tasks(spark, monkeypatch):
    """Terms found inside words, by the tasks and by the join that many terms take; the first way shuffles no words."""
    from rookery.plans import retrieval

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcä中") for _ in range(rng.randint(1, 6)))
    rows = [(i, rng.choice([" ", "\t", "\n ", "\x0b"]).join(word() for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(300, None), (301, "a b c")]
    terms = sorted({word() for _ in range(60)}) + ["a b", ""]
    table, wanted = spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame([(t,) for t in [*terms, None]], "term string")
    want = {(k, t) for k, x in rows for t in terms if t and t in (x or "")}
    places = retrieval.term_places(table, ["k"], "t", wanted)
    assert {tuple(r) for r in places.collect()} == want
    assert "Exchange" not in places._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "MOST_SENT", 10)
    assert {tuple(r) for r in retrieval.term_hits(table, ["k"], "t", wanted).collect()} == want
