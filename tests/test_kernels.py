"""Golden cases and invariants of the row kernels."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rookery import catalog
from rookery.functions import text as T
from rookery.plans import chunking, keywords, models, retrieval
from rookery.sources import evidence, exports, readers

TEXTS = ["", "one", "a. b. c", "词语。" * 400, "no marks here " * 60, "x" * 1300, "line\nline two; three! four?" * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_cuts_lose_nothing(text):
    kept = chunking.sentence_cuts(text, 100)
    assert "".join(kept) == text and all(len(p) <= 100 for p in kept)
    pieces = chunking.halving(text, 100)
    assert all(0 < len(p) <= 100 for p in pieces)
    bare = lambda t: "".join(c for c in t if c not in chunking.PIECE_MARKS and not c.isspace())
    assert bare("".join(pieces)) == bare(text)


def test_sentence_cut_prefers_the_last_mark_of_the_second_half():
    assert chunking.sentence_cuts("aaaa. bbb. cccc", 12) == ["aaaa. bbb.", " cccc"]
    assert chunking.sentence_cuts("a. bbbbbbbbbbbbbb", 10) == ["a. bbbbbbb", "bbbbbbb"]
    assert chunking.sentence_cuts("a; bbbb; cccc\ndd", 10) == ["a; bbbb; c", "ccc\ndd"]  # neither semicolons nor line breaks are marks
    assert chunking.sentence_cuts("aaaa." + " " * 25, 10) == ["aaaa." + " " * 5]  # blank pieces go


def test_halving_follows_the_rule():
    assert chunking.halving("  short text, whole  ", 100) == ["short text, whole"]
    assert chunking.halving("aaaa,bbbb。cccc", 10) == ["aaaa,bbbb", "cccc"]  # the mark nearest to the middle; marks go at the cut
    assert chunking.halving("abcdefghij klmnop qrst", 10) == ["abcdefghij", "klmnop qrs", "t"]  # blanks are no marks: cut at the limit
    assert chunking.halving("a," + "b" * 30, 10) == ["a,bbbbbbbb", "b" * 10, "b" * 10, "b" * 2]  # too far from the middle


def test_heading_sections():
    text = "before\n# One\nalpha\n## Two\nbeta\n```\n# not a heading\n```\n# Three\n"
    got = chunking.heading_sections(text, chunking.HEADINGS, 1000)
    assert got == [("", "before"), ("One", "alpha"), ("One Two", "beta\n```\n# not a heading\n```"), ("Three", "")]
    assert chunking.heading_sections("abc" * 40, ["("], 50) == [("", ("abc" * 40)[:50]), ("", ("abc" * 40)[50:100]), ("", ("abc" * 40)[100:])]
    assert len(chunking.heading_sections("# " + "t" * 400 + "\nx", chunking.HEADINGS, 100)[0][0]) == 255


def test_cover_density():
    assert keywords.cover_density([[1, 5, 9, 12]]) == pytest.approx(0.4 / 1.4)  # four hits of one term
    adjacent, apart = keywords.cover_density([[1], [2]]), keywords.cover_density([[1], [9]])
    assert adjacent == pytest.approx(0.1 / 1.1) and apart < adjacent
    total = 0.1 + 0.1 / 8 + 0.1  # covers 1-2, 2-10 with seven words between, 10-11
    assert keywords.cover_density([[1, 10], [2, 11]]) == pytest.approx(total / (total + 1))


def test_page_text_and_selectors():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article class='main x'><h2>Head</h2><p>One &amp; two<script>no()</script></p><ul><li>item</li></ul></article></body></html>"
    assert readers.page_text(page) == "menu\n\n## Head\n\nOne & two\n\n- item"
    assert "menu" not in readers.page_text(page, readers.selector([".main"]))
    assert readers.page_text(page, readers.selector([".other", ".main", "article"])).startswith("## Head")


def test_pages_become_sections(spark):
    html = "<html><body><p>intro</p><h1>One</h1><p>a &lt; b</p><h2>Two</h2><ul><li>x</li></ul><h1>Three</h1></body></html>"
    got = readers.page_sections(spark.createDataFrame([(7, "u", html), (8, "v", None)], "page_id long, url string, html string")).orderBy("position").collect()
    assert [(r["page_id"], r["title"], r["content"]) for r in got] == [(7, "", "intro"), (7, "One", "a < b"), (7, "One Two", "- x"), (7, "Three", "")]


def test_exported_sheets_stay_in_few_folders(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(exports, "written", lambda *a, f=exports.written, **k: (paths.append(f(*a, **k)), paths[-1])[1])
    documents = spark.range(300).selectExpr("id AS document_id", "concat('n', id) AS name")
    paragraphs = documents.selectExpr("document_id", "document_id * 10 AS paragraph_id", "1L AS position", "'text' AS content")
    questions = spark.createDataFrame([(1, "q")], "query_id long, query string")
    assert exports.knowledge_export(documents, paragraphs, questions).select("sheet").distinct().count() == 300
    folders = [r[0] for r in spark.read.json(paths[0]).select("folder").distinct().collect()]
    assert len(folders) <= exports.FOLDERS


def test_question_table_roles():
    assert readers.qa_roles(["c"]) == {"content": "c"} and readers.qa_roles(["t", "c"]) == {"title": "t", "content": "c"}
    assert readers.qa_roles(["问题1", "分段内容x", "分段标题"]) == {"title": "分段标题", "content": "分段内容x", "questions": "问题1"}
    assert readers.qa_roles(["a", "b", "c", "分段内容"]) == {"title": "a", "content": "分段内容", "questions": "c"}


def test_links_of_all_kinds(spark):
    html = """<A class="x" HREF='https://a.org/p/'>1</A><a href="/q#top">2</a><a href="r.html">3</a><a href="mailto:x@y.z">4</a><a href="#f">5</a><a href="https://b.org/">6</a><a href="//a.org/s">7</a>"""
    pages = spark.createDataFrame([("https://a.org/d/i.html?x=1", html), ("https://a.org/e", '<a href="r">1</a>')], "url string, html string")
    got = {(r["src_url"], r["dst_url"]) for r in readers.child_links(pages).collect()}
    assert got == {("https://a.org/d/i.html?x=1", f"https://a.org/{p}") for p in ("p", "q", "d/r.html", "s")} | {("https://a.org/e", "https://a.org/e/r")}
    assert [r["dst_url"] for r in readers.child_links(pages, "https://a.org/d").collect()] == ["https://a.org/d/r.html"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "c")], "src_url string, dst_url string")
    got = {(r["node"], r["depth"]) for r in readers.reachable(edges, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {("b", 1), ("c", 1), ("d", 2)}


def test_every_page_is_a_start(spark, tmp_path):
    links = {0: [1, 9], 1: [2], 2: [3, 1], 3: [], 20: [0]}
    rows = [(i, f"https://a.org/{i}", "".join(f'<a href="/{j}">x</a>' for j in to)) for i, to in links.items()]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(int(str(v).rsplit("/", 1)[-1]) for v in r) for r in catalog.QUERIES["s07_reachable_pages"](spark, str(tmp_path)).select("start", "node", "depth").collect()}
    want = {(i, j, 1) for i, to in links.items() for j in to}
    want |= {(i, k, 2) for i, j, _ in want for k in links.get(j, []) if k != i and (i, k, 1) not in want}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = {tuple(int(str(v).rsplit("/", 1)[-1]) for v in r) for r in con.sql(f"SELECT start, node, depth FROM ({catalog.ORACLE_SQL['s07_reachable_pages']})").fetchall()}
    assert got == sql == want and (1, 3, 2) in got and (2, 1, 1) in got


def evidence_items(value, most=100):
    """(path, paragraph_id, excerpt, relevance) by walking the value: members by name, the items of a list before what is inside them."""
    out, todo = [], [("", value, False)]
    while todo:
        path, at, named = todo.pop()
        if isinstance(at, dict):
            todo += [(f"{path}.{k}" if path else k, v, k == "evidence") for k, v in sorted(at.items(), reverse=True)]
        elif isinstance(at, list):
            for x in at if named else ():
                if isinstance(x, dict) and (excerpt := str(x.get("excerpt") or "").strip()):
                    p, r = x.get("paragraph_id"), x.get("relevance")
                    out.append((path, None if p is None else str(p), excerpt[:1200], float(r) if isinstance(r, (int, float)) else None))
            todo += [(f"{path}[{i}]", v, False) for i, v in reversed(list(enumerate(at)))]
    return out[:most]


def test_evidence_paths(spark):
    values = [
        {"a": [{"evidence": ["x", {"excerpt": " y" * 2000, "paragraph_id": 7, "relevance": 0.5, "evidence": [{"excerpt": "deep"}]}, {"excerpt": " "}]}], "evidence": [{"paragraph_id": 1}], "b": {"evidence": {"excerpt": "no list"}}},
        {"evidence": [{"excerpt": str(i)} for i in range(300)]}, {"evidence": [{"excerpt": "e", "relevance": "0.5", "paragraph_id": "p"}, [{"evidence": [{"excerpt": 12, "relevance": 3}]}]]},
        [[[{"evidence": [{"excerpt": "in lists"}]}]]], {"evidence": [{"z": {"evidence": [{"excerpt": f"{i}a"} for i in range(60)]}, "excerpt": f"top{i}"} for i in range(3)]}, {}, 5, None,
    ]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, "{not json"), (91, None), (92, "")]
    got = {}
    for r in evidence.extracted(spark.createDataFrame(rows, "id long, payload string"), "id", "payload").collect():
        got.setdefault(r["id"], []).append((r["path"], r["paragraph_id"], r["excerpt"], r["relevance"]))
    want = {i: items for i, v in enumerate(values) if (items := evidence_items(v))}
    assert {i: sorted(map(repr, x)) for i, x in got.items()} == {i: sorted(map(repr, x)) for i, x in want.items()}
    assert len(got[1]) == 100 and len(got[4]) == 100


def test_feature_hashing_is_deterministic():
    a, b = models.feature_hashing(pd.Series(["some words here", None]))
    assert np.linalg.norm(a) == pytest.approx(1) and not any(b)
    assert a == models.feature_hashing(pd.Series(["some words here"]))[0]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column.alias("r")).first()["r"]


def test_masking(spark):
    m = T.MASK
    line = "call 13812345678 or a.b@example.org id 11010520000101002X or 110105200001010021"
    assert one(spark, T.masked("c"), line) == f"call {m} or {m} id {m} or {m}"
    assert one(spark, T.masked("c"), "11010519491231002X") == f"110105{m}X"  # what looks like a phone goes first
    for phone in ("138 1234 5678", "138-1234-5678", "+8613812345678", "86 13812345678", "+86-138 1234 5678"):
        assert one(spark, T.masked("c"), f"tel {phone}!") == f"tel {m}!"
    assert one(spark, T.masked("c"), "jos\u00e9.p@mail-x.example.org,") == f"{m},"
    assert one(spark, T.partly_masked("c"), "13812345678 abc@x.org") == "138****5678 ab***@x.org"
    for text in ("1 3 8 1 2 3 4 5 6 7 8", "138 12345 678", "1\u00a038\t12345678", "123456789012345", "6222021234567890123"):
        assert one(spark, T.residual_pii("c"), text)
    for text in ("1234", "2381234567", "12345678901234", "x123456789012345", "12 3456 7890"):
        assert not one(spark, T.residual_pii("c"), text)
    assert [one(spark, T.masked_phone("c"), t) for t in ("123", "1234567", "13812345678", "")] == ["****", "123****4567", "138****5678", ""]
    assert [one(spark, T.masked_email("c"), t) for t in ("a@b.c", "abc@b.c", "none", "abc@d@e")] == ["***@b.c", "ab***@b.c", "none", "ab***@d@e"]


def test_identity_slots_and_plain_text(spark):
    names = lambda t: one(spark, F.array(*T.identity_fields("c")), t)
    assert names("姓名：张三；电话 86-13812345678 邮箱 a_b@c-d.org") == ["张三", "a_b@c-d.org", "86-13812345678"]
    assert names("简历\n李四\n") == ["简历", "", ""] and names("nothing") == ["", "", ""]
    slots = lambda t, cities=("北京", "深圳市"): one(spark, F.to_json(F.array(*[x.cast("string") for x in T.query_slots("c", list(cities))])), t)
    assert slots("北京市 5年以上 本科 Java") == '["5","2","[北京]","Java"]'
    assert slots("2023年毕业 硕士或博士 深圳") == '[null,"4","[深圳市]","2023年毕业 或"]'
    assert one(spark, T.plain_text("c"), "# T\n**a** __b__ *c* _d_ `e` [l](u) ![i](u) <b>x</b>\n\n\ny") == "T a b c d e l x y"
    assert one(spark, T.ocr_lines("c"), "a；；b；c；d；\ne；f；") == "a\nb\nc\nd\ne\nf"
    skills = spark.createDataFrame([(["Java", " java ", "x", "负责开发", "a：b", "c\nd", '"SQL"，', "y" * 31],)], "s array<string>")
    assert skills.select(T.clean_skills("s").alias("r")).first()["r"] == ["Java", "SQL"]
    assert spark.range(1).select(T.traced_items(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.repeat(F.lit("z"), i * 100))).alias("r")).first()["r"] == ["z" * n for n in (100, 200, 200, 200, 200)]


def test_states_and_cells(spark):
    assert one(spark, T.task_state("c", 3), "21") == "n" and one(spark, T.task_state("c", 1), "21") == "1"
    assert one(spark, T.with_task_state("c", 2, "4"), "21") == "nn41"
    assert one(spark, T.guarded_cell("c"), "=1+1") == "'=1+1"
    assert one(spark, T.ocr_lines("c"), "a；b；c；d；e；f") == "a\nb\nc\nd\ne\nf"


def test_gbk_fallback(spark, tmp_path):
    long = "\n".join(f"第{i}行 line" for i in range(3000))
    for name, data in {"u.txt": "中文".encode(), "g.txt": "中文".encode("gbk"), "long-u.txt": long.encode(), "long-g.txt": long.encode("gbk")}.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in readers.text_files(spark, f"{tmp_path}", most=1000).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["piece"], r["text"]))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in got.items()} == {"u.txt": "中文", "g.txt": "中文", "long-u.txt": long, "long-g.txt": long}
    assert len(got["long-g.txt"]) > 1 and len(got["g.txt"]) == 1


def test_rerank_keeps_order_when_the_model_fails(spark):
    hits = spark.createDataFrame([(1, 1, "a b", "a", 0.5), (1, 2, "a b", "a b", 0.4)], "query_id long, paragraph_id long, query string, passage string, rrf double")

    def broken(_):
        raise RuntimeError

    assert [r["paragraph_id"] for r in retrieval.reranked(hits).orderBy("rank").collect()] == [2, 1]
    assert [r["paragraph_id"] for r in retrieval.reranked(hits, broken).orderBy("rank").collect()] == [1, 2]


def test_fused_ranks(spark):
    leg = lambda *ids: spark.createDataFrame([(1, i, 1.0 / (k + 1)) for k, i in enumerate(ids)], "query_id long, paragraph_id long, score double")
    got = {r["paragraph_id"]: r["rrf"] for r in retrieval.fused([leg(1, 2), leg(2, 3)]).collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62 + 1 / 61), 3: pytest.approx(1 / 62)}


def test_stream_equals_batch_on_repeated_runs(spark):
    sf = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, catalog.QUERIES["st01_live_trend"](spark, sf).collect())) for _ in range(2))
    assert a == b and len(a) > 5


def test_keyword_queries_by_hand(spark):
    texts = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue red fish"), (3, "one red two blue"), (4, "green blue"), (5, "red fish green")], "paragraph_id long, content string")
    index = keywords.keyword_index(texts)

    def found(text):
        return {r["paragraph_id"] for r in keywords.keyword_search(index, spark.createDataFrame([(1, text)], "query_id long, query string"), None).collect()}

    assert found("red blue") == {1, 2, 3} and found('"red fish"') == {1, 2, 5} and found('"fish red"') == set()
    assert found("red -blue") == {5} and found('blue -"red fish"') == {3, 4} and found("blue --green") == {1, 2, 3}
    assert found("green OR one two") == {3, 4, 5} and found("-red") == set() and found("") == set() and found("red missing") == set()
    assert found("red-fish") == {1, 2, 5} and found("RED red Fish") == {1, 2, 5}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from rookery.streaming import jobs

    docs = spark.createDataFrame([(1, "one two. three"), (2, "call 1 3 8 1 2 3 4 5 6 7 8 now"), (3, "mail a@b.org")], "doc_id long, text string")
    for _ in range(2):
        jobs.ingest_batch(docs, str(tmp_path), 0)
    jobs.ingest_batch(docs.where("doc_id = 1"), str(tmp_path), 1)
    log = {(r["batch"], r["doc_id"], r["node"]): (r["outcome"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert len(log) == spark.read.parquet(f"{tmp_path}/log").count() == 5 + 4 + 5 + 5
    assert log[0, 2, "gate"] == ("rejected", 1) and (0, 2, "index") not in log and log[0, 3, "mask"] == ("done", 1) and log[0, 1, "index"] == ("done", 3)


def test_texts_without_ink_have_no_sentence_pieces(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " \n\u3000"), (4, " a ")], "document_id long, content string")
    assert [tuple(r) for r in chunking.t24(rows, 100).collect()] == [(4, 1, " a ")]


def test_long_tables_are_packed_across_runs(spark):
    sizes = [(i * 7919) % 37 + (i % 5 == 0) * 13 for i in range(25_000)]
    files = {1: sizes, 2: [500] * 3 + [0] * 30 + [3] * 20, 3: [1] * 10_007}
    lines = {f: [chr(97 + i % 26) * s for i, s in enumerate(l)] for f, l in files.items()}
    rows = spark.createDataFrame(pd.DataFrame([(f, k, x) for f, l in lines.items() for k, x in enumerate(l)], columns=["file", "k", "line"]))
    for limit in (200, 30_000):
        want = {}
        for f, l in lines.items():
            out = []
            for x in l:
                if out and len(out[-1]) + len(x) < limit:
                    out[-1] += x
                else:
                    out.append("HEAD\n" + x)
            want |= {(f, i + 1): c for i, c in enumerate(out)}
        assert {(r["file"], r["n"]): r["content"] for r in readers.markdown_rows(rows, "file", "HEAD\n", limit).collect()} == want
