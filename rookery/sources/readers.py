"""Sources: stored web pages, link graphs, CSV and nested JSON, read as whole corpora."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.windows import global_numbers, numbered
from ..registry import query
from ..session import ship, staged
from .files import csv_read, csv_written, fresh, written

_BLOCKS = {"p", "div", "li", "tr", "article", "section", "ul", "ol", "table", "br", "nav", "footer", "header"}
_SKIP = {"script", "style", "head", "noscript", "template"}


class _Markdown(HTMLParser):
    """Headings become ATX headings, list items bullets, links their text; scripts and styles go."""

    def __init__(self, keep=None):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.keep, self.inside = [], 0, keep, 0 if keep else 1

    def handle_starttag(self, tag, attrs):
        if self.keep and (self.inside or self.keep(tag, dict(attrs))) and tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.inside += 1
        if tag in _SKIP:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")
        if self.keep and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if not self.hidden and self.inside:
            self.out.append(re.sub(r"\s+", " ", data))


def page_text(source: str, keep=None) -> str:
    parser = _Markdown(keep)
    parser.feed(source)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(parser.out))).strip()


def selector(selectors: list[str]):
    """``.class``, ``#id`` or ``tag``; kinds are combined by AND, a later one of the same kind replaces the earlier."""
    kinds = {("class" if s[0] == "." else "id" if s[0] == "#" else "tag"): s.lstrip(".#") for s in selectors}
    return lambda tag, attrs: all((k == "tag" and tag == v) or (k == "id" and attrs.get("id") == v) or (k == "class" and v in (attrs.get("class") or "").split()) for k, v in kinds.items())


def pages_to_text(pages: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """page_id, url, text of every stored page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = selector(selectors) if selectors else None
        for batch in batches:
            yield batch[["page_id", "url"]].assign(text=[page_text(x or "", keep) for x in batch["html"]])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string")


@query("s04_html_to_text", "pages")
def s04(pages: DataFrame) -> DataFrame:
    return page_sections(pages)


def page_sections(pages: DataFrame, limit: int = 100_000) -> DataFrame:
    """page_id, position, title, content: pages as text with headings, split at them (see chunking.split_by_headings)."""
    from ..plans.chunking import HEADINGS, split_by_headings

    texts = pages_to_text(pages).select(F.col("page_id").alias("document_id"), F.col("text").alias("content"))
    return split_by_headings(texts, HEADINGS, limit).withColumnRenamed("document_id", "page_id")


@query("s05_html_selected", "pages")
def s05(pages: DataFrame) -> DataFrame:
    return pages_to_text(pages, ["article"])


_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def child_links(pages: DataFrame, prefix: str | None = None) -> DataFrame:
    """src_url, dst_url: links below ``prefix`` (the page's own site), absolute, without fragment and trailing slash, each once.

    Links may be absolute, from the root of the site, or relative to the page (to its folder where it is an HTML file).
    """
    site = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    bare = F.regexp_replace("url", r"[?#].*$", "")
    folder = F.when(bare.rlike(r"\.html?$"), F.regexp_replace(bare, "/[^/]*$", "")).otherwise(F.regexp_replace(bare, "/$", ""))
    rows = pages.select("url", site.alias("site"), folder.alias("folder"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    rows = rows.where(~F.col("href").rlike("^(?i)(tel:|mailto:|javascript:|#|$)"))
    target = F.when(F.col("href").rlike("^(?i)https?:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("site", "^https?:", 0), "href")).when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.concat("folder", F.lit("/"), "href"))
    target = F.regexp_replace(F.regexp_replace(target, "#.*$", ""), "/$", "")
    under = F.lit(prefix) if prefix else F.col("site")
    links = rows.select(F.col("url").alias("src_url"), target.alias("dst_url"), under.alias("under"))
    return links.where((F.col("dst_url") == F.col("under")) | F.col("dst_url").startswith(F.concat("under", F.lit("/")))).select("src_url", "dst_url").distinct()


_LINKS = r"""SELECT DISTINCT url AS src_url, dst AS dst_url FROM (SELECT url, site, regexp_replace(regexp_replace(CASE WHEN regexp_matches(href, '^(?i)https?:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(site, '^https?:') || href
    WHEN starts_with(href, '/') THEN site || href ELSE CASE WHEN regexp_matches(bare, '\.html?$') THEN regexp_replace(bare, '/[^/]*$', '') ELSE regexp_replace(bare, '/$', '') END || '/' || href END, '#.*$', ''), '/$', '') AS dst FROM (
    SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, regexp_replace(url, '[?#].*$', '') AS bare, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
    WHERE NOT regexp_matches(href, '^(?i)(tel:|mailto:|javascript:|#|$)')) WHERE dst = site OR starts_with(dst, site || '/')"""


@query("s06_child_links", "pages", sql=_LINKS)
def s06(pages: DataFrame) -> DataFrame:
    return child_links(pages)


def reachable(edges: DataFrame, starts: DataFrame, levels: int = 2) -> DataFrame:
    """start, node, depth: nodes within ``levels`` links of each start, at their least depth; nodes met before are not entered again."""
    seen = starts.select(F.col("url").alias("start"), F.col("url").alias("node"), F.lit(0).cast("bigint").alias("depth")).distinct()
    last = seen
    for level in range(1, levels + 1):
        step = last.select("start", F.col("node").alias("src_url")).join(edges, "src_url").select("start", F.col("dst_url").alias("node")).distinct()
        last = step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level).cast("bigint"))
        seen = seen.unionByName(last)
    return seen.where("depth > 0")


@query("s07_reachable_pages", "pages", sql=f"""WITH RECURSIVE e AS ({_LINKS}), r AS (SELECT DISTINCT url AS start, url AS node, 0 AS depth FROM pages UNION SELECT start, dst_url, depth + 1 FROM r JOIN e ON src_url = node WHERE depth < 2)
    SELECT start, node, min(depth)::BIGINT AS depth FROM r WHERE node <> start GROUP BY 1, 2""")
def s07(pages: DataFrame) -> DataFrame:
    """From every page two links deep, along the links of stored pages."""
    return reachable(child_links(pages), pages)


#: Rows of a table file that are packed in one row.
RUN = 10_000


def _exits(limit: int, head: int):
    """For each place of a run where its first paragraph may begin: length of the paragraph open at its end and number of paragraphs begun. ``sizes``: lengths of the run's lines."""

    def run(sizes: pd.Series) -> pd.DataFrame:
        opens, begun = [], []
        for lengths in sizes:
            upto = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
            n = len(lengths)
            # a paragraph that begins with line i ends before the first later line that brings it to the limit
            after = np.maximum(np.searchsorted(upto, upto[:-1] + limit - head, side="left") - 1, np.arange(n) + 1)
            size, count = [0] * n, [1] * n
            for i in range(n - 1, -1, -1):
                j = int(after[i])
                size[i], count[i] = (size[j], count[j] + 1) if j < n else (int(head + upto[n] - upto[i]), 1)
            most = int(after[0]) + 1
            opens.append(size[:most])
            begun.append(count[:most])
        return pd.DataFrame({"open": opens, "begun": begun})

    return F.pandas_udf(run, "open array<bigint>, begun array<bigint>")


def markdown_rows(lines: DataFrame, file: str, head: str, limit: int) -> DataFrame:
    """file, n, content: Markdown rows of each file packed in order while the text stays shorter than ``limit``; each paragraph begins with the head.

    ``lines``: file, k (order) and line. A file is dealt into runs of rows by the places of all rows in their order. What a run does depends on the paragraph that
    is open where it begins, of which only the length matters: a run's first new paragraph begins at one of few lines, and the end of the run is found for each
    of them. A fold over the runs of a file (lengths only) picks the right ones, then each run is packed in one row, and the parts of a paragraph are joined.
    """
    ship(lines.sparkSession)
    placed = global_numbers(lines, [file, "k"], "place")
    first = placed.groupBy(file).agg(F.min("place").alias("first"))
    dealt = placed.join(first, file).withColumn("run", F.floor((F.col("place") - F.col("first")) / RUN))
    nested = staged(dealt.groupBy(file, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("l")), "markdown-runs")
    sizes = F.transform("l", lambda x: F.char_length(x).cast("bigint"))
    ends = nested.select(file, "run", sizes.alias("sizes")).withColumn("e", _exits(limit, len(head))("sizes"))
    ends = ends.select(file, "run", F.slice("sizes", F.lit(1), F.size("e.open")).alias("sizes"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), "e.open", "e.begun")
    kind = nested.schema[file].dataType.simpleString()

    def entries(runs: pd.DataFrame) -> pd.DataFrame:
        """Length of the open paragraph and its number where each run begins."""
        out, size, n = [], 0, 0
        for r in runs.sort_values("run").itertuples(index=False):
            out.append((r.run, size, n))
            reached = size + np.cumsum(r.sizes)
            at = int(np.searchsorted(reached, limit)) if n else 0
            if at < len(r.sizes):
                size, n = int(r.open[at]), n + int(r.begun[at])
            else:
                size += int(r.total)
        found = pd.DataFrame(out, columns=["run", "size", "n"])
        found.insert(0, file, runs[file].iloc[0])
        return found

    known = ends.groupBy(F.col(file)).applyInPandas(entries, f"`{file}` {kind}, run bigint, size bigint, n bigint")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.col("size").alias("size"), F.col("n").alias("n"))

    def add(s, x):
        size = s["size"] + F.char_length(x)
        fits = (s["n"] > 0) & (size < limit)
        return F.when(fits, F.struct(s["done"].alias("done"), F.concat(s["open"], x).alias("open"), size.alias("size"), s["n"].alias("n"))).otherwise(
            F.struct(F.array_append(s["done"], s["open"]).alias("done"), F.concat(F.lit(head), x).alias("open"), (F.char_length(x) + len(head)).cast("bigint").alias("size"), (s["n"] + 1).alias("n")))

    packed = F.aggregate("l", start, add, lambda s: F.array_append(s["done"], s["open"]))
    parts = nested.join(known, [file, "run"]).select(file, "run", "n", F.posexplode(packed).alias("i", "part")).where("part <> ''")
    parts = parts.select(file, (F.col("n") + F.col("i")).cast("bigint").alias("n"), F.struct("run", "part").alias("p"))
    joined = parts.groupBy(file, "n").agg(F.array_sort(F.collect_list("p")).alias("l"))
    return joined.select(file, "n", F.array_join(F.transform("l", lambda x: x["part"]), "").alias("content"))


def markdown_cell(c: str):
    return F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("&#124;"))


@query("s09_csv_to_markdown", "customer", sql=r"""WITH RECURSIVE c AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, '| ' || c_custkey || ' | ' || replace(c_name, '#', '&#124;') || ' | ' || c_mktsegment || '<br>' || c_custkey || ' |' || chr(10) AS line FROM customer),
    h AS (SELECT '| c_custkey | c_name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) AS head), f AS (SELECT file, i, 1 AS n, head || line AS open FROM c, h WHERE i = 1
    UNION ALL SELECT f.file, c.i, CASE WHEN length(open) + length(line) < 1000 THEN n ELSE n + 1 END, CASE WHEN length(open) + length(line) < 1000 THEN open || line ELSE head || line END FROM f JOIN c ON c.file = f.file AND c.i = f.i + 1, h)
    SELECT CAST(file AS INT) AS file, n::BIGINT AS n, arg_max(open, i) AS content FROM f GROUP BY 1, 2""")
def csv_to_markdown(customers: DataFrame) -> DataFrame:
    """One CSV file per nation is written, read back and packed into Markdown tables; cells hold bars and line breaks."""
    columns = ["c_custkey", "c_name", "note"]
    note = F.concat("c_mktsegment", F.lit("\n"), F.col("c_custkey").cast("string"))
    path = csv_written(customers.select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("|")).alias("c_name"), note.alias("note"), F.col("c_nationkey").alias("file")), "customers", ["file"])
    rows = csv_read(customers.sparkSession, path, [*columns, "file"])
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |\n"
    lines = rows.select(F.col("file").cast("int").alias("file"), F.col("c_custkey").cast("bigint").alias("k"), bar([markdown_cell(c) for c in columns]).alias("line"))
    return markdown_rows(lines, "file", head, 1000)


@query("s10_csv_key_values", "nation", sql="SELECT 'n_nationkey:' || n_nationkey || '; n_name:' || n_name || ', the \"' || n_regionkey || '\"; n_regionkey:' || n_regionkey AS line FROM nation")
def key_values(nations: DataFrame) -> DataFrame:
    """A CSV file with quoted commas and quotes, written and read back; one text per row."""
    name = F.concat("n_name", F.lit(', the "'), F.col("n_regionkey").cast("string"), F.lit('"'))
    path = csv_written(nations.select("n_nationkey", name.alias("n_name"), "n_regionkey"), "nations")
    rows = csv_read(nations.sparkSession, path, nations.columns)
    return rows.select(F.concat_ws("; ", *[F.concat(F.lit(f"{c}:"), F.col(c)) for c in rows.columns]).alias("line"))


# How the headers of a question table begin.
QA_PREFIXES = {"title": "分段标题", "content": "分段内容", "questions": "问题"}


def qa_roles(header: list[str]) -> dict[str, str]:
    """Column of each role of a question table: by position (content; title, content; title, content, questions), then by the prefix of a header, which wins."""
    names = {1: ["content"], 2: ["title", "content"]}.get(len(header), ["title", "content", "questions"])
    roles = dict(zip(names, header, strict=False))
    for h in header:
        for role, prefix in QA_PREFIXES.items():
            if h and h.startswith(prefix):
                roles[role] = h
                break
    return roles


def question_rows(table: DataFrame, keys: list[str], header: list[str]) -> DataFrame:
    """keys, title (255 characters), content (102,400) and questions (non-blank lines, 255 each); rows without content are left out."""
    roles = qa_roles(header)
    text = lambda role: F.coalesce(F.col(f"`{roles[role]}`"), F.lit("")) if role in roles else F.lit("")
    questions = F.transform(F.filter(F.split(text("questions"), "\n"), lambda q: F.trim(q) != ""), lambda q: F.left(q, F.lit(255)))
    return table.where(F.col(f"`{roles['content']}`").isNotNull()).select(*keys, F.left(text("title"), F.lit(255)).alias("title"), F.left(text("content"), F.lit(102_400)).alias("content"), questions.alias("questions"))


@query("s11_question_table", "v_turn", sql="""SELECT conv_id, turn, substring(answer, 1, 255) AS title, substring(question, 1, 102400) AS content, array_to_string(list_transform(list_filter(string_split(question || chr(10) || ' ' || chr(10) || '"q" ' || answer, chr(10)), lambda q: trim(q) <> ''), lambda q: substring(q, 1, 255)), chr(10)) AS questions FROM v_turn""")
def question_table(turns: DataFrame) -> DataFrame:
    """A CSV file whose headers stand in another order than usual, with line breaks and quotes in its cells, written and read back."""
    header = ["问题（一行一个）", "分段内容（必填）", "分段标题"]
    asked = F.concat("question", F.lit('\n \n"q" '), "answer")
    path = csv_written(turns.select("conv_id", "turn", asked.alias(header[0]), F.col("question").alias(header[1]), F.col("answer").alias(header[2])), "questions")
    rows = csv_read(turns.sparkSession, path, ["conv_id", "turn", *header])
    found = question_rows(rows, ["conv_id", "turn"], header)
    return found.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "title", "content", F.array_join("questions", "\n").alias("questions"))


def markdown_tables(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, sheet, row_no (from 1), cells of the pipe tables below ``## `` headings; a text without headings is one sheet named default."""
    marked = F.when(F.col(column).rlike(r"(?m)^\s*## "), F.col(column)).otherwise(F.concat(F.lit("## default\n"), F.col(column)))
    sheets = texts.select(key, F.posexplode(F.slice(F.split(marked, r"(?m)^\s*## "), 2, 1 << 30)).alias("s", "sheet"))
    lines = sheets.select(key, "s", F.trim(F.substring_index("sheet", "\n", 1)).alias("name"), F.posexplode(F.transform(F.split("sheet", "\n"), F.trim)).alias("i", "line")).where("i > 0 AND startswith(line, '|')")
    rows = lines.where(~F.col("line").rlike(r"^\|[\s\-:|]+\|$")).withColumn("row_no", numbered(key, "s", order=["i"]) - 1).where("row_no > 0")  # the first is the header
    cells = F.transform(F.filter(F.split("line", r"\|"), lambda x, i: i > 0), lambda c: F.replace(F.replace(F.trim(c), F.lit("&#124;"), F.lit("|")), F.lit("|<br>|"), F.lit("|\n|")))
    return rows.select(key, F.col("name").alias("sheet"), "row_no", F.slice(cells, F.lit(1), F.size(cells) - 1).alias("cells"))


_CELL = "trim(replace(replace({c}, '|', '/'), chr(10), ' '))"


@query("s12_markdown_question_tables", "v_turn", sql=f"SELECT conv_id, 'faq' AS sheet, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_no, {_CELL.format(c='question')} || '|' AS title, {_CELL.format(c='answer')} || '|' || chr(10) || '|' AS content FROM v_turn")
def markdown_question_tables(turns: DataFrame) -> DataFrame:
    """Pipe tables under ``## `` headings, the text of a conversation a JSON line, read and parsed back to rows; as many files as there are tasks, not conversations."""
    bare = lambda c: F.trim(F.replace(F.replace(F.col(c), F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" ")))
    line = F.concat(F.lit("| "), bare("question"), F.lit("&#124; | "), bare("answer"), F.lit("&#124;<br>&#124; |"))
    texts = turns.groupBy("conv_id").agg(F.concat(F.lit("intro\n## faq\n| title | content |\n| --- | --- |\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")).alias("md"))
    read = turns.sparkSession.read.schema("conv_id bigint, md string").json(written(texts.select("conv_id", "md"), "json", "tables"))
    rows = markdown_tables(read, "conv_id", "md")
    return rows.select("conv_id", "sheet", "row_no", F.get("cells", F.lit(0)).alias("title"), F.get("cells", F.lit(1)).alias("content"))


RESUME = """candidate_id bigint, name string, birth string, origin string, education array<struct<graduated: string, school: string, degree: string>>,
    work array<struct<period: string, employer: string, title: string, content: string>>, projects array<struct<period: string, name: string, duty: string>>"""
# Degrees as they are written and their levels, what a period looks like, and the labels of the text.
DEGREES = {"博士": "博士", "博士学位": "博士", "硕士": "硕士", "硕士学位": "硕士", "学士": "本科", "学士学位": "本科", "大专": "大专"}
PERIOD = r"(\d{4})[./年-]+\d{1,2}[./年-]+(\d{4})"
LABELS = {
    "education": ("教育经历", [("毕业时间", "graduated"), ("毕业院校", "school"), ("学位", "degree")]),
    "work": ("工作经历", [("工作时间", "period"), ("工作单位", "employer"), ("职务", "title"), ("工作内容", "content")]),
    "projects": ("项目经历", [("项目时间", "period"), ("项目名称", "name"), ("项目责任", "duty")]),
}


def resumes(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Nested records of candidates, written as JSON lines and read back: applications are work entries, every other one with a period of years; hired ones are projects too."""
    year = F.year("create_time")
    period = F.when(F.col("application_id") % 2 == 0, F.concat(year.cast("string"), F.lit(".03-"), (year + F.col("application_id") % 9).cast("string"), F.lit(".05"))).otherwise(F.concat(year.cast("string"), F.lit(".03-now")))
    entry = F.struct("application_id", period.alias("period"), F.concat(F.lit("employer "), "job_id").alias("employer"), F.col("status").alias("title"), F.concat(F.repeat(F.concat(F.lit("did "), F.col("channel"), F.lit("。")), (F.col("application_id") % 60).cast("int")), F.lit("end")).alias("content"))
    work = applications.groupBy("candidate_id").agg(F.array_sort(F.collect_list(entry)).alias("w"))
    c = F.col("candidate_id")
    school = lambda degree: F.struct(F.lit("2010.06").alias("graduated"), F.col("segment").alias("school"), degree.alias("degree"))
    degree = F.when(c % 4 == 0, "硕士学位").when(c % 4 == 1, "学士").when(c % 4 == 2, "大专").otherwise("other")
    none = F.array().cast("array<struct<application_id:bigint,period:string,employer:string,title:string,content:string>>")
    rows = candidates.join(work, "candidate_id", "left").select("candidate_id", "name", F.when(c % 3 == 0, "1990.01").alias("birth"), F.when(c % 5 == 0, "here").alias("origin"), F.array(school(F.lit("none")), school(degree)).alias("education"), F.coalesce("w", none).alias("w"))
    keep = lambda *fields: lambda x: F.struct(*[x[a].alias(b) for a, b in fields])
    rows = rows.withColumn("work", F.transform("w", keep(("period", "period"), ("employer", "employer"), ("title", "title"), ("content", "content"))))
    rows = rows.withColumn("projects", F.transform(F.filter("w", lambda x: x["title"] == "HIRED"), keep(("period", "period"), ("employer", "name"), ("title", "duty")))).drop("w")
    return candidates.sparkSession.read.schema(RESUME).json(written(rows, "json", "resumes"))


def highest_degree():
    """Level of the first degree that is known; null without one."""
    levels = F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv])
    return F.get(F.filter(F.transform("education", lambda e: F.try_element_at(levels, e["degree"])), lambda d: d.isNotNull()), F.lit(0))


def entry_lines(x, fields: list[tuple[str, str]]):
    return F.array_join(F.array(*[F.concat(F.lit(f"{label}："), F.coalesce(x[name], F.lit(""))) for label, name in fields]), "\n")


_W = """a AS (SELECT application_id, candidate_id, year(create_time) || '.03-' || CASE WHEN application_id % 2 = 0 THEN (year(create_time) + application_id % 9) || '.05' ELSE 'now' END AS period, 'employer ' || job_id AS employer, status, repeat('did ' || channel || '。', CAST(application_id % 60 AS INT)) || 'end' AS content FROM v_application),
    c AS (SELECT candidate_id, name, segment, CASE WHEN candidate_id % 3 = 0 THEN '1990.01' END AS birth, CASE WHEN candidate_id % 5 = 0 THEN 'here' END AS origin, CASE candidate_id % 4 WHEN 0 THEN '硕士学位' WHEN 1 THEN '学士' WHEN 2 THEN '大专' ELSE 'other' END AS degree,
    CASE candidate_id % 4 WHEN 0 THEN '硕士' WHEN 1 THEN '本科' WHEN 2 THEN '大专' END AS level FROM v_candidate)"""
_WORK = "'工作时间：' || period || chr(10) || '工作单位：' || employer || chr(10) || '职务：' || status || chr(10) || '工作内容：' || content"
_PROJECT = "'项目时间：' || period || chr(10) || '项目名称：' || employer || chr(10) || '项目责任：' || status"
_SCHOOL = "'毕业时间：2010.06' || chr(10) || '毕业院校：' || segment || chr(10) || '学位：'"


@query("s13_resume_text", "v_candidate", "v_application", sql=f"""WITH {_W}, w AS (SELECT candidate_id, string_agg(chr(10) || chr(10) || '【工作经历】' || chr(10) || {_WORK}, '' ORDER BY application_id) AS t, string_agg(chr(10) || chr(10) || '【项目经历】' || chr(10) || {_PROJECT}, '' ORDER BY application_id) FILTER (WHERE status = 'HIRED') AS p FROM a GROUP BY 1)
    SELECT candidate_id, '【基本信息】' || chr(10) || '姓名：' || name || coalesce(chr(10) || '出生年月：' || birth, '') || coalesce(chr(10) || '最高学历：' || level, '') || coalesce(chr(10) || '籍贯：' || origin, '')
    || chr(10) || chr(10) || '【教育经历】' || chr(10) || {_SCHOOL} || 'none' || chr(10) || chr(10) || '【教育经历】' || chr(10) || {_SCHOOL} || degree || coalesce(t, '') || coalesce(p, '') AS text FROM c LEFT JOIN w USING (candidate_id)""")
def resume_text(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Sectioned text of nested resumes."""
    rows = resumes(candidates, applications)
    head = F.array_compact(F.array(F.lit("【基本信息】"), F.concat(F.lit("姓名："), F.coalesce("name", F.lit("未知"))), F.concat(F.lit("出生年月："), "birth"), F.concat(F.lit("最高学历："), highest_degree()), F.concat(F.lit("籍贯："), "origin")))
    parts = [F.transform(name, _section(title, fields)) for name, (title, fields) in LABELS.items()]
    return rows.select("candidate_id", F.array_join(F.concat(head, *parts), "\n").alias("text"))


def _section(title: str, fields: list[tuple[str, str]]):
    return lambda x: F.concat(F.lit(f"\n【{title}】\n"), entry_lines(x, fields))


def _titled(title: str, fields: list[tuple[str, str]], named: str):
    return lambda x: F.struct(F.concat(F.lit(f"{title}-"), F.left(F.coalesce(x[named], F.lit("")), F.lit(10))).alias("title"), entry_lines(x, fields).alias("content"))


def sentence_packed(c, limit: int):
    """A text of up to ``limit`` characters whole; a longer one by sentences, packed while it stays within the limit, trimmed."""
    sentences = F.filter(F.split(c, r"(?<=[。；！？\n])"), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    over = lambda s, x: (F.char_length(s["open"]) + F.char_length(x) > limit) & (s["open"] != "")
    add = lambda s, x: F.when(over(s, x), F.struct(F.array_append(s["done"], s["open"]).alias("done"), x.alias("open"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], x).alias("open")))
    packed = F.aggregate(sentences, start, add, lambda s: F.when(F.trim(s["open"]) != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(F.char_length(c) <= limit, F.array(c)).otherwise(F.transform(packed, lambda x: T.trimmed(x)))


@query("s14_resume_sections", "v_candidate", "v_application", sql=f"""WITH RECURSIVE {_W}, e AS (SELECT candidate_id, '0' AS k, '基本信息' AS title, '姓名：' || name || coalesce(chr(10) || '最高学历：' || level, '') || coalesce(chr(10) || '出生年月：' || birth, '') AS content FROM c
    UNION ALL SELECT candidate_id, '1', '教育经历-' || substring(segment, 1, 10), {_SCHOOL} || 'none' FROM c UNION ALL SELECT candidate_id, '2', '教育经历-' || substring(segment, 1, 10), {_SCHOOL} || degree FROM c
    UNION ALL SELECT candidate_id, '3' || lpad(CAST(application_id AS STRING), 12, '0'), '工作经历-' || substring(employer, 1, 10), {_WORK} FROM a JOIN c USING (candidate_id) UNION ALL SELECT candidate_id, '4' || lpad(CAST(application_id AS STRING), 12, '0'), '项目经历-' || substring(employer, 1, 10), {_PROJECT} FROM a JOIN c USING (candidate_id) WHERE status = 'HIRED'),
    s AS (SELECT candidate_id, k, title, list_filter(regexp_extract_all(content, '[^。；！？\\n]*[。；！？\\n]|[^。；！？\\n]+$'), lambda x: trim(x, ' ' || chr(10)) <> '') AS l FROM e WHERE length(content) > 500),
    f AS (SELECT candidate_id, k, title, l, 1 AS i, 1 AS g, l[1] AS open FROM s UNION ALL SELECT candidate_id, k, title, l, i + 1, CASE WHEN length(open) + length(l[i + 1]) > 500 THEN g + 1 ELSE g END, CASE WHEN length(open) + length(l[i + 1]) > 500 THEN l[i + 1] ELSE open || l[i + 1] END FROM f WHERE i < len(l)),
    u AS (SELECT candidate_id, k, 1 AS g, title, content FROM e WHERE length(content) <= 500 UNION ALL SELECT candidate_id, k, g, any_value(title), trim(arg_max(open, i), ' ' || chr(10)) FROM f GROUP BY 1, 2, 3)
    SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY k, g) AS position, title, content FROM u""")
def resume_sections(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """One section for the person, and for each education, work and project entry; long ones are packed again by sentence."""
    rows = resumes(candidates, applications)
    basic = F.array_join(F.array_compact(F.array(F.concat(F.lit("姓名："), "name"), F.concat(F.lit("最高学历："), highest_degree()), F.concat(F.lit("出生年月："), "birth"))), "\n")
    named = {"education": "school", "work": "employer", "projects": "name"}
    parts = [F.transform(name, _titled(title, fields, named[name])) for name, (title, fields) in LABELS.items()]
    sections = F.concat(F.array(F.struct(F.lit("基本信息").alias("title"), basic.alias("content"))), *parts)
    cut = rows.select("candidate_id", F.posexplode(sections).alias("i", "s")).select("candidate_id", "i", "s.title", F.posexplode(sentence_packed(F.col("s.content"), 500)).alias("g", "content"))
    return cut.select("candidate_id", numbered("candidate_id", order=["i", "g"]).alias("position"), "title", "content")


@query("f15_years_and_degree", "v_candidate", "v_application", sql=f"""WITH {_W} SELECT candidate_id, max(greatest(1, application_id % 9)) FILTER (WHERE application_id % 2 = 0 AND year(create_time) + application_id % 9 <= 2030) AS years, any_value(level) AS degree FROM c LEFT JOIN (SELECT a.*, create_time FROM a JOIN v_application USING (application_id)) USING (candidate_id) GROUP BY 1""")
def years_and_degree(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Longest single span of years in the work history, one at least, within 1970 to 2030; level of the first known degree."""
    rows = resumes(candidates, applications)
    year = lambda e, i: F.nullif(F.regexp_extract(e["period"], PERIOD, i), F.lit("")).cast("bigint")
    spans = F.transform("work", lambda e: F.when((year(e, 1) >= 1970) & (year(e, 1) <= year(e, 2)) & (year(e, 2) <= 2030), F.greatest(F.lit(1).cast("bigint"), year(e, 2) - year(e, 1))))
    return rows.select("candidate_id", F.array_max(spans).alias("years"), highest_degree().alias("degree"))


MOST_IMPORT_ROWS, LONGEST_NAME, LONGEST_PHONE = 200, 128, 20


def candidate_import(rows: DataFrame, stored: DataFrame, most: int = MOST_IMPORT_ROWS) -> DataFrame:
    """file, row_no, name, status and reason of every row of candidate files (file, row_no, name, phone, email).

    A row without a name, or with one or a phone that is too long, fails. A row whose phone or email (whatever its case) a stored candidate or
    an earlier valid row of the file has is a duplicate, and created all the same. Every row of a file of more than ``most`` rows is rejected.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = rows.select("file", "row_no", clean("name").alias("name"), clean("phone").alias("phone"), F.lower(clean("email")).alias("email"))
    sizes = rows.groupBy("file").agg(F.count("*").alias("size"))
    reason = F.when(F.col("size") > most, "too many rows").when(F.col("name") == "", "name is required").when(F.char_length("name") > LONGEST_NAME, "name is too long").when(F.char_length("phone") > LONGEST_PHONE, "phone is too long")
    rows = rows.join(sizes, "file").withColumn("reason", reason)
    valid = rows.where("reason IS NULL")

    def hits(field: str) -> DataFrame:
        known = stored.select(F.lower(field).alias(field)).where(f"{field} <> ''").distinct().withColumn("known", F.lit(True))
        first = valid.where(f"{field} <> ''").groupBy("file", field).agg(F.min("row_no").alias(f"first_{field}"))
        return first.join(known, field, "left").select("file", field, f"first_{field}", F.coalesce("known", F.lit(False)).alias(f"known_{field}"))

    found = rows.join(hits("phone"), ["file", "phone"], "left").join(hits("email"), ["file", "email"], "left")
    hit = lambda field: F.coalesce(F.col(f"known_{field}") | (F.col("row_no") > F.col(f"first_{field}")), F.lit(False))
    status = F.when(F.col("reason").isNotNull(), "failed").when(hit("phone") | hit("email"), "duplicate").otherwise("created")
    return found.select("file", "row_no", "name", status.alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))


_FILE = "CASE WHEN library_id % 5 = 0 THEN library_id ELSE library_id * 1000 + CAST(floor(candidate_id / 500) AS INT) END"
_IMPORT = f"""r AS (SELECT {_FILE} AS file, row_number() OVER (PARTITION BY {_FILE} ORDER BY candidate_id) + 1 AS row_no, CASE WHEN candidate_id % 29 = 0 THEN ' ' WHEN candidate_id % 31 = 0 THEN repeat('n', 130) ELSE name END AS name, CASE WHEN candidate_id % 37 = 0 THEN repeat('1', 21) ELSE phone END AS phone, email FROM v_candidate WHERE candidate_id % 7 <> 0)"""
_IMPORTED = f"""{_IMPORT}, k AS (SELECT phone, lower(email) AS email FROM v_candidate WHERE candidate_id % 7 = 0), z AS (SELECT *, count(*) OVER (PARTITION BY file) AS size FROM r),
    v AS (SELECT file, row_no, trim(name) AS name, phone, lower(email) AS email, CASE WHEN size > 200 THEN 'too many rows' WHEN trim(name) = '' THEN 'name is required' WHEN length(name) > 128 THEN 'name is too long' WHEN length(phone) > 20 THEN 'phone is too long' ELSE '' END AS reason FROM z),
    i AS (SELECT file, row_no, name, CASE WHEN reason <> '' THEN 'failed' WHEN EXISTS (SELECT 1 FROM k WHERE k.phone = v.phone) OR EXISTS (SELECT 1 FROM k WHERE k.email = v.email)
    OR EXISTS (SELECT 1 FROM v o WHERE o.file = v.file AND o.reason = '' AND o.row_no < v.row_no AND o.phone = v.phone) OR EXISTS (SELECT 1 FROM v o WHERE o.file = v.file AND o.reason = '' AND o.row_no < v.row_no AND o.email = v.email) THEN 'duplicate' ELSE 'created' END AS status, reason FROM v)"""


def _imported(candidates: DataFrame) -> DataFrame:
    """Candidate files, some of a whole library and some of a part, with a column that is not known, written and read back; every seventh candidate is stored already."""
    c = F.col("candidate_id")
    name = F.when(c % 29 == 0, " ").when(c % 31 == 0, F.repeat(F.lit("n"), 130)).otherwise(F.col("name"))
    sent = candidates.where(c % 7 != 0).select(F.expr(_FILE).alias("file"), (F.row_number().over(W.partitionBy(F.expr(_FILE)).orderBy("candidate_id")) + 1).alias("row_no"), name.alias("name"), F.when(c % 37 == 0, F.repeat(F.lit("1"), 21)).otherwise(F.col("phone")).alias("phone"), "email", F.lit("x,y").alias("city"))
    path = csv_written(sent, "candidates")
    rows = csv_read(candidates.sparkSession, path, ["file", "row_no", "name", "phone", "email", "city"])
    rows = rows.select(F.col("file").cast("int").alias("file"), F.col("row_no").cast("bigint").alias("row_no"), "name", "phone", "email")
    return candidate_import(rows, candidates.where(c % 7 == 0))


@query("s15_candidate_import", "v_candidate", sql=f"WITH {_IMPORTED} SELECT * FROM i")
def s15(candidates: DataFrame) -> DataFrame:
    return _imported(candidates)


@query("s15b_candidate_import_totals", "v_candidate", sql=f"WITH {_IMPORTED} SELECT file, count(*) AS total, count(*) FILTER (WHERE status = 'created') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'duplicate') AS duplicates FROM i GROUP BY 1")
def import_totals(candidates: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return _imported(candidates).groupBy("file").agg(F.count("*").alias("total"), count("created").alias("success"), count("failed").alias("failed"), count("duplicate").alias("duplicates"))


def decoded_text(files: DataFrame) -> DataFrame:
    """path, text of a ``binaryFile`` frame: UTF-8, else GBK (which Spark cannot decode itself)."""
    ship(files.sparkSession)
    gbk = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("gbk", "replace")), "string")
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(gbk("content")).alias("text"))


#: Files of more bytes than this are read in pieces of lines.
MOST_BYTES = 1 << 26


def text_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, piece, text of the files below ``path``: whole up to ``most`` bytes, longer ones line by line.

    The lines of a long file are split among tasks; its piece is the place of the line. A file is UTF-8 if all of it is, else GBK, in which no line break is
    part of a character either. Spark's file sources leave out empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = decoded_text(files.where(F.col("length") <= most).select("path", "content")).select("path", F.lit(0).cast("bigint").alias("piece"), "text")
    large = files.where(F.col("length") > most).select("path")
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + 0).alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("content"))
    lines = staged(lines.join(F.broadcast(large) if large.limit(10_001).count() <= 10_000 else large, "path", "left_semi").select("*", F.is_valid_utf8("content").alias("fine")), "text-lines")
    kinds = lines.groupBy("path").agg(F.bool_and("fine").alias("utf8"), F.max(F.struct("block", "at")).alias("last"))
    ship(spark)
    gbk = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("gbk", "replace")), "string")
    each = lines.join(kinds, "path")
    text = F.when(F.col("utf8"), F.col("content")).otherwise(gbk(F.col("content").cast("binary")))
    ended = F.when(F.struct("block", "at") == F.col("last"), text).otherwise(F.concat(text, F.lit("\n")))
    numbered_ = each.select("path", "block", "at", ended.alias("text"))
    first = numbered_.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = first.select("path", "block", "first", (F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    pieces = numbered_.join(before, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("piece"), "text")
    return small.unionByName(pieces)


@query("s08_text_with_fallback", "v_query_text", sql="SELECT CAST(query_id AS STRING) AS name, CASE WHEN query_id % 3 = 0 THEN '中文 ' || regexp_replace(query, '[^\\x00-\\x7F]', '', 'g') ELSE query END AS text FROM v_query_text")
def s08(texts: DataFrame) -> DataFrame:
    """Texts written as files, every third in GBK, and read back; a text that ends in a line break loses it, as the writer ends every file with one."""
    spark = texts.sparkSession
    ship(spark)
    to_gbk = F.pandas_udf(lambda s: s.map(lambda t: ("中文 " + t).encode("gbk")), "binary")
    raw = F.when(F.col("query_id") % 3 == 0, to_gbk(F.regexp_replace("query", r"[^\x00-\x7F]", ""))).otherwise(F.encode("query", "UTF-8"))
    path = fresh(spark, "texts")
    texts.select(F.col("query_id").alias("name"), raw.cast("string").alias("value")).repartition("name").write.partitionBy("name").text(path)  # bytes go out as they are
    read = text_files(spark, path)
    return read.select(F.regexp_extract("path", "/name=([^/]*)/", 1).alias("name"), F.regexp_replace("text", "\n$", "").alias("text"))
