"""Chunking and index jobs over a whole corpus: DataFrame in, DataFrame out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.queries import MASKED_SQL, residual_sql
from ..operators.windows import numbered
from ..registry import query
from ..session import ship
from .tokens import postings, tokens

# The marks at which a chunk may end, and the heading levels of Markdown.
MARKS = "!?.;\n。！？；"
#: Pattern names that a user may choose from, and their patterns.
PATTERNS = {
    "#": r"(?<=^)# .*|(?<=\n)# .*", "##": r"(?<=\n)(?<!#)## (?!#).*|(?<=^)(?<!#)## (?!#).*", "###": r"(?<=\n)(?<!#)### (?!#).*|(?<=^)(?<!#)### (?!#).*",
    "####": r"(?<=\n)(?<!#)#### (?!#).*|(?<=^)(?<!#)#### (?!#).*", "#####": r"(?<=\n)(?<!#)##### (?!#).*|(?<=^)(?<!#)##### (?!#).*", "######": r"(?<=\n)(?<!#)###### (?!#).*|(?<=^)(?<!#)###### (?!#).*",
    "-": r"(?<! )- .*", "space": r"(?<! ) (?! )", "semicolon": r"(?<!；)；(?!；)", "comma": r"(?<!，)，(?!，)", "period": r"(?<!。)。(?!。)", "enter": r"(?<!\n)\n(?!\n)", "blank line": r"(?<!\n)\n\n(?!\n)",
}
SECTION, ITEM, FIRST_TITLE = r"^【([^】]+)】\s*$", r"^[-•·]\s", "基本信息"
SENTENCE_MARKS, PIECE_MARKS = "。.！!？?", "。；;！？!?\n，,"
HEADINGS = [r"(?m)^# .*$", r"(?m)^## .*$", r"(?m)^### .*$", r"(?m)^#### .*$", r"(?m)^##### .*$", r"(?m)^###### .*$"]


def boundary_chunks(c: str | Column, size: int = 256) -> Column:
    """Chunks of at most ``size`` characters and the mark behind them, then what is left over, cut hard. Blank ones go.

    The text is cut once, behind every mark. Stretches are packed greedily; one that is too long gives its beginning to the left-overs,
    and so does a lone mark with nothing before or behind it that fits.
    """
    c = F.col(c) if isinstance(c, str) else c
    cuts = F.split(c, f"(?<=[{re.escape(MARKS)}])")
    none, most = F.array().cast("array<string>"), size + 1
    start = F.struct(none.alias("done"), F.lit("").alias("open"), none.alias("left"), F.lit("").alias("gap"))
    tail = F.element_at(cuts, -1)

    def with_some(texts: Column, text: Column) -> Column:
        return F.when(text != "", F.concat(texts, F.array(text))).otherwise(texts)

    def add(s: Column, x: Column) -> Column:
        done, now, left, gap = s["done"], s["open"], s["left"], s["gap"]
        whole, over = F.char_length(now) > 1, F.char_length(x) - most
        closed = F.struct(
            F.when(whole, F.concat(done, F.array(now))).otherwise(done).alias("done"), F.right(x, F.lit(most)).alias("open"), F.when(whole, with_some(left, gap)).otherwise(left).alias("left"),
            F.concat(F.when(whole, "").otherwise(F.concat(gap, now)), F.when(over > 0, F.left(x, over)).otherwise("")).alias("gap"),
        )
        grown = F.struct(done.alias("done"), F.concat(now, x).alias("open"), left.alias("left"), gap.alias("gap"))
        return F.when(F.char_length(now) + F.char_length(x) <= most, grown).otherwise(closed)

    def finish(s: Column) -> Column:
        whole = F.char_length(s["open"]) > 1
        left = F.when(whole, with_some(with_some(s["left"], s["gap"]), tail)).otherwise(with_some(s["left"], F.concat(s["gap"], s["open"], tail)))
        pieces = F.flatten(F.transform(left, lambda x: F.regexp_extract_all(x, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))))
        return F.concat(F.when(whole, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]), pieces)

    return F.filter(F.aggregate(F.slice(cuts, F.lit(1), F.size(cuts) - 1), start, add, finish), lambda x: F.trim(x) != "")


@query("t21_boundary_chunks", "v_paragraph", sql="""WITH c AS (SELECT paragraph_id, regexp_extract_all(content, '(?s).{1,256}[!?.;\\n。！？；]') AS m,
    list_filter(flatten(list_transform(regexp_split_to_array(content, '(?s).{1,256}[!?.;\\n。！？；]'), lambda x: regexp_extract_all(x, '(?s).{1,256}'))), lambda x: x <> '') AS l FROM v_paragraph),
    a AS (SELECT paragraph_id, list_filter(list_concat(m, l), lambda x: trim(x) <> '') AS c FROM c) SELECT paragraph_id, i AS chunk_no, c[i] AS chunk FROM (SELECT paragraph_id, c, unnest(range(1, len(c) + 1)) AS i FROM a)""")
def chunked(paragraphs: DataFrame, size: int = 256) -> DataFrame:
    return paragraphs.select("paragraph_id", F.posexplode(boundary_chunks("content", size)).alias("n", "chunk")).select("paragraph_id", (F.col("n") + 1).cast("bigint").alias("chunk_no"), "chunk")


def heading_sections(text: str, patterns: list[str], limit: int) -> list[tuple[str, str]]:
    """(title path, content) in document order; headings inside code fences do not count; long contents are cut at ``limit``."""
    hidden = re.sub(r"(?s)```.*?```", lambda m: re.sub(r"[^\n]", "\0", m[0]), text)
    cuts = []
    for level, pattern in enumerate(patterns):
        try:
            cuts += [(m.start(), m.end(), level) for m in re.finditer(pattern, hidden)]
        except re.error:
            continue  # an invalid pattern matches nothing
    cuts.sort()
    out, path, begin = [], {}, 0
    for start, end, level in [*cuts, (len(text), len(text), None)]:
        body = text[begin:start].strip()
        title = " ".join(path[k] for k in sorted(path))[:255]
        if body or begin:
            out += [(title, body[i : i + limit]) for i in range(0, max(1, len(body)), limit)]
        if level is not None:
            path = {k: v for k, v in path.items() if k < level} | {level: text[start:end].strip("# \n")}
        begin = end
    return [(t, b) for t, b in out if t or b]


def split_by_headings(documents: DataFrame, patterns: list[str] = HEADINGS, limit: int = 100_000) -> DataFrame:
    """document_id, position, title and content of the sections of every document."""
    ship(documents.sparkSession)
    limit = min(100_000, max(50, limit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i + 1, t, c) for d, text in zip(batch["document_id"], batch["content"], strict=True) for i, (t, c) in enumerate(heading_sections(text or "", patterns, limit))]
            yield pd.DataFrame(rows, columns=["document_id", "position", "title", "content"])

    return documents.select("document_id", "content").mapInPandas(run, "document_id bigint, position bigint, title string, content string")


# lines with the headings above them: h0 and h1 are the last heading of the first level and the last one of the second behind it, at or before a line
_PATHS = """l AS (SELECT *, max(CASE WHEN level = 0 THEN i END) OVER w AS i0, max(CASE WHEN level = 1 THEN i END) OVER w AS i1, count(level) OVER w AS sec FROM v_headed_document WINDOW w AS (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT l.*, trim(a.line, '# ' || chr(10)) AS h0, CASE WHEN i1 > coalesce(i0, -1) THEN trim(b.line, '# ' || chr(10)) END AS h1 FROM l LEFT JOIN v_headed_document a ON a.document_id = l.document_id AND a.i = i0 LEFT JOIN v_headed_document b ON b.document_id = l.document_id AND b.i = i1)"""
_STRIPPED = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query("t22_heading_sections", "v_headed_document", sql=f"""WITH {_PATHS}, s AS (SELECT document_id, sec, substring(coalesce(concat_ws(' ', arg_min(h0, i), arg_min(h1, i)), ''), 1, 255) AS title, coalesce({_STRIPPED.format(c="string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY i)")}, '') AS content FROM p GROUP BY 1, 2)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY sec) AS position, title, content FROM s WHERE title <> '' OR content <> ''""")
def t22(documents: DataFrame) -> DataFrame:
    return split_by_headings(documents)


@query("t25_selected_patterns", "v_headed_document", sql=f"""WITH {_PATHS}, r AS (SELECT *, lag(h0) OVER w AS g0, lag(h1) OVER w AS g1 FROM p WINDOW w AS (PARTITION BY document_id ORDER BY i)),
    o AS (SELECT document_id, i, 0 AS part, CASE WHEN i = 0 THEN '' ELSE substring(concat_ws(' ', g0, g1, ''), 1, 255) END AS title, CASE WHEN level IS NULL THEN {_STRIPPED.format(c='line')} ELSE '' END AS body FROM r UNION ALL SELECT document_id, i, 1, substring(concat_ws(' ', h0, h1), 1, 255), '' FROM r WHERE level IS NOT NULL),
    c AS (SELECT document_id, i, part, title, unnest(CASE WHEN body = '' THEN [''] ELSE regexp_extract_all(body, '(?s).{{1,500}}') END) AS content, unnest(range(0, greatest(1, (length(body) + 499) // 500))) AS k FROM o)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i, part, k) AS position, title, content FROM c WHERE title <> '' OR content <> ''""")
def t25(documents: DataFrame, names: tuple[str, ...] = ("#", "##", "blank line", "enter", "-")) -> DataFrame:
    """Sections by the patterns that a user chose by name, 500 characters at most."""
    return split_by_headings(documents, [PATTERNS[n] for n in names], 500)


@query("t23_blank_line_split", "v_document", sql="""WITH s AS (SELECT document_id, string_split(replace(content, '. ', chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM v_document), i AS (SELECT document_id, unnest(range(1, len(p) + 1)) AS position, unnest(p) AS content FROM s)
    SELECT document_id, position, content FROM i WHERE trim(content) <> ''""")
def blank_line_split(documents: DataFrame) -> DataFrame:
    """Paragraphs between blank lines (sentence ends are made blank lines first, as the tables have none)."""
    text = F.replace("content", F.lit(". "), F.lit("\n\n"))
    rows = documents.select("document_id", F.posexplode(F.split(text, "\n\n")).alias("n", "content"))
    return rows.where(F.trim("content") != "").select("document_id", (F.col("n") + 1).cast("bigint").alias("position"), "content")


def sentence_cuts(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut behind the last sentence mark of the second half of the window, else hard. Blank ones go."""
    out, at = [], 0
    while len(text) - at > limit:
        mark = max(text.rfind(m, at + limit // 2 + 1, at + limit) for m in SENTENCE_MARKS)
        end = mark + 1 if mark >= 0 else at + limit
        out.append(text[at:end])
        at = end
    return [p for p in [*out, text[at:]] if p.strip()]


def halving(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: cut at the mark nearest to the middle, looked for within ``limit`` characters around it, and trimmed of marks there; without one, cut at ``limit``."""
    todo, out = [text], []
    while todo:
        piece = todo.pop().strip()
        if len(piece) <= limit:
            out += [piece] if piece else []
            continue
        middle = len(piece) // 2
        near = [i for i in range(max(0, middle - limit // 2), min(len(piece), middle + limit // 2)) if piece[i] in PIECE_MARKS]
        cut = min(near, key=lambda i: (abs(i - middle), i), default=0)
        left, right = piece[:cut].rstrip(PIECE_MARKS).strip(), piece[cut:].lstrip(PIECE_MARKS).strip()
        if left and right:
            todo += [right, left]
        else:
            out.append(piece[:limit])
            todo.append(piece[limit:])
    return out


def _pieces(rows: DataFrame, key: str, kernel, limit: int) -> DataFrame:
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i + 1, p) for k, text in zip(batch[key], batch["content"], strict=True) for i, p in enumerate(kernel(text or "", limit))]
            yield pd.DataFrame(out, columns=[key, "piece_no", "piece"])

    return rows.select(key, "content").mapInPandas(run, f"{key} bigint, piece_no bigint, piece string")


def _sentence_sql(table: str, limit: int) -> str:
    """Recursive CTE ``cuts`` (document_id, n, piece) over ``table`` (document_id, content)."""
    half = limit // 2
    mark = f"length(regexp_extract(substring(rest, {half + 2}, {limit - half - 1}), '(?s)^.*[{SENTENCE_MARKS}]'))"
    cut = f"CASE WHEN length(rest) <= {limit} THEN length(rest) WHEN {mark} > 0 THEN {half + 1} + {mark} ELSE {limit} END"
    return f"""cuts AS (SELECT document_id, 0 AS n, content AS rest, '' AS piece FROM {table} UNION ALL SELECT document_id, n + 1, substring(rest, c + 1), substring(rest, 1, c) FROM (SELECT *, {cut} AS c FROM cuts WHERE length(rest) > 0))"""


_NOT_BLANK = f"regexp_matches(piece, '[^{T.BLANK}]')"


@query("t24_sentence_cuts", "v_document", sql=f"WITH RECURSIVE {_sentence_sql('v_document', 500)} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n) AS piece_no, piece FROM cuts WHERE n > 0 AND {_NOT_BLANK}")
def t24(documents: DataFrame, limit: int = 500) -> DataFrame:
    return _pieces(documents, "document_id", sentence_cuts, limit)


def _halving_sql(table: str, limit: int) -> str:
    """Recursive CTE ``halves`` (paragraph_id, path, t, done): done rows in the order of their paths are the pieces."""
    half, trim = limit // 2, lambda c: f"regexp_replace({c}, '\\A[{T.BLANK}]+|[{T.BLANK}]+\\z', '', 'g')"
    marks = f"[{PIECE_MARKS}]"
    before = f"length(regexp_extract(substring(t, lo + 1, mid - lo), '(?s)^(.*){marks}', 1))"
    behind = f"length(regexp_extract(substring(t, mid + 1, hi - mid), '(?s)^([^{PIECE_MARKS}]*){marks}', 1))"
    return rf"""halves AS (SELECT paragraph_id, '' AS path, {trim('content')} AS t, false AS done FROM {table} UNION ALL SELECT paragraph_id, p.path || side, piece, stop FROM (
    SELECT *, length(l) > 0 AND length(r) > 0 AS found FROM (SELECT *, {trim(f"regexp_replace(substring(t, 1, cut), '{marks}+\\z', '')")} AS l, {trim(f"regexp_replace(substring(t, cut + 1), '\\A{marks}+', '')")} AS r FROM (
    SELECT *, CASE WHEN has_a AND (NOT has_b OR mid - (lo + a) <= b) THEN lo + a WHEN has_b THEN mid + b ELSE 0 END AS cut FROM (
    SELECT *, {before} AS a, {behind} AS b, regexp_matches(substring(t, lo + 1, mid - lo), '{marks}') AS has_a, regexp_matches(substring(t, mid + 1, hi - mid), '{marks}') AS has_b FROM (
    SELECT *, greatest(0, mid - {half}) AS lo, least(length(t), mid + {half}) AS hi FROM (SELECT *, length(t) // 2 AS mid FROM halves WHERE NOT done))))) ) p,
    LATERAL (SELECT '0' AS side, CASE WHEN length(t) <= {limit} THEN t WHEN found THEN l ELSE substring(t, 1, {limit}) END AS piece, length(t) <= {limit} OR NOT found AS stop
    UNION ALL SELECT '1', CASE WHEN found THEN r ELSE {trim(f"substring(t, {limit + 1})")} END, false WHERE length(t) > {limit}) s)"""


_HALVED = f"pieces AS (SELECT paragraph_id, row_number() OVER (PARTITION BY paragraph_id ORDER BY path) AS piece_no, t AS piece FROM halves WHERE done AND t <> '')"


@query("t30_halving_split", "v_paragraph", sql=f"WITH RECURSIVE {_halving_sql('v_paragraph', 100)}, {_HALVED} SELECT * FROM pieces")
def t30(paragraphs: DataFrame, limit: int = 100) -> DataFrame:
    return _pieces(paragraphs, "paragraph_id", halving, limit)


_RULED = f"""l AS (SELECT *, regexp_extract(content, '{SECTION}', 1) AS heading, regexp_matches(content, '{SECTION}') AS is_heading, regexp_matches(content, '{ITEM}') AS is_item, regexp_matches(content, '[^{T.BLANK}]') AS ink FROM v_resume_line),
    g AS (SELECT *, is_heading OR is_item OR (ink AND row_number() OVER (PARTITION BY document_id, ink ORDER BY position) = 1) AS starts FROM l),
    h AS (SELECT *, sum(starts::INT) OVER (PARTITION BY document_id ORDER BY position) AS section, coalesce(last_value(CASE WHEN is_heading THEN trim(heading) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY position), '{FIRST_TITLE}') AS title FROM g),
    s AS (SELECT document_id, section::BIGINT AS section, arg_min(title, position) AS title, min(position) AS start_line, max(position) AS end_line FROM h WHERE section > 0 GROUP BY 1, 2)"""


@query("t26_rule_sections", "v_resume_line", sql=f"WITH {_RULED} SELECT * FROM s")
def rule_sections(lines: DataFrame) -> DataFrame:
    """Sections by bracket headings and bullets: a running count of starts numbers the lines; a bullet has the title of the last heading.

    ``lines``: document_id, position, content. Blank lines before the first start belong to none.
    """
    heading, ink = F.col("content").rlike(SECTION), F.col("content").rlike(f"[^{T.BLANK}]")
    order = W.partitionBy("document_id").orderBy("position")
    starts = heading | F.col("content").rlike(ITEM) | (ink & (F.row_number().over(W.partitionBy("document_id", "ink").orderBy("position")) == 1))
    marked = lines.withColumn("ink", ink).select("document_id", "position", starts.alias("starts"), F.when(heading, F.trim(F.regexp_extract("content", SECTION, 1))).alias("heading"))
    numbered_lines = marked.select("document_id", "position", F.sum(F.col("starts").cast("bigint")).over(order).alias("section"), F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit(FIRST_TITLE)).alias("title"))
    return numbered_lines.where("section > 0").groupBy("document_id", "section").agg(F.min_by("title", "position").alias("title"), F.min("position").alias("start_line"), F.max("position").alias("end_line"))


def validate_ranges(ranges: DataFrame, lines: DataFrame, most: int = 500) -> DataFrame:
    """Per document: ranges (start_line, end_line) inside the text, none overlapping, none too long in lines or characters, no written line left out.

    Line totals come from running sums, so a range is two look-ups however long it is.
    """
    order = W.partitionBy("document_id").orderBy("position")
    ink = F.col("content").rlike(f"[^{T.BLANK}]").cast("bigint")
    upto = lines.select("document_id", "position", F.sum(F.char_length("content") + 1).over(order).alias("chars"), F.sum(ink).over(order).alias("ink"))
    totals = upto.groupBy("document_id").agg(F.max("position").alias("total"), F.max("ink").alias("all_ink"))
    ordered = ranges.join(totals, "document_id").withColumns({
        "before": F.lag("end_line").over(W.partitionBy("document_id").orderBy("start_line", "end_line")),
        "inside": (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("total")),
    })
    at = lambda line, name: upto.select("document_id", F.col("position").alias(line), F.col("chars").alias(f"{name}_chars"), F.col("ink").alias(f"{name}_ink"))
    sized = ordered.withColumn("previous", F.col("start_line") - 1).join(at("end_line", "end"), ["document_id", "end_line"], "left").join(at("previous", "start"), ["document_id", "previous"], "left").fillna(0, ["start_chars", "start_ink"])
    length, wide = F.col("end_chars") - F.col("start_chars") - 1, F.col("end_line") - F.col("start_line") + 1
    checked = sized.groupBy("document_id").agg(
        F.bool_and("inside").alias("inside"), F.bool_or(F.coalesce(F.col("start_line") <= F.col("before"), F.lit(False))).alias("overlaps"),
        F.bool_or((wide > most) | F.coalesce(length > most, F.lit(False))).alias("too_long"), F.sum(F.col("end_ink") - F.col("start_ink")).alias("ink"), F.max("all_ink").alias("all_ink"), F.count("*").alias("ranges"))
    covered = F.coalesce(F.col("ink") >= F.col("all_ink"), F.lit(False))  # counts lines twice where ranges overlap, which is invalid anyway
    return checked.select("document_id", "inside", "overlaps", "too_long", "ranges", (F.col("inside") & ~F.col("overlaps") & ~F.col("too_long") & covered).alias("valid"))


def supplied_ranges(lines: DataFrame) -> DataFrame:
    """Ranges of five lines with faults: every ninth document has an overlap, every eleventh a range beyond its end, every seventh lacks its second range."""
    d, n = F.col("document_id"), F.floor((F.col("position") - 1) / 5)
    ranges = lines.groupBy("document_id", n.alias("n")).agg(F.min("position").alias("s"), F.max("position").alias("e")).where(~((d % 7 == 0) & (F.col("n") == 1)))
    return ranges.select("document_id", "n", (F.col("s") - F.when((d % 9 == 0) & (F.col("n") > 0), 1).otherwise(0)).alias("start_line"), (F.col("e") + F.when(d % 11 == 0, 100).otherwise(0)).alias("end_line"))


SUPPLIED_SQL = """r AS (SELECT document_id, (position - 1) // 5 AS n, min(position) - CASE WHEN document_id % 9 = 0 AND (position - 1) // 5 > 0 THEN 1 ELSE 0 END AS start_line, max(position) + CASE WHEN document_id % 11 = 0 THEN 100 ELSE 0 END AS end_line
    FROM v_resume_line GROUP BY document_id, (position - 1) // 5 HAVING NOT (document_id % 7 = 0 AND (position - 1) // 5 = 1))"""


def _valid_sql(ranges: str, name: str) -> str:
    """CTE ``name`` (document_id, inside, overlaps, too_long, ranges, valid) by looking at every line of every range."""
    return f"""{name}_o AS (SELECT *, lag(end_line) OVER (PARTITION BY document_id ORDER BY start_line, end_line) AS before FROM {ranges}), {name}_t AS (SELECT document_id, max(position) AS total FROM v_resume_line GROUP BY 1),
    {name}_c AS (SELECT o.document_id, o.start_line, o.end_line, any_value(before) AS before, any_value(total) AS total, sum(length(content) + 1) - 1 AS chars FROM {name}_o o JOIN {name}_t t ON t.document_id = o.document_id LEFT JOIN v_resume_line l ON l.document_id = o.document_id AND position BETWEEN start_line AND end_line GROUP BY 1, 2, 3),
    {name}_m AS (SELECT DISTINCT l.document_id FROM v_resume_line l WHERE regexp_matches(content, '[^{T.BLANK}]') AND NOT EXISTS (SELECT 1 FROM {ranges} x WHERE x.document_id = l.document_id AND l.position BETWEEN x.start_line AND x.end_line)),
    {name} AS (SELECT document_id, bool_and(1 <= start_line AND start_line <= end_line AND end_line <= total) AS inside, bool_or(coalesce(start_line <= before, false)) AS overlaps, bool_or(end_line - start_line + 1 > 500 OR (end_line <= total AND coalesce(chars > 500, false))) AS too_long, count(*) AS ranges,
    bool_and(1 <= start_line AND start_line <= end_line AND end_line <= total) AND NOT bool_or(coalesce(start_line <= before, false)) AND NOT bool_or(end_line - start_line + 1 > 500 OR coalesce(chars > 500, false)) AND document_id NOT IN (SELECT document_id FROM {name}_m) AS valid FROM {name}_c GROUP BY 1)"""


@query("t27_validate_ranges", "v_resume_line", sql=f"WITH {SUPPLIED_SQL}, {_valid_sql('r', 'v')} SELECT * FROM v")
def t27(lines: DataFrame) -> DataFrame:
    return validate_ranges(supplied_ranges(lines), lines)


@query("t28_resolve_ranges", "v_paragraph", sql="""WITH r AS (SELECT DISTINCT document_id, (position - 1) // 5 AS n, ((position - 1) // 5) * 5 + 1 AS s, ((position - 1) // 5) * 5 + 5 AS e FROM v_paragraph)
    SELECT p.document_id, n AS range_no, string_agg(content, chr(10) ORDER BY position) AS text FROM v_paragraph p JOIN r ON r.document_id = p.document_id AND position BETWEEN s AND e GROUP BY 1, 2""")
def resolve_ranges(paragraphs: DataFrame) -> DataFrame:
    """Verbatim text of line ranges: an equi join on the document with a range condition inside."""
    n = F.floor((F.col("position") - 1) / 5)
    ranges = paragraphs.select("document_id", n.alias("range_no"), (n * 5 + 1).alias("s"), (n * 5 + 5).alias("e")).distinct()
    lines = paragraphs.join(ranges, "document_id").where("position BETWEEN s AND e").groupBy("document_id", "range_no").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("l"))
    return lines.select("document_id", "range_no", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("text"))


def joined_lines(lines: DataFrame, ranges: DataFrame, number: str) -> DataFrame:
    """document_id, n, chunk: the lines of each range, joined."""
    rows = lines.join(ranges.select("document_id", F.col(number).cast("bigint").alias("n"), "start_line", "end_line"), "document_id").where("position BETWEEN start_line AND end_line")
    nested = rows.groupBy("document_id", "n").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("l"))
    return nested.select("document_id", "n", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("chunk"))


@query("t29_fallback_chain", "v_resume_line", sql=f"""WITH RECURSIVE {SUPPLIED_SQL}, {_valid_sql('r', 'v')}, {_RULED}, {_valid_sql('s', 'w')}, ok AS (SELECT document_id FROM v WHERE valid), ruled AS (SELECT document_id FROM w WHERE valid AND document_id NOT IN (SELECT document_id FROM ok)),
    rest AS (SELECT document_id, string_agg(content, chr(10) ORDER BY position) AS content FROM v_resume_line WHERE document_id NOT IN (SELECT document_id FROM ok UNION ALL SELECT document_id FROM ruled) GROUP BY 1), {_sentence_sql('rest', 500)}
    SELECT document_id, n::BIGINT AS n, string_agg(content, chr(10) ORDER BY position) AS chunk, 'supplied' AS path FROM v_resume_line JOIN r USING (document_id) WHERE document_id IN (SELECT document_id FROM ok) AND position BETWEEN start_line AND end_line GROUP BY 1, 2
    UNION ALL SELECT document_id, section, string_agg(content, chr(10) ORDER BY position), 'rules' FROM v_resume_line JOIN s USING (document_id) WHERE document_id IN (SELECT document_id FROM ruled) AND position BETWEEN start_line AND end_line GROUP BY 1, 2
    UNION ALL SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n), piece, 'sentences' FROM cuts WHERE n > 0 AND {_NOT_BLANK}""")
def fallback_chain(lines: DataFrame) -> DataFrame:
    """Supplied boundaries first (documents with valid ranges), then rules where they are valid, then sentence cuts; ``path`` tells which."""
    given, ruled = supplied_ranges(lines), rule_sections(lines)
    valid = validate_ranges(given, lines).where("valid").select("document_id")
    by_rule = validate_ranges(ruled, lines).where("valid").select("document_id").join(valid, "document_id", "left_anti")
    tagged = lambda rows, path: rows.select("document_id", "n", "chunk", F.lit(path).alias("path"))
    rest = lines.join(valid, "document_id", "left_anti").join(by_rule, "document_id", "left_anti").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("l"))
    texts = rest.select("document_id", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("content")).where(F.col("content").rlike(f"[^{T.BLANK}]"))
    cut = t24(texts).select("document_id", F.col("piece_no").alias("n"), F.col("piece").alias("chunk"))
    parts = [joined_lines(lines, given.join(valid, "document_id", "left_semi"), "n"), joined_lines(lines, ruled.join(by_rule, "document_id", "left_semi"), "section"), cut]
    return tagged(parts[0], "supplied").unionByName(tagged(parts[1], "rules")).unionByName(tagged(parts[2], "sentences"))


_CHUNKED = f"""m AS (SELECT {{key}}, regexp_extract_all({{text}}, '(?s).{{{{1,256}}}}[!?.;\n。！？；]') AS m, list_filter(flatten(list_transform(regexp_split_to_array({{text}}, '(?s).{{{{1,256}}}}[!?.;\n。！？；]'), lambda x: regexp_extract_all(x, '(?s).{{{{1,256}}}}'))), lambda x: x <> '') AS l FROM {{table}}),
    c AS (SELECT {{key}}, list_filter(list_concat(m, l), lambda x: trim(x) <> '') AS c FROM m)"""


@query("t31_index_rows", "v_paragraph", sql=f"""WITH RECURSIVE {_halving_sql('v_paragraph', 100)}, {_HALVED}, d AS (SELECT document_id, sum(length(content))::BIGINT AS char_length FROM v_paragraph GROUP BY 1),
    {_CHUNKED.format(key='paragraph_id, piece_no', text='piece', table='pieces')}, e AS (SELECT document_id, paragraph_id, piece_no, row_number() OVER (PARTITION BY document_id ORDER BY p.position, piece_no) AS position FROM pieces JOIN v_paragraph p USING (paragraph_id))
    SELECT document_id, position, i AS chunk_no, 'document ' || document_id || chr(10) || c[i] AS chunk, char_length FROM (SELECT document_id, position, c, char_length, unnest(range(1, len(c) + 1)) AS i FROM e JOIN c USING (paragraph_id, piece_no) JOIN d USING (document_id))""")
def index_rows(paragraphs: DataFrame) -> DataFrame:
    """Pieces of each paragraph, numbered through the document, each with its title-prefixed chunks; the document's length counts the contents as they were."""
    lengths = paragraphs.groupBy("document_id").agg(F.sum(F.char_length("content").cast("bigint")).alias("char_length"))
    pieces = t30(paragraphs).join(paragraphs.select("paragraph_id", "document_id", F.col("position").alias("place")), "paragraph_id")
    placed = pieces.withColumn("position", numbered("document_id", order=["place", "piece_no"])).join(lengths, "document_id")
    rows = placed.select("document_id", "position", "char_length", F.posexplode(boundary_chunks("piece")).alias("n", "c"))
    title = F.concat(F.lit("document "), F.col("document_id").cast("string"))
    return rows.select("document_id", "position", (F.col("n") + 1).cast("bigint").alias("chunk_no"), F.concat(title, F.lit("\n"), "c").alias("chunk"), "char_length")


@query("t32_pii_gate", "v_paragraph", sql=f"WITH m AS (SELECT document_id, {MASKED_SQL} AS t FROM v_paragraph) SELECT document_id, NOT bool_or({residual_sql('t')}) AS accepted FROM m GROUP BY 1")
def pii_gate(paragraphs: DataFrame) -> DataFrame:
    """Everything is masked first; one paragraph with residual data rejects its whole document."""
    return paragraphs.groupBy("document_id").agg((~F.bool_or(T.residual_pii(T.masked("content")))).alias("accepted"))


@query("t33_chunk_expansion", "v_query_text", "v_paragraph", sql=f"""WITH {_CHUNKED.format(key='paragraph_id', text='content', table='v_paragraph')}
    SELECT CAST(query_id AS BIGINT) AS source_id, 0 AS source_type, 0 AS chunk_no, query AS chunk FROM v_query_text UNION ALL SELECT paragraph_id, 1, i - 1, c[i] FROM (SELECT paragraph_id, c, unnest(range(1, len(c) + 1)) AS i FROM c WHERE paragraph_id % 2 = 1)
    UNION ALL SELECT paragraph_id, 1, 0, substring(content, 1, 10) FROM v_paragraph WHERE paragraph_id % 2 = 0 UNION ALL SELECT paragraph_id, 1, 1, content FROM v_paragraph WHERE paragraph_id % 2 = 0""")
def chunk_expansion(questions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Questions pass through; paragraphs use their stored chunks (even ids have two) or are chunked when they have none."""
    stored = F.when(F.col("paragraph_id") % 2 == 0, F.array(F.left("content", F.lit(10)), F.col("content")))
    return questions.select(F.col("query_id").cast("bigint").alias("source_id"), F.lit(0).alias("source_type"), F.posexplode(F.array("query")).alias("chunk_no", "chunk")).unionByName(
        paragraphs.select(F.col("paragraph_id").alias("source_id"), F.lit(1).alias("source_type"), F.posexplode(F.coalesce(stored, boundary_chunks("content"))).alias("chunk_no", "chunk")))


@query("t35_incremental", "v_document", "v_paragraph", sql="SELECT paragraph_id FROM v_paragraph WHERE document_id IN (SELECT document_id FROM v_document WHERE right(status, 1) IN ('0', '3'))")
def incremental(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    wanted = documents.where(T.task_state("status", 1).isin("0", "3"))
    return paragraphs.join(wanted, "document_id", "left_semi").select("paragraph_id")


@query("t36_token_index", "v_paragraph", "v_kb_term", sql="""WITH k AS (SELECT knowledge_id, list_sort(list_distinct(list(term))) AS terms FROM v_kb_term GROUP BY 1), p AS (SELECT knowledge_id, paragraph_id, lower(content) AS t, regexp_extract_all(lower(content), '[\\p{Latin}\\p{Nd}]+|[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]') AS found FROM v_paragraph),
    a AS (SELECT knowledge_id, paragraph_id, list_concat(found, list_filter(coalesce(terms, []), lambda x: contains(t, x) AND NOT list_contains(found, x))) AS found FROM p LEFT JOIN k USING (knowledge_id)),
    u AS (SELECT knowledge_id, paragraph_id, found[i] AS token, i FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM a))
    SELECT knowledge_id, paragraph_id, token, count(*) AS n, string_agg(CAST(i AS STRING), ',' ORDER BY i) AS positions FROM u GROUP BY 1, 2, 3""")
def token_index(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings per knowledge base; its dictionary terms that occur in a text are tokens as well."""
    dictionaries = terms.groupBy("knowledge_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    rows = paragraphs.join(dictionaries, "knowledge_id", "left")
    found = postings(rows, ["knowledge_id", "paragraph_id"], "content", F.coalesce("terms", F.array().cast("array<string>")))
    return found.select("knowledge_id", "paragraph_id", "token", F.size("positions").cast("bigint").alias("n"), F.array_join("positions", ",").alias("positions"))


BASE_TERMS, ALIAS_TERMS = ["spark sql", "data lake"], {"pyspark": "spark", "parq": "parquet"}


@query("t37_term_dictionary", "v_job", "v_query_text", sql="""SELECT DISTINCT term FROM (SELECT unnest(['spark sql', 'data lake', 'pyspark', 'spark', 'parq', 'parquet']) AS term UNION ALL SELECT unnest(skills) FROM v_job UNION ALL SELECT lower(title) FROM v_job UNION ALL SELECT title FROM v_job)
    WHERE length(term) > 1 AND term NOT IN (SELECT unnest(string_split(query, ' ')) FROM v_query_text)""")
def term_dictionary(jobs: DataFrame, stored: DataFrame, base: list[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Base terms, aliases and what they stand for, raw and normalised skills of the jobs, without those that are stored already."""
    aliases = ALIAS_TERMS if aliases is None else aliases
    fixed = F.array(*[F.lit(t) for t in [*(BASE_TERMS if base is None else base), *[x for kv in aliases.items() for x in kv]]])
    skills = jobs.select(F.explode(F.concat("skills", F.array("title"))).alias("term"))
    terms = skills.unionByName(skills.select(T.normalised_skill("term").alias("term"))).unionByName(jobs.sparkSession.range(1).select(F.explode(fixed).alias("term")))
    return terms.where(F.char_length("term") > 1).distinct().join(stored.select(F.explode(F.split("query", " ")).alias("term")), "term", "left_anti")


@query("t38_indexing_outcome", "v_document", "v_paragraph", sql=f"""WITH m AS (SELECT document_id, {MASKED_SQL} AS t FROM (SELECT document_id, content, content AS t FROM v_paragraph)), f AS (SELECT document_id, bool_or({residual_sql('t')}) AS failed FROM m GROUP BY 1)
    SELECT document_id, failed, CASE WHEN failed THEN '3' WHEN right(status, 1) = '5' THEN '4' ELSE '2' END AS state FROM f JOIN v_document USING (document_id)""")
def indexing_outcome(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A document fails when the gate rejects any of its paragraphs (personal data that masking leaves); a running revoke (5) is settled to revoked (4)."""
    failed = paragraphs.groupBy("document_id").agg(F.bool_or(T.residual_pii(T.masked("content"))).alias("failed"))
    state = F.when(F.col("failed"), "3").when(T.task_state("status", 1) == "5", "4").otherwise("2")
    return failed.join(documents.select("document_id", "status"), "document_id").select("document_id", "failed", state.alias("state"))


def reindex(documents: DataFrame, paragraphs: DataFrame, tenants: tuple[str, ...], dry_run: bool = True) -> DataFrame:
    """Paragraphs of the active documents of some tenants that are to be indexed again; a dry run counts them per tenant."""
    active = documents.where("is_active").select("document_id")
    wanted = paragraphs.where(F.col("knowledge_id").isin(*tenants)).join(active, "document_id", "left_semi")
    return wanted.groupBy("knowledge_id").agg(F.count("*").alias("paragraphs")) if dry_run else wanted.select("knowledge_id", "document_id", "paragraph_id")


_REINDEX = "FROM v_paragraph WHERE knowledge_id IN ('src1', 'src4') AND document_id IN (SELECT document_id FROM v_document WHERE is_active)"


@query("t40_reindex_dry_run", "v_document", "v_paragraph", sql=f"SELECT knowledge_id, count(*) AS paragraphs {_REINDEX} GROUP BY 1")
def reindex_dry_run(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    return reindex(documents, paragraphs, ("src1", "src4"))


@query("t40b_reindex_rows", "v_document", "v_paragraph", sql=f"SELECT knowledge_id, document_id, paragraph_id {_REINDEX}")
def reindex_rows(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    return reindex(documents, paragraphs, ("src1", "src4"), dry_run=False)


@query("t41_keywords", "v_paragraph", sql="SELECT paragraph_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{Latin}\\p{Nd}]+'), lambda t: t NOT IN ('the', 'of', 'and')))), ',') AS keywords FROM v_paragraph")
def keywords(sections: DataFrame, stop: tuple[str, ...] = ("the", "of", "and")) -> DataFrame:
    """Distinct tokens of each section without stop words; punctuation makes no tokens."""
    found = F.array_distinct(F.filter(tokens("content"), lambda t: ~t.isin(*stop)))
    return sections.select("paragraph_id", F.array_join(F.array_sort(found), ",").alias("keywords"))
