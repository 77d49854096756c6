"""Scalar functions as Column expressions: cleaning, masking, extraction, state strings, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What \w, \d and \s stand for in these patterns: all scripts, spelled out so that every engine reads them alike.
WORD, DIGIT, BLANK = r"\p{L}\p{M}\p{Nd}\p{Pc}", r"\p{Nd}", r"\s\x0B\x1C-\x1F\x{85}\p{Z}"

# They must equal the reference's for equal results.
PHONE = rf"(?:\+?86[{BLANK}-]?)?1[3-9]{DIGIT}(?:[{BLANK}-]?{DIGIT}{{4}}){{2}}"
EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+"
ID18 = rf"(?<![{WORD}]){DIGIT}{{17}}[{DIGIT}Xx](?![{WORD}])"
STRICT_PHONE = rf"1[{BLANK}]*[3-9][{BLANK}]*{DIGIT}(?:[{BLANK}]*{DIGIT}){{8}}"
ID15 = rf"(?<![{WORD}]){DIGIT}{{15}}(?![{WORD}])"
CARD = rf"(?<![{WORD}]){DIGIT}{{16,19}}(?![{WORD}])"
PLAIN_PHONE = rf"(?:\+?86[- ]?)?1[3-9]{DIGIT}{{9}}"
NAMES = [rf"姓名[:：;；][{BLANK}]*([^\n；;]{{2,8}})", r"(?dm)^([\x{4E00}-\x{9FA5}]{2,4})$"]
NAME_EDGES = ":：，,。;；"
YEARS = rf"(?<!{DIGIT})({DIGIT}{{1,2}})[{BLANK}]*年(?:以上)?(?!{DIGIT})"
DEGREES = {"大专": 1, "专科": 1, "本科": 2, "硕士": 3, "博士": 4}
STOP_PHRASES = ["\n", "：", "负责", "熟悉"]
SKILL_EDGES = "\"'，。；"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0E}\x{FE0F}]"
FULL_SEMICOLON = "；"
MASK = "[已脱敏]"
REDACTED = "***REDACTED***"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_for_embedding(c: str | Column) -> Column:
    """No emoji or variation selectors, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), EMOJI, ""), r"\s+", " "))


def sanitised(c: str | Column) -> Column:
    """Unix line ends, no control characters, single blanks, at most one blank line, trimmed."""
    c = F.regexp_replace(F.regexp_replace(_c(c), r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def trimmed(c: str | Column, characters: str | None = None) -> Column:
    """Without white space, or the given characters, at both ends."""
    if characters:
        return F.btrim(_c(c), F.lit(characters))
    return F.regexp_replace(_c(c), rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def ocr_lines(c: str | Column) -> Column:
    """A stream with at least five full-width semicolons and under three line breaks is cut at the semicolons; runs count once, ends are trimmed."""
    c = _c(c)
    count = lambda ch: F.char_length(c) - F.char_length(F.replace(c, F.lit(ch), F.lit("")))
    lines = F.regexp_replace(F.regexp_replace(c, f"{FULL_SEMICOLON}+", "\n"), r"\n{2,}", "\n")
    return F.when((count(FULL_SEMICOLON) >= 5) & (count("\n") < 3), trimmed(lines)).otherwise(c)


def masked(c: str | Column) -> Column:
    """Phone, email and 18-digit id replaced, in that order."""
    out = _c(c)
    for pattern in (PHONE, EMAIL, ID18):
        out = F.regexp_replace(out, pattern, MASK)
    return out


def residual_pii(c: str | Column) -> Column:
    """Phones with any white space between digits, 15-digit ids, 16 to 19 digit cards."""
    c = _c(c)
    return c.rlike(STRICT_PHONE) | c.rlike(ID15) | c.rlike(CARD)


def partly_masked(c: str | Column) -> Column:
    """Phones keep 3 + 4 digits, email addresses two characters and the domain."""
    out = F.regexp_replace(_c(c), r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2")
    return F.regexp_replace(out, r"([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def masked_phone(c: str | Column) -> Column:
    """First three and last four digits from seven characters on; empty values stay."""
    c = _c(c)
    shown = F.when(F.char_length(c) >= 7, F.concat(F.left(c, F.lit(3)), F.lit("****"), F.right(c, F.lit(4)))).otherwise(F.lit("****"))
    return F.when(c.isNull() | (c == ""), c).otherwise(shown)


def masked_email(c: str | Column) -> Column:
    """Two characters of a longer local part and the domain, which begins after the first @; values without @ stay."""
    c = _c(c)
    local = F.substring_index(c, "@", 1)
    domain = F.substring(c, F.char_length(local) + 1, F.char_length(c))
    shown = F.concat(F.when(F.char_length(local) > 2, F.concat(F.left(local, F.lit(2)), F.lit("***"))).otherwise(F.lit("***")), domain)
    return F.when(c.contains("@"), shown).otherwise(c)


def identity_fields(c: str | Column) -> tuple[Column, Column, Column]:
    """Name (after its label, else a line of two to four CJK characters), email and phone; empty where there is none."""
    first = lambda p, group: F.regexp_extract(_c(c), p, group)
    names = [trimmed(trimmed(first(p, 1)), NAME_EDGES) for p in NAMES]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in names], F.lit("")), first(EMAIL, 0), first(PLAIN_PHONE, 0)


def query_slots(c: str | Column, cities: list[str]) -> tuple[Column, Column, Column, Column]:
    """Least years, degree level, cities (longest first) and what is left of a query."""
    c = _c(c)
    found = F.regexp_extract(c, YEARS, 0)
    years = F.nullif(F.regexp_extract(c, YEARS, 1), F.lit("")).cast("bigint")
    rest = F.when(found != "", F.replace(c, found, F.lit(" "))).otherwise(c)
    level = F.lit(None).cast("bigint")
    for word, rank in DEGREES.items():  # a later word wins
        level = F.when(rest.contains(word), F.lit(rank).cast("bigint")).otherwise(level)
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    named = []
    for city in sorted(cities, key=len, reverse=True):
        short = city.removesuffix("市")
        named.append(F.when(rest.contains(short), F.lit(city)))
        for form in (short + "市", city, short):
            rest = F.replace(rest, F.lit(form), F.lit(" "))
    return years, level, F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"), trimmed(F.regexp_replace(rest, f"[{BLANK}]+", " "))


def section_cleaned(c: str | Column) -> Column:
    """Blank runs, hash runs and tabs of section text."""
    out = F.regexp_replace(_c(c), r"[ \t]+", " ")
    out = F.regexp_replace(out, r"#+ ?", "")
    return F.trim(F.regexp_replace(out, r"\n{2,}", "\n"))


# What is taken out of Markdown, in this order, and what takes its place. Tags of any kind go with the last but one step.
PLAIN = [
    (r"(?d)!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (rf"(?dm)^#{{1,6}}[{BLANK}]+", ""), (r"(?d)\*\*(.*?)\*\*", "$1"), (r"(?d)__(.*?)__", "$1"),
    (r"(?d)\*(.*?)\*", "$1"), (r"(?d)_(.*?)_", "$1"), (r"(?d)`(.*?)`", "$1"), (r"(?s)```.*?```", ""), (r"\n{2,}", "\n"), (r"<[^>]+>", ""), (rf"[{BLANK}]+", " "),
]


def plain_text(c: str | Column) -> Column:
    """Markdown and HTML to plain text on one line."""
    out = _c(c)
    for pattern, replacement in PLAIN:
        out = F.regexp_replace(out, pattern, replacement)
    return trimmed(out)


def task_state(status: str | Column, k: int) -> Column:
    """State digit of task ``k`` counted from the right; a missing digit is n (ignored)."""
    s = _c(status)
    return F.when(F.char_length(s) >= k, F.substring(F.reverse(s), k, 1)).otherwise(F.lit("n"))


def with_task_state(status: str | Column, k: int, digit: str, width: int = 4) -> Column:
    return F.reverse(F.overlay(F.reverse(F.lpad(_c(status), width, "n")), F.lit(digit), F.lit(k)))


def noted_time(times: Column, k: int, digit: str, now: Column) -> Column:
    """``times`` (task -> state -> time) with the time of a state of task ``k`` set."""
    empty = F.create_map().cast("map<string,map<string,string>>")
    times, task = F.coalesce(times, empty), F.lit(str(k))
    own = F.coalesce(F.try_element_at(times, task), F.create_map().cast("map<string,string>"))
    own = F.map_concat(F.map_filter(own, lambda state, _: state != digit), F.create_map(F.lit(digit), now))
    return F.map_concat(F.map_filter(times, lambda name, _: name != str(k)), F.create_map(task, own))


# Names under which secrets are kept.
SECRET_KEYS = ["credential", "secret_key", "access_token", "password", "token", "api_key", "webhook_url"]


def redacted(values: str | Column) -> Column:
    """A map whose non-empty values under secret names, whatever their case, are replaced."""
    return F.transform_values(_c(values), lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS) & (v != ""), F.lit(REDACTED)).otherwise(v))


def traced(values: str | Column, most: int = 200) -> Column:
    """A map with its texts cut to ``most`` characters; an array keeps its first five items, each cut."""
    return F.transform_values(_c(values), lambda _, v: F.left(v, F.lit(most)))


def traced_items(items: str | Column, most: int = 200) -> Column:
    return F.transform(F.slice(_c(items), 1, 5), lambda x: F.left(x, F.lit(most)))


def normalised_skill(c: str | Column, aliases: dict[str, str] | None = None) -> Column:
    out = F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))
    if aliases:
        names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        out = F.coalesce(F.try_element_at(names, out), out)
    return out


def clean_skills(c: str | Column, least: int = 2, most: int = 30, cap: int = 15) -> Column:
    """Trimmed of white space and marks, length limits, no stop phrases, first spelling wins whatever its case, at most ``cap``."""
    skills = F.transform(_c(c), lambda x: trimmed(trimmed(x), SKILL_EDGES))
    stops = F.array(*[F.lit(p) for p in STOP_PHRASES])
    skills = F.filter(skills, lambda x: ~F.exists(stops, lambda p: x.contains(p)))
    skills = F.filter(skills, lambda x: F.char_length(x).between(least, most))
    first = F.filter(skills, lambda x, i: F.array_position(F.transform(skills, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, cap)


def evidence_strength(relevances: str | Column) -> Column:
    """min(1, highest relevance + 0.05 for each further item); 0 without evidence."""
    r = _c(relevances)
    return F.when(F.size(r) > 0, F.least(F.lit(1.0), F.array_max(r) + 0.05 * (F.size(r) - 1))).otherwise(0.0)


def guarded_cell(c: str | Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading quote."""
    return F.when(_c(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), _c(c))).otherwise(_c(c))


def cosine(a: str | Column, b: str | Column) -> Column:
    a, b = _c(a), _c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
