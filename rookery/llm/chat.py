"""Chat formatting by prefix-target expansion: every assistant turn becomes an example with all turns before it as context.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts get a backslash behind their first character (and one more
where backslashes stand there already), so only the template's own marks are left as control strings and reading back is exact. Roles are
percent-escaped, as they end at a line break. Of an example only the text of its last turn is trainable: ``loss_start`` and ``loss_length`` are its
code points. Turns behind the last assistant turn form a last example without a trainable part, so no turn is lost.

An example is built in a row of its own from the turns of its conversation; examples of one conversation are never gathered in one row. The turns of one
conversation are: its digest is one hash over all its text, and a hash is not mergeable.

Defined cases: turns go by turn, role, text, nulls first, so ties have one order and repeated rows stay; a null text is empty; a null role is marked as such and read back as
null (empty in digests); rows with a null conv_id form one conversation; only the role ``assistant`` is trained; a conversation without it has an empty
loss text; very long texts are taken whole; an empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What must not come from a text: a first character, then one of these.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def role_escaped(role: Column) -> Column:
    return F.coalesce(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("%00"))


def role_read(role: Column) -> Column:
    return F.when(role != "%00", F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start (from 0), loss_length."""
    rows = conversations.select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _before).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), role_escaped(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), F.coalesce(t["role"] == TARGET_ROLE, F.lit(False)).alias("target"))).alias("turns"),
    ).select("conv_id", "turns", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))).alias("segments"))
    at = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["target"] | (i == F.size("turns") - 1))
    each = parts.select("conv_id", "turns", "segments", F.posexplode(at).alias("example", "at"))
    turn = F.get("turns", F.col("at"))
    each = each.select("conv_id", "example", F.array_join(F.slice("segments", F.lit(1), F.col("at")), "").alias("context"), turn.alias("turn"))
    own = F.concat("context", F.col("turn.head"), F.col("turn.body"), F.lit(CLOSE))
    return each.select(
        "conv_id", "example", own.alias("formatted"), (F.char_length("context") + F.char_length("turn.head")).cast("long").alias("loss_start"),
        F.when(F.col("turn.target"), F.char_length("turn.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def _before(a: Column, b: Column) -> Column:
    """Order of turns by turn, role, text, nulls first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), -1).otherwise(1)
    return out


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p.startswith(OPEN))
    role_end = lambda p: F.instr(p, "\n")
    return F.transform(parts, lambda p: F.struct(
        role_read(F.substring(p, F.lit(len(OPEN) + 1), role_end(p) - len(OPEN) - 1)).alias("role"),
        unescaped(F.substring(p, role_end(p) + 1, F.char_length(p))).alias("text"),
    ))


def trained(formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the loss mask of an example."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


#: A conversation that speaks in control strings.
PLANTED = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def digest(found: DataFrame) -> DataFrame:
    """What is read back from the examples of each conversation. The grouping of ``examples`` holds, so nothing is shuffled again."""
    loss = found.select("conv_id", "example", "formatted", F.char_length("formatted").alias("chars"), trained(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    back = loss.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),  # holds all turns
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"), F.sum(F.char_length("loss")).alias("loss_chars"),
    )
    back = back.withColumn("turns", read_turns(F.col("last")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.col("loss_chars").cast("long").alias("loss_chars"),
        F.sha2(F.array_join(F.transform("losses", lambda x: x["loss"]), ""), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(examples(rows.unionByName(spark.sql(PLANTED))))


#: The digests straight from the rows; lengths by counting control strings.
SQL = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, role IS NOT DISTINCT FROM 'assistant' AS target,
    sum(12 + coalesce(length(role) + 2 * length(regexp_replace(role, '[^%\n]', '', 'g')), 3) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])')) + 11) OVER (w ROWS UNBOUNDED PRECEDING) AS chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE target), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE target), '')) AS loss_sha256, CAST(coalesce(sum(chars) FILTER (WHERE target OR i = n), 0) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""
