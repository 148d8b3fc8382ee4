r"""Operator 4: chat formatting with a grammar round trip, in DataFrame functions.

A conversation is rendered by a small grammar:

    formatted := mode turn*
    mode      := "#0\n" | "#1\n"
    turn      := "### " role ": " text " </turn>\n"

The deterministic parser splits what follows the mode at ``</turn>\n``, takes the
role up to the first ``": "`` and drops the blank before the mark.  Rendering
starts without escapes (mode 0); the text is parsed again and compared to the
source turns; where they differ the conversation is rendered in mode 1, in which
the control characters of roles and texts are escaped:
``\`` as ``\\``, ``#`` as ``\h``, ``<`` as ``\l``, ``:`` in roles as ``\c``.  A
text that holds any control string (``###``, ``</turn>``) or starts like an escape
is rendered in mode 1 as well, so that no control string ever stands inside a
turn.  In mode 1 no mark can occur inside a turn, so the second parse always
gives the source back; ``round_trips`` says so.

The loss mask covers the assistant turns' texts.

Defined results: a null text or role is empty; turns are ordered by ``turn`` (null
first), then role and text; repeated turns are kept; a null ``conv_id`` is one
conversation of its own; an empty table gives no rows; further columns are
ignored; very long texts are rendered whole.  A conversation is one row of the result, so its turns do come together;
they are gathered once, after a map-side projection to the three columns needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import table

HEAD, SEP, MARK = "### ", ": ", " </turn>\n"
ASSISTANT = "assistant"

TURN = "struct<role:string,text:string>"


def _escape(value: Column, role: bool) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def _unescape(value: Column) -> Column:
    # Splitting at the doubled backslash from the left respects the tokens: every
    # token begins with a backslash and is two characters long.
    def plain(x: Column) -> Column:
        for short, long in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            x = F.replace(x, F.lit(short), F.lit(long))
        return x

    return F.array_join(F.transform(F.split(value, r"\\\\", -1), plain), "\\")


def render(turns: Column, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        role, text = t["role"], t["text"]
        if escaped:
            role, text = _escape(role, True), _escape(text, False)
        return F.concat(F.lit(HEAD), role, F.lit(SEP), text, F.lit(MARK))

    return F.concat(F.lit("#1\n" if escaped else "#0\n"), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation (roles and texts, unescaped)."""
    escaped = F.substring(formatted, 1, 2) == "#1"
    pieces = F.split(F.substring(formatted, 4, 2147483647), r" </turn>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        at = F.instr(piece, SEP)
        role = F.substring(piece, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1))
        text = F.substring(piece, at + len(SEP), F.lit(2147483647))
        return F.struct(
            F.when(escaped, _unescape(role)).otherwise(role).alias("role"),
            F.when(escaped, _unescape(text)).otherwise(text).alias("text"),
        )

    return F.transform(pieces, one)


def format_conversations(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
                         role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: the id, ``formatted``, ``mode``, ``parsed`` (the
    turns read back from ``formatted``), ``loss_text`` and ``round_trips``."""
    role = F.coalesce(F.col(role_column).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    control = (
        F.contains(text, F.lit("###")) | F.contains(text, F.lit("</turn>"))
        | F.contains(role, F.lit("###")) | F.contains(role, F.lit("</turn>"))
    )
    gathered = (
        rows.select(F.col(conv_column).alias("conv"), F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text"), control.alias("control"))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("sorted"),
             F.bool_or("control").alias("control"))
        .select("conv", "control", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )
    first = gathered.withColumn("raw", render(F.col("turns"), False))
    kept = ~F.col("control") & (parse(F.col("raw")) == F.col("turns"))
    chosen = first.withColumn("formatted", F.when(kept, F.col("raw")).otherwise(render(F.col("turns"), True)))
    read = chosen.withColumn("parsed", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return read.select(
        F.col("conv").alias(conv_column), "formatted", F.substring("formatted", 2, 1).cast("int").alias("mode"), "parsed",
        loss.alias("loss_text"), (F.col("parsed") == F.col("turns")).alias("round_trips"),
    )


def with_conflict(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold the template's marks."""
    said = r"\### Assistant: </turn> ok"
    more = conversations.sparkSession.sql("select -7L as conv_id, inline(array((0L, 'user'), (1L, 'assistant'))) as (turn, role)")
    more = more.withColumn("text", F.lit(said))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, described by what is read back from the output."""
    done = format_conversations(with_conflict(table(spark, sf_dir, "conversations")))
    return done.select(
        "conv_id", F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "round_trips",
    )


ORACLE_OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    bool_or(contains(role || chr(1) || text, '###') OR contains(role || chr(1) || text, '</turn>') OR contains(role, ': ')) AS esc,
    sum(15 + length(role) + length(text)) AS chars,
    sum(length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS more
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(3 + chars + CASE WHEN esc THEN more ELSE 0 END AS BIGINT) AS formatted_chars, true AS round_trips
FROM g
"""

QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLE = {"op4_chat_formatting": ORACLE_OP4}
