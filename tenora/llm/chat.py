"""Chat formatting as relational work: collect and sort turns, merge neighbours of one role, concatenate. Spark
expressions only.

A formatted conversation is a row of blocks, one for each run of turns with the same role:

    <|im_start|>ROLE newline TEXT <|im_sep|> TEXT ... <|im_end|> newline

Texts and roles are escaped: a control string inside them gets a backslash after its first character, one more than the
backslashes already there, so every text comes back exactly and no control string survives outside the marks. A role's
newlines and backslashes are written as backslash n and two backslashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: What follows the first character of a control string: this template's marks, and those of common other templates.
_REST = r"(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE, ESCAPED = rf"([<\[])(\\*){_REST}", rf"([<\[])\\(\\*){_REST}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    lines = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(lines, "\\"))


def format_chats(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, formatted, segments) of every conversation.

    ``segments`` holds the formatted text in order as (text, loss): loss is true for each assistant text and for nothing
    else. Null texts and roles are empty. Turns are ordered by turn number (null first), then role, then text; repeated
    rows are repeated turns. Rows with a null conversation form one conversation.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_turns = turns.select(F.col(key).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    positions = F.sequence(F.lit(1), F.size("turns"))
    first = F.filter(positions, lambda i: (i == 1) | (
        F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = sorted_turns.withColumn("first", first).withColumn("blocks", F.transform("first", lambda s, k: F.slice(
        "turns", s, F.coalesce(F.get(F.col("first"), k + 1), F.size("turns") + 1) - s)))

    def segments(block: Column) -> Column:
        name, loss = block[0]["role"], block[0]["role"] == LOSS_ROLE

        def mark(s: Column) -> Column:
            return F.struct(s.alias("text"), F.lit(False).alias("loss"))

        head = mark(F.concat(F.lit(START), _escape_role(name), F.lit("\n")))
        texts = F.transform(block, lambda t, i: F.array(
            F.when(i == 0, head).otherwise(mark(F.lit(SEP))), F.struct(escape(t["text"]).alias("text"), loss.alias("loss"))))
        return F.concat(F.flatten(texts), F.array(mark(F.lit(END + "\n"))))

    cut = runs.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(
            _unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """Figures read back from formatted conversations."""
    back = chats.withColumn("turns_", parse_chat(F.col("formatted"))).withColumn("loss_", loss_text(F.col("segments")))
    lines = F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns_").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_").cast("long").alias("loss_chars"), F.sha2(F.col("loss_").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_LENGTHS = r"'([<\[])(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'"

#: ``digests`` of all conversations and conversation -7 in SQL.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS first FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, {_LENGTHS})) + CASE WHEN first
    THEN {len(START) + len(END) + 2} + length(replace(replace(regexp_replace(role, {_LENGTHS}), '\\', '\\\\'), chr(10), '\\n'))
    ELSE {len(SEP)} END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
