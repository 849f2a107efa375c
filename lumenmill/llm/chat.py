"""Chat formatting with DataFrame expressions only.

Turns are collected per conversation and sorted; adjacent turns of one role form a block whose texts are joined by
an array aggregation. Template of a block::

    <|turn|>ROLE<|text|>TEXT(<|next|>TEXT)*<|end|>

Control strings in roles and texts get a backslash after their first character, and backslashes are doubled, so the
output can be read back without loss. ``loss_mask`` has, for each block in order, how many characters of it to skip and
how many to train on.

Edge cases: a null role or text is empty; a null turn sorts first; equal turns sort by role, then text; repeated rows
are repeated turns; rows with a null conv_id form one conversation (a conversation is
one string, so its turns meet in one row by definition); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of common templates, this one's included by its first two characters.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Make control strings inert; :func:`unescape` is the inverse."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Drop the backslash of each escaped pair."""
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to (conv_id, formatted, loss_mask)."""
    empty = F.lit("")
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", empty).alias("role"),
            F.coalesce("text", empty).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i).role != F.get("ts", i - 1).role),
    )
    chats = chats.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("ts"))
        part = F.slice("ts", start + 1, stop - start)
        return F.struct(
            F.get("ts", start).role.alias("role"),
            F.concat(F.lit(TURN), escape(F.get("ts", start).role), F.lit(TEXT)).alias("head"),
            F.array_join(F.transform(part, lambda t: escape(t.text)), NEXT).alias("body"),
        )

    chats = chats.withColumn("blocks", F.transform("starts", block))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b.body, F.lit(END))), "").alias("formatted"),
        F.transform(
            "blocks",
            lambda b: F.struct(
                F.char_length(b["head"]).alias("skip"),
                F.when(b.role == loss_role, F.char_length(b.body)).otherwise(0).alias("take"),
            ),
        ).alias("loss_mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Parse formatted conversations: adds ``turns`` (role, text), in order, and ``loss_texts`` under the mask."""
    blocks = F.slice(F.split("formatted", F.lit(r"<\|end\|>"), -1), 1, F.size("loss_mask"))

    def parse(b: Column) -> Column:
        parts = F.split(b, r"<\|text\|>", 2)
        role = unescape(F.substr(F.get(parts, F.lit(0)), F.lit(len(TURN) + 1)))
        return F.transform(
            F.split(F.get(parts, F.lit(1)), r"<\|next\|>", -1),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    masked = F.zip_with(
        "_blocks", "loss_mask", lambda b, m: F.struct(m["take"].alias("take"), F.substr(b, m["skip"] + 1, m["take"]).alias("text"))
    )
    return (
        chats.withColumn("_blocks", blocks)
        .withColumn("turns", F.flatten(F.transform("_blocks", parse)))
        .withColumn(
            "loss_texts",
            F.flatten(
                F.transform(
                    F.filter(masked, lambda m: m["take"] > 0),
                    lambda m: F.transform(F.split(m.text, r"<\|next\|>", -1), unescape),
                )
            ),
        )
        .drop("_blocks")
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the conversation -7 of control strings, formatted and read back."""
    probe = spark.sql(
        "SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES "
        "(-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_chats(turns))
    loss = F.array_join("loss_texts", "")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(x, '\\', '\\\\')"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(({_ESCAPED.replace('x', 'text', 1)})) AS text_chars, length(({_ESCAPED.replace('x', 'role', 1)})) AS role_chars,
    (before IS NULL OR before <> role) AS opens FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN opens THEN role_chars + {len(TURN + TEXT + END)} ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
