"""Chat formatting as array expressions over collected turns.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role are merged into one block:

    <|turn|>role<|says|>text<|next|>text<|end|>

<|next|> parts the texts of merged turns, so every turn can be read back. Inside roles and texts each control string,
our own or one of the usual ones of other templates, gets a backslash behind its first character, and strings that
already look so get one more; taking one off again restores every text. The loss mask is the list of (start, length) of
the assistant texts in the formatted string, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let

TURN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
#: What follows the first character, < or [, in a control string.
_REST = r"(\||/?s>|</?SYS>>|/?SYS>>|/?INST\]|/?TOOL)"
_ESCAPE = rf"([<\[])(\\*){_REST}"
_UNESCAPE = rf"([<\[])\\(\\*){_REST}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns with one role, from an ordered array of (role, text)."""
    def starts(ts: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (
            (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"])))

    def blocks(ts: Column, at: Column) -> Column:
        return F.transform(at, lambda s, k: F.struct(
            F.get(ts, s)["role"].alias("role"),
            F.transform(F.slice(ts, s + 1, F.coalesce(F.get(at, k + 1), F.size(ts)) - s), lambda t: t["text"]).alias("texts")))

    return let(turns, lambda ts: let(starts(ts), lambda at: blocks(ts, at)))


def format_blocks(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(
        F.lit(TURN), escape(b["role"]), F.lit(SAYS), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(END))), "")


def loss_spans(blocks: Column, role: str = "assistant") -> Column:
    """(start, length) of each text of the role in the formatted string, counted in code points from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def text(state: Column, raw: Column, counts: Column) -> Column:
        size = F.length(escape(raw))
        span = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct((state["at"] + size + len(NEXT)).alias("at"),
                        F.when(counts, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def block(state: Column, b: Column) -> Column:
        opened = F.struct((state["at"] + len(TURN) + F.length(escape(b["role"])) + len(SAYS)).alias("at"),
                          state["spans"].alias("spans"))
        return F.aggregate(
            b["texts"], opened, lambda s, t: text(s, t, b["role"] == role),
            lambda s: F.struct((s["at"] - len(NEXT) + len(END)).alias("at"), s["spans"].alias("spans")))

    return F.aggregate(blocks, start, block, lambda s: s["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv_id, formatted, loss.

    One shuffle on conv_id. A conversation is one output string, so it has to fit in a row; nothing else is collected.
    Null roles and texts are empty strings. Turns are ordered by (turn, role, text), null turns first, so ties and
    repeated rows have one defined order and all stay. Rows without conv_id cannot be brought together: each is a
    conversation of its own, with null conv_id. Other columns are ignored. An empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = rows.filter(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("turns"))
    blocks = known.unionByName(alone).select("conv_id", merged(F.col("turns")).alias("blocks"))
    return blocks.select("conv_id", format_blocks(F.col("blocks")).alias("formatted"), loss_spans(F.col("blocks")).alias("loss"))


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped and with merged turns apart."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(TURN) + 1)), SAYS, 1)
        texts = F.substr(block, F.length(role) + F.lit(len(TURN) + len(SAYS) + 1))
        return F.transform(F.split(texts, r"<\|next\|>"), lambda t: F.struct(
            unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss
      FROM c GROUP BY conv_id),
e AS (SELECT conv_id, turn, role, text, regexp_replace(role, '([<\\[])(\\\\*)(\\||/?s>|</?SYS>>|/?SYS>>|/?INST\\]|/?TOOL)', '\\1\\\\\\2\\3', 'g') AS er,
             regexp_replace(text, '([<\\[])(\\\\*)(\\||/?s>|</?SYS>>|/?SYS>>|/?INST\\]|/?TOOL)', '\\1\\\\\\2\\3', 'g') AS et,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
f AS (SELECT conv_id, sum(length(et) + 8 * CASE WHEN before = role THEN 1 ELSE 0 END
                          + CASE WHEN before = role THEN 0 ELSE 23 + length(er) END) AS n FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(f.n AS BIGINT) AS formatted_chars
FROM a JOIN f USING (conv_id)
"""
