"""Chat formatting with a loss mask, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged into a block; the blocks are concatenated:

    <s>[INST]role[/INST]text<turn>text</s>

The strings ``<s> </s> <turn> [INST] [/INST]`` mark turns. Where a text or a role holds
one of them, a backslash is put behind its first character, and one more where there
are some already, so no text can open or close a turn and `turns` gives back every
text as it was. The loss mask holds the places of the trained role's texts, in code
points of the formatted string, without any mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEADED, NEXT, CLOSE = "<s>[INST]", "[/INST]", "<turn>", "</s>"
_MARK_TAIL = r"(/?s>|turn>|/?INST\])"
_MARK = r"([<\[])(\\*+)" + _MARK_TAIL
_ESCAPED = r"([<\[])\\(\\*+)" + _MARK_TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def merged(turns: Column) -> Column:
    """Blocks ``(role, texts)`` of a sorted array of turns: adjacent turns of one role become one."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    heads = F.filter(at, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(turns)))

    def block(head: Column, end: Column) -> Column:
        texts = F.transform(F.slice(turns, head + 1, end - head), lambda t: t["text"])
        return F.struct(F.get(turns, head)["role"].alias("role"), texts.alias("texts"))

    return F.zip_with(heads, ends, block)


def _spans(blocks: Column, trained: str) -> Column:
    """Places of the trained role's texts, the blocks being escaped already."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def over_text(at: Column, text: Column) -> Column:
        end = at["at"] + F.length(text)
        return F.struct(
            (end + len(NEXT)).alias("at"),
            F.concat(at["spans"], F.array(F.struct(at["at"].alias("start"), end.alias("end")))).alias("spans"),
        )

    def over_block(at: Column, block: Column) -> Column:
        body = at["at"] + len(OPEN) + F.length(block["role"]) + len(HEADED)
        length = F.length(F.array_join(block["texts"], NEXT))
        inside = F.when(
            block["role"] == trained,
            F.aggregate(block["texts"], F.struct(body.alias("at"), at["spans"].alias("spans")), over_text)["spans"],
        ).otherwise(at["spans"])
        return F.struct((body + length + len(CLOSE)).alias("at"), inside.alias("spans"))

    return F.aggregate(blocks, start, over_block)["spans"]


def format_chats(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """Rows ``(conversation, formatted, loss_spans)``, one for each conversation.

    ``loss_spans`` are structs ``(start, end)``, end exclusive. Null texts and roles count
    as empty. Turns go by number, null first; equal numbers by role, then text; repeated
    rows are turns of their own. Rows without a conversation are one conversation of
    that name. Other columns play no part. An empty table gives no rows.
    """
    entry = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    collected = turns.select(F.col(conversation).alias("conversation"), entry.alias("entry")).groupBy("conversation").agg(
        F.sort_array(F.collect_list("entry")).alias("turns")
    )
    blocks = collected.select("conversation", merged(F.col("turns")).alias("blocks"))
    escaped = blocks.select(
        "conversation",
        F.transform("blocks", lambda b: F.struct(
            escape(b["role"]).alias("role"), F.transform(b["texts"], escape).alias("texts")
        )).alias("blocks"),
    )
    written = F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), b["role"], F.lit(HEADED), F.array_join(b["texts"], NEXT), F.lit(CLOSE)
    ))
    return escaped.select(
        F.col("conversation").alias(conversation), F.array_join(written, "").alias("formatted"),
        _spans(F.col("blocks"), trained).alias("loss_spans"),
    )


def turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted string, as they were before."""
    blocks = F.split(formatted, r"\Q" + CLOSE + r"\E")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last mark

    def read(block: Column) -> Column:
        head = F.substring_index(block, HEADED, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + len(HEADED) + 1)
        return F.transform(F.split(body, r"\Q" + NEXT + r"\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, as they were before."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
