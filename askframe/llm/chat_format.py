"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role are merged into a block;
blocks are marked and concatenated. A block reads

    <s>[ROLE name]first text[NEXT]second text</s>

with ``name`` URL-encoded. Control strings inside a text get a backslash after their
first character, and one more if they have some already, so every text comes back unchanged. The loss mask holds
the place of each assistant text, without marks, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and those of common chat templates, after their first character and any backslashes.
REST = r"(/?s>|/?INST\]|NEXT\]|ROLE|<SYS>>|</SYS>>|/?SYS\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>)"
START, NEXT, END = "<s>[ROLE ", "[NEXT]", "</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, r"$1$2$3")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` string, ``loss_mask`` array<struct<start, length>>.

    Turns go by ``turn`` (null first), then role and text, so ties and repeated rows have one order. A null
    text is empty, a null role is the empty role. ``start`` counts code points from 0 in ``formatted``.
    Rows with a null conversation make one conversation. A conversation becomes one string, so its turns
    meet in one row; nothing else does. Other columns are not read. An empty table gives an empty result.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    x = df.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    x = x.withColumn("safe", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))))
    # where a run of one role begins, and the run itself
    n = F.size("safe")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("safe", i)["role"] != F.element_at("safe", F.greatest(i - 1, F.lit(1)))["role"]))
    x = x.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(n + 1))
    runs = F.zip_with("begins", ends, lambda b, e: F.slice("safe", b, e - b))
    x = x.withColumn("runs", runs)
    blocks = F.transform(
        "runs",
        lambda r: F.struct(
            F.concat(F.lit(START), F.url_encode(r[0]["role"]), F.lit("]")).alias("head"),
            F.array_join(F.transform(r, lambda t: t["text"]), NEXT).alias("body"),
            F.when(r[0]["role"] == TRAINED, F.transform(r, lambda t: F.length(t["text"]))).otherwise(F.lit(None).cast("array<int>")).alias("lengths"),
        ),
    )
    x = x.withColumn("blocks", blocks)
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit(END))), "")
    span = "struct<start:int,length:int>"
    # walk the blocks, keeping the place and the spans so far
    def walk(state: Column, b: Column) -> Column:
        at = state["at"] + F.length(b["head"])
        own = F.aggregate(
            F.coalesce(b["lengths"], F.array().cast("array<int>")),
            F.struct(at.alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
            lambda s, k: F.struct((s["at"] + k + len(NEXT)).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), k.alias("length")))).alias("spans")),
        )
        return F.struct((at + F.length(b["body"]) + len(END)).alias("at"), F.concat(state["spans"], own["spans"]).alias("spans"))

    mask = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")), walk)["spans"]
    return x.select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.regexp_extract_all(formatted, F.lit(r"(?s)<s>\[ROLE [^\]]*\].*?</s>"), F.lit(0))
    pattern = r"(?s)^<s>\[ROLE ([^\]]*)\](.*)</s>$"
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_extract(b, pattern, 2), r"\[NEXT\]", -1),
                lambda t: F.struct(F.url_decode(F.regexp_extract(b, pattern, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
