"""Chat formatting with prefix-target expansion: every assistant turn becomes an example of its own.

A conversation is formatted once. Its examples are prefixes of that text, each ending after one assistant reply, and only
that reply is trainable; so an example is kept as three numbers, context_chars, loss_start and loss_chars, and
expand_examples() cuts out its text. Stored text therefore grows with the conversation, not with its square.

Template: `### role: text </turn>` and a line feed for every turn. In roles and texts a backslash goes before each
backslash, `#` and `<` (in roles also `:`), so that control strings appear only where the template puts them;
unescape() takes these backslashes away. DataFrame functions only.

Defined results for odd input: null role or text is empty; a null conv_id is a conversation; turns are in order of turn
(null first), then role, then text, so that ties and repeated rows have one result, and all of them are turns; a
conversation without assistant turns has no examples; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = " </turn>\n"


def escape(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, formatted, examples): examples is an array of (example_no, turn_no, context_chars, loss_start, loss_chars).

    Offsets count code points from 0. A conversation's turns meet in one row, as its text has to be one string."""
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn(
        "parts",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit("### "), escape(t["role"], ":"), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == assistant).alias("reply"))),
    ).drop("turns")
    whole = whole.withColumn("formatted", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    whole = whole.withColumn("sizes", F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["reply"].alias("reply")))).drop("parts")
    spans = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn_no:int,context_chars:int,loss_start:int,loss_chars:int>>").alias("spans"), F.lit(0).alias("turn_no")),
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(END)).alias("at"),
            F.when(
                s["reply"],
                F.concat(acc["spans"], F.array(F.struct(acc["turn_no"].alias("turn_no"), acc["at"].alias("context_chars"), (acc["at"] + s["head"]).alias("loss_start"), s["body"].alias("loss_chars")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
            (acc["turn_no"] + 1).alias("turn_no"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select("conv_id", "formatted", spans.alias("examples"))


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example_no, turn_no, text, loss_start, loss_chars. text is all turns before the reply, and the reply."""
    rows = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example_no", "e"))
    end = F.col("e.loss_start") + F.col("e.loss_chars") + len(END)
    return rows.select("conv_id", "example_no", "e.turn_no", F.substring("formatted", F.lit(1), end).alias("text"), "e.loss_start", "e.loss_chars")


def read_turns(formatted: Column) -> Column:
    """An array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    head = r"(?s)^### ((?:\\.|[^\\:])*): "
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def read_losses(formatted: Column, examples: Column) -> Column:
    """An array of the trainable texts, unescaped, in order."""
    return F.transform(examples, lambda e: unescape(F.substring(formatted, e["loss_start"] + 1, e["loss_chars"])))
