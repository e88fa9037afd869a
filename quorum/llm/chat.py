r"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it as context, and only
its text trainable. A turn is written as

    <turn>ROLE<says>TEXT</turn>\n

where roles and texts have ``\`` written as ``\\`` and ``<`` as ``\l``, so that no marker can
occur inside them and the original comes back exactly.

A conversation that does not end with an assistant turn has one more example, of all its
turns, with nothing trainable, so that the output holds every turn. Examples of a conversation
of n turns hold up to n * n / 2 turns together: that is what the expansion asks for.

* null texts and roles count as empty. Turns of equal number stand in the order of role and
  text; null numbers come first. Repeated rows are turns of their own.
* rows with a null id are one conversation. Extra columns are not read.
* an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Escaped text holds no ``<``, which can therefore stand for a backslash on the way."""
    halfway = F.replace(F.replace(text, F.lit("\\\\"), F.lit("<")), F.lit("\\l"), F.lit("\\"))
    return F.translate(halfway, "<\\", "\\<")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(SAYS), escape(text), F.lit(CLOSE))


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``target`` (number of the last turn, from 1), ``formatted``, ``loss_start`` and
    ``loss_end`` (code points of ``formatted``, end exclusive; null if nothing is trainable)."""
    turns = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rendered = grouped.select(
        "conv_id",
        F.transform("t", lambda t: t["role"] == ASSISTANT).alias("_trains"),
        F.transform("t", lambda t: F.length(escape(t["text"]))).alias("_length"),
        F.transform("t", lambda t: render(t["role"], t["text"])).alias("_turns"),
    )
    n = F.size("_turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("_trains", i - 1) | (i == n))
    one = rendered.select("conv_id", "_trains", "_length", "_turns", F.explode(targets).alias("target"))
    one = one.select(
        "conv_id",
        "target",
        F.array_join(F.slice("_turns", F.lit(1), F.col("target")), "").alias("formatted"),
        F.when(F.get("_trains", F.col("target") - 1), F.get("_length", F.col("target") - 1)).alias("_n"),
    )
    end = F.length("formatted") - len(CLOSE)
    return one.select(
        "conv_id",
        "target",
        "formatted",
        F.when(F.col("_n").isNotNull(), end - F.col("_n")).alias("loss_start"),
        F.when(F.col("_n").isNotNull(), end).alias("loss_end"),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text, as it was before formatting; null if there is none."""
    return unescape(F.substring(formatted, start + 1, end - start))


def parse(formatted: Column) -> Column:
    """The turns of an example as an array of (role, text)."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substring(t, len(OPEN) + 1, F.length(t)), SAYS, 1)).alias("role"),
            unescape(F.substring_index(t, SAYS, -1)).alias("text"),
        ),
    )
