"""Chat formatting with Spark expressions only.

One row per turn goes in, one formatted string per conversation comes out:
the turns of a conversation are collected as structs and sorted, neighbouring
turns of the same role are merged into one block with array functions, and
the blocks are concatenated (time and memory in proportion to the text). No Python runs on the executors.

Template (fixed values)::

    <turn ROLE>TEXT<next>TEXT</turn>\\n

``<next>`` parts the merged turns of a block, so that merging loses nothing.
Roles and texts are escaped so that none of the template's marks can occur in
them: a backslash becomes ``\\b``, ``<`` becomes ``\\l``, ``>`` becomes ``\\g``.
In an escaped text every backslash is followed by b, l or g, so undoing l and g
first and b last restores the text exactly, whatever it held.

Defined cases: a null text is the empty string, a null role the empty role.
Turns are ordered by (turn, role, text), nulls first; repeated rows are kept as
turns of their own. Rows with a null conversation id form one conversation with
a null id. An empty table gives no rows; other columns are ignored. One
conversation's output is one string, so it is the unit that has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, NEXT, END = "<turn ", ">", "<next>", "</turn>\n"
#: The code that stands for each escaped character, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted): every conversation as one string of the template."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"),
                 F.coalesce(F.col(text), F.lit("")).alias("x")).alias("row"))
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def piece(row: Column, i: Column) -> Column:
        merged = (i > 0) & (F.get("rows", i - 1)["r"] == row["r"])
        opening = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(OPEN), escape(row["r"]), F.lit(SHUT))
        return F.concat(F.when(merged, F.lit(NEXT)).otherwise(opening), escape(row["x"]))

    return collected.select("conv_id", F.concat(F.array_join(F.transform("rows", piece), ""), F.lit(END)).alias("formatted"))


def _blocks(formatted: Column) -> Column:
    """The blocks of a formatted string: role and texts, both still escaped."""
    return F.transform(
        F.filter(F.split(formatted, END), lambda b: b != ""),
        lambda b: F.struct(F.substring(b, F.lit(len(OPEN) + 1), F.instr(b, SHUT) - len(OPEN) - 1).alias("role"),
                           F.split(F.substr(b, F.instr(b, SHUT) + 1), NEXT).alias("texts")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns as an array of (role, text) in
    order, parsed from the formatted string alone."""
    turns = F.flatten(F.transform(_blocks(F.col("formatted")), lambda b: F.transform(
        b["texts"], lambda x: F.struct(unescape(b["role"]).alias("role"), unescape(x).alias("text")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def loss_mask(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): the formatted string cut into segments
    (piece, loss) that join to the whole string again; loss is true on the texts
    of ``role``, one segment per turn, and on nothing else."""
    def segments(b: Column) -> Column:
        def parts(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), b["role"], F.lit(SHUT)))
            after = F.when(i == F.size(b["texts"]) - 1, F.lit(END)).otherwise(F.lit(""))
            return F.array(F.struct(before.alias("piece"), F.lit(False).alias("loss")),
                           F.struct(x.alias("piece"), (unescape(b["role"]) == role).alias("loss")),
                           F.struct(after.alias("piece"), F.lit(False).alias("loss")))
        return F.flatten(F.transform(b["texts"], parts))
    return formatted.select("conv_id", "formatted",
                            F.flatten(F.transform(_blocks(F.col("formatted")), segments)).alias("mask"))


def conversation_digest(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """The contract's digest columns, all read back from the formatted string."""
    both = loss_mask(formatted, role).select(F.struct("conv_id", "mask").alias("conv_id"), "formatted")
    back = read_back(both)
    loss = F.array_join(F.transform(F.filter("conv_id.mask", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
