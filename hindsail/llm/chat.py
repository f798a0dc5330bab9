"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is under the loss mask. A conversation that does
not end with an assistant turn gets one more example that holds it whole and
trains nothing, so no turn is lost.

Template of a turn: `<|im_start|>role\\ntext<|im_end|>\\n`. In texts and roles a
backslash is doubled and `<|` is written `<\\|`, so no text can forge a mark and
unescape() gives it back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A newline is written backslash n; a doubled backslash is looked at first, so the two never mix."""
    return F.array_join(F.transform(F.split(F.replace(role, F.lit("<\\|"), F.lit("<|")), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """Examples of conversations(conv_id, turn, role, text): conv_id, example int, n_turns int, formatted string, loss_start long, loss_end long (code points, end exclusive; both null where nothing is trained).

    Turns are ordered by turn, then role and text; rows that repeat a turn are
    turns of their own. A null text or role counts as empty, a null conv_id is
    a conversation, a null turn comes first. Extra columns are left out. One
    example is one row, and its prefixes are built inside the window over its
    conversation: one shuffle, on conv_id.
    """
    plain = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escape(F.col("text"))
    marked = plain.select(
        "conv_id",
        (F.col("role") == "assistant").alias("reply"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), body, F.lit(END)).alias("block"),
        F.char_length(body).alias("size"),
        F.row_number().over(order).alias("n_turns"),
        F.lead(F.lit(True)).over(order).isNull().alias("last"),
        "turn", "role", "text",
    )
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = marked.select("conv_id", "reply", "last", "size", "n_turns", F.sum(F.col("reply").cast("int")).over(upto).alias("replies"), F.collect_list("block").over(upto).alias("blocks"))
    examples = whole.where(F.col("reply") | F.col("last"))
    text = F.array_join("blocks", "")
    end = F.char_length("formatted") - len(END)
    return (
        examples.withColumn("formatted", text)
        .select(
            "conv_id",
            (F.col("replies") - F.col("reply").cast("int")).cast("int").alias("example"),
            "n_turns",
            "formatted",
            F.when(F.col("reply"), end - F.col("size")).cast("long").alias("loss_start"),
            F.when(F.col("reply"), end).cast("long").alias("loss_end"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What format_chats() wrote, by conversation, from formatted texts and masks alone: conv_id, n_turns, turns (array of role and text), loss_text, formatted_chars.

    The longest example holds all turns; the masked parts of all examples, in
    order, are the assistant texts.
    """
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", F.struct("n_turns", "example")).alias("formatted"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(masked.isNotNull(), F.struct("example", masked.alias("part"))))).alias("parts"),
    )
    blocks = F.split("formatted", r"<\|im_end\|>\n")
    turn = lambda b: F.struct(
        unescape_role(F.substring_index(F.substring(b, len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, "\n") + 1, F.lit(1 << 30))).alias("text"),
    )
    return by.select("conv_id", F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turn).alias("turns"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("loss_text"), "formatted_chars").withColumn("n_turns", F.size("turns").cast("long"))
