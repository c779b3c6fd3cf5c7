"""Operator 10: chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, cut into blocks of adjacent turns with
the same role, and concatenated::

    <s>[TURN role]text[+]text of the same role[/TURN][TURN role]text[/TURN]...</s>

Every control string starts with ``<`` or ``[``. In texts and roles each of these characters,
and the escape character itself, is followed by ``ESCAPE``, so no control string of this or any
other bracketed template survives in a text, and dropping single escapes restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"
BEGIN, END, OPEN, CLOSE, SAME = "<s>", "</s>", "[TURN ", "[/TURN]", "[+]"
_ROLE_END = "<!"  # stands for ] in a role: no other < is without its escape


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"([{ESCAPE}<\\[])", f"$1{ESCAPE}")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def format_conversations(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row per conversation.

    ``loss_mask`` lists runs of ``formatted`` as structs (chars, loss) in code points; together
    they cover it. Turns are ordered by turn number (null first), then role, then text, so ties
    and repeated rows have a fixed place; each stays a turn of its own. Null texts and roles are
    empty; a null conversation id is a conversation. Extra columns are ignored and an empty table
    gives an empty result.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda k: (k == 0) | (F.col("t")[k]["role"] != F.col("t")[F.greatest(k - 1, F.lit(0))]["role"]))
    cut = sorted_turns.withColumn("at", begins)
    blocks = cut.select("conv_id", F.transform("at", lambda b, k: F.slice("t", b + 1, F.coalesce(F.get("at", k + 1), F.size("t")) - b)).alias("blocks"))

    def segments(block: Column) -> Column:
        """The strings of a block in order, each with its part in the loss."""
        role = block[0]["role"]
        head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("]"), F.lit(_ROLE_END)), F.lit("]"))
        said = F.transform(block, lambda t, k: F.array(F.struct(F.when(k == 0, head).otherwise(F.lit(SAME)).alias("text"), F.lit(False).alias("loss")), F.struct(escaped(t["text"]).alias("text"), role.isin(*loss_roles).alias("loss"))))
        return F.concat(F.flatten(said), F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))))

    def plain(text: str) -> Column:
        return F.array(F.struct(F.lit(text).alias("text"), F.lit(False).alias("loss")))

    parts = blocks.select("conv_id", F.concat(plain(BEGIN), F.flatten(F.transform("blocks", segments)), plain(END)).alias("parts"))
    return parts.select("conv_id", F.array_join(F.col("parts.text"), "").alias("formatted"), F.transform("parts", lambda p: F.struct(F.char_length(p["text"]).alias("chars"), p["loss"].alias("loss"))).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs (role, text)."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted) - len(BEGIN) - len(END))
    blocks = F.filter(F.split(body, r"\[/TURN\]"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.regexp_extract(block, r"^\[TURN ([^\]]*)\]", 1)
        role = unescaped(F.replace(head, F.lit(_ROLE_END), F.lit("]")))
        texts = F.split(F.substring(block, F.char_length(head) + len(OPEN) + 2, F.char_length(block)), r"\[\+\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between its runs."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("said"))
    step = F.aggregate(mask, zero, lambda acc, m: F.struct((acc["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.array_append(acc["said"], F.substring(formatted, acc["at"] + 1, m["chars"]))).otherwise(acc["said"]).alias("said")))
    return unescaped_join(step["said"])


def unescaped_join(said: Column) -> Column:
    return F.array_join(F.transform(said, unescaped), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from the output of ``format_conversations``."""
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
