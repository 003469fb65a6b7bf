"""Chat formatting by prefix-target expansion: one example per assistant turn, all turns before it as context, only that reply trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the control strings of the template
_OPEN = "<turn "
_HEAD_END = ">\n"
_CLOSE = "\n</turn>\n"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """A backslash before each backslash and before each `<` that starts a control string."""
    return F.regexp_replace(text, r"\\|<(?=/?turn)", r"\\$0")


def escaped_role(role: Column) -> Column:
    """A backslash before everything that could end a turn's head or start a control string."""
    return F.regexp_replace(role, r"[\\<>\n]", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_chars) from rows (conv_id, turn, role, text).

    Every assistant turn gives one example: the conversation up to and with
    it, in which only its text is trainable (loss_start and loss_chars count
    code points of the example's text).  A conversation that doesn't end with
    an assistant turn gives one more example without a trainable part, so that
    no turn is lost.  Turns stand in the order of turn, then role, then text,
    null first; a null role or text is empty; repeated rows are turns of
    their own.  All rows without conv_id are one conversation.

    In escaped text the closing string, which starts with a line end and an
    unescaped sign, can't occur, so a split at it gives the turns back.  What
    is gathered in one row is one conversation, which is one text.
    """
    said = turns.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
    )
    talks = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("talk"))
    shaped = talks.select("conv_id", F.transform("talk", lambda t: F.struct(
        (t["role"] == TARGET_ROLE).alias("target"),
        F.concat(F.lit(_OPEN), escaped_role(t["role"]), F.lit(_HEAD_END)).alias("head"),
        escaped(t["text"]).alias("body"),
    )).alias("talk"))
    full = lambda t: F.concat(t["head"], t["body"], F.lit(_CLOSE))
    ends = shaped.select("conv_id", "talk", F.posexplode("talk").alias("at", "last")).where(F.col("last.target") | (F.col("at") == F.size("talk") - 1))
    before = F.array_join(F.transform(F.slice("talk", F.lit(1), F.col("at")), full), "")
    made = ends.select("conv_id", (F.col("at") + 1).cast("long").alias("n_turns"), "last", before.alias("before"))
    trainable = F.col("last.target")
    return made.select(
        "conv_id", F.col("n_turns").alias("example"), "n_turns", F.concat("before", full(F.col("last"))).alias("text"),
        F.when(trainable, F.char_length("before") + F.char_length("last.head")).cast("long").alias("loss_start"),
        F.when(trainable, F.char_length("last.body")).cast("long").alias("loss_chars"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    parts = F.filter(F.split(text, _CLOSE), lambda p: F.startswith(p, F.lit(_OPEN)))
    head = lambda p: F.instr(p, _HEAD_END)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring(p, F.lit(len(_OPEN) + 1), head(p) - len(_OPEN) - 1)).alias("role"),
        unescaped(F.substring(p, head(p) + len(_HEAD_END), F.char_length(p))).alias("text"),
    ))


def digests(made: DataFrame) -> DataFrame:
    """What formatted examples say, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come from the longest example, trainable text from every example in
    order; both are parsed from the text and unescaped.
    """
    whole = turns_of(F.col("longest"))
    trained = unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    per = made.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", trained.alias("reply"))))), lambda r: r["reply"]), "").alias("loss"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    ).withColumn("turns", whole)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
