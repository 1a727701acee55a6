"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn is an example of its own: all turns before it are its
context and only its text is trainable. A turn is formatted once, with its
place in the conversation's character stream; an example is the prefix of that
stream that ends with its reply, and its loss mask is the span of the reply's
text. ``write_examples`` writes every example in full, in rows of a block of
turns each, so that neither a long conversation nor a long example is one row
or one task, and reads the turns back from them. ``expand`` joins an example's
text into one row.

Template:  <|turn|>ROLE<|text|>TEXT<|end|>
Control strings inside roles and texts get a backslash after their first
character, and a backslash is doubled; dropping one backslash before any
character restores the original.

Defined results: a null text or role is empty; turns are ordered by turn
(nulls first), then role, then text, so ties and repeated rows have one
result; a conversation without assistant turns has no example but keeps its
turns; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
REPLY_ROLE = "assistant"
# Control strings of common chat templates; "<|" and "|>" cover the marks above.
CONTROLS = ("<|", "|>", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]")
#: Turn numbers that share a window; a longer conversation is dealt over several.
BLOCK_TURNS = 256
#: Turns of an example that share a row of the written examples.
EXAMPLE_TURNS = 32


def escape(c: F.Column) -> F.Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        c = F.replace(c, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return c


def unescape(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                 block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn: conv_id, turn_no (from 1), char_start, formatted, and for
    assistant turns example (from 1), n_context_turns, loss_start, loss_end
    (characters of the conversation's stream, end exclusive)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = turns.withColumns({
        "formatted": F.concat(head, escape(F.col("text")), F.lit(END)), "head_chars": F.length(head),
        "reply": (F.col("role") == REPLY_ROLE).cast("long"),
        "block": F.floor(F.coalesce("turn", F.lit(-1)) / block_turns)})
    turns = turns.withColumn("chars", F.length("formatted").cast("long"))
    # places within a block of turns, then the blocks' sums before it
    here = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumns({
        "no": F.row_number().over(here), "c0": F.coalesce(F.sum("chars").over(before), F.lit(0)),
        "r0": F.coalesce(F.sum("reply").over(before), F.lit(0))})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"),
                                                    F.sum("reply").alias("r"))
              .select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
                      *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in "ncr"]))
    placed = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    turn_no, start = F.col("no") + F.col("n_before"), F.col("c0") + F.col("c_before")
    is_reply = F.col("reply") == 1
    return placed.select(
        "conv_id", turn_no.alias("turn_no"), start.alias("char_start"), "formatted",
        F.when(is_reply, F.col("r0") + F.col("r_before") + 1).alias("example"),
        F.when(is_reply, turn_no - 1).alias("n_context_turns"),
        F.when(is_reply, start + F.col("head_chars")).alias("loss_start"),
        F.when(is_reply, start + F.col("chars") - len(END)).alias("loss_end"))


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: every example in full."""
    ends = turns.where("example is not null").select(
        F.col("conv_id").alias("e_conv"), "example", F.col("turn_no").alias("last"), "loss_start", "loss_end")
    prefix = turns.drop("example", "loss_start", "loss_end").join(
        ends, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("turn_no") <= F.col("last")))
    return (prefix.groupBy("conv_id", "example", "loss_start", "loss_end")
            .agg(F.array_sort(F.collect_list(F.struct("turn_no", "formatted"))).alias("t"))
            .select("conv_id", "example", F.array_join(F.col("t.formatted"), "").alias("text"), "loss_start", "loss_end"))


def read_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, text, loss_text: parsed from the formatted strings;
    loss_text is what lies under the loss mask, unescaped (null without a mask)."""
    pattern = r"(?s)^<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>$"
    masked = F.expr("substring(formatted, cast(loss_start - char_start + 1 as int), cast(loss_end - loss_start as int))")
    return turns.select("conv_id", "turn_no", unescape(F.regexp_extract("formatted", pattern, 1)).alias("role"),
                        unescape(F.regexp_extract("formatted", pattern, 2)).alias("text"),
                        F.when(F.col("loss_start").isNotNull(), unescape(masked)).alias("loss_text"),
                        F.length("formatted").alias("chars"))


def conversation_digest(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Per conversation, from the formatted turns: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_examples. A long conversation is joined block by block first."""
    def joined(order, *texts):
        return F.array_sort(F.collect_list(F.struct(order, *texts)))

    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    blocks = (read_turns(turns).withColumns({"said": said, "block": F.floor(F.col("turn_no") / block_turns)})
              .groupBy("conv_id", "block")
              .agg(joined("turn_no", "said", F.coalesce("loss_text", F.lit("")).alias("loss")).alias("t"),
                   F.sum("chars").alias("chars"), F.count("loss_text").alias("examples"))
              .select("conv_id", "block", F.array_join("t.said", "").alias("said"),
                      F.array_join("t.loss", "").alias("loss"), F.size("t").alias("n"), "chars", "examples"))
    whole = blocks.groupBy("conv_id").agg(joined("block", "said", "loss").alias("t"), F.sum("n").alias("n_turns"),
                                          F.sum("chars").alias("formatted_chars"), F.sum("examples").alias("n_examples"))
    loss = F.array_join("t.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("t.said", ""), 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                        "formatted_chars", "n_examples")


def example_blocks(turns: DataFrame, example_turns: int = EXAMPLE_TURNS) -> DataFrame:
    """Every example in full, a row per block of its turns: conv_id, example, block,
    first_turn, n_turns, char_start, text, and in the block of the reply loss_start and
    loss_end. Turns that no example holds (after the last reply) have a null example."""
    def block(turn_no):
        return F.floor((turn_no - 1) / example_turns)

    blocks = (turns.groupBy("conv_id", block(F.col("turn_no")).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("turn_no", "char_start", "formatted"))).alias("t")))
    one, last = F.lit(1).cast("long"), F.col("turn_no")
    replies = turns.where("example is not null").select(
        F.col("conv_id").alias("e_conv"), "example", one.alias("from_turn"), last.alias("to_turn"), "loss_start", "loss_end")
    unheld = (turns.groupBy("conv_id").agg(F.max("turn_no").alias("to_turn"),
                                           F.max(F.when(F.col("example").isNotNull(), last)).alias("held"))
              .select(F.col("conv_id").alias("e_conv"), F.lit(None).cast("long").alias("example"),
                      (F.coalesce("held", F.lit(0)) + one).alias("from_turn"), "to_turn",
                      F.lit(None).cast("long").alias("loss_start"), F.lit(None).cast("long").alias("loss_end"))
              .where("from_turn <= to_turn"))
    wanted = replies.unionByName(unheld).withColumn(
        "e_block", F.explode(F.sequence(block(F.col("from_turn")), block(F.col("to_turn")))))
    held = F.filter("t", lambda x: (x["turn_no"] >= F.col("from_turn")) & (x["turn_no"] <= F.col("to_turn")))
    ends_here = F.col("e_block") == block(F.col("to_turn"))
    return (blocks.join(wanted, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("block") == F.col("e_block")))
            .withColumn("t", held)
            .select("conv_id", "example", "block", F.col("t")[0]["turn_no"].alias("first_turn"),
                    F.size("t").alias("n_turns"), F.col("t")[0]["char_start"].alias("char_start"),
                    F.array_join("t.formatted", "").alias("text"),
                    F.when(ends_here, F.col("loss_start")).alias("loss_start"),
                    F.when(ends_here, F.col("loss_end")).alias("loss_end")))


def turns_of(examples: DataFrame) -> DataFrame:
    """The rows of ``format_turns``, cut out of written examples: a reply from the example
    that trains it, any other turn from the last example or the rows without one."""
    parts = examples.withColumn("t", F.split("text", r"(?=<\|turn\|>)"))
    reply = F.element_at("t", -1)
    turn_no = F.col("first_turn") + F.size("t") - 1
    replies = parts.where("loss_start is not null").select(
        "conv_id", turn_no.alias("turn_no"), (F.col("char_start") + F.length("text") - F.length(reply)).alias("char_start"),
        reply.alias("formatted"), "example", (turn_no - 1).alias("n_context_turns"), "loss_start", "loss_end")
    last = examples.groupBy("conv_id").agg(F.max("example").alias("l_example")).withColumnRenamed("conv_id", "l_conv")
    before = F.aggregate(F.slice("t", 1, F.col("i")), F.lit(0), lambda n, x: n + F.length(x))
    none = F.lit(None).cast("long")
    others = (parts.join(last, F.col("conv_id").eqNullSafe(F.col("l_conv")))
              .where("example is null or example = l_example")
              .select("conv_id", "first_turn", "char_start", "t", F.posexplode("t").alias("i", "formatted"))
              .where(~F.startswith("formatted", F.lit(TURN + REPLY_ROLE + TEXT)))
              .select("conv_id", (F.col("first_turn") + F.col("i")).alias("turn_no"),
                      (F.col("char_start") + before).alias("char_start"), "formatted", none.alias("example"),
                      none.alias("n_context_turns"), none.alias("loss_start"), none.alias("loss_end")))
    return replies.unionByName(others)


def write_examples(conversations: DataFrame, example_turns: int = EXAMPLE_TURNS, **kw) -> DataFrame:
    """Writes every example in full and returns the turns as read back from them."""
    turns = stored(format_turns(conversations, **kw), "chat-turns")
    return turns_of(stored(example_blocks(turns, example_turns), "chat-examples"))
