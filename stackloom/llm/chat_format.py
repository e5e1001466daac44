"""Perspective rotation of multi-party dialogues, by DataFrame functions alone.

For every speaker of a conversation the whole dialogue is rendered once more with
that speaker as assistant, all others as named users, and the character ranges the
speaker's turns take (text and end mark) as the training mask.  System turns are
rendered for everyone and are nobody's perspective.

A conversation may be any share of the table, so one rendering comes in parts of
`part_turns` turns, a row each.  Parts are cut from the whole: their texts joined
by part number are the whole rendering, `start` is a part's place in it, and masks
count from the start of the whole, so whole_dialogues() only puts them together.
A dialogue of up to `part_turns` turns is one part.

1. Turns are put in order by a range partitioning, which splits a conversation
   and turns that share a number; a turn's number in its conversation is its place
   in its range plus the turns of that conversation in the ranges before.  No more
   conversations span ranges than there are ranges, so that table is broadcast.
2. Parts are gathered by (conversation, part); what a part adds to a rendering
   follows from lengths alone, and is summed over parts in rows without texts.
3. Speakers meet parts by (conversation, part).

Order: turn (null first), role, text.  Edge cases: a null role is the speaker
`unknown`; a null text is empty; a null conversation id is a conversation of its
own; ties and repeated rows are rendered again, next to each other; a very long
text is part of one row; a conversation of system turns alone gives no rows; extra
columns are ignored and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.scratch import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART_TURNS = 64


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns (conv_id, turn, role, text) with rn, a turn's number in its conversation, from 0."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    # written, so that a turn keeps its range
    placed = scratch.write(placed, "placed").withColumn("piece", F.shiftright("seq", 33))
    pieces = scratch.write(placed.groupBy("conv_id", "piece").agg(F.count("*").alias("n"), F.min("seq").alias("seq0")), "pieces")
    ends = pieces.groupBy("piece").agg(F.min_by("conv_id", "seq0").alias("first"), F.max_by("conv_id", "seq0").alias("last"))
    # a conversation that goes on in the next range is the last of its range
    spans = pieces.alias("p").join(F.broadcast(ends).alias("e"), (F.col("p.piece") == F.col("e.piece")) & (F.col("p.conv_id").eqNullSafe(F.col("e.first")) | F.col("p.conv_id").eqNullSafe(F.col("e.last"))))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("p.conv_id", "p.piece", "n").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before > 0")
    spans = scratch.write(spans.select(F.col("conv_id").alias("s_conv"), F.col("piece").alias("s_piece"), "before"), "spans")
    inside = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("seq")) - 1
    numbered = placed.withColumn("rn", inside).join(F.broadcast(spans), F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("piece") == F.col("s_piece")), "left")
    return numbered.select("conv_id", "role", "text", (F.col("rn") + F.coalesce("before", F.lit(0))).cast("long").alias("rn"))


def rotate_perspectives(
    turns: DataFrame, part_turns: int = PART_TURNS, system_role: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, speaker, part, start, n_turns, n_target_chars, rendered, mask): mask is "from-to,..." in code points of the whole dialogue, in which rendered stands at start."""
    scratch = Scratch(turns.sparkSession, "chat")
    t = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    t = _numbered(t, scratch).withColumn("part", F.floor(F.col("rn") / part_turns).cast("long"))

    def head(role):
        return F.when(role == system_role, F.lit("system")).otherwise(F.concat(F.lit("user name="), role))

    frame = len(OPEN) + len("\n") + len(CLOSE)
    parts = t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("rn", "role", "text"))).alias("turns"))
    parts = scratch.write(parts, "parts")
    own = parts.select("conv_id", "part", F.explode("turns").alias("x")).select("conv_id", "part", F.col("x.role").alias("role"), F.length("x.text").alias("n"))
    own = scratch.write(own.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.col("n") + frame + F.length(head(F.col("role")))).alias("chars")), "own")
    # lengths as if nobody were the speaker, and what a speaker's own turns are shorter by
    plain = own.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    speakers = own.filter(F.col("role") != system_role).select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    grid = plain.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    mine = own.select(F.col("conv_id").alias("conv"), F.col("part").alias("at"), F.col("role").alias("who"), F.col("n").alias("mine"))
    grid = grid.join(mine, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("at")) & (F.col("speaker") == F.col("who")), "left")
    shorter = F.length("speaker") + len("user name=") - len("assistant")
    grid = grid.select("conv_id", "speaker", "part", (F.col("chars") - F.coalesce("mine", F.lit(0)) * shorter).alias("chars"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("long"))
    grid = scratch.write(grid.select(F.col("conv_id").alias("conv"), "speaker", F.col("part").alias("at"), "start"), "grid")
    both = parts.join(grid, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("at")))

    def body(x):
        return F.concat(F.lit(OPEN), F.when(x["role"] == F.col("speaker"), F.lit("assistant")).otherwise(head(x["role"])), F.lit("\n"))

    segments = F.transform("turns", lambda x: F.struct(body(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["role"] == F.col("speaker")).alias("own")))
    s = both.select("conv_id", "speaker", "part", "start", segments.alias("s"))
    zero = F.struct(F.col("start").alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"]) - 1
        spans = F.when(x["own"], F.concat(acc["spans"], F.array(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))).otherwise(acc["spans"])
        return F.struct((b + 1).alias("at"), F.when(x["own"], acc["n"] + b - a).otherwise(acc["n"]).alias("n"), spans.alias("spans"))

    s = s.withColumn("acc", F.aggregate("s", zero, step))
    return s.select(
        "conv_id", "speaker", "part", "start", F.size("s").cast("long").alias("n_turns"), F.col("acc.n").alias("n_target_chars"),
        F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"), F.array_join("acc.spans", ",").alias("mask"),
    )


def whole_dialogues(parts: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, n_target_chars, rendered, mask): the parts of rotate_perspectives put together, for callers whose dialogues fit a row."""
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("part", c))), lambda x: x[c])
    masks = F.filter(in_order("mask"), lambda x: x != "")
    return parts.groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_target_chars").alias("n_target_chars"), F.array_join(in_order("rendered"), "").alias("rendered"), F.array_join(masks, ",").alias("mask"))
