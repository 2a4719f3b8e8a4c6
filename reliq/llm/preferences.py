"""Chat formatting of preferences: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (same place, role and text) is rendered once as the prompt; what follows in each
conversation is its completion. A turn reads as opening tag with the role, line break, text, closing tag, line break. The mask
of a completion lists the spans (start, end in characters) that are learned: the texts of its assistant turns, with the closing
tag. If a conversation ends inside the common prefix its completion is empty; no span of the prompt is learned.

Everything is native: turns get their places by window, the first difference by aggregation, texts by ordered aggregation of
each conversation, which must fit a row because its rendering does.

Defined cases: null texts and roles read as empty; null conversation ids take no part; turns with null numbers come first;
repeated turn numbers keep an order by role and text, repeated rows are turns of their own; a pair needs both conversations;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|done|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def preferences(turns: DataFrame, pair: Column, is_chosen: Column, learned_role: str = "assistant") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) per pair.

    turns: (conv_id, turn, role, text). ``pair`` and ``is_chosen`` read ``conv_id``; a conversation is one side of one pair.
    """
    order = Window.partitionBy("pair_id", "is_chosen").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.filter(F.col("conv_id").isNotNull()).select(
        pair.alias("pair_id"), is_chosen.alias("is_chosen"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("pair_id IS NOT NULL AND is_chosen IS NOT NULL").withColumn("place", F.row_number().over(order))
    sides = placed.groupBy("pair_id", "is_chosen").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    both = sides.groupBy("pair_id").agg(
        F.max(F.when(F.col("is_chosen"), F.col("turns"))).alias("good"), F.max(F.when(~F.col("is_chosen"), F.col("turns"))).alias("bad")
    ).filter("good IS NOT NULL AND bad IS NOT NULL")
    shorter = F.least(F.size("good"), F.size("bad"))
    differing = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.get("good", i - 1) != F.get("bad", i - 1))
    common = both.withColumn("prompt_turns", F.coalesce(F.get(differing, 0) - 1, shorter))

    def text_of(side: str, start: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice(side, start, n), lambda t: render(t["role"], t["text"])), "")

    def rest(side: str) -> Column:
        return F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0)))

    def mask(side: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

        def add(state: Column, t: Column) -> Column:
            begin = state["at"] + F.char_length(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)))
            end = begin + F.char_length(F.concat(t["text"], F.lit(CLOSE)))
            span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
            return F.struct(end.cast("long").alias("at"), F.when(t["role"] == learned_role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(rest(side), start, add, lambda s: s["spans"])

    return common.select(
        "pair_id", F.col("prompt_turns").cast("int").alias("prompt_turns"), text_of("good", F.lit(1), F.col("prompt_turns")).alias("prompt"),
        F.array_join(F.transform(rest("good"), lambda t: render(t["role"], t["text"])), "").alias("chosen"),
        F.array_join(F.transform(rest("bad"), lambda t: render(t["role"], t["text"])), "").alias("rejected"),
        mask("good").alias("chosen_mask"), mask("bad").alias("rejected_mask"))
