"""Preference formatting of conversations, with DataFrame functions only.

Two conversations of a pair share a prompt: their longest common prefix of turns, rendered once. What follows in each is
its completion, with a loss mask. A mask is run-length text, ``bit:characters`` joined by commas, one or two runs a turn;
bit 1 covers what an assistant wrote and the end mark after it.

Pairing by ``pair_neighbours``: conversations are cut into blocks of ``BLOCK`` successive conv_ids; within a block they
are ordered by their first turn, so those with the same first turn stand together, and every two neighbours make a pair.
A first turn that a third of all conversations share is thus spread over all blocks. Turns meet by conv_id only; the
largest group is one conversation, which is one output row.

Defined cases: a null role or text is an empty string, null turns come first, turns with equal numbers follow role and
text, repeated rows are repeated turns; rows with a null conv_id are left out; the last of an odd block has no partner:
its prompt is empty and its rejected side null; a conversation without turns comes first in its block and shares none;
very long conversations are one row each; other columns are ignored; pairs that agree throughout have empty completions; marks inside texts
are broken by a space; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation, as an array of (turn, role, text)."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def pair_neighbours(convs: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected) of neighbours within blocks of conv_ids."""
    own = Window.partitionBy("_block").orderBy(F.get("turns", F.lit(0))["text"], "conv_id")
    placed = (
        convs.withColumn("_block", F.floor(F.col("conv_id") / BLOCK))
        .withColumn("_row", F.row_number().over(own))
        .withColumn("rejected_id", F.lead("conv_id").over(own))
        .withColumn("rejected", F.lead("turns").over(own))
    )
    return placed.where("_row % 2 = 1").select(
        F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), "rejected_id", "rejected"
    )


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns in which two arrays of turns agree in role and text."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.element_at(a, i)["role"] != F.element_at(b, i)["role"])
        | (F.element_at(a, i)["text"] != F.element_at(b, i)["text"]),
    )
    return F.when(b.isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, shorter))


def render(turns: Column) -> Column:
    """Turns as one string."""
    return F.array_join(F.transform(turns, _turn), "")


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _turn(t: Column) -> Column:
    return F.concat(F.lit(START), _clean(t["role"]), F.lit("\n"), _clean(t["text"]), F.lit(END + "\n"))


def mask(turns: Column) -> Column:
    """The loss mask of ``render(turns)``."""

    def runs(t: Column) -> Column:
        head = F.length(_clean(t["role"])) + len(START) + 1
        rest = F.length(_clean(t["text"])) + len(END) + 1
        return F.when(
            t["role"] == "assistant", F.concat(F.lit("0:"), head.cast("string"), F.lit(",1:"), rest.cast("string"))
        ).otherwise(F.concat(F.lit("0:"), (head + rest).cast("string")))

    return F.array_join(F.transform(turns, runs), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """One row per pair (chosen_id, chosen, rejected_id, rejected): prompt, completions and their masks."""
    known = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return known.select(
        "chosen_id",
        "rejected_id",
        "n_common",
        render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"),
        mask(rest("chosen")).alias("chosen_mask"),
        F.when(F.col("rejected").isNotNull(), render(rest("rejected"))).alias("rejected"),
        F.when(F.col("rejected").isNotNull(), mask(rest("rejected"))).alias("rejected_mask"),
    )


SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i
  from conversations where conv_id is not null),
firsts as (
  select conv_id, text as first_text, conv_id // {BLOCK} as block from turns where i = 1),
placed as (
  select conv_id, row_number() over w as r, lead(conv_id) over w as other
  from firsts window w as (partition by block order by first_text, conv_id)),
pairs as (select conv_id as chosen_id, other as rejected_id from placed where r % 2 = 1),
same as (
  select p.chosen_id, min(case when a.role = b.role and a.text = b.text then null else coalesce(a.i, b.i) end) as differs,
         max(a.i) as n
  from pairs p join turns a on a.conv_id = p.chosen_id
  left join turns b on b.conv_id = p.rejected_id and b.i = a.i group by 1),
known as (select p.*, coalesce(s.differs - 1, s.n) as n_common from pairs p join same s using (chosen_id)),
shown as (
  select conv_id, i, '{START}' || replace(role, '<|im_', '< |im_') || chr(10) || replace(text, '<|im_', '< |im_') || '{END}' || chr(10) as r,
         case when role = 'assistant' then '0:' || (length(replace(role, '<|im_', '< |im_')) + {len(START) + 1}) || ',1:' || (length(replace(text, '<|im_', '< |im_')) + {len(END) + 1})
              else '0:' || (length(replace(role, '<|im_', '< |im_')) + length(replace(text, '<|im_', '< |im_')) + {len(START) + len(END) + 2}) end as m
  from turns)
select k.chosen_id, k.rejected_id, cast(k.n_common as integer) as n_common,
       coalesce((select string_agg(r, '' order by i) from shown where conv_id = k.chosen_id and i <= k.n_common), '') as prompt,
       coalesce((select string_agg(r, '' order by i) from shown where conv_id = k.chosen_id and i > k.n_common), '') as chosen,
       coalesce((select string_agg(m, ',' order by i) from shown where conv_id = k.chosen_id and i > k.n_common), '') as chosen_mask,
       case when k.rejected_id is not null then coalesce((select string_agg(r, '' order by i) from shown where conv_id = k.rejected_id and i > k.n_common), '') end as rejected,
       case when k.rejected_id is not null then coalesce((select string_agg(m, ',' order by i) from shown where conv_id = k.rejected_id and i > k.n_common), '') end as rejected_mask
from known k
"""
