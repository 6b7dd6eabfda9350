"""Preference formatting: chosen and rejected conversations as prompt and completions.

The longest common prefix of turns is rendered once as the prompt; what follows
in either conversation is its completion. The loss mask of a completion is the
list of character spans (start:end, end exclusive, code points) of what its
assistant turns say, end mark included; headers and other turns are masked out.

DataFrame functions only. Turns are placed in their conversation by a window,
and a pair's turns meet in one row, which is the row that is returned; no other
group is ever collected.

Defined results: repeated rows of a turn count once; turns that share a number
are ordered by role, then text; a null turn number sorts first; a null role or
text is empty; a pair of which one side is missing has no row; equal
conversations have empty completions. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def format_preferences(turns: DataFrame) -> DataFrame:
    """From ``turns(pair, side, turn, role, text)``, side 0 chosen and 1 rejected:
    ``pair, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask``."""
    clean = turns.select("pair", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.where("pair is not null and side in (0, 1)").repartition("pair").distinct()
    shown = F.concat(F.lit(HEAD), "role", F.lit(MIDDLE), "text", F.lit(END))
    order = Window.partitionBy("pair", "side").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = clean.withColumn("shown", shown).select(
        "pair",
        "side",
        F.row_number().over(order).alias("at"),
        "role",
        "text",
        "shown",
        F.coalesce(F.sum(F.char_length("shown")).over(before), F.lit(0)).alias("start"),
    )
    pairs = placed.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("side", "at", "role", "text", "shown", "start"))).alias("turns"))
    chosen, rejected = F.filter("turns", lambda t: t["side"] == 0), F.filter("turns", lambda t: t["side"] == 1)
    pairs = pairs.select("pair", chosen.alias("side0"), rejected.alias("side1"))
    pairs = pairs.where("size(side0) > 0 and size(side1) > 0")
    same = F.zip_with("side0", "side1", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("side0")).cast("int"))
    columns = [F.array_join(F.transform(F.slice("side0", F.lit(1), F.col("n_common")), lambda t: t["shown"]), "").alias("prompt")]
    masks = []
    for s, name in enumerate(["chosen", "rejected"]):
        rest = F.slice(f"side{s}", F.col("n_common") + 1, F.size(f"side{s}"))
        columns.append(F.array_join(F.transform(rest, lambda t: t["shown"]), "").alias(name))
        masks.append(_mask(rest).alias(f"{name}_mask"))
    return pairs.select("pair", "n_common", *columns, *masks)


def _mask(rest: F.Column) -> F.Column:
    """Spans of the assistant's words in the rendered turns."""
    base = F.coalesce(F.get(rest, F.lit(0))["start"], F.lit(0))
    skip = len(HEAD) + len(MIDDLE)
    said = F.filter(rest, lambda t: t["role"] == "assistant")
    span = F.transform(said, lambda t: F.concat_ws(":", t["start"] - base + skip + F.char_length(t["role"]), t["start"] - base + F.char_length(t["shown"])))
    return F.array_join(span, ",")


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Every two conversations whose ids differ in the last bit, the even one chosen;
    negative ids too, as -2 and -1 are a pair."""
    return conversations.select(F.shiftright("conv_id", 1).alias("pair"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")


#: The query ``format_preferences(adjacent_pairs(conversations))`` in SQL.
SQL = r"""
with placed as (
  select distinct (conv_id - (conv_id % 2 + 2) % 2) // 2 as pair, (conv_id % 2 + 2) % 2 as side, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), numbered as (
  select *, row_number() over (partition by pair, side order by turn nulls first, role, text) as k,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown
  from placed
), joined as (
  select coalesce(a.pair, b.pair) as pair, coalesce(a.k, b.k) as k,
         coalesce(a.role = b.role and a.text = b.text, false) as same
  from (select * from numbered where side = 0) a full join (select * from numbered where side = 1) b
    on a.pair = b.pair and a.k = b.k
), common as (
  select pair, coalesce(min(k) filter (where not same) - 1, max(k)) as n_common from joined
  where pair in (select pair from numbered group by pair having count(distinct side) = 2) group by pair
), rest as (
  select n.*, c.n_common, n.k > c.n_common as after,
         coalesce(sum(case when n.k > c.n_common then length(shown) end)
                  over (partition by n.pair, n.side order by n.k rows between unbounded preceding and 1 preceding), 0) as start
  from numbered n join common c using (pair)
)
select pair, cast(any_value(n_common) as integer) as n_common,
       coalesce(string_agg(shown, '' order by k) filter (where side = 0 and not after), '') as prompt,
       coalesce(string_agg(shown, '' order by k) filter (where side = 0 and after), '') as chosen,
       coalesce(string_agg(shown, '' order by k) filter (where side = 1 and after), '') as rejected,
       coalesce(string_agg(cast(start + 5 + length(role) as bigint) || ':' || cast(start + length(shown) as bigint), ',' order by k)
                filter (where side = 0 and after and role = 'assistant'), '') as chosen_mask,
       coalesce(string_agg(cast(start + 5 + length(role) as bigint) || ':' || cast(start + length(shown) as bigint), ',' order by k)
                filter (where side = 1 and after and role = 'assistant'), '') as rejected_mask
from rest group by pair
"""
