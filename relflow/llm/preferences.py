"""Preference formatting: one prompt and two masked completions for each pair of
conversations. DataFrame functions only.

A pair has the turns of a chosen and a rejected conversation. The longest common
prefix of whole turns (same role and text) is rendered once, as the prompt; what
follows it in either conversation is that side's completion. A completion comes
with the spans that are trained on: the text of each assistant turn with its end
mark, in code points of the completion, end exclusive. All else is masked.

Rows: one per ``pair_id``; null is an id like others. Turns are in the order of
``turn``, then role, then text, so repeated turn numbers have a defined order; a
turn row that repeats exactly is a turn twice. A null role is "user", a null text
is empty. Conversations that are equal have empty completions; a side without
turns, or one that is the other's prefix, has an empty completion. Rows whose side
is neither "chosen" nor "rejected" are ignored, with their pair if it has no other
rows. An empty table gives no rows. Other columns are not read. A conversation is
one sample and one row of the output, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def _trained(turns: Column) -> Column:
    """Spans of the assistant turns in the rendered turns."""
    def step(acc, t):
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns`` (pair_id, side, turn, role, text) -> ``(pair_id, n_common, prompt,
    chosen, chosen_spans, rejected, rejected_spans)``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = {s: F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")}
    pairs = turns.where(F.col("side").isin(list(sides))).groupBy("pair_id").agg(*sides.values())
    least = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), least), F.slice("rejected", F.lit(1), least),
                      lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    at = F.array_position(same, False)
    pairs = pairs.withColumn("n_common", F.when(at == 0, least).otherwise(at - 1).cast("int"))
    rest = {s: F.slice(s, F.col("n_common") + 1, F.size(s)) for s in sides}
    return pairs.select("pair_id", "n_common", _render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
                        *[c for s in sides for c in (_render(rest[s]).alias(s), _trained(rest[s]).alias(f"{s}_spans"))])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
