"""Preference formatting, in DataFrame operations alone.

Of a pair of conversations (chosen, rejected) the longest common prefix of turns is the prompt, rendered once; what follows on each side is a completion whose assistant
turns carry the loss. The result has one row a rendered turn, so that a conversation of any length stays distributed: no conversation is gathered, and the
cut of a pair is a minimum over its turns that is pre-aggregated before the shuffle. assemble() joins the rows of each pair into texts with masks.

Defined results. Turns stand in the order of `turn`, null last; rows of one conversation with the same `turn` form one step, whose order does not
matter: a step is common if both sides have the same roles and texts as often. A null role or text is empty. A pair of which one side is missing has no prompt; a pair of
equal conversations has only a prompt. Rows of a null pair are completions of their side. Repeated rows are rendered as often as they occur, the prompt as often as in the chosen conversation.
Columns of other names are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, materialise

LAST = 2**63 - 1


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def segments(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """pair_id, paired, part (prompt, chosen or rejected), turn, role, rendered, loss (whether the turn is trained on) of each turn.

    pair: to which pair a row of turns belongs; chosen: whether its conversation is the chosen one (null: it is)."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(True)).alias("good"), F.coalesce(turns["turn"].cast("long"), F.lit(LAST)).alias("turn"), role.alias("role"), text.alias("text"))
    sign = F.when(F.col("good"), F.lit(1)).otherwise(F.lit(-1))

    def balance(seed: int) -> Column:  # nothing is left if both sides have the same
        return F.sum(F.xxhash64(F.lit(seed), "role", "text").cast("decimal(20,0)") * sign)

    steps = rows.where("pair_id is not null").groupBy("pair_id", "turn").agg(F.count_if("good").alias("c"), F.count_if(~F.col("good")).alias("r"), balance(1).alias("b1"), balance(2).alias("b2"))
    differs = (F.col("c") != F.col("r")) | (F.col("b1") != 0) | (F.col("b2") != 0)
    cuts = steps.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("cut"), ((F.sum("c") > 0) & (F.sum("r") > 0)).alias("paired"))
    rows = lookup(rows, materialise(cuts), ["pair_id"], 48, "left", F.xxhash64("turn", "text")).withColumn("paired", F.coalesce("paired", F.lit(False)))
    common = F.col("paired") & (F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    part = F.when(common, F.lit("prompt")).when(F.col("good"), F.lit("chosen")).otherwise(F.lit("rejected"))
    rows = rows.where(~common | F.col("good")).withColumn("part", part)
    return rows.select("pair_id", "paired", "part", F.when(F.col("turn") < LAST, F.col("turn")).alias("turn"), "role", render(F.col("role"), F.col("text")).alias("rendered"), ((F.col("part") != "prompt") & (F.col("role") == "assistant")).alias("loss"))


def assemble(rows: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and of each completion the spans [from, to) of code points, counted from the completion's start, that carry the loss.

    A row holds a pair's whole text, so this is for pairs that fit in memory; segments() has no such need."""
    order = W.partitionBy("pair_id", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "rendered").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("rendered")).over(order), F.lit(0))
    rows = rows.withColumn("at", at).withColumn("nth", F.count("*").over(order))
    one = F.sort_array(F.collect_list(F.struct("nth", "rendered", "at", "loss")))
    parts = rows.groupBy("pair_id", "part").agg(one.alias("x"), F.first("paired").alias("paired")).select("pair_id", "part", "paired", F.concat_ws("", "x.rendered").alias("text"), F.transform(F.filter("x", lambda y: y.loss), lambda y: F.struct(y["at"].alias("from"), (y["at"] + F.length(y["rendered"])).alias("to"))).alias("spans"))
    pick = lambda part, column: F.first(F.when(F.col("part") == part, F.col(column)), ignorenulls=True)
    texts = [F.coalesce(pick(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")]
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    spans = [F.coalesce(pick(p, "spans").cast("array<struct<from:bigint,to:bigint>>"), none).alias(f"{p}_loss") for p in ("chosen", "rejected")]
    return parts.groupBy("pair_id").agg(F.first("paired").alias("paired"), *texts, *spans)
