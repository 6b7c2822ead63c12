"""Mixing sources to target weights.

Every document gets a hash-random key. A source's documents are dealt by the leading digits of the key into ranges, each range is
sorted by key in a task of its own, and prefix sums of the sizes within a range plus the summed sizes of all earlier ranges of the source
give each document's position in its source without any task holding a source. A source whose target exceeds its size
is repeated in whole epochs; the last epoch is cut at the exact budget.

Defined results. A null text or one without words has size 0 and is never taken. A null source is a source of its own, ordered last.
Documents with equal doc_id have equal keys and are ordered by size, then by a hash of the text; rows that are equal in these are interchangeable, so
a rerun returns the same rows. An empty table gives no rows. Columns of other names pass through, also those that clash with the added ones: they lie in a struct until
the end, and added columns replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken")


def targets(per_source: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Rows (s, source_size) with the column target.

    The shares of the total are in proportion to the weights, which repeat in the order of s. A target stops at most times its source's size and the
    excess goes to the others by weight, until none is above: the level L with sum(least(L * w, most * size)) = total. With the
    sources in the order of the level at which they fill up, L follows from prefix sums. The windows here run over one row a source."""
    order = W.orderBy("s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = per_source.select("s", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    everything, filled = W.partitionBy(), W.orderBy("full_at", "s").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("full_at", F.col("cap") / F.col("w"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    still = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filled), F.lit(0.0))
    t = t.withColumn("level", left / still).withColumn("rank", F.row_number().over(W.orderBy("full_at", "s")))
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("rank"))).over(everything)
    return t.withColumn("the_level", level).select("s", "source_size", F.least(F.coalesce(F.col("the_level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", digits: int = 3) -> DataFrame:
    """docs with size (words), source_size, target (of its source) and taken (words the mix takes, repeats counted).

    keep: the columns returned besides, all by default. digits: leading hexadecimal digits of the key that form a range (16 ** digits ranges a source)."""
    keep = docs.columns if keep is None else keep
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("doc"),
        docs["doc_id"].alias("id"),
        # sorts by code point with null last
        F.concat(F.when(docs["source"].isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(docs["source"].cast("string"), F.lit(""))).alias("s"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.xxhash64(docs["text"], docs["source"]).alias("tie"),
    ).withColumn("range", F.substring("key", 1, digits))
    if "text" not in keep:
        rows = materialise(rows)  # narrow: the texts are read once
    ranges = rows.groupBy("s", "range").agg(F.sum("size").alias("in_range"))
    ranges = materialise(ranges)
    goal = targets(ranges.groupBy("s").agg(F.sum("in_range").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("in_range").over(W.partitionBy("s").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("s", "range", before.alias("before")).join(goal, "s")
    within = W.partitionBy("s", "range").orderBy("key", "id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["s", "range"])
    epochs = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(most))
    rest = F.when(F.col("epochs") < most, F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("at")))
    rows = rows.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in keep if c not in ADDED], *ADDED)
