"""Detection and classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import iou
from . import greedy

#: The thresholds 0.2, 0.25, ... 0.95.
THRESHOLDS = [round(0.2 + 0.05 * i, 2) for i in range(16)]
BOX = ("x1", "y1", "x2", "y2")


def grid(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of gt and pred rows for every confidence threshold, in one job. Matching is done once, by rising IoU rank; a threshold keeps the matches of its predictions."""
    truth, found = rows.where("role = 'gt'"), rows.where("role = 'pred'")
    matched = greedy.match(truth, found, 0.5).select(F.col("pred_key").alias("det_key"), F.lit(1).alias("hit"))
    scored = found.join(matched, "det_key", "left").select("score", F.coalesce("hit", F.lit(0)).alias("hit"))
    # few different scores: summed before the thresholds are met
    by_score = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    t = rows.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    total = truth.agg(F.count("*").alias("gts"))
    out = by_score.crossJoin(F.broadcast(t)).where("score >= threshold").groupBy("threshold").agg(F.sum("hits").alias("tp"), (F.sum("n") - F.sum("hits")).alias("fp"))
    out = t.join(out, "threshold", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    eps = F.lit(1e-6)
    out = out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + eps), "recall": F.col("tp") / (F.col("gts") + eps)})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def best_threshold(table: DataFrame, by: str = "f1") -> DataFrame:
    """The row of the greatest value, the least threshold of equal ones."""
    return table.orderBy(F.desc(by), "threshold").limit(1)


def average_precision(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per class the mean of precision at each recall step, with precision made non-increasing. Scores are few, so the curves run over one row a class and score."""
    truth, found = rows.where("role = 'gt'"), rows.where("role = 'pred'")
    matched = greedy.match(truth.withColumnRenamed("class_name", "c"), found, threshold).select(F.col("pred_key").alias("det_key"), F.lit(1).alias("hit"))
    scored = found.join(matched, "det_key", "left").groupBy("class_name", "score").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    w = W.partitionBy("class_name").orderBy(F.desc("score"))
    curve = scored.withColumns({"tp": F.sum("hits").over(w), "all": F.sum("n").over(w)}).withColumn("precision", F.col("tp") / F.col("all"))
    curve = curve.withColumn("best", F.max("precision").over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    gts = truth.groupBy("class_name").agg(F.count("*").alias("gts"))
    return curve.groupBy("class_name").agg(F.sum(F.col("hits") * F.col("best")).alias("s")).join(gts, "class_name").select("class_name", (F.col("s") / F.col("gts")).alias("ap"))


def classification(rows: DataFrame) -> DataFrame:
    """Per class of (truth, predicted): support, precision, recall, f1."""
    pairs = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    tp = pairs.where("truth = predicted").select(F.col("truth").alias("class_name"), F.col("n").alias("tp"))
    gt, pr = pairs.groupBy(F.col("truth").alias("class_name")).agg(F.sum("n").alias("support")), pairs.groupBy(F.col("predicted").alias("class_name")).agg(F.sum("n").alias("found"))
    out = gt.join(pr, "class_name", "full").join(tp, "class_name", "left").na.fill(0)
    out = out.withColumns({"precision": F.try_divide("tp", "found"), "recall": F.try_divide("tp", "support")})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).na.fill(0.0)


def auroc(rows: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve of (score, positive), by rank sums over one row a score."""
    by = rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if("positive").alias("p"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = by.withColumn("u", F.col("p") * (below + (F.col("n") - F.col("p")) / 2))
    return part.agg((F.sum("u") / (F.sum("p") * (F.sum("n") - F.sum("p")))).alias("auroc"))
