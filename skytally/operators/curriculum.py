"""Difficulty of images and its schedule over epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import area

# Reference area, expected boxes, image area and coverage limits of the difficulty scores, and their weights.
REFERENCE_AREA, EXPECTED_BOXES, IMAGE_AREA, SMALL, LARGE = 200 * 200, 10, 800 * 800, 0.01, 0.5
WEIGHTS = (0.4, 0.3, 0.3)


def difficulty(images: DataFrame, detections: DataFrame) -> DataFrame:
    """image_id and difficulty; images without boxes are of medium difficulty, 0.5."""
    stats = detections.groupBy("image_id").agg(F.count("*").alias("n"), F.avg(area("x1", "y1", "x2", "y2").cast("double")).alias("mean"), (F.sum(area("x1", "y1", "x2", "y2")) / float(IMAGE_AREA)).alias("cover"))
    by_area = 1.0 - F.least(F.lit(1.0), F.col("mean") / REFERENCE_AREA)
    by_count = 1.0 - F.least(F.lit(1.0), F.col("n") / EXPECTED_BOXES)
    linear = 1.0 - (F.col("cover") - SMALL) / (LARGE - SMALL)
    by_cover = F.when(F.col("cover") < SMALL, 1.0).when(F.col("cover") > LARGE, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear)))
    score = WEIGHTS[0] * by_area + WEIGHTS[1] * by_count + WEIGHTS[2] * by_cover
    return images.select("image_id").join(stats, "image_id", "left").select("image_id", F.when(F.col("n").isNull(), 0.5).otherwise(score).alias("difficulty"))


def schedules(epoch: Column, warm: int, start: float, end: float) -> dict[str, Column]:
    """The difficulty allowed at an epoch; the exponential one knows no start and end."""
    share = F.least(F.lit(1.0), epoch / float(warm))
    return {"linear": F.least(F.lit(1.0), start + (end - start) * share), "exponential": 1.0 - F.exp(-3.0 * share), "constant": F.lit(float(end))}


def included(images: DataFrame, allowed: float, margin: float = 0.1) -> DataFrame:
    """Images of at most the allowed difficulty plus the margin, or all if there is none."""
    fits = F.col("difficulty") <= allowed + margin
    some = images.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("_some"))
    return images.crossJoin(F.broadcast(some)).where(fits | ~F.col("_some")).drop("_some")  # one row


def crops_of(crops: DataFrame, classes: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Crops (class_name, kind) of the classes and kinds asked for; all of either if none are."""
    for column, wanted in (("class_name", classes), ("kind", kinds)):
        crops = crops if wanted is None else crops.where(F.col(column).isin(wanted))
    return crops


def crops_to_images(crops: DataFrame, annotations: DataFrame) -> DataFrame:
    """The annotations that the crops (crop_id, annotation_id) kept by a filter came from, each once, with the number of its crops."""
    return annotations.join(crops.groupBy(F.col("annotation_id").alias("id")).agg(F.count("*").alias("crops")), "id")
