"""Validity of annotation rows and label lines, with the first rule that fails as a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coco_reasons(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """annotations with reason, null if valid. Structure comes before relations, and these before content."""
    known_images = images.select(F.col("image_id"), F.lit(True).alias("_image"))
    known_classes = F.broadcast(categories.select("class_name", F.lit(True).alias("_class")))  # a label set
    rows = annotations.join(known_images, "image_id", "left").join(known_classes, "class_name", "left")
    reason = (
        F.when(F.col("id").isNull(), "missing id")
        .when(F.col("class_name").isNull(), "missing category")
        .when(F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull(), "missing bbox")
        .when(F.col("_image").isNull(), "unknown image")
        .when(F.col("_class").isNull(), "unknown category")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "empty bbox")
        .when(F.col("area") <= 0, "bad area")
        .when(~F.col("iscrowd").isin(0, 1), "bad iscrowd")
    )
    return rows.withColumn("reason", reason).drop("_image", "_class")


def yolo_reason(line: Column, classes: int) -> Column:
    """Why a label line is invalid: too few tokens, no class in range, a number that is none or not in [0, 1], half a point."""
    tokens = F.split(F.trim(line), r"\s+")
    numbers = F.transform(F.slice(tokens, 2, F.size(tokens)), lambda x: x.try_cast("double"))
    class_id = F.get(tokens, 0).try_cast("int")
    return (
        F.when(F.size(tokens) < 5, "too few values")
        .when(class_id.isNull() | (class_id < 0) | (class_id >= classes), "bad class")
        .when(F.exists(numbers, lambda x: x.isNull()), "not a number")
        .when(F.exists(numbers, lambda x: (x < 0) | (x > 1)), "out of range")
        .when((F.size(tokens) > 5) & (F.size(tokens) % 2 == 0), "odd polygon")
    )


def summary(rows: DataFrame) -> DataFrame:
    """Rows by reason, valid ones as `valid`."""
    return rows.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def label_format(line: Column) -> Column:
    """yolo for five values, obb for nine, else unknown."""
    n = F.size(F.split(F.trim(line), r"\s+"))
    return F.when(n == 5, "yolo").when(n == 9, "obb").otherwise("unknown")


def yolo_structure(images: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """split, stem and problem: images (split, stem) without label lines, lines (split, stem, class_id) without an image, and lines of classes that the configuration lacks."""
    lines = labels.groupBy("split", "stem").agg(F.count_if((F.col("class_id") < 0) | (F.col("class_id") >= classes) | F.col("class_id").isNull()).alias("bad"))
    both = images.select("split", "stem", F.lit(True).alias("image")).join(lines, ["split", "stem"], "full")
    problems = F.array_compact(F.array(F.when(F.col("bad").isNull(), F.lit("no labels")), F.when(F.col("image").isNull(), F.lit("no image")), F.when(F.col("bad") > 0, F.lit("unknown class"))))
    return both.select("split", "stem", F.explode(problems).alias("problem"))
