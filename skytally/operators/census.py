"""Counts, confidence and coverage of a campaign, and its one-row report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_confidence(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Per dataset and class of non-empty detections: count, images, confidence statistics."""
    rows = images.select("image_id", "dataset").join(detections.where("class_name <> 'EMPTY'"), "image_id")
    return rows.groupBy("dataset", F.coalesce("class_name", F.lit("unknown")).alias("class_name")).agg(
        F.count("*").alias("detections"), F.count_distinct("image_id").alias("images"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence")
    )


def bounds(images: DataFrame) -> DataFrame:
    """One row: bounding box of the positions and how many images have one."""
    return images.agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.count_if(F.col("latitude").isNotNull()).alias("located"), F.count("*").alias("images"),
        F.coalesce(F.avg("latitude"), F.lit(0.0)).alias("center_lat"), F.coalesce(F.avg("longitude"), F.lit(0.0)).alias("center_lon"),
    )


def merged_counts(per_image: DataFrame) -> DataFrame:
    """class_name and n summed over maps of counts (image_id, counts)."""
    return per_image.select(F.explode("counts").alias("class_name", "n")).groupBy("class_name").agg(F.sum("n").alias("n"))


def count_maps(detections: DataFrame) -> DataFrame:
    """image_id and counts, a map of the image's classes."""
    per = detections.groupBy("image_id", "class_name").agg(F.count("*").alias("n"))
    return per.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("class_name", "n"))).alias("counts"))


def report(images: DataFrame, detections: DataFrame) -> DataFrame:
    """One row: images, detections, density and the statistics of bounds()."""
    d = detections.agg(F.count("*").alias("detections"), F.count_distinct("image_id").alias("images_with_detections"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    return bounds(images).crossJoin(d).withColumn("per_image", F.col("detections") / F.col("images"))  # one row each


def removal_by_class(before: DataFrame, after: DataFrame, key: str = "det_key") -> DataFrame:
    """Per class the detections before and after a removal of duplicates, those removed, their share, and the mean confidence of what stays."""
    left = after.select(key, F.lit(1).alias("_stays"))
    rows = before.join(left, key, "left").groupBy("class_name")
    out = rows.agg(F.count("*").alias("total"), F.count("_stays").alias("kept"), F.avg(F.when(F.col("_stays").isNotNull(), F.col("confidence"))).alias("mean_confidence"))
    return out.withColumns({"removed": F.col("total") - F.col("kept"), "share": (F.col("total") - F.col("kept")) / F.col("total")})
