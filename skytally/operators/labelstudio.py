"""Nested labelling tasks: an explicit schema, flattening, filters and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<id:string,origin:string,score:double,original_width:bigint,original_height:bigint,value:struct<x:double,y:double,width:double,height:double,rotation:double,rectanglelabels:array<string>>>"
TASK = f"id bigint, project bigint, data struct<image:string>, annotations array<struct<id:bigint,completed_by:bigint,result:array<{RESULT}>>>, predictions array<struct<id:bigint,model_version:string,score:double,result:array<{RESULT}>>>"
#: Which origins count as made by people; a changed prediction counts as both.
ORIGINS = {"annotation": ("manual", "prediction-changed"), "prediction": ("prediction", "prediction-changed")}


def tasks_from(detections: DataFrame, width: int = 3600, height: int = 2700) -> DataFrame:
    """Tasks in the schema TASK, one an image, of detections."""
    value = F.struct(
        (F.col("x1") * 100.0 / width).alias("x"), (F.col("y1") * 100.0 / height).alias("y"), ((F.col("x2") - F.col("x1")) * 100.0 / width).alias("width"), ((F.col("y2") - F.col("y1")) * 100.0 / height).alias("height"),
        F.when(F.col("pos") % 6 == 0, 30.0).otherwise(0.0).alias("rotation"), F.array("class_name").alias("rectanglelabels"),
    )
    origin = F.when(F.col("pos") % 3 == 0, "manual").when(F.col("pos") % 3 == 1, "prediction").otherwise("prediction-changed")
    result = F.struct(F.col("det_key").cast("string").alias("id"), origin.alias("origin"), F.when(F.col("pos") % 4 != 0, F.col("confidence")).alias("score"), F.lit(width).cast("long").alias("original_width"), F.lit(height).cast("long").alias("original_height"), value.alias("value"))
    rows = detections.groupBy("image_id").agg(F.sort_array(F.collect_list(result)).alias("result"))
    annotation = F.struct(F.col("image_id").alias("id"), F.lit(1).cast("long").alias("completed_by"), F.col("result"))
    return rows.select(F.col("image_id").alias("id"), F.lit(1).cast("long").alias("project"), F.struct(F.concat(F.lit("/data/img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("image")).alias("data"), F.array(annotation).alias("annotations"))


def flatten(tasks: DataFrame) -> DataFrame:
    """A row a label of a result of an annotation; tasks without any keep a row with is_empty."""
    rows = tasks.select(F.col("id").alias("task_id"), F.col("data.image").alias("image_path"), F.explode_outer("annotations").alias("a"))
    rows = rows.select("task_id", "image_path", F.col("a.id").alias("annotation_id"), F.col("a.completed_by").alias("completed_by"), F.explode_outer("a.result").alias("r"))
    rows = rows.select("*", F.explode_outer("r.value.rectanglelabels").alias("label"))
    v, w, h = F.col("r.value"), F.col("r.original_width"), F.col("r.original_height")
    return rows.select(
        "task_id", "image_path", "annotation_id", "completed_by", F.col("r.id").cast("long").alias("result_id"), "label", F.col("r.origin").alias("origin"), F.col("r.score").alias("score"),
        v["x"].alias("x_percent"), v["y"].alias("y_percent"), v["width"].alias("width_percent"), v["height"].alias("height_percent"), (v["x"] / 100.0 * w).alias("x_pixel"), (v["y"] / 100.0 * h).alias("y_pixel"), (v["width"] / 100.0 * w).alias("width_pixel"), (v["height"] / 100.0 * h).alias("height_pixel"),
        v["rotation"].alias("rotation"), F.col("r").isNull().alias("is_empty"),
    )


def filter_results(flat: DataFrame, labels: Callable[[Column], Column] | None = None, min_score: float | None = None, origins: str | None = None) -> DataFrame:
    """Rows whose label passes, whose score is unknown or high enough, and that people (annotation) or a model (prediction) made."""
    if labels is not None:
        flat = flat.where(labels(F.col("label")))
    if min_score is not None:
        flat = flat.where(F.col("score").isNull() | (F.col("score") >= min_score))
    if origins is not None:
        flat = flat.where(F.col("origin").isin(*ORIGINS[origins]))
    return flat


def label_summary(flat: DataFrame) -> DataFrame:
    return flat.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"), F.count_if(F.col("rotation") != 0).alias("rotated"))
