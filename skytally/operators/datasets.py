"""Merging annotation datasets: harmonised categories, first images by path, dense new ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import overlap


def dense_ids(rows: DataFrame, order: list, name: str = "new_id", start: int = 0) -> DataFrame:
    """Whole numbers without gaps in the given order, without sorting everything in one task: ranks within ranges of the order plus the counts of the ranges before."""
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranked = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    ranked = overlap.written(ranked, "ranges")  # the ranges are sampled; both uses below must see the same
    sizes = ranked.groupBy("_p").agg(F.max("_n").alias("_size"))  # one row a range
    before = F.coalesce(F.sum("_size").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return ranked.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_before") + F.col("_n") - 1 + start).cast("long")).drop("_p", "_n", "_before")


def merge_categories(categories: DataFrame) -> DataFrame:
    """(place, name, supercategory) to one category for each name regardless of case and blanks: its key, and the id in the order of first appearance."""
    key = F.concat(F.lower(F.trim("name")), F.lit("|"), F.coalesce("supercategory", F.lit("")))
    first = categories.groupBy(key.alias("key")).agg(F.min("place").alias("first"), F.min_by("name", "place").alias("name"))
    return first.select("key", "name", F.row_number().over(W.orderBy("first", "key")).cast("long").alias("category_id"))  # a label set


def merge(images: DataFrame, annotations: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Images (dataset, image_id, file_name) with the first of each path, by dataset and id, kept; and the annotations (dataset, image_id, ...) of kept images."""
    first = images.groupBy(name).agg(F.min(F.struct("dataset", "image_id")).alias("_first"))
    kept = first.select(F.col("_first.dataset").alias("dataset"), F.col("_first.image_id").alias("image_id"))
    return images.join(kept, ["dataset", "image_id"], "left_semi"), annotations.join(kept, ["dataset", "image_id"], "left_semi")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split_counts(rows: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Counts of the three splits, also of missing ones."""
    names = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return names.join(rows.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def merge_configs(paths: DataFrame, names: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Data configurations as one: paths (config, split, path) and names (config, class_id, name) to the different paths of each split, and to names for 0 ... most classes - 1.

    Configurations that name a class differently are refused, unless forced: then all classes get made-up names."""
    every = names.groupBy("class_id").agg(F.count_distinct("name").alias("kinds"), F.min("name").alias("name"))  # one row a class
    most = names.groupBy("config").agg(F.count_distinct("class_id").alias("nc")).agg(F.max("nc").alias("nc"))
    if not force and not every.where("kinds > 1").isEmpty():
        raise ValueError("the configurations name classes differently")
    numbers = most.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)).alias("class_id"))
    label = F.concat(F.lit("class_"), F.col("class_id").cast("string"))
    merged = numbers.join(every.select(F.col("class_id").cast("long").alias("class_id"), "name"), "class_id", "left").select("class_id", (label if force else F.coalesce("name", label)).alias("name"))
    return paths.select("split", "path").distinct(), merged
