"""Leakage-free splits: groups of images by place or camp, and the assignment of whole groups to splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import overlap


def grid_group(lat: Column, lon: Column, cell: float) -> tuple[Column, Column]:
    """The group number lat * 10000 + lon of the cell, in which different cells may meet, and a key in which none do."""
    y, x = F.floor(lat / cell), F.floor(lon / cell)
    return (y * 10000 + x).cast("long"), F.concat_ws(":", y, x)


def near_groups(points: DataFrame, eps: float) -> DataFrame:
    """id and group_id: connected groups of points (id, y, x) at most eps apart. Points meet in the cells of a grid, each with the cells around it; points of one place count as one there."""
    places = points.where("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(y) AND NOT isnan(x)").groupBy("y", "x").agg(F.min("id").alias("id"))
    at = lambda c: F.floor(F.col(c) / eps).cast("long")
    p = places.withColumns({"gy": at("y"), "gx": at("x")})
    near = p.select(F.col("id").alias("b"), F.col("y").alias("by"), F.col("x").alias("bx"), F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)).alias("gy"), "gx")
    near = near.withColumn("gx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1)))
    links = p.join(near, ["gy", "gx"]).where("id < b").where(F.pow(F.col("y") - F.col("by"), 2.0) + F.pow(F.col("x") - F.col("bx"), 2.0) <= eps * eps)
    found = overlap.groups(places, links.select(F.col("id").alias("a"), "b")).join(places, "id").select("y", "x", "group_id")
    return points.join(found, ["y", "x"], "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def camps(images: DataFrame) -> DataFrame:
    """image_id and camp: the camp's name, or a group of its own for an image without one."""
    return images.select("image_id", F.coalesce("camp_id", F.concat(F.lit("image_"), F.col("image_id").cast("string"))).alias("camp"))


def assign(groups: DataFrame, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """group_id, n and split. Whole groups, in the order of a hash, go to test until it has its share of all rows, then to val, then to train."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string")).cast("binary"))
    order = W.orderBy(key, "group_id")  # one row a group
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = before / F.sum("n").over(W.partitionBy())
    return groups.select("group_id", "n", F.when(share < test, "test").when(share < test + val, "val").otherwise("train").alias("split"))


def stratified(histogram: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """group_id and split from (group_id, label, n): greedily, large groups first, each to the split whose missing labels it fills best.

    The order of groups matters, so the histogram (one row a group and label, not the images) is handled in one Arrow batch."""
    import numpy as np
    import pandas as pd

    def run(h: pd.DataFrame) -> pd.DataFrame:
        table = h.pivot_table(index="group_id", columns="label", values="n", fill_value=0)
        order = table.assign(total=table.sum(axis=1)).sort_values(["total"], ascending=False, kind="stable").index
        names, want = list(ratios), np.array([[r] for r in ratios.values()]) * table.sum().to_numpy()[None, :]
        have, out = np.zeros_like(want, dtype=float), []
        for g in order:
            counts = table.loc[g].to_numpy()
            cost = [np.abs(want - np.vstack([have[:i], have[i : i + 1] + counts, have[i + 1 :]])).sum() for i in range(len(names))]
            i = int(np.argmin(cost))
            have[i] += counts
            out.append((g, names[i]))
        return pd.DataFrame(out, columns=["group_id", "split"])

    kind = dict(histogram.dtypes)["group_id"]
    return histogram.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda d: run(d.drop(columns="_one")), f"group_id {kind}, split string")
