"""Tile grids and the join of annotations to the tiles that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def steps(length: Column, patch: int, stride: int, compat: bool = True) -> Column:
    """Tiles along one axis of the padded image. As the padding is computed, an image shorter than patch - stride has none; compat=False gives it one."""
    extra = F.ceil((length - patch) / F.lit(float(stride))) * stride - (length - patch)
    n = F.floor((length + extra - patch) / F.lit(float(stride))) + 1
    return F.greatest(F.lit(0 if compat else 1), n).cast("int")


def grid(images: DataFrame, patch: int, stride: int, compat: bool = True) -> DataFrame:
    """image_id, ty, tx and the corners of each tile, rows of tiles first."""
    rows = images.select("image_id", steps(F.col("height"), patch, stride, compat).alias("ny"), steps(F.col("width"), patch, stride, compat).alias("nx")).where("ny > 0 AND nx > 0")
    rows = rows.select("image_id", "nx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("ty")).select("image_id", "ty", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("tx"))
    return rows.select("image_id", "ty", "tx", (F.col("tx") * stride).alias("x0"), (F.col("ty") * stride).alias("y0"), (F.col("tx") * stride + patch).alias("x1"), (F.col("ty") * stride + patch).alias("y1"))


def stretched(length: Column, tile: Column, overlap: float) -> Column:
    """Starts and ends along one axis of an unpadded grid whose last tile is stretched to the border."""
    step = (1 - overlap) * tile
    n = F.ceil((length - tile) / step).cast("int")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.floor(tile + i * step) - tile).cast("int").alias("lo"), F.when(i == n - 1, length).otherwise(F.floor(tile + i * step)).cast("int").alias("hi")))
    return F.when(n > 0, ends).otherwise(F.array(F.struct(F.lit(0).alias("lo"), length.cast("int").alias("hi"))))


def border_tiles(images: DataFrame, across: float, down: float, overlap: float) -> DataFrame:
    """The stretched grid, columns first."""
    rows = images.select("image_id", F.explode(stretched(F.col("width"), F.ceil(F.col("width") * across), overlap)).alias("x"), F.col("height"))
    rows = rows.select("image_id", "x", F.explode(stretched(F.col("height"), F.ceil(F.col("height") * down), overlap)).alias("y"))
    return rows.select("image_id", F.col("x.lo").alias("x0"), F.col("x.hi").alias("x1"), F.col("y.lo").alias("y0"), F.col("y.hi").alias("y1"))


def assign(annotations: DataFrame, images: DataFrame, patch: int, stride: int, min_visibility: float = 0.1) -> DataFrame:
    """Annotations cut to every tile in which more than min_visibility of them shows, in the tile's coordinates.

    Which tiles a box touches follows from its corners, so this is arithmetic and an equi-join to the images: no box meets a tile that it doesn't touch."""
    size = images.select("image_id", steps(F.col("height"), patch, stride).alias("ny"), steps(F.col("width"), patch, stride).alias("nx"))
    a = annotations.join(size, "image_id").where("nx > 0 AND ny > 0")

    def touched(low: str, length: str, n: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(low) - patch) / F.lit(float(stride))).cast("int") + 1)
        last = F.least(F.col(n) - 1, (F.ceil((F.col(low) + F.col(length)) / F.lit(float(stride))) - 1).cast("int"))
        return F.when(first <= last, F.sequence(first, last))

    a = a.withColumn("ty", F.explode(touched("y", "h", "ny"))).withColumn("tx", F.explode(touched("x", "w", "nx")))
    x0, y0 = F.col("tx") * stride, F.col("ty") * stride
    left, top, right, bottom = F.greatest(F.col("x"), x0), F.greatest(F.col("y"), y0), F.least(F.col("x") + F.col("w"), x0 + patch), F.least(F.col("y") + F.col("h"), y0 + patch)
    cut = a.select("id", "image_id", "class_name", "ty", "tx", (left - x0).alias("tile_x"), (top - y0).alias("tile_y"), (right - left).alias("tile_w"), (bottom - top).alias("tile_h"), F.try_divide((right - left) * (bottom - top), F.col("w") * F.col("h")).alias("visibility"))
    return cut.where((F.col("tile_w") > 0) & (F.col("tile_h") > 0) & (F.col("visibility") > min_visibility))
