"""Footprints, positions of detections, and the flight path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.boxes import ciou


def located(images: DataFrame) -> DataFrame:
    """Images with a position, with gsd (cm a pixel), UTM zone and the centre's easting and northing."""
    rows = images.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    rows = rows.select("*", F.expr(G.gsd_sql("180e0", "24e0", "35e0", "height")).alias("gsd"), F.expr(G.zone_sql("latitude", "longitude")).alias("zone"))
    # step by step: each of these is used several times by the next
    xi, eta, t = G.krueger_sql("latitude", "longitude", "zone")
    rows = rows.select("*", F.expr(t).alias("_t"))
    rows = rows.select("*", F.expr(xi.replace(t, "_t")).alias("_xi"), F.expr(eta.replace(t, "_t")).alias("_eta"))
    e, n = G.series_sql("_xi", "_eta", "latitude")
    return rows.select(*images.columns, "gsd", "zone", F.expr(e).alias("e0"), F.expr(n).alias("n0"))


def footprints(images: DataFrame) -> DataFrame:
    """image_id, zone, west, south, east, north and what else images have."""
    dx, dy = F.expr("width / 2e0 * (gsd * 1e-2)"), F.expr("height / 2e0 * (gsd * 1e-2)")
    return located(images).select("*", (F.col("e0") - dx).alias("west"), (F.col("n0") - dy).alias("south"), (F.col("e0") + dx).alias("east"), (F.col("n0") + dy).alias("north"))


def polygon(images: DataFrame, per_edge: int) -> DataFrame:
    """The points of the footprints' edges in degrees, per_edge from each corner on, counter-clockwise from the south-west."""
    k = F.col("nth") % per_edge / float(per_edge)
    side = F.floor(F.col("nth") / per_edge)
    rows = footprints(images).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(4 * per_edge - 1))))
    w, h = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    rows = rows.withColumn("east_at", F.when(side == 0, F.col("west") + w * k).when(side == 1, F.col("east")).when(side == 2, F.col("east") - w * k).otherwise(F.col("west")))
    rows = rows.withColumn("north_at", F.when(side == 0, F.col("south")).when(side == 1, F.col("south") + h * k).when(side == 2, F.col("north")).otherwise(F.col("north") - h * k))
    lat, lon = G.latlon_sql("east_at", "north_at", "zone", "latitude < 0")
    return rows.select("image_id", "nth", F.expr(lat).alias("lat"), F.expr(lon).alias("lon"))


def detection_gps(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections with the position of their centre, where the image has one."""
    px = G.pixel_utm_sql("cast((x1 + x2) / 2e0 AS bigint)", "cast((y1 + y2) / 2e0 AS bigint)", "width", "height", "gsd", "e0", "n0")
    rows = detections.join(located(images).select("image_id", "latitude", "width", "height", "gsd", "zone", "e0", "n0"), "image_id")
    rows = rows.withColumns({"east_at": F.expr(px[0]), "north_at": F.expr(px[1])})
    lat, lon = G.latlon_sql("east_at", "north_at", "zone", "latitude < 0")
    return rows.withColumns({"lat": F.expr(lat), "lon": F.expr(lon)}).select(*detections.columns, "lat", "lon")


def legs(images: DataFrame, by: str = "camp_id", order: str = "coords") -> DataFrame:
    """Each image with the distance in km from the one before on its campaign's path, which goes by position (as the reference analysis does) or by time."""
    along = ["latitude", "longitude", "altitude", "file_name"] if order == "coords" else ["ts", "file_name"]
    w = W.partitionBy(by).orderBy(*along)
    rows = images.where("latitude IS NOT NULL").select("*", F.lag("latitude").over(w).alias("lat0"), F.lag("longitude").over(w).alias("lon0"))
    return G.with_distance_km(rows, "lat0", "lon0", "latitude", "longitude", "km").drop("lat0", "lon0")


def path_metrics(images: DataFrame, by: str = "camp_id", order: str = "coords") -> DataFrame:
    """Per campaign: waypoints, total, mean, longest and shortest leg, altitude above ground (where known), hours."""
    high = F.when(F.col("altitude") > 0, F.col("altitude"))
    hours = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 3.6e9
    return legs(images, by, order).groupBy(by).agg(
        F.count("*").alias("waypoints"), F.coalesce(F.sum("km"), F.lit(0.0)).alias("total_km"), F.coalesce(F.avg("km"), F.lit(0.0)).alias("mean_km"), F.coalesce(F.max("km"), F.lit(0.0)).alias("max_km"), F.coalesce(F.min("km"), F.lit(0.0)).alias("min_km"),
        F.avg(high).alias("mean_altitude"), F.min(high).alias("min_altitude"), F.max(high).alias("max_altitude"), hours.alias("hours"),
    )


def detection_boxes(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections with their box on the ground: zone, west, south, east, north in metres."""
    one = located(images).select("image_id", "width", "height", "gsd", "zone", "e0", "n0")
    rows = detections.join(one, "image_id")
    at = {"west": G.pixel_utm_sql("x1", "y2", "width", "height", "gsd", "e0", "n0"), "east": G.pixel_utm_sql("x2", "y1", "width", "height", "gsd", "e0", "n0")}
    sides = {"west": at["west"][0], "south": at["west"][1], "east": at["east"][0], "north": at["east"][1]}
    return rows.select(*detections.columns, "zone", *[F.expr(v).alias(k) for k, v in sides.items()])


def duplicate_boxes(detections: DataFrame, images: DataFrame, image_threshold: float, box_threshold: float) -> DataFrame:
    """det_a > det_b and ciou of detections of one class in overlapping images whose boxes on the ground have a complete IoU above the threshold.

    Boxes meet on a grid of a sixteenth of a footprint, apart by zone and class, so no image's detections are paired with all of another's. They are computed and shuffled once; whether their images overlap
    is told by the two footprints of each pair of boxes that meets."""
    from . import overlap

    found = overlap.places(footprints(images))
    many, cell = found.agg(F.count("*"), F.greatest(F.avg(F.col("east") - F.col("west")), F.avg(F.col("north") - F.col("south"))) / 16).first()
    of = found.select(F.col("id").alias("place"), F.explode("images").alias("image_id"))
    boxes = detection_boxes(detections.join(of, "image_id"), images)
    boxes = boxes.select(F.col("det_key").alias("id"), F.concat_ws("|", F.col("zone").cast("string"), "class_name").alias("zone"), *overlap.SIDES, "image_id", "place")
    pairs = overlap.meeting(boxes, box_threshold, cell or 1.0, ["image_id", "place"]).where("image_id_a <> image_id_b").select("id_a", "id_b", "place_a", "place_b", F.col("ciou").alias("box_ciou"))
    for s in "ab":
        feet = found.select(F.col("id").alias(f"place_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in overlap.SIDES])
        pairs = pairs.join(F.broadcast(feet) if many <= 500_000 else feet, f"place_{s}")  # 24 MB
    pairs = pairs.where(ciou(*[f"{c}_{s}" for s in "ab" for c in overlap.SIDES]) > image_threshold)
    return pairs.select(F.col("id_a").alias("det_a"), F.col("id_b").alias("det_b"), F.col("box_ciou").alias("ciou"))


def tile_centres(tiles: DataFrame, images: DataFrame, border: int = 0) -> DataFrame:
    """Tiles (image_id, x0, y0, x1, y1) with the position of their centre, for images whose border of so many pixels was cut away before they were tiled."""
    one = located(images).select("image_id", "latitude", "width", "height", "gsd", "zone", "e0", "n0")
    px = G.pixel_utm_sql(f"((x0 + x1) / 2e0 + {border})", f"((y0 + y1) / 2e0 + {border})", "width", "height", "gsd", "e0", "n0")
    rows = tiles.join(one, "image_id").withColumns({"east_at": F.expr(px[0]), "north_at": F.expr(px[1])})
    lat, lon = G.latlon_sql("east_at", "north_at", "zone", "latitude < 0")
    return rows.withColumns({"lat": F.expr(lat), "lon": F.expr(lon)}).select(*tiles.columns, "lat", "lon")
