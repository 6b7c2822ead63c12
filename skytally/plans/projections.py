"""Scalar functions over boxes, ground positions, labels and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import geo as G
from ..functions import labels as L
from ..operators import curriculum, flight
from .book import Book

book = Book()
QUERIES, SQL = book.queries, book.sql
BOX = ("x1", "y1", "x2", "y2")
GSD = G.gsd_sql("180e0", "24e0", "35e0", "height")
E, N = G.utm_sql("latitude", "longitude")
FOOT = G.footprint_sql("latitude", "longitude", "width", "height", "gsd")
TRUNC = "cast(trunc(({a} + {b}) / 2e0) AS bigint)"


@book.query("detections", "SELECT det_key, (x2 - x1) * (y2 - y1) AS area, x2 - x1 AS w, y2 - y1 AS h, trunc((x1 + x2) / 2e0)::BIGINT AS cx, trunc((y1 + y2) / 2e0)::BIGINT AS cy FROM detections")
def p01_geometry(d: DataFrame) -> DataFrame:
    return d.select("det_key", B.area(*BOX).alias("area"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), B.center("x1", "x2").alias("cx"), B.center("y1", "y2").alias("cy"))


@book.query(
    "detections images",
    """SELECT det_key, x1 + y1 + x2 + y2 = 0 OR class_name = 'EMPTY' AS is_empty, round(coalesce(sqrt(pow(trunc((x1 + x2) / 2e0) - width / 2e0, 2) + pow(trunc((y1 + y2) / 2e0) - height / 2e0, 2)), 99999e0), 6) AS distance
FROM detections LEFT JOIN (SELECT image_id, CASE WHEN image_id % 19 <> 0 THEN width END AS width, height FROM images) USING (image_id)""",
)
def p02_p03_empty_and_distance(d: DataFrame, images: DataFrame) -> DataFrame:
    sizes = images.select("image_id", F.when(F.col("image_id") % 19 != 0, F.col("width")).alias("width"), "height")
    return d.join(sizes, "image_id", "left").select("det_key", B.is_empty(*BOX, "class_name").alias("is_empty"), F.round(B.distance_to_center(*BOX, "width", "height"), 6).alias("distance"))


@book.query("detections", "SELECT det_key, greatest(0, least(x1 - 40 + 800, 1600)) AS x1, greatest(0, least(y1 - 40 + 640, 1600)) AS y1, greatest(0, least(x2 - 40 + 800, 1600)) AS x2, greatest(0, least(y2 - 40 + 640, 1600)) AS y2 FROM detections")
def p04_p05_offset_and_clamp(d: DataFrame) -> DataFrame:
    return d.select("det_key", *[B.clamp(F.col(v) - 40 + (800 if v[0] == "x" else 640), 0, 1600).alias(v) for v in BOX])


@book.query(
    "detections images",
    """SELECT det_key, round(x1 / width::DOUBLE, 9) AS rx, round(y1 / height::DOUBLE, 9) AS ry, round((x2 - x1) / width::DOUBLE, 9) AS rw, round((y2 - y1) / height::DOUBLE, 9) AS rh,
round(x1 / width::DOUBLE * 100, 7) AS px, round(y1 / height::DOUBLE * 100, 7) AS py, round((x2 - x1) / width::DOUBLE * 100, 7) AS pw, round((y2 - y1) / height::DOUBLE * 100, 7) AS ph FROM detections JOIN images USING (image_id)""",
)
def p06_p07_relative_boxes(d: DataFrame, images: DataFrame) -> DataFrame:
    d = d.join(images.select("image_id", "width", "height"), "image_id")
    sides = {"x": ("x1", "width"), "y": ("y1", "height"), "w": (F.col("x2") - F.col("x1"), "width"), "h": (F.col("y2") - F.col("y1"), "height")}
    return d.select("det_key", *[F.round(B.relative(*v), 9).alias(f"r{k}") for k, v in sides.items()], *[F.round(B.percent(*v), 7).alias(f"p{k}") for k, v in sides.items()])


@book.query("annotations", "SELECT id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM annotations")
def p08_coco_to_corners(a: DataFrame) -> DataFrame:
    return a.select("id", *[F.expr(e).cast("long").alias(n) for e, n in (("x", "x1"), ("y", "y1"), ("x + w", "x2"), ("y + h", "y2"))])


@book.query(
    "annotations images",
    """WITH p AS (SELECT id, width, height, x * 100e0 / width * 1.3e0 - 5 AS px, y * 100e0 / height * 1.3e0 - 5 AS py, w * 100e0 / width AS pw, h * 100e0 / height AS ph FROM annotations JOIN images USING (image_id))
SELECT id, round(px / 100e0 * width, 6) + 0.0 AS x_pixel, round(pw / 100e0 * width, 6) AS w_pixel, round((px + pw / 2) / 100, 9) + 0.0 AS cx, round((py + ph / 2) / 100, 9) + 0.0 AS cy, round(pw * ph / 10000, 9) AS area,
round(greatest(0, least(px, 100)), 6) AS clipped_x, round(greatest(0, least(pw, 100 - greatest(0, px))), 6) AS clipped_w FROM p""",
)
def p09_p10_percent_boxes(a: DataFrame, images: DataFrame) -> DataFrame:
    p = a.join(images.select("image_id", "width", "height"), "image_id").select(
        "id", "width", "height", (F.col("x") * 100.0 / F.col("width") * 1.3 - 5).alias("px"), (F.col("y") * 100.0 / F.col("height") * 1.3 - 5).alias("py"), (F.col("w") * 100.0 / F.col("width")).alias("pw"), (F.col("h") * 100.0 / F.col("height")).alias("ph")
    )
    start, length = B.clip_percent("px", "pw")
    return p.select(
        "id", (F.round(B.from_percent("px", "width"), 6) + 0.0).alias("x_pixel"), F.round(B.from_percent("pw", "width"), 6).alias("w_pixel"), (F.round((F.col("px") + F.col("pw") / 2) / 100, 9) + 0.0).alias("cx"), (F.round((F.col("py") + F.col("ph") / 2) / 100, 9) + 0.0).alias("cy"),
        F.round(F.col("pw") * F.col("ph") / 10000, 9).alias("area"), F.round(start, 6).alias("clipped_x"), F.round(length, 6).alias("clipped_w"),
    )


@book.query(
    "annotations",
    """WITH b AS (SELECT id, x - 4e0 AS x, y - 4e0 AS y, w::DOUBLE AS w, h::DOUBLE AS h, 3600e0 AS bw, 2700e0 AS bh FROM annotations),
v AS (SELECT *, x >= -5 AND y >= -5 AND x + w <= bw + 5 AND y + h <= bh + 5 AS ok, greatest(0, least(x, bw)) AS ax, greatest(0, least(y, bh)) AS ay FROM b),
k AS (SELECT *, greatest(0, least(w, bw - ax)) AS aw, greatest(0, least(h, bh - ay)) AS ah FROM v)
SELECT id, CASE WHEN ok THEN floor(ax) ELSE x END AS cx, CASE WHEN ok THEN floor(ay) ELSE y END AS cy, CASE WHEN ok THEN floor(aw) ELSE w END AS cw, CASE WHEN ok THEN floor(ah) ELSE h END AS ch,
false AS was_clipped, ok AND (ax <> x OR ay <> y OR aw <> w OR ah <> h) AS was_clipped_fixed, ok AS is_valid FROM k""",
)
def p11_clip_box(a: DataFrame) -> DataFrame:
    a = a.select("id", (F.col("x") - 4).alias("x"), (F.col("y") - 4).alias("y"), "w", "h")
    return a.select("id", *[v.alias(k) for k, v in B.clip_box("x", "y", "w", "h", F.lit(3600), F.lit(2700)).items()])


@book.query(
    "annotations images categories",
    "SELECT id, printf('%d %.6f %.6f %.6f %.6f', category_id - 1, (x + w / 2e0) / width, (y + h / 2e0) / height, w::DOUBLE / width, h::DOUBLE / height) AS line FROM annotations JOIN images USING (image_id) JOIN categories USING (class_name)",
)
def p12_yolo_line(a: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    rows = a.join(images.select("image_id", "width", "height"), "image_id").join(categories, "class_name")
    return rows.select("id", B.yolo_line(F.col("category_id") - 1, "x", "y", "w", "h", "width", "height").alias("line"))


@book.query(
    "annotations images",
    """WITH n AS (SELECT id, width, height, (x + w / 2e0) / width AS cx, (y + h / 2e0) / height AS cy, w::DOUBLE / width AS nw, h::DOUBLE / height AS nh FROM annotations JOIN images USING (image_id))
SELECT id, round((cx - nw / 2) * width, 5) AS x, round((cy - nh / 2) * height, 5) AS y, round(nw * width, 5) AS w, round(nh * height, 5) AS h FROM n""",
)
def p13_yolo_to_coco(a: DataFrame, images: DataFrame) -> DataFrame:
    n = a.join(images.select("image_id", "width", "height"), "image_id").select("id", "width", "height", F.expr("(x + w / 2e0) / width").alias("cx"), F.expr("(y + h / 2e0) / height").alias("cy"), F.expr("w / width").alias("nw"), F.expr("h / height").alias("nh"))
    return n.select("id", *[F.round(v, 5).alias(k) for k, v in zip("xywh", B.yolo_to_coco("cx", "cy", "nw", "nh", "width", "height"), strict=True)])


@book.query("images", f"SELECT image_id, {GSD} AS gsd, round({E}, 3) AS easting, round({N}, 3) AS northing, {G.zone_sql('latitude', 'longitude')}::BIGINT AS zone FROM images WHERE latitude IS NOT NULL")
def p14_p15_gsd_and_utm(images: DataFrame) -> DataFrame:
    rows = images.where("latitude IS NOT NULL")
    return rows.select("image_id", F.expr(GSD).alias("gsd"), F.round(F.expr(E), 3).alias("easting"), F.round(F.expr(N), 3).alias("northing"), F.expr(G.zone_sql("latitude", "longitude")).cast("long").alias("zone"))


FOOT_SQL = "WITH g AS (SELECT *, " + GSD + " AS gsd FROM images WHERE latitude IS NOT NULL), f AS (SELECT image_id, " + ", ".join(f"{v} AS {k}" for k, v in FOOT.items()) + " FROM g)"


@book.query("images", FOOT_SQL + " SELECT image_id, round(west, 3) AS west, round(south, 3) AS south, round(east, 3) AS east, round(north, 3) AS north FROM f")
def p16_footprint(images: DataFrame) -> DataFrame:
    f = flight.footprints(images)
    return f.select("image_id", *[F.round(k, 3).alias(k) for k in FOOT])


@book.query(
    "images",
    FOOT_SQL + """ SELECT image_id, round((east - west) * (north - south), 2) AS area, round((west + east) / 2, 3) AS center_x, round((south + north) / 2, 3) AS center_y, round(west - 10, 3) AS grown_west, round(north + 10, 3) AS grown_north,
round(greatest(0, least(east, 350000e0) - greatest(west, 349000e0)) * greatest(0, least(north, 7350000e0) - greatest(south, 7345000e0)), 1) AS overlap FROM f""",
)
def p17_bounds(images: DataFrame) -> DataFrame:
    f = flight.footprints(images)
    return f.select(
        "image_id", F.round(B.area("west", "south", "east", "north"), 2).alias("area"), F.round((F.col("west") + F.col("east")) / 2, 3).alias("center_x"), F.round((F.col("south") + F.col("north")) / 2, 3).alias("center_y"), F.round(F.col("west") - 10, 3).alias("grown_west"), F.round(F.col("north") + 10, 3).alias("grown_north"),
        F.round(F.greatest(F.lit(0.0), F.least("east", F.lit(350000.0)) - F.greatest("west", F.lit(349000.0))) * F.greatest(F.lit(0.0), F.least("north", F.lit(7350000.0)) - F.greatest("south", F.lit(7345000.0))), 1).alias("overlap"),
    )


POINTS = "east_at", "north_at"
LAT, LON = G.latlon_sql("east_at", "north_at", "zone", "latitude < 0")


@book.query(
    "images",
    FOOT_SQL.replace("SELECT image_id,", "SELECT image_id, latitude, " + G.zone_sql("latitude", "longitude") + " AS zone,") + f""",
p AS (SELECT image_id, latitude, zone, side * 10 + k AS nth, CASE side WHEN 0 THEN west + (east - west) * k / 10e0 WHEN 1 THEN east WHEN 2 THEN east - (east - west) * k / 10e0 ELSE west END AS east_at,
 CASE side WHEN 0 THEN south WHEN 1 THEN south + (north - south) * k / 10e0 WHEN 2 THEN north ELSE north - (north - south) * k / 10e0 END AS north_at FROM f, (SELECT unnest(range(4)) AS side), (SELECT unnest(range(10)) AS k))
SELECT image_id, nth::INT AS nth, round({LAT}, 8) AS lat, round({LON}, 8) AS lon FROM p""",
)
def p18_polygon_points(images: DataFrame) -> DataFrame:
    return flight.polygon(images, 10).select("image_id", "nth", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


CIOU_SQL = """{iou} - (pow(a.x1 + a.x2 - b.x1 - b.x2, 2) + pow(a.y1 + a.y2 - b.y1 - b.y2, 2)) / 4e0 / (pow(greatest(a.x2, b.x2) - least(a.x1, b.x1), 2) + pow(greatest(a.y2, b.y2) - least(a.y1, b.y1), 2))
 - pow({v}, 2) / greatest(1e-12, 1 - {iou} + {v})""".replace("{iou}", B.IOU_SQL.format(a="a.", b="b.")).replace("{v}", "(4e0 / (pi() * pi()) * pow(atan((a.x2 - a.x1)::DOUBLE / (a.y2 - a.y1)) - atan((b.x2 - b.x1)::DOUBLE / (b.y2 - b.y1)), 2))")


@book.query("dense", f"SELECT a.det_key AS a, b.det_key AS b, round({B.IOU_SQL.format(a='a.', b='b.')}, 9) AS iou, round({CIOU_SQL}, 9) AS ciou FROM dense a JOIN dense b ON a.image_id = b.image_id AND a.pos < b.pos")
def p19_ciou(d: DataFrame) -> DataFrame:
    a, b = (d.select("image_id", *[F.col(c).alias(f"{s}_{c}") for c in ("det_key", "pos", *BOX)]) for s in "ab")
    pairs = a.join(b, "image_id").where("a_pos < b_pos")
    boxes = [f"{s}_{c}" for s in "ab" for c in BOX]
    return pairs.select(F.col("a_det_key").alias("a"), F.col("b_det_key").alias("b"), F.round(B.iou(*boxes), 9).alias("iou"), F.round(B.ciou(*boxes), 9).alias("ciou"))


@book.query(
    "images",
    """SELECT image_id, floor(abs(latitude))::BIGINT AS lat_d, floor((abs(latitude) - floor(abs(latitude))) * 60)::BIGINT AS lat_m, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS lat_ref,
CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS lon_ref, CASE WHEN altitude >= 0 THEN 0 ELSE 1 END AS alt_ref, round(latitude, 9) AS back FROM images WHERE latitude IS NOT NULL""",
)
def p20_dms(images: DataFrame) -> DataFrame:
    d, m, s = G.dms(F.col("latitude"))
    rows = images.where("latitude IS NOT NULL").select("image_id", "latitude", "longitude", "altitude", d.alias("d"), m.alias("m"), s.alias("s"))
    sign = F.when(F.col("latitude") >= 0, 1).otherwise(-1)
    return rows.select(
        "image_id", F.col("d").cast("long").alias("lat_d"), F.col("m").cast("long").alias("lat_m"), F.when(F.col("latitude") >= 0, "N").otherwise("S").alias("lat_ref"), F.when(F.col("longitude") >= 0, "E").otherwise("W").alias("lon_ref"),
        F.when(F.col("altitude") >= 0, 0).otherwise(1).alias("alt_ref"), F.round(sign * (F.col("d") + F.col("m") / 60 + F.col("s") / 3600), 9).alias("back"),
    )


PX = G.pixel_utm_sql("trunc((x1 + x2) / 2e0)", "trunc((y1 + y2) / 2e0)", "width", "height", "gsd", "e0", "n0")


@book.query(
    "detections images",
    f"""WITH g AS (SELECT image_id, latitude, width, height, {G.zone_sql('latitude', 'longitude')} AS zone, {GSD} AS gsd, {E} AS e0, {N} AS n0 FROM images WHERE latitude IS NOT NULL),
p AS (SELECT det_key, latitude, zone, {PX[0]} AS east_at, {PX[1]} AS north_at FROM detections JOIN g USING (image_id))
SELECT det_key, round({LAT}, 8) AS lat, round({LON}, 8) AS lon FROM p""",
)
def p21_detection_gps(d: DataFrame, images: DataFrame) -> DataFrame:
    return flight.detection_gps(d, images).select("det_key", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@book.query(
    "detections images",
    """SELECT det_key, greatest(0, least((x1 + x2) / 2e0 - 64, width - 1)) AS sx1, greatest(0, least((y1 + y2) / 2e0 - 64, height - 1)) AS sy1, greatest(0, least((x1 + x2) / 2e0 + 64, width - 1)) AS sx2, greatest(0, least((y1 + y2) / 2e0 + 64, height - 1)) AS sy2,
greatest(0, least((x1 + x2) / 2e0 - 64, width)) AS ex1, greatest(0, least((y1 + y2) / 2e0 + 64, height)) AS ey2 FROM detections JOIN images USING (image_id)""",
)
def p22_p42_square_boxes(d: DataFrame, images: DataFrame) -> DataFrame:
    d = d.join(images.select("image_id", "width", "height"), "image_id")
    inner = B.square_around(*BOX, 128, F.col("width") - 1, F.col("height") - 1)
    outer = B.square_around(*BOX, 128, F.col("width"), F.col("height"))
    return d.select("det_key", *[v.alias(f"s{k}") for k, v in zip(BOX, inner, strict=True)], outer[0].alias("ex1"), outer[3].alias("ey2"))


@book.query(
    "dense",
    """SELECT det_key, greatest(0, x1 - 8) AS rx, greatest(0, y1 - 8) AS ry, least(320, x2 + 8) AS rx2, least(240, y2 + 8) AS ry2, least(320, x2 + 8) - greatest(0, x1 - 8) >= 32 AND least(240, y2 + 8) - greatest(0, y1 - 8) >= 32 AS large_enough FROM dense""",
)
def p23_f15_roi_boxes(d: DataFrame) -> DataFrame:
    d = d.select("det_key", F.greatest(F.lit(0), F.col("x1") - 8).alias("rx"), F.greatest(F.lit(0), F.col("y1") - 8).alias("ry"), F.least(F.lit(320), F.col("x2") + 8).alias("rx2"), F.least(F.lit(240), F.col("y2") + 8).alias("ry2"))
    return d.withColumn("large_enough", (F.col("rx2") - F.col("rx") >= 32) & (F.col("ry2") - F.col("ry") >= 32))


AXIS = """{p}m AS (SELECT *, greatest(0, trunc(({a} + {b}) / 2e0 - 64)::BIGINT) AS lo, least({limit}, trunc(({a} + {b}) / 2e0 + 64)::BIGINT) AS hi FROM {src}),
{p}n AS (SELECT * EXCLUDE (lo, hi), CASE WHEN {limit} < 128 THEN 0 WHEN hi - lo < 128 AND lo <> 0 THEN greatest(0, hi - 128) ELSE lo END AS lo, CASE WHEN {limit} < 128 THEN {limit} WHEN hi - lo < 128 AND lo = 0 THEN least({limit}, 128) ELSE hi END AS hi FROM {p}m),
{p}o AS (SELECT * EXCLUDE (lo, hi), greatest(0, least(lo, {limit} - 1)) AS {a}c, greatest(greatest(0, least(lo, {limit} - 1)) + 1, least(hi, {limit})) AS {b}c FROM {p}n)"""


@book.query("dense", "WITH " + AXIS.format(p="x", a="x1", b="x2", limit="300", src="dense") + ",\n" + AXIS.format(p="y", a="y1", b="y2", limit="100", src="xo") + " SELECT det_key, x1c::BIGINT AS x1c, x2c::BIGINT AS x2c, y1c::BIGINT AS y1c, y2c::BIGINT AS y2c, x2c > x1c + 9 AS wide FROM yo")
def p24_p25_g06_crops(d: DataFrame) -> DataFrame:
    x1, x2 = B.shifted_crop("x1", "x2", 128, F.lit(300))
    y1, y2 = B.shifted_crop("y1", "y2", 128, F.lit(100))
    return d.select("det_key", x1.cast("long").alias("x1c"), x2.cast("long").alias("x2c"), y1.cast("long").alias("y1c"), y2.cast("long").alias("y2c"), (x2 > x1 + 9).alias("wide"))


@book.query("detections", "SELECT det_key, greatest(trunc((x1 + x2) / 2e0)::BIGINT - 48, 0) AS x1, greatest(trunc((y1 + y2) / 2e0)::BIGINT - 48, 0) AS y1, least(trunc((x1 + x2) / 2e0)::BIGINT + 48, 3600) AS x2, least(trunc((y1 + y2) / 2e0)::BIGINT + 48, 2700) AS y2 FROM detections WHERE least(trunc((x1 + x2) / 2e0) + 48, 3600) - greatest(trunc((x1 + x2) / 2e0) - 48, 0) >= 10 AND least(trunc((y1 + y2) / 2e0) + 48, 2700) - greatest(trunc((y1 + y2) / 2e0) - 48, 0) >= 10")
def p25_classifier_windows(d: DataFrame) -> DataFrame:
    x1, x2 = B.crop_window(B.center("x1", "x2"), F.lit(3600), 96)
    y1, y2 = B.crop_window(B.center("y1", "y2"), F.lit(2700), 96)
    return d.select("det_key", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("x2 - x1 >= 10 AND y2 - y1 >= 10")


@book.query(
    "images dense",
    """WITH a AS (SELECT image_id, count(*) AS n, avg(((x2 - x1) * (y2 - y1))::DOUBLE) AS mean, sum((x2 - x1) * (y2 - y1)) / 640000e0 AS cover FROM dense GROUP BY 1),
s AS (SELECT image_id, n, 1 - least(1, mean / 40000) AS by_area, 1 - least(1, n / 10e0) AS by_count, CASE WHEN cover < 0.01 THEN 1 WHEN cover > 0.5 THEN 0 ELSE greatest(0, least(1, 1 - (cover - 0.01e0) / 0.49e0)) END AS by_cover FROM a)
SELECT image_id, round(CASE WHEN n IS NULL THEN 0.5e0 ELSE 0.4e0 * by_area + 0.3e0 * by_count + 0.3e0 * by_cover END, 9) AS difficulty FROM images LEFT JOIN s USING (image_id)""",
)
def p26_a23_difficulty(images: DataFrame, d: DataFrame) -> DataFrame:
    return curriculum.difficulty(images, d).select("image_id", F.round("difficulty", 9).alias("difficulty"))


@book.query(
    "region",
    """SELECT e AS epoch, round(least(1, 0.2e0 + (1 - 0.2e0) * least(1, e / 10e0)), 9) AS linear, round(1 - exp(-3 * least(1, e / 10e0)), 9) AS exponential, 1e0 AS constant FROM (SELECT unnest(range(21))::INT AS e)""",
)
def p27_schedule(region: DataFrame) -> DataFrame:
    epochs = region.sparkSession.range(21).select(F.col("id").cast("int").alias("epoch"))
    return epochs.select("epoch", *[F.round(v, 9).alias(k) for k, v in curriculum.schedules(F.col("epoch"), 10, 0.2, 1.0).items()])


@book.query("detections categories", "SELECT det_key, (category_id <> 1)::INT AS is_wildlife, category_id + 1 AS shifted, CASE WHEN category_id = 1 THEN 0 ELSE category_id END AS with_background FROM detections JOIN categories USING (class_name)")
def p28_p29_label_maps(d: DataFrame, categories: DataFrame) -> DataFrame:
    rows = d.join(F.broadcast(categories), "class_name")  # a handful of classes
    return rows.select("det_key", L.binary("category_id", [1]).alias("is_wildlife"), (F.col("category_id") + 1).alias("shifted"), F.when(F.col("category_id") == 1, 0).otherwise(F.col("category_id")).alias("with_background"))


@book.query("gt_pred", "SELECT det_key, round(score * (0.5e0 + (det_key % 50) / 100e0), 9) AS fused, CASE WHEN det_key % 3 = 0 THEN 'other' ELSE class_name END AS class_name FROM gt_pred WHERE role = 'pred' AND det_key % 7 <> 0")
def p30_f23_score_fusion(g: DataFrame) -> DataFrame:
    g = g.where("role = 'pred'")
    classified = g.select("det_key", F.expr("0.5e0 + (det_key % 50) / 100e0").alias("score2"), F.expr("CASE WHEN det_key % 3 = 0 THEN 'other' ELSE class_name END").alias("class2")).where("det_key % 7 <> 0")
    return g.join(classified, "det_key").select("det_key", F.round(F.col("score") * F.col("score2"), 9).alias("fused"), F.col("class2").alias("class_name"))


@book.query(
    "embeddings",
    """WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE * 8) AS z FROM embeddings), s AS (SELECT *, list_sum(list_transform(z, lambda x: exp(x))) AS total FROM l)
SELECT vec_id, list_position(z, list_max(z))::INT - 1 AS class_id, round(exp(list_max(z)) / total, 7) AS score FROM s""",
)
def p31_softmax(e: DataFrame) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 8)
    class_id, score = L.softmax_top(z)
    return e.select("vec_id", class_id.alias("class_id"), F.round(score, 7).alias("score"))


@book.query(
    "pages",
    """SELECT page_id, regexp_replace(regexp_extract(url, '[^/?#]*$'), '%20', ' ', 'g') AS base, replace(url, '/images/', '/labels/') AS label_path, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host FROM pages""",
)
def p33_p34_paths(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.regexp_replace(F.regexp_extract("url", "[^/?#]*$", 0), "%20", " ").alias("base"), F.replace("url", F.lit("/images/"), F.lit("/labels/")).alias("label_path"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))


@book.query(
    "images",
    """SELECT image_id, regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) || '_tile_' || image_id % 12 AS tile, regexp_extract(file_name, '([0-9]+)\\.jpg$', 1)::BIGINT AS nth, regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) || '_aug_' || image_id % 3 || '.jpg' AS augmented FROM images""",
)
def p32_p35_p36_names(images: DataFrame) -> DataFrame:
    stem = L.stem("file_name")
    parsed = F.str_to_map(F.concat(F.lit("tile:"), F.col("image_id") % 12, F.lit(",copy:"), F.col("image_id") % 3), F.lit(","), F.lit(":"))
    return images.select("image_id", F.concat(stem, F.lit("_tile_"), parsed["tile"]).alias("tile"), F.regexp_extract("file_name", r"([0-9]+)\.jpg$", 1).cast("long").alias("nth"), F.concat(stem, F.lit("_aug_"), parsed["copy"], F.lit(".jpg")).alias("augmented"))


@book.query("dense", "SELECT image_id, count(*) AS n, sum((x2 - x1) * (y2 - y1))::BIGINT AS area, round(avg((x1 + x2) / 2e0), 6) AS cx, round(avg((y1 + y2) / 2e0), 6) AS cy FROM dense GROUP BY image_id")
def p39_p40_targets(d: DataFrame) -> DataFrame:
    return d.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(B.area(*BOX)).alias("area"), F.round(F.avg((F.col("x1") + F.col("x2")) / 2), 6).alias("cx"), F.round(F.avg((F.col("y1") + F.col("y2")) / 2), 6).alias("cy"))
