"""Duplicates by box, removal statistics, configurations, structure checks, regions, crops and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import census, curriculum, datasets, flight, greedy, sampling, validate
from .book import Book
from .joins import EDGES_SQL, SPLIT
from .projections import CIOU_SQL, GSD
from .windows import NMS_SQL

book = Book()
QUERIES, SQL = book.queries, book.sql

PX = [G.pixel_utm_sql(x, y, "width", "height", "gsd", "e0", "n0") for x, y in (("x1", "y2"), ("x2", "y1"))]
E0, N0 = G.utm_sql("latitude", "longitude")
BOX_CIOU = CIOU_SQL.replace("x1", "west").replace("y1", "south").replace("x2", "east").replace("y2", "north")


@book.query(
    "images detections",
    EDGES_SQL
    + f""", lo AS MATERIALIZED (SELECT image_a, image_b FROM e WHERE ciou > 0.2e0), c AS MATERIALIZED (SELECT image_id, width, height, {GSD} AS gsd, {E0} AS e0, {N0} AS n0 FROM images WHERE latitude IS NOT NULL),
b AS MATERIALIZED (SELECT det_key, image_id, class_name, {PX[0][0]} AS west, {PX[0][1]} AS south, {PX[1][0]} AS east, {PX[1][1]} AS north FROM detections JOIN c USING (image_id)),
p AS (SELECT greatest(a.det_key, b.det_key) AS det_a, least(a.det_key, b.det_key) AS det_b, {BOX_CIOU} AS box_ciou FROM lo JOIN b a ON a.image_id = image_a JOIN b ON b.image_id = image_b AND a.class_name = b.class_name)
SELECT det_a, det_b, round(box_ciou, 6) AS ciou FROM p WHERE box_ciou > 0.01e0""",
)
def j09_duplicate_boxes(images: DataFrame, d: DataFrame) -> DataFrame:
    """Pairs of detections of one class whose boxes on the ground overlap, in overlapping images."""
    return flight.duplicate_boxes(d, images, 0.2, 0.01).select("det_a", "det_b", F.round("ciou", 6).alias("ciou"))


@book.query(
    "dense",
    f"""WITH RECURSIVE {NMS_SQL}, s AS (SELECT image_id, unnest(kept).k AS det_key FROM m WHERE i = len(l) + 1)
SELECT class_name, count(*) AS total, count(s.det_key) AS kept, count(*) - count(s.det_key) AS removed, round((count(*) - count(s.det_key)) / count(*)::DOUBLE, 9) AS share, round(avg(confidence) FILTER (s.det_key IS NOT NULL), 9) AS mean_confidence
FROM dense LEFT JOIN s USING (det_key) GROUP BY class_name""",
)
def a07_removal_by_class(d: DataFrame) -> DataFrame:
    out = census.removal_by_class(d, greedy.nms(d, 0.5))
    return out.select("class_name", "total", "kept", "removed", F.round("share", 9).alias("share"), F.round("mean_confidence", 9).alias("mean_confidence"))


@book.query("images", f"SELECT {SPLIT} AS split, count(DISTINCT file_name) AS paths FROM images GROUP BY 1")
def u03_merged_config_paths(images: DataFrame) -> DataFrame:
    """The datasets' data configurations as one: different paths of each split."""
    twice = images.select(F.col("dataset").alias("config"), F.expr(SPLIT).alias("split"), F.col("file_name").alias("path"))
    names = images.sparkSession.createDataFrame([("F", 0, "deer"), ("O", 0, "deer"), ("O", 1, "elk")], "config string, class_id int, name string")
    paths, _ = datasets.merge_configs(twice.unionByName(twice.withColumn("config", F.lit("again"))), names)
    return paths.groupBy("split").agg(F.count("*").alias("paths"))


@book.query("categories", "SELECT category_id - 1 AS class_id, 'class_' || (category_id - 1) AS name FROM categories")
def u03_merged_config_names(categories: DataFrame) -> DataFrame:
    """Configurations that name classes differently, forced: made-up names."""
    one = categories.select(F.lit("a").alias("config"), (F.col("category_id") - 1).alias("class_id"), F.col("class_name").alias("name"))
    other = one.select(F.lit("b").alias("config"), "class_id", F.lower("name").alias("name"))
    return datasets.merge_configs(one.select("config", F.lit("train").alias("split"), F.col("name").alias("path")), one.unionByName(other), force=True)[1]


@book.query(
    "images annotations categories",
    f"""WITH i AS (SELECT {SPLIT} AS split, image_id FROM images WHERE image_id % 5 <> 0), l AS (SELECT {SPLIT} AS split, image_id, bool_or(category_id > 3) AS bad FROM annotations JOIN categories USING (class_name) GROUP BY 1, 2),
b AS (SELECT coalesce(i.split, l.split) AS split, coalesce(i.image_id, l.image_id) AS image_id, i.image_id AS i, l.image_id AS l, bad FROM i FULL JOIN l ON i.image_id = l.image_id)
SELECT split, 'img_' || image_id AS stem, 'no labels' AS problem FROM b WHERE l IS NULL UNION ALL SELECT split, 'img_' || image_id, 'no image' FROM b WHERE i IS NULL UNION ALL SELECT split, 'img_' || image_id, 'unknown class' FROM b WHERE bad""",
)
def f09_yolo_structure(images: DataFrame, a: DataFrame, categories: DataFrame) -> DataFrame:
    """A configuration of three classes, over a dataset in which a fifth of the images are missing."""
    stem = F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("stem")
    there = images.where("image_id % 5 <> 0").select(F.expr(SPLIT).alias("split"), stem)
    lines = a.join(F.broadcast(categories), "class_name").select(F.expr(SPLIT).alias("split"), stem, (F.col("category_id") - 1).alias("class_id"))  # a label set
    return validate.yolo_structure(there, lines, 3)


@book.query(
    "images annotations",
    """SELECT i.image_id, a.id AS original_annotation_id, a.class_name, file_name || '_' || a.id AS name, 'annotation' AS kind FROM images i JOIN annotations a USING (image_id) WHERE a.w >= 20 AND a.h >= 20
UNION ALL SELECT image_id, NULL, 'background', file_name || '_bg' || k, 'random' FROM images, (SELECT unnest(range(2)) AS k) WHERE image_id NOT IN (SELECT image_id FROM annotations)""",
)
def g07_roi_rows(images: DataFrame, a: DataFrame) -> DataFrame:
    """Regions of interest: one an annotation that is large enough, and two random ones of the background of each image without any."""
    own = a.where("w >= 20 AND h >= 20").join(images.select("image_id", "file_name"), "image_id")
    own = own.select("image_id", F.col("id").alias("original_annotation_id"), "class_name", F.concat_ws("_", "file_name", F.col("id").cast("string")).alias("name"), F.lit("annotation").alias("kind"))
    rest = images.join(a, "image_id", "left_anti").select("image_id", "file_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return own.unionByName(rest.select("image_id", F.lit(None).cast("long").alias("original_annotation_id"), F.lit("background").alias("class_name"), F.concat("file_name", F.lit("_bg"), F.col("k").cast("string")).alias("name"), F.lit("random").alias("kind")))


CROPS = "SELECT id * 10 + k AS crop_id, id AS annotation_id, class_name, CASE WHEN k = 0 THEN 'object' ELSE 'context' END AS kind FROM annotations, (SELECT unnest(range(2)) AS k)"


def crops(a: DataFrame) -> DataFrame:
    rows = a.select("id", "class_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select((F.col("id") * 10 + F.col("k")).alias("crop_id"), F.col("id").alias("annotation_id"), "class_name", F.when(F.col("k") == 0, "object").otherwise("context").alias("kind"))


@book.query("annotations", f"SELECT crop_id, class_name, kind FROM ({CROPS}) WHERE class_name IN ('PROMO', 'ECONOMY') AND kind = 'object'")
def f19_crops_by_class(a: DataFrame) -> DataFrame:
    return curriculum.crops_of(crops(a), ["PROMO", "ECONOMY"], ["object"]).select("crop_id", "class_name", "kind")


@book.query("annotations", f"SELECT a.id, a.image_id, a.class_name, count(*) AS crops FROM annotations a JOIN ({CROPS}) c ON c.annotation_id = a.id WHERE crop_id % 3 <> 0 GROUP BY 1, 2, 3")
def c13_crops_back_to_images(a: DataFrame) -> DataFrame:
    return curriculum.crops_to_images(crops(a).where("crop_id % 3 <> 0"), a).select("id", "image_id", "class_name", "crops")


@book.query(
    "images",
    """WITH m AS (SELECT image_id, height, CASE image_id % 4 WHEN 0 THEN 'FC6310' WHEN 1 THEN 'ZenmuseP1' WHEN 2 THEN 'other' END AS model, CASE WHEN image_id % 3 = 0 THEN 35e0 END AS focal, CASE WHEN image_id % 5 = 0 THEN 13.2e0 END AS sensor FROM images),
s AS (SELECT *, coalesce(sensor, CASE WHEN model IN ('FC6310', 'ZenmuseP1') THEN 24e0 END) AS mm, coalesce(focal, 50e0) AS f FROM m) SELECT image_id, round(180e0 * 100e0 * (mm * 0.1e0) / (f * 0.1e0 * height), 3) AS gsd FROM s""",
)
def p14_gsd_of_camera(images: DataFrame) -> DataFrame:
    """Sample distances with the sensor of the camera's model and the image's own focal length where none is specified."""
    model = F.expr("CASE image_id % 4 WHEN 0 THEN 'FC6310' WHEN 1 THEN 'ZenmuseP1' WHEN 2 THEN 'other' END")
    focal, sensor = F.when(F.col("image_id") % 3 == 0, F.lit(35.0)), F.when(F.col("image_id") % 5 == 0, F.lit(13.2))
    return images.select("image_id", G.gsd_of_camera(F.lit(180.0), F.col("height"), model, focal, sensor, F.lit(50.0)).alias("gsd"))


@book.query("embeddings", None)
def c08_clusters(e: DataFrame) -> DataFrame:
    """k-means of the best silhouette; tested by its invariants, since no other engine draws the same starts."""
    return sampling.clusters(e, "embedding").select("vec_id", "cluster", "k")
