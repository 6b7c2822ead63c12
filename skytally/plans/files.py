"""Round trips through files: what a writer leaves is what the reader finds, and SQL tells what that is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flight, overlap, tiles
from ..sources import readers, writers
from ..streaming import ingest
from .book import Book
from .joins import SPLIT
from .projections import GSD

book = Book()
QUERIES, SQL = book.queries, book.sql


def place(rows: DataFrame, name: str) -> tuple[SparkSession, str]:
    """The session, and a new folder in the one that the cluster shares."""
    spark = rows.sparkSession
    folder = f"{overlap.shared_folder(spark)}/skytally-files-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark, folder


@book.query(
    "detections images",
    "SELECT latitude, longitude, altitude, file_name AS image_path, class_name, confidence, trunc((x1 + x2) / 2)::BIGINT AS x_center, trunc((y1 + y2) / 2)::BIGINT AS y_center, x2 - x1 AS width, y2 - y1 AS height FROM detections JOIN images USING (image_id)",
)
def k01_detections_csv(d: DataFrame, images: DataFrame) -> DataFrame:
    spark, path = place(d, "detections")
    writers.detections_csv(d, images.drop("width", "height"), path)
    return spark.read.schema("latitude double, longitude double, altitude double, image_path string, class_name string, confidence double, x_center long, y_center long, width long, height long").csv(path, header=True)


@book.query("detections images", "SELECT latitude, longitude, altitude, file_name AS image_path, class_name FROM detections JOIN images USING (image_id)")
def k04_detection_report(d: DataFrame, images: DataFrame) -> DataFrame:
    spark, path = place(d, "report")
    writers.detection_report(d, images, path)
    return spark.read.schema("latitude double, longitude double, altitude double, image_path string, class_name string").csv(path, header=True)


@book.query("detections images", "SELECT image_id::VARCHAR AS image_id, sum(count(*)) OVER (PARTITION BY image_id)::INT AS total_detections, class_name, count(*) AS n FROM detections JOIN images USING (image_id) GROUP BY image_id, class_name")
def s10_k02_k03_k05_k17_results_json(d: DataFrame, images: DataFrame) -> DataFrame:
    """Per-image results as JSON lines, read back in their schema, a row a class."""
    spark, path = place(d, "results")
    per = d.groupBy("image_id", "class_name").agg(F.count("*").alias("n")).groupBy("image_id")
    rows = per.agg(F.sum("n").cast("int").alias("total_detections"), F.map_from_entries(F.collect_list(F.struct("class_name", "n"))).alias("class_counts"))
    rows = rows.join(images.select("image_id", F.col("file_name").alias("image_path"), "width", "height"), "image_id")
    writers.json_lines(rows.withColumn("image_id", F.col("image_id").cast("string")), path)
    found = readers.results(spark, path, lines=True)
    return found.select("image_id", "total_detections", F.explode("class_counts").alias("class_name", "n"))


@book.query("images annotations categories", f"SELECT {SPLIT} AS split, id, image_id, category_id, x::DOUBLE AS x, w::DOUBLE AS w, file_name FROM annotations JOIN images USING (image_id) JOIN categories USING (class_name)")
def s03_k06_coco_files(images: DataFrame, a: DataFrame, categories: DataFrame) -> DataFrame:
    """A COCO document a split, read back and joined."""
    spark, path = place(images, "coco")
    i = images.select(F.col("image_id").alias("id"), "file_name", "width", "height", F.expr(SPLIT).alias("split"))
    writers.coco(i, a.join(F.broadcast(categories), "class_name"), categories.select(F.col("category_id").alias("id"), F.col("class_name").alias("name"), F.lit(None).cast("string").alias("supercategory")), path)  # a label set
    found = readers.coco(spark, f"{path}/split=*/*.txt")
    names = found["images"].select("split", F.col("id").alias("image_id"), "file_name")
    return found["annotations"].join(names, ["split", "image_id"]).select("split", "id", "image_id", "category_id", "x", "w", "file_name")


@book.query(
    "images annotations categories",
    f"SELECT {SPLIT} AS split, 'img_' || image_id AS stem, printf('%d %.6f %.6f %.6f %.6f', category_id, (x + w / 2e0) / width, (y + h / 2e0) / height, w::DOUBLE / width, h::DOUBLE / height) AS raw, category_id::INT AS class_id FROM annotations JOIN images USING (image_id) JOIN categories USING (class_name)",
)
def s04_k07_yolo_files(images: DataFrame, a: DataFrame, categories: DataFrame) -> DataFrame:
    spark, path = place(images, "yolo")
    rows = a.join(F.broadcast(categories), "class_name").select("image_id", F.col("category_id").alias("class_id"), "x", "y", "w", "h")  # a label set
    writers.yolo(rows, images.select("image_id", F.expr(SPLIT).alias("split"), F.regexp_replace("file_name", r"\.jpg$", "").alias("stem"), "width", "height"), path)
    return readers.yolo(spark, path).select("split", "stem", "raw", "class_id")


@book.query("images", "SELECT file_name AS filename, latitude, longitude, altitude FROM images WHERE latitude IS NOT NULL")
def s07_gps_csv(images: DataFrame) -> DataFrame:
    spark, path = place(images, "gps")
    images.where("latitude IS NOT NULL").select(F.col("file_name").alias("filename"), "latitude", "longitude", "altitude").write.csv(path, header=True, sep=";")
    return readers.gps_table(spark, path)


@book.query("detections", "SELECT (image_id % 97)::VARCHAR AS duplicate, det_key::VARCHAR AS bbox_id, image_id::VARCHAR AS task_id, class_name AS species FROM detections")
def s11_duplicates_csv(d: DataFrame) -> DataFrame:
    spark, path = place(d, "duplicates")
    d.select(F.expr("image_id % 97").alias("duplicate"), F.col("det_key").alias("bounding box"), F.col("image_id").alias("image"), F.col("class_name").alias("species")).write.csv(path, header=True)
    return readers.duplicates(spark, path)


@book.query(
    "annotations images categories",
    """WITH r AS (SELECT id AS roi_id, category_id AS class_id, class_name, id AS original_annotation_id, file_name FROM annotations JOIN images USING (image_id) JOIN categories USING (class_name))
SELECT roi_id, class_id, class_name, original_annotation_id, file_name, count(*) OVER (PARTITION BY class_name) AS in_class FROM r""",
)
def s12_k09_roi_files(a: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Region labels, class map and statistics as files; read back and joined."""
    spark, path = place(a, "rois")
    rows = a.join(images.select("image_id", "file_name"), "image_id").join(F.broadcast(categories), "class_name")  # a label set
    writers.roi_files(rows.select(F.col("id").alias("roi_id"), F.col("category_id").alias("class_id"), "class_name", F.col("id").alias("original_annotation_id"), "file_name"), path)
    names = spark.read.schema("class_id long, class_name string").json(f"{path}/class_map")
    counts = spark.read.schema("class_name string, n long").json(f"{path}/statistics").select("class_name", F.col("n").alias("in_class"))
    found = readers.roi_labels(spark, f"{path}/labels", lines=True).drop("class_name")
    return found.join(F.broadcast(names), "class_id").join(F.broadcast(counts), "class_name").select("roi_id", "class_id", "class_name", "original_annotation_id", "file_name", "in_class")  # a row a class


@book.query("images", f"SELECT DISTINCT dataset, {SPLIT} AS split, true AS has_files FROM images")
def s13_dataset_catalog(images: DataFrame) -> DataFrame:
    spark, path = place(images, "catalog")
    images.select("image_id", "dataset", F.expr(SPLIT).alias("split")).repartition("dataset", "split").write.partitionBy("dataset", "split").parquet(path)
    return readers.dataset_catalog(spark, path).select("dataset", "split", (F.col("files") > 0).alias("has_files"))


@book.query("categories", "SELECT category_id, class_name AS name FROM categories")
def s17_label_config(categories: DataFrame) -> DataFrame:
    """A labelling configuration of all classes, in their order, read back."""
    spark = categories.sparkSession
    config = categories.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category_id", "class_name"))), lambda x: F.concat(F.lit('<Label value="'), x["class_name"], F.lit('"/>'))), "")).first()[0]  # a label set
    return readers.label_map(spark, f"<View><RectangleLabels>{config or ''}</RectangleLabels></View>")


@book.query("images", "SELECT '/data/' || file_name AS path FROM images")
def k15_path_list(images: DataFrame) -> DataFrame:
    spark, path = place(images, "paths")
    writers.path_list(images.select(F.concat(F.lit("/data/"), "file_name").alias("path")), path)
    return spark.read.text(path).select(F.col("value").alias("path"))


@book.query("images", "SELECT image_id, 9 AS points, true AS closed FROM images WHERE latitude IS NOT NULL")
def k13_geojson_map(images: DataFrame) -> DataFrame:
    """Footprints as GeoJSON features: a closed ring of two points an edge each."""
    spark, path = place(images, "map")
    writers.geojson(flight.polygon(images, 2), path)
    kind = "type string, properties struct<image_id:long>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    ring = F.col("geometry.coordinates")[0]
    return spark.read.schema(kind).json(path).select("properties.image_id", F.size(ring).alias("points"), (F.element_at(ring, 1) == F.element_at(ring, -1)).alias("closed"))


@book.query(
    "detections",
    "SELECT image_id, round(max(confidence) OVER (PARTITION BY image_id), 6) AS score, det_key, class_name AS label, round(x1 * 100e0 / 8192, 6) AS x, round((y2 - y1) * 100e0 / 5460, 6) AS height FROM detections",
)
def s05_k12_labelling_payloads(d: DataFrame) -> DataFrame:
    """Predictions for the labelling tool as JSON, parsed again."""
    kind = "score double, result array<struct<id:long,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>>"
    rows = writers.task_payloads(d, 8192, 5460).select("image_id", F.from_json("payload", kind).alias("p")).select("image_id", F.round("p.score", 6).alias("score"), F.explode("p.result").alias("r"))
    return rows.select("image_id", "score", F.col("r.id").alias("det_key"), F.col("r.value.rectanglelabels")[0].alias("label"), F.round("r.value.x", 6).alias("x"), F.round("r.value.height", 6).alias("height"))


@book.query("images", "WITH n AS (SELECT image_id, height, width, " + GSD + " AS gsd FROM images WHERE latitude IS NOT NULL) SELECT image_id, (ty * 2000)::INT AS y0, (tx * 2000)::INT AS x0, true AS inside FROM n, (SELECT unnest(range(10)) AS ty), (SELECT unnest(range(10)) AS tx) WHERE ty < ceil((height - 2000) / 2000e0) + 1 AND tx < ceil((width - 2000) / 2000e0) + 1")
def g03_k10_s15_tile_positions(images: DataFrame) -> DataFrame:
    """Tiles with the position of their centre, as CSV, read back; inside: within a kilometre of the image's own."""
    spark, path = place(images, "tiles")
    writers.tile_positions(flight.tile_centres(tiles.grid(images, 2000, 2000), images), path)
    found = spark.read.schema("image_id long, x0 int, y0 int, x1 int, y1 int, lat double, lon double").csv(path, header=True)
    rows = found.join(images.select("image_id", "latitude", "longitude"), "image_id")
    near = (F.abs(F.col("lat") - F.col("latitude")) < 0.01) & (F.abs(F.col("lon") - F.col("longitude")) < 0.01)
    return rows.select("image_id", "y0", "x0", near.alias("inside"))


@book.query("events", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def t01_t03_followed_events(e: DataFrame) -> DataFrame:
    """Events that arrive as files, followed as a stream and appended batch by batch."""
    spark, path = place(e, "events")
    writers.json_lines(e.select("event_type", "value"), f"{path}/in")
    stream = ingest.follow(spark, f"{path}/in", "event_type string, value double", files_per_batch=1)
    ingest.append(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
