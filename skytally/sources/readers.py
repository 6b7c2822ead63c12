"""Files to DataFrames in explicit schemas, through Spark's own readers."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labelstudio
from . import schemas


def images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = schemas.EXTENSIONS) -> DataFrame:
    """path, length and modification time of the image files below a folder; contents aren't read. Raises if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    found = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).distinct()
    if found.isEmpty():
        raise FileNotFoundError(f"no image below {folder}")
    return found


def matching(spark: SparkSession, folder: str, patterns: tuple[str, ...]) -> DataFrame:
    """path of the files below a folder whose names match one of the patterns (with * and ?) in lower or upper case; each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    any_of = "|".join(re.escape(p.lower()).replace(r"\*", ".*").replace(r"\?", ".") for p in patterns)
    return files.where(F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).rlike(f"^(?:{any_of})$")).distinct()


def coco(spark: SparkSession, path: str, split: str | None = None) -> dict[str, DataFrame]:
    """images, annotations (with x, y, w, h) and categories of COCO files, each with its file and split."""
    raw = spark.read.schema(schemas.COCO).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    found = [F.nullif(F.regexp_extract("file", p, 1), F.lit("")) for p in (r"(train|val|test)[^/]*$", r"(train|val|test)[^/]*/[^/]*$")]  # of the file's name, else of its folder's
    name = F.lit(split) if split else F.coalesce(*found, F.lit(""))
    part = lambda c: raw.select("file", name.alias("split"), F.explode(c).alias("r")).select("file", "split", "r.*")
    a = part("annotations")
    return {"images": part("images"), "annotations": a.select("*", *[F.get("bbox", F.lit(i)).alias(k) for i, k in enumerate("xywh")]), "categories": part("categories")}


def yolo(spark: SparkSession, folder: str) -> DataFrame:
    """stem, split, class_id, cx, cy, w, h, polygon and raw of the label lines below a folder: labels/split/stem.txt, or files of many images below labels/split=..., in which the stem and a tab precede each line."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder).withColumn("file", F.col("_metadata.file_path"))
    raw = raw.where(F.trim("value") != "").withColumn("own", F.regexp_extract("value", r"^([^\t]*)\t", 1)).withColumn("value", F.regexp_replace("value", r"^[^\t]*\t", ""))
    t = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(F.slice(t, 2, F.size(t)), lambda x: x.try_cast("double"))
    return raw.select(
        F.coalesce(F.nullif("own", F.lit("")), F.regexp_extract("file", r"([^/]+)\.txt$", 1)).alias("stem"), F.regexp_extract("file", r"/labels/(?:(?:split=)?(.+)/)?[^/]+$", 1).alias("split"), F.get(t, 0).try_cast("int").alias("class_id"),
        *[F.get(numbers, F.lit(i)).alias(k) for i, k in enumerate(("cx", "cy", "w", "h"))], F.when(F.size(t) > 5, numbers).alias("polygon"), F.col("value").alias("raw"),
    )


def yolo_names(text: str) -> dict[int, str]:
    """Class names of a data.yaml (its names: as a list or a map), read on the driver."""
    block = re.search(r"^names:\s*(\[.*?\]|(?:\n\s+.*)+)", text, re.M | re.S)
    if not block:
        return {}
    if block[1].startswith("["):
        return dict(enumerate(x.strip().strip("'\"") for x in block[1][1:-1].split(",") if x.strip()))
    out: dict[int, str] = {}
    for line in block[1].strip().splitlines():
        m = re.match(r"\s*(?:-|(\d+):)\s*(.+?)\s*$", line)
        if m:
            out[int(m[1]) if m[1] else len(out)] = m[2].strip("'\"")
    return out


def gps_table(spark: SparkSession, path: str, separators: tuple[str, ...] = (";", ",")) -> DataFrame:
    """filename, latitude, longitude, altitude of a table with a header, with the first separator that yields all columns."""
    names = [f.split()[0] for f in schemas.GPS.split(", ")]
    for sep in separators:
        rows = spark.read.csv(path, sep=sep, header=True)
        if set(names) <= set(rows.columns):
            return rows.select(F.col("filename"), *[F.col(n).try_cast("double").alias(n) for n in names[1:]])
    raise ValueError(f"{path} has no columns {names} under any of {separators}")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Labelling tasks of an export: an array of tasks in a file."""
    return spark.read.schema(labelstudio.TASK).option("multiLine", True).json(path)


def tasks_from_json(rows: DataFrame, column: str) -> DataFrame:
    """Tasks of a text column, a task a row."""
    return rows.select(F.from_json(column, labelstudio.TASK).alias("t")).where("t IS NOT NULL").select("t.*")


def label_map(spark: SparkSession, config: str) -> DataFrame:
    """category_id (from 1, in the order of the document) and name of the labels of an XML labelling configuration."""
    names = dict.fromkeys(x.get("value") for x in ElementTree.fromstring(config).iter("Label"))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "category_id long, name string")


def results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Per-image results, as one array or, which Spark can split, as lines."""
    return spark.read.schema(schemas.DETECTIONS).option("multiLine", not lines).json(path)


def duplicates(spark: SparkSession, path: str) -> DataFrame:
    """The table of duplicate groups, its columns renamed from those of the annotation tool."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumnsRenamed({"image": "task_id", "bounding box": "bbox_id"}).select("duplicate", "bbox_id", "task_id", "species")


def roi_labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schemas.ROI_LABELS).option("multiLine", not lines).json(path)


def tile_positions(spark: SparkSession, path: str) -> DataFrame:
    """name, nth, x0, x1, y0, y1, lat, lon of the tiles of a coordinates file, a map from image names to lists."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", schemas.TILES)).alias("name", "t"))
    rows = rows.select("name", F.posexplode(F.arrays_zip("t.tiles_bounds", "t.tiles_gps_coords")).alias("nth", "z"))
    b, g = F.col("z.tiles_bounds"), F.col("z.tiles_gps_coords")
    return rows.select("name", "nth", b[0][0].alias("x0"), b[0][1].alias("x1"), b[1][0].alias("y0"), b[1][1].alias("y1"), F.get(g, F.lit(0)).alias("lat"), F.get(g, F.lit(1)).alias("lon"))


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """dataset, split and files of a tree of dataset=.../split=... folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]+)/", 1).alias(k)
    return files.select(part("dataset"), part("split")).groupBy("dataset", "split").agg(F.count("*").alias("files"))
