"""Round trips of readers and writers, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from skytally.sources import readers, schemas, writers
from skytally.streaming import ingest


def test_coco_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", 640, 480, "train"), (2, "b.jpg", 640, 480, "val")], "id long, file_name string, width int, height int, split string")
    a = spark.createDataFrame([(5, 1, 1, 10, 20, 30, 40, 1200, 0)], "id long, image_id long, category_id long, x int, y int, w int, h int, area int, iscrowd int")
    c = spark.createDataFrame([(1, "deer", None)], "id long, name string, supercategory string")
    writers.coco(images, a, c, f"{tmp_path}/coco")
    got = readers.coco(spark, f"{tmp_path}/coco/split=train/*.txt", "train")
    assert [(r.id, r.x, r.h, r.split) for r in got["annotations"].collect()] == [(5, 10.0, 40.0, "train")]
    assert got["images"].first().file_name == "a.jpg" and got["categories"].first().name == "deer"


def test_coco_split_of_several_documents(spark, tmp_path):
    """A split of more images than a document may have: whole together, and each a document of its own."""
    import glob
    import json

    images = spark.range(1000).selectExpr("id", "concat(id, '.jpg') AS file_name", "640 AS width", "480 AS height", "IF(id < 900, 'train', 'val') AS split")
    a = spark.range(2500).selectExpr("id", "id % 997 AS image_id", "1L AS category_id", "1 AS x", "2 AS y", "3 AS w", "4 AS h", "12 AS area", "0 AS iscrowd")
    c = spark.createDataFrame([(1, "deer", None), (2, "elk", None)], "id long, name string, supercategory string")
    writers.coco(images, a, c, f"{tmp_path}/coco", most=100)
    texts = [open(f).read() for f in glob.glob(f"{tmp_path}/coco/split=train/*.txt")]
    docs = [json.loads(x) for x in texts]
    assert len(docs) > 5 and all(len(d["images"]) < 200 and len(d["categories"]) == 2 and {x["image_id"] for x in d["annotations"]} <= {x["id"] for x in d["images"]} for d in docs)
    assert sorted(x["id"] for d in docs for x in d["images"]) == list(range(900))
    got = readers.coco(spark, f"{tmp_path}/coco/split=*/*.txt")
    assert sorted((r.id, r.image_id, r.split) for r in got["annotations"].collect()) == [(i, i % 997, "train" if i % 997 < 900 else "val") for i in range(2500)]
    assert got["images"].count() == 1000


def test_yolo_and_names(spark, tmp_path):
    folder = tmp_path / "labels" / "train"
    folder.mkdir(parents=True)
    (folder / "img.txt").write_text("1 0.5 0.5 0.4 0.4\n0 0.1 0.2 0.3 0.4 0.5 0.6\n\n")
    rows = sorted(readers.yolo(spark, str(tmp_path)).collect(), key=lambda r: r.class_id)
    assert [(r.stem, r.split, r.class_id, r.cx) for r in rows] == [("img", "train", 0, 0.1), ("img", "train", 1, 0.5)] and len(rows[0].polygon) == 6
    assert readers.yolo_names("nc: 2\nnames: [a, 'b']\n") == {0: "a", 1: "b"} and readers.yolo_names("names:\n  0: a\n  1: b\n") == {0: "a", 1: "b"}


def test_gps_table_and_images(spark, tmp_path):
    (tmp_path / "gps.csv").write_text("filename,latitude,longitude,altitude\na.jpg,1.5,2.5,x\n")
    r = readers.gps_table(spark, f"{tmp_path}/gps.csv").first()
    assert (r.filename, r.latitude, r.altitude) == ("a.jpg", 1.5, None)
    with pytest.raises(FileNotFoundError):
        readers.images(spark, str(tmp_path))
    (tmp_path / "a.JPG").write_bytes(b"x")
    assert readers.images(spark, str(tmp_path)).count() == 1


def test_label_map_and_tiles(spark, tmp_path):
    assert [(r.category_id, r.name) for r in readers.label_map(spark, "<View><Label value='b'/><Label value='a'/><Label value='b'/></View>").collect()] == [(1, "b"), (2, "a")]
    (tmp_path / "t.json").write_text(json.dumps({"img": {"tiles_bounds": [[[0, 5], [1, 6]]], "tiles_gps_coords": [[1.0, 2.0]]}}))
    r = readers.tile_positions(spark, f"{tmp_path}/t.json").first()
    assert (r.name, r.nth, r.x1, r.y0, r.lon) == ("img", 0, 5, 1, 2.0)


def test_geojson_and_payloads(spark, tmp_path):
    p = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(4)], "image_id long, nth int, lat double, lon double")
    writers.geojson(p, f"{tmp_path}/g")
    ring = json.loads(spark.read.text(f"{tmp_path}/g").first().value)["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and len(ring) == 5
    d = spark.createDataFrame([(1, 7, 10, 10, 20, 20, 0.5, "x")], "image_id long, det_key long, x1 int, y1 int, x2 int, y2 int, confidence double, class_name string")
    assert json.loads(writers.task_payloads(d, 100, 100).first().payload)["score"] == 0.5


def test_stream(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 3.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    writers.json_lines(e, f"{tmp_path}/in")
    s = ingest.follow(spark, f"{tmp_path}/in", "ts timestamp, event_type string, value double")
    ingest.append(s, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    r = ingest.window_counts(spark.read.parquet(f"{tmp_path}/out")).first()
    assert (r.n, r["mean"]) == (2, 2.0) and schemas.GPS


def test_yolo_files_of_many_images(spark, tmp_path):
    images = spark.createDataFrame([(i, "train" if i else "val", f"img {i}", 100, 100) for i in range(5)], "image_id long, split string, stem string, width int, height int")
    a = spark.createDataFrame([(i, 2, 10 * k, 10, 20, 20) for i in range(5) for k in range(2)], "image_id long, class_id long, x int, y int, w int, h int")
    writers.yolo(a, images, f"{tmp_path}/set")
    got = sorted((r.stem, r.split, r.class_id, round(r.cx, 6), r.polygon) for r in readers.yolo(spark, f"{tmp_path}/set").collect())
    assert got == [(f"img {i}", "train" if i else "val", 2, round(0.1 + 0.1 * k, 6), None) for i in range(5) for k in range(2)]
    assert readers.yolo_names(writers.data_config({0: "deer", 1: "elk"}, {"train": ["a"]})) == {0: "deer", 1: "elk"}


def test_patterns_in_either_case(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.png", "d.txt", "ajpg"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1] for r in readers.matching(spark, str(tmp_path), ("*.jpg", "?.PNG")).collect()}
    assert got == {"a.jpg", "b.JPG", "c.png"}


def test_status_and_inference_of_a_stream(spark, tmp_path):
    writers.json_lines(spark.createDataFrame([(i,) for i in range(6)], "v int"), f"{tmp_path}/in")

    def twice(frames):
        for f in frames:
            f["v"] *= 2
            yield f

    stream = ingest.infer(ingest.follow(spark, f"{tmp_path}/in", "v int"), twice, "v int")
    query = ingest.append(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    told = ingest.status(query)
    assert not told["active"] and told["rows"] == 6 and told["error"] == ""
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8, 10]

