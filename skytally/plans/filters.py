"""Predicates and validity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import curriculum, labelstudio, sampling, validate
from .book import Book

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("dense", "SELECT det_key, confidence FROM dense WHERE NOT (x1 + y1 + x2 + y2 = 0 OR class_name = 'EMPTY') AND confidence >= 0.8e0 AND class_name IN (SELECT DISTINCT class_name FROM dense WHERE class_name < 'N') AND y2 > y1 AND x2 > x1")
def f01_f02_f03_detection_filters(d: DataFrame) -> DataFrame:
    kept = d.where(~B.is_empty("x1", "y1", "x2", "y2", "class_name")).where(F.col("confidence") >= 0.8)
    return kept.where(F.col("class_name") < "N").where("y2 > y1 AND x2 > x1").select("det_key", "confidence")


@book.query("images dense", "SELECT image_id FROM images i WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.image_id = i.image_id) OR EXISTS (SELECT 1 FROM dense d WHERE d.image_id = i.image_id AND class_name LIKE 'P%')")
def f03_images_by_class(images: DataFrame, d: DataFrame) -> DataFrame:
    """Images with a kept class; unlabelled ones always pass."""
    wanted = d.groupBy("image_id").agg(F.bool_or(F.col("class_name").startswith("P")).alias("keep"))
    return images.join(wanted, "image_id", "left").where(F.coalesce("keep", F.lit(True))).select("image_id")


LS = """task AS (SELECT image_id AS task_id, det_key AS result_id, pos, class_name AS label, CASE WHEN pos % 4 = 0 THEN NULL ELSE confidence END AS score,
 CASE pos % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'prediction' ELSE 'prediction-changed' END AS origin FROM detections)"""


@book.query("detections", f"WITH {LS} SELECT task_id, result_id, label, score, origin FROM task WHERE (score IS NULL OR score >= 0.7e0) AND label > 'M' AND origin IN ('manual', 'prediction-changed')")
def f04_f05_labelling_results(d: DataFrame) -> DataFrame:
    flat = labelstudio.flatten(labelstudio.tasks_from(d))
    return labelstudio.filter_results(flat, labels=lambda x: x > "M", min_score=0.7, origins="annotation").select("task_id", "result_id", "label", "score", "origin")


@book.query("detections", "SELECT image_id AS task_id, count(*) AS n_results FROM detections GROUP BY 1 HAVING count(*) >= 4 AND bool_or(class_name > 'S')")
def f06_labelling_tasks(d: DataFrame) -> DataFrame:
    tasks = labelstudio.tasks_from(d)
    results = F.flatten(F.transform("annotations", lambda a: a["result"]))
    return tasks.where((F.size(results) >= 4) & F.exists(results, lambda r: F.exists(r["value"]["rectanglelabels"], lambda x: x > "S"))).select(F.col("id").alias("task_id"), F.size(results).cast("long").alias("n_results"))


BAD = """bad AS (SELECT CASE WHEN id % 97 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 89 = 0 THEN image_id + 100000000 ELSE image_id END AS image_id, CASE WHEN id % 83 = 0 THEN NULL WHEN id % 79 = 0 THEN 'NOTHING' ELSE class_name END AS class_name,
 CASE WHEN id % 73 = 0 THEN NULL ELSE x END AS x, y, CASE WHEN id % 71 = 0 THEN 0 ELSE w END AS w, h, CASE WHEN id % 67 = 0 THEN -area ELSE area END AS area, iscrowd FROM annotations)"""
REASON = """CASE WHEN id IS NULL THEN 'missing id' WHEN class_name IS NULL THEN 'missing category' WHEN x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'missing bbox' WHEN image_id NOT IN (SELECT image_id FROM images) THEN 'unknown image'
 WHEN class_name NOT IN (SELECT class_name FROM categories) THEN 'unknown category' WHEN w <= 0 OR h <= 0 THEN 'empty bbox' WHEN area <= 0 THEN 'bad area' WHEN iscrowd NOT IN (0, 1) THEN 'bad iscrowd' END"""


def broken(a: DataFrame) -> DataFrame:
    return a.selectExpr(
        "CASE WHEN id % 97 = 0 THEN NULL ELSE id END AS id", "CASE WHEN id % 89 = 0 THEN image_id + 100000000 ELSE image_id END AS image_id", "CASE WHEN id % 83 = 0 THEN NULL WHEN id % 79 = 0 THEN 'NOTHING' ELSE class_name END AS class_name",
        "CASE WHEN id % 73 = 0 THEN NULL ELSE x END AS x", "y", "CASE WHEN id % 71 = 0 THEN 0 ELSE w END AS w", "h", "CASE WHEN id % 67 = 0 THEN -area ELSE area END AS area", "iscrowd",
    )


@book.query("annotations images categories", f"WITH {BAD} SELECT coalesce(id, -1) AS id, image_id, class_name, {REASON} AS reason FROM bad")
def f07_coco_reasons(a: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    return validate.coco_reasons(broken(a), images, categories).select(F.coalesce("id", F.lit(-1)).alias("id"), "image_id", "class_name", "reason")


@book.query("annotations images categories", f"WITH {BAD} SELECT coalesce({REASON}, 'valid') AS reason, count(*) AS n FROM bad GROUP BY 1")
def a17_validation_summary(a: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    return validate.summary(validate.coco_reasons(broken(a), images, categories))


LINES = """CASE WHEN id % 7 = 0 THEN concat(cast(id % 9 AS string), ' 0.5 0.5 0.2') WHEN id % 7 = 1 THEN concat(cast(id % 9 AS string), ' 0.5 x 0.2 0.2') WHEN id % 7 = 2 THEN concat(cast(id % 9 AS string), ' 0.5 1.5 0.2 0.2')
 WHEN id % 7 = 3 THEN concat(cast(id % 9 AS string), ' 0.1 0.2 0.3 0.4 0.5') WHEN id % 7 = 4 THEN concat(cast(id % 9 AS string), ' 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8') ELSE concat(cast(id % 9 AS string), ' 0.5 0.5 0.2 0.2') END"""


@book.query(
    "annotations",
    f"""WITH l AS (SELECT id, string_split({LINES}, ' ') AS t FROM annotations), n AS (SELECT id, t, list_transform(t[2:], lambda x: try_cast(x AS DOUBLE)) AS v FROM l)
SELECT id, CASE WHEN len(t) < 5 THEN 'too few values' WHEN t[1]::INT >= 6 THEN 'bad class' WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'not a number' WHEN len(list_filter(v, lambda x: x < 0 OR x > 1)) > 0 THEN 'out of range'
 WHEN len(t) > 5 AND len(t) % 2 = 0 THEN 'odd polygon' END AS reason, CASE len(t) WHEN 5 THEN 'yolo' WHEN 9 THEN 'obb' ELSE 'unknown' END AS format FROM n""",
)
def f08_f27_yolo_lines(a: DataFrame) -> DataFrame:
    rows = a.select("id", F.expr(LINES).alias("line"))
    return rows.select("id", validate.yolo_reason(F.col("line"), 6).alias("reason"), validate.label_format(F.col("line")).alias("format"))


@book.query("images", "SELECT image_id, coalesce(latitude <> 0 AND longitude <> 0 AND altitude <> 0, false) AS truthy, latitude IS NOT NULL AND longitude IS NOT NULL AS known FROM images")
def f10_has_gps(images: DataFrame) -> DataFrame:
    truthy = (F.col("latitude") != 0) & (F.col("longitude") != 0) & (F.col("altitude") != 0)
    return images.select("image_id", F.coalesce(truthy, F.lit(False)).alias("truthy"), (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("known"))


@book.query(
    "dense",
    "SELECT det_key, x1 < 200 AND x2 > 100 AND y1 < 160 AND y2 > 60 AS overlaps, (x1 + x2) / 2e0 BETWEEN 100 AND 200 AND (y1 + y2) / 2e0 BETWEEN 60 AND 160 AS center_inside, x1 >= 0 AND y1 >= 0 AND x2 <= 320 AND y2 <= 240 AS within_tile, (x1 + x2) / 2e0 > 320 OR (y1 + y2) / 2e0 > 240 AS center_outside FROM dense",
)
def f11_f12_f25_regions(d: DataFrame) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return d.select(
        "det_key", F.expr("x1 < 200 AND x2 > 100 AND y1 < 160 AND y2 > 60").alias("overlaps"), (cx.between(100, 200) & cy.between(60, 160)).alias("center_inside"), F.expr("x1 >= 0 AND y1 >= 0 AND x2 <= 320 AND y2 <= 240").alias("within_tile"), ((cx > 320) | (cy > 240)).alias("center_outside")
    )


@book.query("images dense", "SELECT image_id, file_name FROM images WHERE latitude IS NOT NULL AND image_id IN (SELECT image_id FROM dense) AND NOT file_name LIKE '%13.jpg'")
def f16_f26_selectable_images(images: DataFrame, d: DataFrame) -> DataFrame:
    return images.where("latitude IS NOT NULL").where(~F.col("file_name").endswith("13.jpg")).join(d, "image_id", "left_semi").select("image_id", "file_name")


DIFFICULTY = """a AS (SELECT image_id, count(*) AS n, avg(((x2 - x1) * (y2 - y1))::DOUBLE) AS mean, sum((x2 - x1) * (y2 - y1)) / 640000e0 AS cover FROM dense GROUP BY 1),
s AS (SELECT image_id, CASE WHEN n IS NULL THEN 0.5e0 ELSE 0.4e0 * (1 - least(1, mean / 40000)) + 0.3e0 * (1 - least(1, n / 10e0)) + 0.3e0 * CASE WHEN cover < 0.01 THEN 1 WHEN cover > 0.5 THEN 0 ELSE greatest(0, least(1, 1 - (cover - 0.01e0) / 0.49e0)) END END AS difficulty FROM images LEFT JOIN a USING (image_id))"""


@book.query("images dense", f"WITH {DIFFICULTY} SELECT image_id FROM s WHERE difficulty <= 0.6e0 + 0.1e0 OR NOT EXISTS (SELECT 1 FROM s WHERE difficulty <= 0.7e0)")
def f17_curriculum(images: DataFrame, d: DataFrame) -> DataFrame:
    return curriculum.included(curriculum.difficulty(images, d), 0.6).select("image_id")


@book.query("annotations", "SELECT id, w > 0 AND h > 0 OR iscrowd = 2 AS non_empty FROM annotations WHERE x IS NOT NULL AND NOT isnan(x::DOUBLE) AND class_name <> 'background'")
def f18_f20_f21_annotation_rows(a: DataFrame) -> DataFrame:
    a = a.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double"))).where("class_name <> 'background'")
    return a.select("id", F.expr("w > 0 AND h > 0 OR iscrowd = 2").alias("non_empty"))


@book.query(
    "dense",
    """WITH f AS (SELECT *, (x2 - x1) * (y2 - y1) >= 5000 AS large, confidence BETWEEN 0.6e0 AND 0.8e0 AS unsure FROM dense),
g AS (SELECT *, CASE WHEN bool_or(large AND unsure) OVER w THEN large AND unsure WHEN bool_or(large) OVER w THEN large ELSE true END AS fits FROM f WINDOW w AS (PARTITION BY image_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_key) AS nth FROM g WHERE fits) SELECT det_key, nth::INT AS nth FROM r WHERE nth <= 2""",
)
def f22_loss_sampling(d: DataFrame) -> DataFrame:
    return sampling.cascade(d, [F.expr("(x2 - x1) * (y2 - y1) >= 5000"), F.col("confidence").between(0.6, 0.8)], "image_id", 2).select("det_key", "nth")


@book.query("events", "SELECT event_id, user_id, event_type AS status FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def f24_o02_jobs(e: DataFrame) -> DataFrame:
    """A page of the newest jobs of a status."""
    return e.where("event_type = 'click'").orderBy(F.desc("ts"), "event_id").offset(10).limit(50).select("event_id", "user_id", F.col("event_type").alias("status"))


@book.query("events", "SELECT event_id, event_type AS status FROM events WHERE user_id = 7")
def f24_jobs_of_user(e: DataFrame) -> DataFrame:
    """All jobs of one user."""
    return e.where(F.col("user_id") == 7).select("event_id", F.col("event_type").alias("status"))


@book.query("events", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'cancelled' ELSE event_type END AS status FROM events WHERE NOT (event_type = 'purchase' AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY)")
def f28_job_retention(e: DataFrame) -> DataFrame:
    """Finished jobs of a certain age go; open ones are cancelled."""
    newest = e.agg(F.max("ts").alias("newest"))
    kept = e.crossJoin(F.broadcast(newest)).where(~((F.col("event_type") == "purchase") & (F.col("ts") < F.col("newest") - F.expr("INTERVAL 7 DAYS"))))  # one row
    return kept.select("event_id", F.when(F.col("event_type") == "view", "cancelled").otherwise(F.col("event_type")).alias("status"))
