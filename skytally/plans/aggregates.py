"""Counts, statistics, quality metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import census, datasets, flight, labelstudio, metrics, sampling
from .book import Book
from .filters import LS
from .joins import MATCH_SQL

book = Book()
QUERIES, SQL = book.queries, book.sql


def flight_metrics_sql(steps: int = 6) -> str:
    """Legs by position and Vincenty's inverse formula, one common table expression a step."""
    big, flat = f"{G.A!r}::DOUBLE", f"{G.FLATTENING!r}::DOUBLE"
    parts = [
        "p AS (SELECT camp_id, altitude, ts, latitude AS lat, longitude AS lon, lag(latitude) OVER w AS lat0, lag(longitude) OVER w AS lon0 FROM images WHERE latitude IS NOT NULL WINDOW w AS (PARTITION BY camp_id ORDER BY latitude, longitude, altitude, file_name))",
        f"u AS (SELECT *, atan((1 - {flat}) * tan(radians(lat0))) AS u1, atan((1 - {flat}) * tan(radians(lat))) AS u2, radians(lon - lon0) AS l FROM p)",
        "l0 AS (SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l AS lam FROM u)",
    ]
    for k in range(steps + 1):
        parts.append(f"a{k} AS (SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM l{k})")
        parts.append(f"b{k} AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM a{k})")
        parts.append(f"c{k} AS (SELECT *, 1 - sa * sa AS ca FROM b{k})")
        parts.append(f"d{k} AS (SELECT *, cs - CASE WHEN ca = 0 THEN 0 ELSE 2 * s1 * s2 / ca END AS cm, {flat} / 16 * ca * (4 + {flat} * (4 - 3 * ca)) AS cc FROM c{k})")
        parts.append(f"l{k + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sa, ca, cm, cc), l + (1 - cc) * {flat} * sa * (atan2(ss, cs) + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM d{k})")
    b = f"({big} * (1 - {flat}))"
    parts.append(f"e AS (SELECT *, ca * ({big} * {big} - {b} * {b}) / ({b} * {b}) AS usq FROM d{steps})")
    parts.append("f AS (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS aa, usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bb FROM e)")
    parts.append(f"g AS (SELECT *, {b} * aa * (atan2(ss, cs) - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000 AS km FROM f)")
    high = "CASE WHEN altitude > 0 THEN altitude END"
    return "WITH " + ",\n".join(parts) + f"""
SELECT camp_id, count(*) AS waypoints, round(coalesce(sum(km), 0), 6) AS total_km, round(coalesce(avg(km), 0), 6) AS mean_km, round(coalesce(max(km), 0), 6) AS max_km, round(coalesce(min(km), 0), 6) AS min_km,
 round(avg({high}), 6) AS mean_altitude, round(min({high}), 6) AS min_altitude, round(max({high}), 6) AS max_altitude, round((epoch_us(max(ts)::TIMESTAMP) - epoch_us(min(ts)::TIMESTAMP)) / 3.6e9, 6) AS hours FROM g GROUP BY camp_id"""


@book.query(
    "images detections",
    """SELECT dataset, class_name, count(*) AS detections, count(DISTINCT image_id) AS images, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence
FROM images JOIN detections USING (image_id) WHERE class_name <> 'EMPTY' GROUP BY 1, 2""",
)
def a01_a02_class_confidence(images: DataFrame, d: DataFrame) -> DataFrame:
    return census.class_confidence(images, d)


@book.query("images", "SELECT min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, count(latitude) AS located, count(*) AS images, round(avg(latitude), 9) AS center_lat, round(avg(longitude), 9) AS center_lon FROM images")
def a03_a31_bounds(images: DataFrame) -> DataFrame:
    b = census.bounds(images)
    return b.withColumns({c: F.round(c, 9) for c in ("center_lat", "center_lon")})


@book.query("detections", "SELECT class_name, count(*) AS n FROM detections GROUP BY 1")
def a04_o01_merged_counts(d: DataFrame) -> DataFrame:
    return census.merged_counts(census.count_maps(d))


@book.query("images detections", "SELECT dataset, count(DISTINCT i.image_id) FILTER (latitude IS NOT NULL) AS with_footprint, count(DISTINCT i.image_id) FILTER (latitude IS NULL) AS without, count(det_key) AS detections FROM images i LEFT JOIN detections d ON d.image_id = i.image_id GROUP BY 1")
def a06_footprint_counts(images: DataFrame, d: DataFrame) -> DataFrame:
    per = d.groupBy("image_id").agg(F.count("*").alias("n"))
    rows = images.join(per, "image_id", "left")
    return rows.groupBy("dataset").agg(F.count_if(F.col("latitude").isNotNull()).alias("with_footprint"), F.count_if(F.col("latitude").isNull()).alias("without"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"))


@book.query("images", flight_metrics_sql())
def a08_w01_w11_flight_metrics(images: DataFrame) -> DataFrame:
    out = flight.path_metrics(images)
    return out.select("camp_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "camp_id"])


@book.query(
    "images detections",
    """SELECT camp_id, round(sum(CASE WHEN latitude IS NOT NULL THEN width * (g * 1e-2) * height * (g * 1e-2) END), 1) AS area_m2, round(avg(CASE WHEN altitude > 0 THEN altitude END), 6) AS altitude, count(*) AS images
FROM (SELECT *, round((180e0 * 1e2 * (24e0 * 0.1e0)) / (35e0 * 0.1e0 * height), 3) AS g FROM images) GROUP BY 1""",
)
def a09_flight_efficiency(images: DataFrame, d: DataFrame) -> DataFrame:
    g = F.round(F.expr("(180e0 * 1e2 * (24e0 * 0.1e0)) / (35e0 * 0.1e0 * height)"), 3) * 0.01
    area = F.when(F.col("latitude").isNotNull(), F.col("width") * g * F.col("height") * g)
    return images.groupBy("camp_id").agg(F.round(F.sum(area), 1).alias("area_m2"), F.round(F.avg(F.when(F.col("altitude") > 0, F.col("altitude"))), 6).alias("altitude"), F.count("*").alias("images"))


@book.query(
    "images detections",
    "SELECT count(*) AS images, count(latitude) AS located, (SELECT count(*) FROM detections) AS detections, (SELECT count(DISTINCT image_id) FROM detections) AS images_with_detections, round((SELECT avg(confidence) FROM detections), 6) AS mean_confidence, round((SELECT count(*) FROM detections)::DOUBLE / count(*), 6) AS per_image FROM images",
)
def a10_campaign_report(images: DataFrame, d: DataFrame) -> DataFrame:
    r = census.report(images, d)
    return r.select("images", "located", "detections", "images_with_detections", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("per_image", 6).alias("per_image"))


@book.query("detections", f"WITH {LS} SELECT label, count(*) AS n, count(DISTINCT task_id) AS tasks, count(*) FILTER (pos % 6 = 0) AS rotated FROM task GROUP BY 1")
def a12_g09_label_summary(d: DataFrame) -> DataFrame:
    return labelstudio.label_summary(labelstudio.flatten(labelstudio.tasks_from(d)))


@book.query("detections", "SELECT image_id AS task_id, det_key AS result_id, class_name AS label, round(x1::DOUBLE, 6) AS x_pixel, round((y2 - y1)::DOUBLE, 6) AS height_pixel, CASE WHEN pos % 6 = 0 THEN 30e0 ELSE 0e0 END AS rotation FROM detections")
def g09_g10_flatten_tasks(d: DataFrame) -> DataFrame:
    flat = labelstudio.flatten(labelstudio.tasks_from(d))
    return flat.select("task_id", "result_id", "label", F.round("x_pixel", 6).alias("x_pixel"), F.round("height_pixel", 6).alias("height_pixel"), "rotation")


@book.query("images", "SELECT coalesce(dataset, 'all') AS dataset, coalesce(split, 'all') AS split, count(*) AS n FROM (SELECT dataset, CASE WHEN image_id % 10 < 7 THEN 'train' WHEN image_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM images) GROUP BY ROLLUP (dataset, split)")
def a13_a36_dataset_info(images: DataFrame) -> DataFrame:
    rows = images.select("dataset", F.expr("CASE WHEN image_id % 10 < 7 THEN 'train' WHEN image_id % 10 < 9 THEN 'val' ELSE 'test' END").alias("split"))
    return rows.rollup("dataset", "split").agg(F.count("*").alias("n")).select(F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("split", F.lit("all")).alias("split"), "n")


@book.query("images", "SELECT s.split, count(i.image_id) AS n FROM (SELECT unnest(['train', 'val', 'test']) AS split) s LEFT JOIN images i ON (CASE WHEN image_id % 2 = 0 THEN 'train' ELSE 'val' END) = s.split GROUP BY 1")
def a36_split_counts(images: DataFrame) -> DataFrame:
    return datasets.split_counts(images.select(F.expr("CASE WHEN image_id % 2 = 0 THEN 'train' ELSE 'val' END").alias("split")))


@book.query("dense", "SELECT count(*) AS rois, count(*) FILTER (class_name > 'P') AS late, count(*) FILTER (x2 - x1 < 64) AS small, count(DISTINCT image_id) AS images FROM dense")
def a14_roi_statistics(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("rois"), F.count_if(F.col("class_name") > "P").alias("late"), F.count_if(F.expr("x2 - x1 < 64")).alias("small"), F.count_distinct("image_id").alias("images"))


@book.query("images", "WITH c AS (SELECT camp_id, count(*) AS n, count(latitude) AS located FROM images GROUP BY 1) SELECT count(*) AS camps, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, round(sum(located) / sum(n) * 100, 6) AS coverage FROM c")
def a15_a16_camp_statistics(images: DataFrame) -> DataFrame:
    c = images.groupBy("camp_id").agg(F.count("*").alias("n"), F.count("latitude").alias("located"))
    return c.agg(F.count("*").alias("camps"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.sum("located") / F.sum("n") * 100, 6).alias("coverage"))


@book.query("images", "SELECT CASE WHEN latitude IS NULL THEN 'no_gps' WHEN altitude = 0 THEN 'no_altitude' ELSE 'matched' END AS status, count(*) AS n FROM images GROUP BY 1")
def a18_match_report(images: DataFrame) -> DataFrame:
    return images.groupBy(F.expr("CASE WHEN latitude IS NULL THEN 'no_gps' WHEN altitude = 0 THEN 'no_altitude' ELSE 'matched' END").alias("status")).agg(F.count("*").alias("n"))


COUNTS = "c AS (SELECT lang AS class_name, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, class_name) AS place, count(*) OVER () AS k FROM c), e AS (SELECT * FROM r WHERE k < 3 OR (place > 1 AND place < k))"


@book.query("documents labels", f"WITH {COUNTS} SELECT round_even(avg(n), 0)::BIGINT AS target FROM e")
def a20_target_count(docs: DataFrame, labels: DataFrame) -> DataFrame:
    counts = docs.join(labels, "doc_id").groupBy(F.col("lang").alias("class_name")).agg(F.count("*").alias("n"))
    return sampling.target_count(counts)


@book.query(
    "documents labels",
    f"WITH {COUNTS}, t AS (SELECT round_even(avg(n), 0)::BIGINT AS target FROM e), o AS (SELECT doc_id, lang AS class_name, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS nth FROM documents JOIN labels USING (doc_id)) SELECT doc_id, class_name FROM o, t WHERE nth <= target",
)
def w09_c12_rebalance(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return sampling.undersample(docs.join(labels, "doc_id").select("doc_id", F.col("lang").alias("class_name")), "doc_id")


@book.query(
    "gt_pred",
    f"""WITH RECURSIVE {MATCH_SQL}, t AS (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS threshold), s AS (SELECT p.score, z.pred_key IS NOT NULL AS hit FROM p LEFT JOIN z ON z.pred_key = p.det_key),
n AS (SELECT threshold, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM t JOIN s ON score >= threshold GROUP BY 1), k AS (SELECT count(*) AS gts FROM g)
SELECT threshold, tp, fp, round(tp / (tp + fp + 1e-6), 9) AS precision, round(tp / (gts + 1e-6), 9) AS recall FROM n, k""",
)
def a24_x10_threshold_grid(g: DataFrame) -> DataFrame:
    return metrics.grid(g, [0.5, 0.6, 0.7, 0.8, 0.9]).select("threshold", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@book.query(
    "gt_pred",
    f"""WITH RECURSIVE {MATCH_SQL}, t AS (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS threshold), s AS (SELECT p.score, z.pred_key IS NOT NULL AS hit FROM p LEFT JOIN z ON z.pred_key = p.det_key),
n AS (SELECT threshold, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM t JOIN s ON score >= threshold GROUP BY 1), k AS (SELECT count(*) AS gts FROM g),
q AS (SELECT threshold, tp, fp, tp / (tp + fp + 1e-6) AS precision, tp / (gts + 1e-6) AS recall FROM n, k), b AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-6) AS f1 FROM q)
SELECT threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM b ORDER BY b.f1 DESC, threshold LIMIT 1""",
)
def w08_best_threshold(g: DataFrame) -> DataFrame:
    best = metrics.best_threshold(metrics.grid(g, [0.5, 0.6, 0.7, 0.8, 0.9]))
    return best.select("threshold", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@book.query(
    "gt_pred",
    f"""WITH RECURSIVE {MATCH_SQL}, s AS (SELECT p.class_name, p.score, count(*) AS n, count(z.pred_key) AS hits FROM p LEFT JOIN z ON z.pred_key = p.det_key GROUP BY 1, 2),
r AS (SELECT *, (sum(hits) OVER w)::DOUBLE / sum(n) OVER w AS precision FROM s WINDOW w AS (PARTITION BY class_name ORDER BY score DESC)),
b AS (SELECT *, max(precision) OVER (PARTITION BY class_name ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM r),
k AS (SELECT class_name, count(*) AS gts FROM g GROUP BY 1)
SELECT class_name, round(sum(hits * best) / any_value(gts), 9) AS ap FROM b JOIN k USING (class_name) GROUP BY class_name""",
)
def a25_a35_average_precision(g: DataFrame) -> DataFrame:
    return metrics.average_precision(g).select("class_name", F.round("ap", 9).alias("ap"))


@book.query(
    "labels documents",
    """WITH r AS (SELECT quality AS truth, (n_chars > 2000)::INT AS predicted FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), k AS (SELECT unnest([0, 1]) AS class_name),
n AS (SELECT class_name, count(*) FILTER (truth = class_name) AS support, count(*) FILTER (predicted = class_name) AS found, count(*) FILTER (truth = class_name AND predicted = class_name) AS tp FROM r, k GROUP BY 1)
SELECT class_name::INT AS class_name, support, found, tp, round(tp / found::DOUBLE, 9) AS precision, round(tp / support::DOUBLE, 9) AS recall FROM n""",
)
def a26_classification(labels: DataFrame, docs: DataFrame) -> DataFrame:
    rows = labels.where("quality IS NOT NULL").join(docs, "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 2000).cast("int").alias("predicted"))
    return metrics.classification(rows).select("class_name", "support", "found", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@book.query(
    "labels documents",
    "WITH r AS (SELECT n_chars AS score, quality = 1 AS positive FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL) SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) / count(*), 9) AS auroc FROM r a, r b WHERE a.positive AND NOT b.positive",
)
def a26_auroc(labels: DataFrame, docs: DataFrame) -> DataFrame:
    rows = labels.where("quality IS NOT NULL").join(docs, "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))
    return metrics.auroc(rows).select(F.round("auroc", 9).alias("auroc"))


@book.query("embeddings", "SELECT k::INT AS k, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std FROM (SELECT k, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(3)) AS k)) GROUP BY 1")
def a27_channel_statistics(e: DataFrame) -> DataFrame:
    rows = e.select(F.posexplode(F.slice("embedding", 1, 3)).alias("k", "v")).select("k", F.col("v").cast("double").alias("v"))
    return rows.groupBy("k").agg(F.round(F.avg("v"), 7).alias("mean"), F.round(F.stddev_pop("v"), 7).alias("std"))


@book.query("gt_pred", "WITH c AS (SELECT image_id, count(*) FILTER (role = 'gt') AS gts, count(*) FILTER (role = 'pred') AS preds FROM gt_pred GROUP BY 1) SELECT round(avg(abs(gts - preds)), 9) AS mae, round(avg((gts = preds)::INT), 9) AS accuracy FROM c")
def a29_count_error(g: DataFrame) -> DataFrame:
    c = g.groupBy("image_id").agg(F.count_if(F.col("role") == "gt").alias("gts"), F.count_if(F.col("role") == "pred").alias("preds"))
    return c.agg(F.round(F.avg(F.abs(F.col("gts") - F.col("preds"))), 9).alias("mae"), F.round(F.avg((F.col("gts") == F.col("preds")).cast("int")), 9).alias("accuracy"))


@book.query(
    "events",
    "WITH s AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1) SELECT event_type, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, round(median(value), 6) AS median, count(*) FILTER (value > mean + std) AS slow FROM events JOIN s USING (event_type) GROUP BY 1",
)
def a30_a32_loader_statistics(e: DataFrame) -> DataFrame:
    s = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    rows = e.join(F.broadcast(s), "event_type")  # a handful of types
    return rows.groupBy("event_type").agg(
        F.round(F.first("mean"), 6).alias("mean"), F.round(F.first("std"), 6).alias("std"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.count_if(F.col("value") > F.col("mean") + F.col("std")).alias("slow")
    )


@book.query("images detections", "SELECT class_name, count(*) FILTER (dataset = 'F') AS \"F\", count(*) FILTER (dataset = 'O') AS \"O\", count(*) FILTER (dataset = 'P') AS \"P\" FROM images JOIN detections USING (image_id) GROUP BY 1")
def a33_label_pivot(images: DataFrame, d: DataFrame) -> DataFrame:
    return d.join(images.select("image_id", "dataset"), "image_id").groupBy("class_name").pivot("dataset", ["F", "O", "P"]).count().na.fill(0)
