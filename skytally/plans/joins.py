"""Joins, generators and spatial matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import geo as G
from ..operators import flight, greedy, overlap, tiles
from .book import Book
from .projections import CIOU_SQL, FOOT_SQL

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query(
    "images annotations categories",
    "SELECT image_id, file_name, coalesce(id, -1) AS id, coalesce(category_id, -1) AS category_id, coalesce(x, -1) AS x, coalesce(w, -1) AS w FROM images LEFT JOIN annotations USING (image_id) LEFT JOIN categories USING (class_name)",
)
def j01_j04_k08_coco_rows(images: DataFrame, a: DataFrame, categories: DataFrame) -> DataFrame:
    rows = images.select("image_id", "file_name").join(a, "image_id", "left").join(F.broadcast(categories), "class_name", "left")  # a label set
    return rows.select("image_id", "file_name", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("id", "category_id", "x", "w")])


SPLIT = "CASE WHEN image_id % 10 < 7 THEN 'train' WHEN image_id % 10 < 9 THEN 'val' ELSE 'test' END"


@book.query("images annotations", f"SELECT split, id FROM annotations JOIN (SELECT image_id, {SPLIT} AS split FROM images) USING (image_id) WHERE split <> 'test'")
def j02_j03_c07_split_annotations(images: DataFrame, a: DataFrame) -> DataFrame:
    parts = images.select("image_id", F.expr(SPLIT).alias("split")).where("split <> 'test'")
    return a.join(parts, "image_id").select("split", "id")


@book.query(
    "images detections",
    "WITH t AS (SELECT det_key, image_id, x1 % 800 AS tx1, y1 % 800 AS ty1, x1 // 800 * 800 AS ox, y1 // 800 * 800 AS oy FROM detections) SELECT image_id, file_name, det_key, tx1 + ox AS x1, ty1 + oy AS y1 FROM t JOIN images USING (image_id)",
)
def j05_assemble_tiles(images: DataFrame, d: DataFrame) -> DataFrame:
    """Detections in tile coordinates, back in their images."""
    t = d.select("det_key", "image_id", F.expr("x1 % 800").alias("tx1"), F.expr("y1 % 800").alias("ty1"), F.expr("x1 div 800 * 800").alias("ox"), F.expr("y1 div 800 * 800").alias("oy"))
    return t.join(images.select("image_id", "file_name"), "image_id").select("image_id", "file_name", "det_key", (F.col("tx1") + F.col("ox")).alias("x1"), (F.col("ty1") + F.col("oy")).alias("y1"))


@book.query(
    "images",
    """WITH gps AS (SELECT CASE image_id % 3 WHEN 0 THEN file_name WHEN 1 THEN 'flight/' || file_name ELSE 'raw\\' || file_name END AS path, latitude AS lat FROM images WHERE image_id % 5 <> 0 AND latitude IS NOT NULL)
SELECT i.image_id, round(coalesce(a.lat, b.lat, c.lat, 999e0), 9) AS lat FROM images i LEFT JOIN gps a ON a.path = i.file_name LEFT JOIN gps b ON b.path = 'flight/' || i.file_name LEFT JOIN gps c ON c.path = 'raw\\' || i.file_name""",
)
def j06_gps_by_path(images: DataFrame) -> DataFrame:
    """Positions by the first of several candidate paths: one equi-join of the candidates, and the best by rank."""
    gps = images.where("image_id % 5 <> 0 AND latitude IS NOT NULL")
    path = F.when(F.col("image_id") % 3 == 0, F.col("file_name")).when(F.col("image_id") % 3 == 1, F.concat(F.lit("flight/"), "file_name")).otherwise(F.concat(F.lit("raw\\"), "file_name"))
    gps = gps.select(path.alias("path"), F.col("latitude").alias("lat"))
    candidates = images.select("image_id", F.posexplode(F.array("file_name", F.concat(F.lit("flight/"), "file_name"), F.concat(F.lit("raw\\"), "file_name"))).alias("rank", "path"))
    found = candidates.join(gps, "path", "left").groupBy("image_id").agg(F.min_by("lat", F.when(F.col("lat").isNotNull(), F.col("rank"))).alias("lat"))
    return found.select("image_id", F.round(F.coalesce("lat", F.lit(999.0)), 9).alias("lat"))


N = "greatest(0, floor((ceil(({len} - {p}) / {s}e0) * {s} + 0e0) / {s}e0) + 1)::BIGINT"
GRID_SQL = """WITH n AS (SELECT image_id, {ny} AS ny, {nx} AS nx FROM images), g AS (SELECT image_id, nx, unnest(range(ny)) AS ty FROM n), t AS (SELECT image_id, ty, unnest(range(nx)) AS tx FROM g)"""


def grid_sql(p: int, s: int) -> str:
    return GRID_SQL.format(ny=N.format(len="height", p=p, s=s), nx=N.format(len="width", p=p, s=s))


@book.query("images", grid_sql(800, 640) + " SELECT image_id, ty::INT AS ty, tx::INT AS tx, (tx * 640)::INT AS x0, (ty * 640)::INT AS y0, (tx * 640 + 800)::INT AS x1, (ty * 640 + 800)::INT AS y1 FROM t")
def g01_s09_tile_grid(images: DataFrame) -> DataFrame:
    return tiles.grid(images, 800, 640)


@book.query(
    "images annotations",
    grid_sql(800, 640) + """, c AS (SELECT id, image_id, class_name, ty, tx, w, h, greatest(x, tx * 640) AS l, greatest(y, ty * 640) AS tp, least(x + w, tx * 640 + 800) AS r, least(y + h, ty * 640 + 800) AS b FROM annotations JOIN t USING (image_id)
 WHERE x < tx * 640 + 800 AND x + w > tx * 640 AND y < ty * 640 + 800 AND y + h > ty * 640)
SELECT id, image_id, class_name, ty::INT AS ty, tx::INT AS tx, l - tx * 640 AS tile_x, tp - ty * 640 AS tile_y, r - l AS tile_w, b - tp AS tile_h, round((r - l) * (b - tp) / (w * h)::DOUBLE, 9) AS visibility FROM c WHERE (r - l) * (b - tp) / (w * h)::DOUBLE > 0.1""",
)
def j07_p37_f13_tile_annotations(images: DataFrame, a: DataFrame) -> DataFrame:
    out = tiles.assign(a, images, 800, 640, 0.1)
    return out.select("id", "image_id", "class_name", "ty", "tx", *[F.col(f"tile_{k}").cast("long").alias(f"tile_{k}") for k in "xywh"], F.round("visibility", 9).alias("visibility"))


@book.query("images annotations", grid_sql(800, 640) + """, c AS (SELECT id, greatest(x, tx * 640) AS l, greatest(y, ty * 640) AS tp, least(x + w, tx * 640 + 800) AS r, least(y + h, ty * 640 + 800) AS b, w * h AS area FROM annotations JOIN t USING (image_id) WHERE x < tx * 640 + 800 AND x + w > tx * 640 AND y < ty * 640 + 800 AND y + h > ty * 640)
SELECT (SELECT count(*) FROM annotations) AS total, count(DISTINCT id) AS kept, round(count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM annotations), 9) AS share FROM c WHERE (r - l) * (b - tp) / area::DOUBLE > 0.1""")
def a19_annotations_kept_by_tiling(images: DataFrame, a: DataFrame) -> DataFrame:
    kept = tiles.assign(a, images, 800, 640, 0.1).agg(F.count_distinct("id").alias("kept"))
    total = a.agg(F.count("*").alias("total"))
    return total.crossJoin(kept).select("total", "kept", F.round(F.col("kept") / F.col("total"), 9).alias("share"))  # one row each


EDGE = CIOU_SQL.replace("x1", "west").replace("y1", "south").replace("x2", "east").replace("y2", "north")
PLAIN = B.IOU_SQL.format(a="a.", b="b.").replace("x1", "west").replace("y1", "south").replace("x2", "east").replace("y2", "north")
EDGES_SQL = FOOT_SQL + f", z AS (SELECT f.*, {G.zone_sql('latitude', 'longitude')} AS zone FROM f JOIN images USING (image_id)), e AS (SELECT a.image_id AS image_a, b.image_id AS image_b, {EDGE} AS ciou, {PLAIN} AS iou FROM z a JOIN z b ON a.zone = b.zone AND a.image_id > b.image_id AND a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north)"


@book.query("images", EDGES_SQL + " SELECT image_a, image_b, round(ciou, 6) AS ciou FROM e WHERE ciou > 0.2e0")
def j08_overlap_edges(images: DataFrame) -> DataFrame:
    return overlap.edges(flight.footprints(images), 0.2).select("image_a", "image_b", F.round("ciou", 6).alias("ciou"))


@book.query(
    "images",
    EDGES_SQL + """, k AS (SELECT * FROM e WHERE ciou > 0.2e0), n AS (SELECT image_a, count(*) AS n FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS images, (SELECT round(avg(n), 6) FROM n) AS avg_neighbours, (SELECT max(n) FROM n) AS max_neighbours, (SELECT min(n) FROM n) AS min_neighbours, round(avg(ciou), 6) AS mean_ciou, round(max(ciou), 6) AS max_ciou FROM k""",
)
def a05_overlap_statistics(images: DataFrame) -> DataFrame:
    n = overlap.neighbours(flight.footprints(images), 0.2)
    return n.select("images", F.round(F.try_divide("pairs", "images"), 6).alias("avg_neighbours"), F.col("most").alias("max_neighbours"), F.col("least").alias("min_neighbours"), F.round("ciou", 6).alias("mean_ciou"), F.round("max_ciou", 6).alias("max_ciou"))


@book.query(
    "images detections",
    EDGES_SQL + " SELECT image_a, image_b, count(*) AS pairs FROM e JOIN detections a ON a.image_id = image_a JOIN detections b ON b.image_id = image_b AND a.class_name = b.class_name WHERE ciou > 0.3e0 GROUP BY 1, 2",
)
def j09_duplicate_candidates(images: DataFrame, d: DataFrame) -> DataFrame:
    """Detections of one class in overlapping images; as footprints are whole images (the reference's default), every such pair is a candidate. Counted, not paired."""
    per = d.groupBy("image_id", "class_name").agg(F.count("*").alias("n"))
    return overlap.common_classes(flight.footprints(images).join(per, "image_id"), 0.3)


@book.query("images", EDGES_SQL + " SELECT round(sum(least(1e12, iou)), 4) AS sum_iou, count(*) AS pairs FROM e WHERE ciou > 0.5e0")
def j16_a11_coverage(images: DataFrame) -> DataFrame:
    k = overlap.place_edges(overlap.places(flight.footprints(images)), 0.5)
    return k.agg(F.round(F.sum(F.col("iou") * F.col("pairs")), 4).alias("sum_iou"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


MATCH_SQL = f"""g AS (SELECT * FROM gt_pred WHERE role = 'gt'), p AS (SELECT * FROM gt_pred WHERE role = 'pred'),
c AS (SELECT a.image_id, a.det_key AS gt_key, b.det_key AS pred_key, {B.IOU_SQL.format(a='a.', b='b.')} AS iou FROM g a JOIN p b ON a.image_id = b.image_id),
o AS (SELECT image_id, list(struct_pack(iou := iou, gt_key := gt_key, pred_key := pred_key) ORDER BY iou DESC, gt_key, pred_key) AS l FROM c WHERE iou >= 0.5 GROUP BY 1),
m AS (SELECT image_id, l, 1 AS i, []::BIGINT[] AS gs, []::BIGINT[] AS ps FROM o UNION ALL
 SELECT image_id, l, i + 1, CASE WHEN list_contains(gs, l[i].gt_key) OR list_contains(ps, l[i].pred_key) THEN gs ELSE list_append(gs, l[i].gt_key) END, CASE WHEN list_contains(gs, l[i].gt_key) OR list_contains(ps, l[i].pred_key) THEN ps ELSE list_append(ps, l[i].pred_key) END FROM m WHERE i <= len(l)),
z AS (SELECT image_id, unnest(gs) AS gt_key, unnest(ps) AS pred_key FROM m WHERE i = len(l) + 1)"""


@book.query("gt_pred", f"WITH RECURSIVE {MATCH_SQL} SELECT image_id, gt_key, pred_key FROM z")
def j10_w03_match(g: DataFrame) -> DataFrame:
    return greedy.match(g.where("role = 'gt'"), g.where("role = 'pred'"), 0.5).select("image_id", "gt_key", "pred_key")


@book.query(
    "gt_pred",
    f"""WITH RECURSIVE {MATCH_SQL}, n AS (SELECT (SELECT count(*) FROM z) AS tp, (SELECT count(*) FROM p) AS preds, (SELECT count(*) FROM g) AS gts)
SELECT tp, preds - tp AS fp, gts - tp AS fn, round(tp / (preds + 1e-6), 9) AS precision, round(tp / (gts + 1e-6), 9) AS recall FROM n""",
)
def a22_precision_recall(g: DataFrame) -> DataFrame:
    tp = greedy.match(g.where("role = 'gt'"), g.where("role = 'pred'"), 0.5).agg(F.count("*").alias("tp"))
    n = g.agg(F.count_if(F.col("role") == "pred").alias("preds"), F.count_if(F.col("role") == "gt").alias("gts"))
    eps = F.lit(1e-6)
    return tp.crossJoin(n).select("tp", (F.col("preds") - F.col("tp")).alias("fp"), (F.col("gts") - F.col("tp")).alias("fn"), F.round(F.col("tp") / (F.col("preds") + eps), 9).alias("precision"), F.round(F.col("tp") / (F.col("gts") + eps), 9).alias("recall"))  # one row each


@book.query("detections", "WITH a AS (SELECT det_key, confidence FROM detections WHERE det_key % 3 <> 0), b AS (SELECT det_key, class_name FROM detections WHERE det_key % 4 <> 0) SELECT det_key, coalesce(confidence, -1) AS confidence, coalesce(class_name, '') AS class_name FROM a FULL JOIN b USING (det_key)")
def j11_full_outer(d: DataFrame) -> DataFrame:
    a, b = d.where("det_key % 3 <> 0").select("det_key", "confidence"), d.where("det_key % 4 <> 0").select("det_key", "class_name")
    return a.join(b, "det_key", "full").select("det_key", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), F.coalesce("class_name", F.lit("")).alias("class_name"))


@book.query("images detections", "SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM detections)")
def j12_negative_images(images: DataFrame, d: DataFrame) -> DataFrame:
    return images.join(d, "image_id", "left_anti").select("image_id")


@book.query(
    "images",
    grid_sql(2000, 2000) + """, n AS MATERIALIZED (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ty, tx) - 1 AS nth, tx, ty FROM t) SELECT i.image_id, i.file_name, n.nth::INT AS nth, (n.tx * 2000)::INT AS x0 FROM images i JOIN n ON n.image_id = i.image_id AND n.nth = i.image_id % 6""".replace("n AS MATERIALIZED", "k AS MATERIALIZED").replace("n.", "k.").replace("JOIN n ON", "JOIN k ON"),
)
def j13_tiles_by_position(images: DataFrame) -> DataFrame:
    """A tile file's parent by name, and its place by number."""
    grid = tiles.grid(images, 2000, 2000).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "x0"))).alias("tiles"))
    rows = grid.select("image_id", F.posexplode("tiles").alias("nth", "tile"))
    wanted = images.select("image_id", "file_name", (F.col("image_id") % 6).cast("int").alias("nth"))
    return wanted.join(rows, ["image_id", "nth"]).select("image_id", "file_name", "nth", F.col("tile.x0").alias("x0"))


@book.query("images", "SELECT i.image_id, coalesce(t.task_id, -1) AS task_id, t.task_id IS NULL AS failed FROM images i LEFT JOIN (SELECT image_id + 5 AS task_id, '/data/' || file_name AS path FROM images WHERE image_id % 4 <> 0) t ON t.path = '/data/' || i.file_name")
def j14_task_ids(images: DataFrame) -> DataFrame:
    t = images.where("image_id % 4 <> 0").select((F.col("image_id") + 5).alias("task_id"), F.concat(F.lit("/data/"), "file_name").alias("path"))
    rows = images.select("image_id", F.concat(F.lit("/data/"), "file_name").alias("path")).join(t, "path", "left")
    return rows.select("image_id", F.coalesce("task_id", F.lit(-1)).alias("task_id"), F.col("task_id").isNull().alias("failed"))


@book.query("detections", "SELECT * FROM detections WHERE det_key IN (SELECT det_key FROM detections WHERE confidence > 0.9e0)")
def j15_filtered_rows(d: DataFrame) -> DataFrame:
    return d.join(d.where("confidence > 0.9e0").select("det_key"), "det_key", "left_semi")


@book.query("images detections", "SELECT camp_id, class_name, count(*) AS n FROM images JOIN detections USING (image_id) GROUP BY 1, 2")
def j17_a21_label_histogram(images: DataFrame, d: DataFrame) -> DataFrame:
    per = d.groupBy("image_id", "class_name").agg(F.count("*").alias("n"))
    return per.join(images.select("image_id", "camp_id"), "image_id").groupBy("camp_id", "class_name").agg(F.sum("n").alias("n"))


@book.query(
    "detections",
    """WITH b AS (SELECT image_id, class_name, det_key, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy FROM detections),
p AS (SELECT a.image_id, a.class_name, sqrt(pow(a.cx - c.cx, 2) + pow(a.cy - c.cy, 2)) AS dist FROM b a JOIN b c ON a.image_id = c.image_id AND a.class_name = c.class_name AND a.det_key < c.det_key)
SELECT image_id, class_name, count(*) AS pairs, round(avg(dist), 6) AS mean, round(max(dist), 6) AS max, round(min(dist), 6) AS min, round(stddev_pop(dist), 6) AS std FROM p GROUP BY 1, 2""",
)
def j18_a28_duplicate_distances(d: DataFrame) -> DataFrame:
    """Distances within groups of duplicates: all detections of one class in one image."""
    b = d.select("image_id", "class_name", "det_key", F.expr("(x1 + x2) / 2e0").alias("cx"), F.expr("(y1 + y2) / 2e0").alias("cy"))
    c = b.toDF("image_id", "class_name", "other", "ox", "oy")
    dist = F.sqrt(F.pow(F.col("cx") - F.col("ox"), 2.0) + F.pow(F.col("cy") - F.col("oy"), 2.0))
    pairs = b.join(c, ["image_id", "class_name"]).where("det_key < other").select("image_id", "class_name", dist.alias("dist"))
    return pairs.groupBy("image_id", "class_name").agg(F.count("*").alias("pairs"), *[F.round(f("dist"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"), (F.stddev_pop, "std"))])


@book.query("gt_pred", "SELECT det_key, max(class_name) FILTER (role = 'gt') AS class_name, round(max(score) FILTER (role = 'pred'), 6) AS score FROM gt_pred GROUP BY det_key HAVING count(*) = 2")
def j19_results_by_id(g: DataFrame) -> DataFrame:
    p = g.where("role = 'pred'").select("det_key", F.round("score", 6).alias("score"))
    return g.where("role = 'gt'").select("det_key", "class_name").join(p, "det_key")


BORDER = """x AS (SELECT image_id, height, width AS len, ceil(width * 0.25e0) AS tile, ceil((width - ceil(width * 0.25e0)) / (0.9e0 * ceil(width * 0.25e0))) AS n FROM images), y AS (SELECT image_id, height AS len, ceil(height * 0.5e0) AS tile, ceil((height - ceil(height * 0.5e0)) / (0.9e0 * ceil(height * 0.5e0))) AS n FROM images),
xs AS (SELECT image_id, floor(tile + i * 0.9e0 * tile) - tile AS lo, CASE WHEN i = n - 1 THEN len ELSE floor(tile + i * 0.9e0 * tile) END AS hi FROM (SELECT *, unnest(range(n::BIGINT)) AS i FROM x)),
ys AS (SELECT image_id, floor(tile + i * 0.9e0 * tile) - tile AS lo, CASE WHEN i = n - 1 THEN len ELSE floor(tile + i * 0.9e0 * tile) END AS hi FROM (SELECT *, unnest(range(n::BIGINT)) AS i FROM y))"""


@book.query("images", f"WITH {BORDER} SELECT xs.image_id, xs.lo::INT AS x0, xs.hi::INT AS x1, ys.lo::INT AS y0, ys.hi::INT AS y1 FROM xs JOIN ys USING (image_id)")
def g02_border_tiles(images: DataFrame) -> DataFrame:
    return tiles.border_tiles(images, 0.25, 0.5, 0.1)


@book.query("images", "SELECT image_id, copy::INT AS copy, file_name || '#' || copy AS name FROM images, (SELECT unnest(range(1, 4)) AS copy)")
def g08_augmented_copies(images: DataFrame) -> DataFrame:
    rows = images.select("image_id", "file_name", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    return rows.select("image_id", "copy", F.concat("file_name", F.lit("#"), "copy").alias("name"))


@book.query("images detections", "SELECT i.image_id, k::INT AS k, ((i.image_id * 7919 + k * 104729) % (width - 256)) AS x1, ((i.image_id * 6007 + k * 15485863) % (height - 256)) AS y1 FROM images i, (SELECT unnest(range(2)) AS k) WHERE i.image_id NOT IN (SELECT image_id FROM detections)")
def g11_fallback_boxes(images: DataFrame, d: DataFrame) -> DataFrame:
    rows = images.join(d, "image_id", "left_anti").select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    return rows.select("image_id", "k", F.expr("(image_id * 7919 + k * 104729) % (width - 256)").alias("x1"), F.expr("(image_id * 6007 + k * 15485863) % (height - 256)").alias("y1"))
