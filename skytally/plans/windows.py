"""Order-dependent operators, sampling, partitioning and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import IOU_SQL
from ..operators import datasets, flight, greedy, overlap, partition, sampling, tiles
from .book import Book
from .joins import SPLIT, grid_sql

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("images", "WITH k AS (SELECT camp_id, image_id, row_number() OVER (PARTITION BY camp_id ORDER BY latitude, longitude, altitude, file_name) AS nth FROM images WHERE latitude IS NOT NULL) SELECT camp_id, image_id, nth::INT AS nth, coalesce(lag(image_id) OVER (PARTITION BY camp_id ORDER BY nth), -1) AS previous FROM k")
def w01_flight_path(images: DataFrame) -> DataFrame:
    w = W.partitionBy("camp_id").orderBy("latitude", "longitude", "altitude", "file_name")
    rows = images.where("latitude IS NOT NULL")
    return rows.select("camp_id", "image_id", F.row_number().over(w).alias("nth"), F.coalesce(F.lag("image_id").over(w), F.lit(-1)).alias("previous"))


NMS_SQL = f"""o AS (SELECT image_id, list(struct_pack(k := det_key, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY confidence DESC, det_key) AS l FROM dense GROUP BY 1),
m AS (SELECT image_id, l, 1 AS i, []::STRUCT(k BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS kept FROM o UNION ALL
 SELECT image_id, l, i + 1, CASE WHEN len(list_filter(kept, lambda b: {IOU_SQL.format(a='b.', b='l[i].')} > 0.5)) > 0 THEN kept ELSE list_append(kept, l[i]) END FROM m WHERE i <= len(l))"""


@book.query("dense", f"WITH RECURSIVE {NMS_SQL} SELECT image_id, unnest(kept).k AS det_key FROM m WHERE i = len(l) + 1")
def w02_nms(d: DataFrame) -> DataFrame:
    return greedy.nms(d, 0.5).select("image_id", "det_key")


BOX_TYPE = "STRUCT(k BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, hx1 BIGINT, hy1 BIGINT, hx2 BIGINT, hy2 BIGINT, merged BIGINT)"
NMM_SQL = f"""o AS (SELECT image_id, list(struct_pack(k := det_key, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY confidence DESC, det_key) AS l FROM dense GROUP BY 1),
m AS (SELECT image_id, l, 1 AS i, []::{BOX_TYPE}[] AS kept FROM o UNION ALL
 SELECT image_id, l, i + 1, CASE WHEN coalesce(place, 0) = 0 THEN list_append(kept, struct_pack(k := l[i].k, x1 := l[i].x1, y1 := l[i].y1, x2 := l[i].x2, y2 := l[i].y2, hx1 := l[i].x1, hy1 := l[i].y1, hx2 := l[i].x2, hy2 := l[i].y2, merged := 1::BIGINT))
  ELSE list_transform(kept, lambda b, j: CASE WHEN j = place THEN struct_pack(k := b.k, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2, hx1 := least(b.hx1, l[i].x1), hy1 := least(b.hy1, l[i].y1), hx2 := greatest(b.hx2, l[i].x2), hy2 := greatest(b.hy2, l[i].y2), merged := b.merged + 1) ELSE b END) END
 FROM (SELECT *, list_position(list_transform(kept, lambda b: {IOU_SQL.format(a='b.', b='l[i].')} > 0.5), true) AS place FROM m WHERE i <= len(l)))"""


@book.query("dense", f"WITH RECURSIVE {NMM_SQL} SELECT image_id, b.k AS det_key, b.hx1 AS x1, b.hy1 AS y1, b.hx2 AS x2, b.hy2 AS y2, b.merged AS merged FROM (SELECT image_id, unnest(kept) AS b FROM m WHERE i = len(l) + 1)")
def w02b_nmm(d: DataFrame) -> DataFrame:
    return greedy.nmm(d, 0.5).select("image_id", "det_key", "x1", "y1", "x2", "y2", "merged")


@book.query("images detections", None)
def w04_duel(images: DataFrame, d: DataFrame) -> DataFrame:
    """The detections that stay after the duels of overlapping images, per connected group of images."""
    places = overlap.places(flight.footprints(images))
    links = overlap.written(overlap.place_edges(places, 0.3).select("id_a", "id_b"), "links")
    groups = overlap.groups(places, links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    of = groups.join(places, "id").select(F.col("id").alias("place"), "group_id", F.explode("images").alias("image_id"))
    far = d.join(images.select("image_id", "width", "height"), "image_id").join(of, "image_id")
    far = far.select("group_id", "class_name", "place", "image_id", "det_key", F.expr("sqrt(pow((x1 + x2) / 2e0 - width / 2e0, 2) + pow((y1 + y2) / 2e0 - height / 2e0, 2))").alias("far"))
    far = overlap.written(far, "far")
    there = far.select("group_id", "class_name", "place").distinct()
    near = links.select(F.col("id_a").alias("place"), F.col("id_b").alias("other")).unionAll(links.where("id_a <> id_b").select("id_b", "id_a"))
    near = there.join(near, "place").join(there.select("class_name", F.col("place").alias("other")), ["class_name", "other"])
    lost = greedy.duel_at_places(far, near)
    return d.join(lost, "det_key", "left_anti").select("det_key", "image_id", "class_name")


@book.query("images annotations", "SELECT id, row_number() OVER (ORDER BY image_id, id) - 1 AS new_id FROM annotations")
def w05_dense_ids(images: DataFrame, a: DataFrame) -> DataFrame:
    return datasets.dense_ids(a.select("image_id", "id"), ["image_id", "id"]).select("id", "new_id")


@book.query("detections", "SELECT x1, y1, x2, y2, min(det_key) AS det_key FROM detections GROUP BY 1, 2, 3, 4")
def w06_first_of_equal_boxes(d: DataFrame) -> DataFrame:
    return d.groupBy("x1", "y1", "x2", "y2").agg(F.min("det_key").alias("det_key"))


@book.query(
    "embeddings",
    """WITH d AS (SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS far FROM embeddings), b AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY far, vec_id) AS bin FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY label, bin ORDER BY md5('7:' || vec_id)) AS nth FROM b) SELECT vec_id, label, bin::INT AS bin FROM r WHERE nth = 1""",
)
def w07_c09_equal_bins(e: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = e.select("vec_id", "label", F.round(norm, 6).alias("far"))
    return sampling.equal_bins(rows, "label", "far", "vec_id", 5).select("vec_id", "label", "bin")


@book.query("embeddings", "SELECT label, n, (floor(n / sum(n) OVER () * 100) + 1)::BIGINT AS quota FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def w10_allocation(e: DataFrame) -> DataFrame:
    return sampling.allocation(e.groupBy("label").agg(F.count("*").alias("n")), 100)


@book.query("images detections", "WITH e AS (SELECT image_id, image_id NOT IN (SELECT image_id FROM detections) AS is_empty FROM images), r AS (SELECT image_id, row_number() OVER (ORDER BY md5('41:' || image_id), image_id) AS nth FROM e WHERE is_empty), k AS (SELECT least(trunc(count(*) FILTER (NOT is_empty) * 0.01)::BIGINT, count(*) FILTER (is_empty)) AS most FROM e) SELECT image_id, is_empty FROM e WHERE NOT is_empty UNION ALL SELECT image_id, true FROM r, k WHERE nth <= most")
def c10_u06_positives_and_negatives(images: DataFrame, d: DataFrame) -> DataFrame:
    labelled = d.select("image_id").distinct().withColumn("has", F.lit(True))
    rows = images.select("image_id").join(labelled, "image_id", "left").select("image_id", F.col("has").isNull().alias("is_empty"))
    return sampling.positives_and_negatives(rows, 0.01)


@book.query(
    "images annotations",
    grid_sql(2000, 2000) + """, h AS (SELECT DISTINCT t.image_id, ty, tx FROM t JOIN annotations a ON a.image_id = t.image_id AND x < tx * 2000 + 2000 AND x + w > tx * 2000 AND y < ty * 2000 + 2000 AND y + h > ty * 2000),
f AS (SELECT t.image_id, t.ty * 1000 + t.tx AS tile, h.ty IS NOT NULL AS has_annotation FROM t LEFT JOIN h USING (image_id, ty, tx)),
r AS (SELECT *, sum(has_annotation::INT) OVER (PARTITION BY image_id) AS full_tiles, row_number() OVER (PARTITION BY image_id, has_annotation ORDER BY md5('42:' || image_id || ':' || tile)) AS nth FROM f)
SELECT image_id, tile::INT AS tile, has_annotation FROM r WHERE has_annotation OR nth <= CASE WHEN full_tiles > 0 THEN trunc(full_tiles * 0.5e0) ELSE 2 END""",
)
def c11_negative_tiles(images: DataFrame, a: DataFrame) -> DataFrame:
    grid = tiles.grid(images, 2000, 2000).select("image_id", "ty", "tx")
    full = tiles.assign(a, images, 2000, 2000, 0.0).select("image_id", "ty", "tx").distinct().withColumn("has", F.lit(True))
    rows = grid.join(full, ["image_id", "ty", "tx"], "left").select("image_id", (F.col("ty") * 1000 + F.col("tx")).alias("tile"), F.col("has").isNotNull().alias("has_annotation"))
    return sampling.negative_tiles(rows, 0.5, 2)


@book.query("images", None)
def c01_near_groups(images: DataFrame) -> DataFrame:
    p = images.where("latitude IS NOT NULL").select(F.col("image_id").alias("id"), F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    return partition.near_groups(p, 0.0005)


@book.query("images", "SELECT image_id, (floor(latitude / 0.01e0) * 10000 + floor(longitude / 0.01e0))::BIGINT AS grp, floor(latitude / 0.01e0)::BIGINT || ':' || floor(longitude / 0.01e0)::BIGINT AS key FROM images WHERE latitude IS NOT NULL")
def c02_grid_groups(images: DataFrame) -> DataFrame:
    number, key = partition.grid_group(F.col("latitude"), F.col("longitude"), 0.01)
    return images.where("latitude IS NOT NULL").select("image_id", number.alias("grp"), key.alias("key"))


@book.query("images", "SELECT image_id, coalesce(camp_id, 'image_' || image_id) AS camp FROM (SELECT image_id, CASE WHEN image_id % 9 <> 0 THEN camp_id END AS camp_id FROM images)")
def c03_camps(images: DataFrame) -> DataFrame:
    return partition.camps(images.select("image_id", F.when(F.col("image_id") % 9 != 0, F.col("camp_id")).alias("camp_id")))


@book.query(
    "images",
    """WITH g AS (SELECT image_id % 97 AS group_id, count(*) AS n FROM images GROUP BY 1), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('42:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS share FROM g)
SELECT group_id, n, CASE WHEN share < 0.2 THEN 'test' WHEN share < 0.2e0 + 0.1e0 THEN 'val' ELSE 'train' END AS split FROM s""",
)
def c04_c06_group_split(images: DataFrame) -> DataFrame:
    groups = images.groupBy(F.expr("image_id % 97").alias("group_id")).agg(F.count("*").alias("n"))
    return partition.assign(groups)


@book.query("images detections", None)
def c05_stratified_split(images: DataFrame, d: DataFrame) -> DataFrame:
    h = d.groupBy(F.expr("image_id % 97").alias("group_id"), F.col("class_name").alias("label")).agg(F.count("*").alias("n"))
    return partition.stratified(h, {"train": 0.7, "val": 0.1, "test": 0.2})


@book.query("images annotations", "WITH k AS (SELECT file_name, min(struct_pack(dataset := dataset, image_id := image_id)) AS f FROM (SELECT dataset, image_id, 'img_' || image_id % 9000 || '.jpg' AS file_name FROM images) GROUP BY 1) SELECT f.dataset AS dataset, f.image_id AS image_id, file_name FROM k")
def u02_w06_merge_datasets(images: DataFrame, a: DataFrame) -> DataFrame:
    renamed = images.select("dataset", "image_id", F.concat(F.lit("img_"), (F.col("image_id") % 9000).cast("string"), F.lit(".jpg")).alias("file_name"))
    kept, _ = datasets.merge(renamed, a.join(images.select("image_id", "dataset"), "image_id"))
    return kept.select("dataset", "image_id", "file_name")


@book.query("detections", "WITH c AS (SELECT class_name AS name, supercategory, min(image_id * 100 + pos) AS place FROM detections GROUP BY 1, 2 UNION ALL SELECT lower(class_name) || ' ', supercategory, min(image_id * 100 + pos) + 1 FROM detections GROUP BY 1, 2), k AS (SELECT lower(trim(name)) || '|' || coalesce(supercategory, '') AS key, min(place) AS first, arg_min(name, place) AS name FROM c GROUP BY 1) SELECT key, name, row_number() OVER (ORDER BY first, key) AS category_id FROM k")
def u02_w05_merge_categories(d: DataFrame) -> DataFrame:
    c = d.groupBy(F.col("class_name").alias("name"), "supercategory").agg(F.min(F.col("image_id") * 100 + F.col("pos")).alias("place"))
    again = d.groupBy(F.concat(F.lower("class_name"), F.lit(" ")).alias("name"), "supercategory").agg((F.min(F.col("image_id") * 100 + F.col("pos")) + 1).alias("place"))
    return datasets.merge_categories(c.unionByName(again))


@book.query("images", "SELECT image_id, file_name FROM images WHERE dataset = 'F' UNION ALL SELECT image_id, file_name FROM images WHERE dataset = 'O'")
def u01_s16_union(images: DataFrame) -> DataFrame:
    return datasets.union([images.where(F.col("dataset") == s).select("image_id", "file_name") for s in ("F", "O")])


@book.query("gt_pred", "SELECT image_id AS task_id, 'missing' AS kind FROM (SELECT image_id FROM gt_pred WHERE role = 'gt' EXCEPT SELECT image_id FROM gt_pred WHERE role = 'pred') UNION ALL SELECT image_id, 'extra' FROM (SELECT image_id FROM gt_pred WHERE role = 'pred' EXCEPT SELECT image_id FROM gt_pred WHERE role = 'gt')")
def u04_task_differences(g: DataFrame) -> DataFrame:
    gt, pr = (g.where(F.col("role") == r).select(F.col("image_id").alias("task_id")) for r in ("gt", "pred"))
    return gt.subtract(pr).withColumn("kind", F.lit("missing")).unionByName(pr.subtract(gt).withColumn("kind", F.lit("extra")))


@book.query("gt_pred", "SELECT det_key FROM gt_pred WHERE role = 'gt' INTERSECT SELECT det_key FROM gt_pred WHERE role = 'pred'")
def u05_common_boxes(g: DataFrame) -> DataFrame:
    return g.where("role = 'gt'").select("det_key").intersect(g.where("role = 'pred'").select("det_key"))


@book.query("images", f"SELECT image_id, {SPLIT} AS split, file_name FROM images ORDER BY file_name LIMIT 200")
def o03_o04_o05_first_files(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.expr(SPLIT).alias("split"), "file_name").orderBy("file_name").limit(200)
