"""Invariants and brute force for what SQL can't tell."""

import random

import pytest
from pyspark.sql import functions as F

from skytally.functions import boxes as B
from skytally.functions import geo as G
from skytally.operators import datasets, flight, greedy, overlap, partition, sampling, tiles


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


BOXES = "image_id long, det_key long, x1 long, y1 long, x2 long, y2 long, confidence double, class_name string"


def random_boxes(n, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.randrange(60), r.randrange(60)
        out.append((k % 3, k, x, y, x + r.randrange(5, 40), y + r.randrange(5, 40), r.randrange(50) / 50, "ab"[k % 2]))
    return out


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = max(0, w) * max(0, h)
    return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)


def test_nms_by_brute_force_and_again(spark):
    rows = random_boxes(60)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(r[0] != k[0] or iou(k, r) <= 0.3 for k in kept):
            kept.append(r)
    once = greedy.nms(frame(spark, rows, BOXES), 0.3)
    assert {r.det_key for r in once.collect()} == {k[1] for k in kept}
    assert {r.det_key for r in greedy.nms(once, 0.3).collect()} == {k[1] for k in kept}


def test_nmm_keeps_every_box_once(spark):
    out = greedy.nmm(frame(spark, random_boxes(60), BOXES), 0.3).collect()
    assert sum(r.merged for r in out) == 60


def test_duel_equals_the_loop(spark):
    r = random.Random(3)
    rows = [(0, a, b, a * 10 + i, b * 10 + j, r.random(), r.random()) for a, b in ((1, 2), (1, 3), (2, 3)) for i in range(3) for j in range(3)]
    gone = set()
    for g, _, _, d1, d2, x, y in sorted(rows, key=lambda t: (t[1], t[2], t[3], t[4])):
        if d1 not in gone and d2 not in gone:
            gone.add(d2 if x < y else d1)
    c = frame(spark, rows, "group_id long, image_1 long, image_2 long, det_1 long, det_2 long, distance_1 double, distance_2 double")
    order = frame(spark, [(k, k) for k in (1, 2, 3)], "image_id long, place long")
    assert {x.det_key for x in greedy.duel(c, order).collect()} == gone


def test_utm_control_points_and_back(spark):
    # easting and northing of well-known places, to the metre
    rows = frame(spark, [(48.8582, 2.2945, 448250, 5411943), (-33.8568, 151.2153, 334897, 6252276)], "lat double, lon double, e long, n long")
    e, n = G.utm_sql("lat", "lon")
    rows = rows.select("*", F.expr(e).alias("east"), F.expr(n).alias("north"), F.expr(G.zone_sql("lat", "lon")).alias("zone"))
    lat, lon = G.latlon_sql("east", "north", "zone", "lat < 0")
    for r in rows.select("*", F.expr(lat).alias("lat2"), F.expr(lon).alias("lon2")).collect():
        assert abs(r.east - r.e) < 60 and abs(r.north - r.n) < 60
        assert abs(r.lat - r.lat2) < 1e-8 and abs(r.lon - r.lon2) < 1e-8  # a millimetre


def test_distance_of_a_degree_of_latitude(spark):
    rows = G.with_distance_km(frame(spark, [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (5.0, 5.0, 5.0, 5.0)], "a double, b double, c double, d double"), "a", "b", "c", "d", "km")
    assert [round(r.km, 4) for r in rows.collect()] == [110.5744, 111.3195, 0.0]


def test_overlap_edges_by_nested_loop(spark):
    r = random.Random(5)
    rows = [(i, 1, x := r.uniform(0, 100), y := r.uniform(0, 100), x + r.uniform(5, 30), y + r.uniform(5, 30)) for i in range(40)]
    f = frame(spark, rows, "image_id long, zone int, west double, south double, east double, north double")
    a, b = f.toDF("a", "za", "aw", "as_", "ae", "an"), f.toDF("b", "zb", "bw", "bs", "be", "bn")
    want = a.crossJoin(b).where("a > b").where(B.ciou("aw", "as_", "ae", "an", "bw", "bs", "be", "bn") > 0.1)
    assert {(x.image_a, x.image_b) for x in overlap.edges(f, 0.1, 7.0).collect()} == {(x.a, x.b) for x in want.collect()}
    with pytest.raises(ValueError):
        overlap.edges(f, -0.5)


def test_connected_groups(spark):
    nodes = frame(spark, [(i,) for i in range(10)], "id long")
    links = frame(spark, [(0, 1), (1, 2), (2, 3), (5, 9), (9, 8)], "a long, b long")
    got = {r.id: r.group_id for r in overlap.groups(nodes, links).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 8: 5, 9: 5, 6: 6, 7: 7}


def test_tiles_cover_the_image_and_cut_boxes_lie_inside(spark):
    images = frame(spark, [(1, 1000, 900), (2, 100, 100)], "image_id long, width int, height int")
    grid = tiles.grid(images, 400, 300).collect()
    assert {r.image_id for r in grid} == {1} and max(r.x1 for r in grid) >= 1000 and max(r.y1 for r in grid) >= 900
    assert {r.image_id for r in tiles.grid(images, 400, 300, compat=False).collect()} == {1, 2}
    a = frame(spark, [(7, 1, "x", 350, 250, 120, 90)], "id long, image_id long, class_name string, x long, y long, w long, h long")
    for r in tiles.assign(a, images, 400, 300, 0.0).collect():
        assert 0 <= r.tile_x and r.tile_x + r.tile_w <= 400 and r.tile_w > 0 and 0 <= r.tile_y and r.tile_y + r.tile_h <= 400 and r.tile_h > 0


def test_splits_are_disjoint_and_complete(spark):
    groups = frame(spark, [(g, 10) for g in range(50)], "group_id long, n long")
    out = partition.assign(groups).collect()
    assert len(out) == 50 and {r.split for r in out} == {"train", "val", "test"}
    h = frame(spark, [(g, "ab"[g % 2], 5) for g in range(20)], "group_id long, label string, n long")
    assert len({r.group_id for r in partition.stratified(h, {"train": 0.7, "val": 0.3}).collect()}) == 20


def test_rebalance_keeps_all_classes(spark):
    rows = frame(spark, [(i, "a" if i < 100 else "b" if i < 150 else "c") for i in range(175)], "id long, class_name string")
    counts = {r["class_name"]: r["count"] for r in sampling.undersample(rows, "id").groupBy("class_name").count().collect()}
    assert counts == {"a": 50, "b": 50, "c": 25}


def test_dense_ids_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = datasets.dense_ids(rows, ["k"]).collect()
    assert all(r.k == r.new_id for r in got) and len(got) == 1000


def test_flight_path_of_one_image(spark):
    one = frame(spark, [(1, "f", 10, 10, 1.0, 2.0, 50.0, "c", "d")], "image_id long, file_name string, width int, height int, latitude double, longitude double, altitude double, camp_id string, dataset string").withColumn("ts", F.current_timestamp())
    r = flight.path_metrics(one).first()
    assert r.total_km == 0.0 and r.waypoints == 1


def test_merged_configurations(spark):
    paths = frame(spark, [("a", "train", "x"), ("b", "train", "x"), ("b", "val", "y")], "config string, split string, path string")
    names = frame(spark, [("a", 0, "deer"), ("b", 0, "deer"), ("b", 2, "elk"), ("b", 1, "fox")], "config string, class_id int, name string")
    one, two = datasets.merge_configs(paths, names)
    assert sorted(map(tuple, one.collect())) == [("train", "x"), ("val", "y")] and sorted(map(tuple, two.collect())) == [(0, "deer"), (1, "fox"), (2, "elk")]
    other = names.unionByName(frame(spark, [("c", 0, "hare")], "config string, class_id int, name string"))
    with pytest.raises(ValueError):
        datasets.merge_configs(paths, other)
    assert sorted(map(tuple, datasets.merge_configs(paths, other, force=True)[1].collect())) == [(0, "class_0"), (1, "class_1"), (2, "class_2")]


def test_clusters_of_separate_points(spark):
    rows = [(i, [10.0 * (i % 3) + 0.01 * i, 0.0]) for i in range(30)] + [(99, None), (98, [None, 1.0])]
    out = sampling.clusters(frame(spark, rows, "id long, v array<double>"), "v", (2, 3, 5)).collect()
    assert {r.k for r in out} == {3} and len(out) == 30 and len({(r.id % 3, r.cluster) for r in out}) == 3


def test_duplicate_boxes_meet_across_images(spark):
    images = frame(spark, [(1, 4000, 3000, -24.0, 31.5), (2, 4000, 3000, -24.0, 31.5001), (3, 4000, 3000, -24.2, 31.5)], "image_id long, width int, height int, latitude double, longitude double")
    e = {r.image_id: r.e0 for r in flight.located(images).collect()}
    gsd = flight.located(images).first().gsd * 0.01
    shift = round((e[2] - e[1]) / gsd)
    d = frame(spark, [(1, 1, 2000, 500, 2100, 600, "a"), (2, 2, 2000 - shift, 500, 2100 - shift, 600, "a"), (2, 3, 2000 - shift, 500, 2100 - shift, 600, "b"), (3, 4, 2000, 500, 2100, 600, "a"), (1, 5, 2000, 500, 2100, 600, "a")], "image_id long, det_key long, x1 long, y1 long, x2 long, y2 long, class_name string")
    got = {(r.det_a, r.det_b) for r in flight.duplicate_boxes(d, images, 0.2, 0.5).collect()}
    assert got == {(2, 1), (5, 2)}


def test_extension_points(spark):
    from skytally import extension

    rows = frame(spark, [(i % 3, i, i * 100 % 7, 0, 50, 50, i / 9, "a") for i in range(9)], BOXES)
    p = extension.Pipeline().add("drop", lambda df: df.where("det_key > 0")).add("mark", lambda df: df.withColumn("kept", F.lit(True))).add("first", lambda df: df.limit(4), before="mark")
    assert p(rows).columns[-1] == "kept" and [n for n, _ in p.history[0]] == ["drop", "first", "mark"]
    p.remove("first")
    assert p(rows).count() == 8 and len(p.history) == 2
    with pytest.raises(ValueError):
        p.add("mark", lambda df: df)
    assert extension.samplers["random"](rows, 3).count() == 3 and "nms" in extension.removals and extension.removals["nms"](rows, 0.5).count() >= 1
    with pytest.raises(KeyError):
        extension.overlaps["unknown"]

    @extension.converters.register("nothing")
    def nothing(spark, path):
        return {}

    with pytest.raises(ValueError):
        extension.converters.register("nothing")(nothing)
    assert extension.converters["nothing"](spark, "") == {}


def test_sensor_of_the_model(spark):
    rows = frame(spark, [("FC330", 10.0), ("unknown", 10.0), (None, 10.0), ("FC330", None)], "model string, own double")
    got = [r[0] for r in rows.select(G.gsd_of_camera(F.lit(100.0), F.lit(1000), F.col("model"), F.lit(None).cast("double"), None, F.col("own"))).collect()]
    assert got == [24.0, None, None, None]

