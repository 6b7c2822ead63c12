"""Many images of one footprint: whole results, without a pair of images for each pair of copies on the way."""

import random

from skytally.operators import flight, overlap
from skytally.plans import joins, windows

FOOT = "image_id long, zone int, west double, south double, east double, north double"
IMAGES = "image_id long, file_name string, width long, height long, latitude double, longitude double, altitude double"


def feet(r, n):
    """n images at few places, most of them copies."""
    spots = [(r.choice((35, 36)), x := r.uniform(0, 60), y := r.uniform(0, 60), x + r.uniform(8, 30), y + r.uniform(8, 30)) for _ in range(12)]
    return [(i, *r.choice(spots)) for i in r.sample(range(1000), n)]


def brute(rows, threshold, spark):
    from skytally.functions import boxes as B

    f = spark.createDataFrame(rows, FOOT)
    a, b = f.toDF("a", "za", "aw", "as_", "ae", "an"), f.toDF("b", "zb", "bw", "bs", "be", "bn")
    found = a.crossJoin(b).where("a > b AND za = zb").select("a", "b", B.ciou("aw", "as_", "ae", "an", "bw", "bs", "be", "bn").alias("c"))
    return {(x.a, x.b): x.c for x in found.where(f"c > {threshold}").collect()}


def test_edges_and_neighbours_of_copies(spark):
    rows = feet(random.Random(8), 60)
    want, f = brute(rows, 0.1, spark), spark.createDataFrame(rows, FOOT)
    got = [(x.image_a, x.image_b, x.ciou) for x in overlap.edges(f, 0.1).collect()]
    assert len(got) == len(want) and all(abs(want[a, b] - c) < 1e-9 for a, b, c in got)
    many = {}
    for a, _ in want:
        many[a] = many.get(a, 0) + 1
    n = overlap.neighbours(f, 0.1).first()
    assert (n.images, n.most, n.least, n.pairs) == (len(many), max(many.values()), min(many.values()), len(want))
    assert abs(n.ciou - sum(want.values()) / len(want)) < 1e-9 and abs(n.max_ciou - max(want.values())) < 1e-9


def one_place(spark, n):
    return spark.range(n).selectExpr("id AS image_id", "'x' AS file_name", "4000L AS width", "3000L AS height", "-24e0 AS latitude", "31.5e0 AS longitude", "100e0 AS altitude")


def test_statistics_of_a_hundred_thousand_copies(spark):
    """Five thousand million pairs of images."""
    r = joins.a05_overlap_statistics(one_place(spark, 100_000)).first()
    assert (r.images, r.avg_neighbours, r.max_neighbours, r.min_neighbours, r.mean_ciou, r.max_ciou) == (99_999, 50_000, 99_999, 1, 1, 1)


def test_coverage_of_a_hundred_thousand_copies(spark):
    r = joins.j16_a11_coverage(one_place(spark, 100_000)).first()
    assert (r.sum_iou, r.pairs) == (4_999_950_000, 4_999_950_000)


def test_candidates_and_boxes_of_copies(spark):
    """A thousand images of one place, each with a box of its own spot: half a million pairs of images, no pair of boxes."""
    d = spark.range(1000).selectExpr("id AS det_key", "id AS image_id", "IF(id % 2 = 0, 'a', 'b') AS class_name", "id % 40 * 90 AS x1", "id div 40 * 90 AS y1").selectExpr("*", "x1 + 30 AS x2", "y1 + 30 AS y2")
    got = joins.j09_duplicate_candidates(one_place(spark, 1000), d.unionByName(d.selectExpr("det_key + 1000 AS det_key", "image_id", "class_name", "x1", "y1", "x2", "y2")))
    assert [(r.p, r.n) for r in got.groupBy("pairs").count().toDF("p", "n").collect()] == [(4, 2 * 500 * 499 // 2)] and got.where("image_a <= image_b").isEmpty()
    assert flight.duplicate_boxes(d, one_place(spark, 1000), 0.2, 0.01).count() == 0
    twice = d.unionByName(d.selectExpr("det_key + 1000 AS det_key", "image_id + 1000 AS image_id", "class_name", "x1", "y1", "x2", "y2"))
    assert {(r.det_a, r.det_b, r.ciou) for r in flight.duplicate_boxes(twice, one_place(spark, 2000), 0.2, 0.01).collect()} == {(k + 1000, k, 1.0) for k in range(1000)}


def test_nothing_overlaps(spark):
    none = one_place(spark, 1)
    assert joins.j08_overlap_edges(none).count() == 0 and joins.j16_a11_coverage(none).first().pairs == 0
    assert joins.a05_overlap_statistics(none).first().images == 0


def test_a_chain_that_a_label_walks_along(spark):
    """The least id is at one end, and the others fall away from it, so that no label comes from farther than a neighbour."""
    ids = [0, *range(119, 0, -1)]
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    got = overlap.groups(spark.createDataFrame([(i,) for i in [*ids, 500]], "id long"), links).collect()
    assert {(x.id, x.group_id) for x in got} == {(i, 0) for i in ids} | {(500, 500)}


def test_duels_of_many_copies(spark):
    """Three thousand images of one place: twelve million candidates, of which one detection a class stays."""
    d = spark.range(3000 * 3).selectExpr("id AS det_key", "id div 3 AS image_id", "IF(id % 3 = 0, 'b', 'a') AS class_name", "id * 7919 % 1000 AS x1", "id * 7919 % 1000 + 20 AS x2", "id * 104729 % 900 AS y1", "id * 104729 % 900 + 20 AS y2")
    rows, gone, left = d.orderBy("image_id", "det_key").collect(), set(), {"a": [], "b": []}
    far = {r.det_key: ((((r.x1 + r.x2) / 2 - 2000) ** 2) + ((r.y1 + r.y2) / 2 - 1500) ** 2) ** 0.5 for r in rows}
    of, name = {r.det_key: r.image_id for r in rows}, {r.det_key: r.class_name for r in rows}
    for image in range(3000):
        for kind in "ab":
            mine = [k for k in range(3 * image, 3 * image + 3) if name[k] == kind]
            for b in sorted({of[k] for k in left[kind]}):
                for x in mine:
                    for y in [k for k in left[kind] if of[k] == b]:
                        if x not in gone and y not in gone:
                            gone.add(y if far[x] < far[y] else x)
            left[kind] = [k for k in [*left[kind], *mine] if k not in gone]
    got = {r.det_key for r in windows.w04_duel(one_place(spark, 3000), d).collect()}
    assert got == {r.det_key for r in rows} - gone
