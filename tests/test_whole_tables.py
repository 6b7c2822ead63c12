"""Queries over whole tables against brute force: no subset of the images is left out."""

import numpy as np

from skytally.operators import flight, overlap
from skytally.plans import registry, windows
from skytally.plans.fixtures import relation

SF = "/root/testdata/sf0.001"


def root(up, x):
    while up[x] != x:
        x = up[x]
    return x


def test_near_groups_cover_all_images(spark):
    rows = relation(spark, SF, "images").where("latitude IS NOT NULL").select("image_id", "latitude", "longitude").collect()
    ids, p = [r.image_id for r in rows], np.array([(r.latitude, r.longitude) for r in rows])
    up = {i: i for i in ids}
    for k, at in enumerate(p):
        for j in np.flatnonzero(((p[k + 1 :] - at) ** 2).sum(1) <= 0.0005 * 0.0005) + k + 1:
            a, b = sorted((root(up, ids[k]), root(up, ids[j])))
            up[b] = a
    got = {r.id: r.group_id for r in registry.QUERIES["c01_near_groups"](spark, SF).collect()}
    assert got == {i: root(up, i) for i in ids}


def test_duels_cover_all_images(spark):
    near = relation(spark, SF, "images").where("image_id < 800").selectExpr("*", "-24e0 + image_id % 20 * 0.0004e0 AS y", "31.5e0 + image_id % 19 * 0.0004e0 AS x").drop("latitude", "longitude")
    images, found = near.withColumnsRenamed({"y": "latitude", "x": "longitude"}), relation(spark, SF, "detections").selectExpr("*", "'one' AS kind").drop("class_name").withColumnRenamed("kind", "class_name")
    d = found.collect()
    size = {r.image_id: (r.width, r.height) for r in images.collect()}
    links = sorted((r.image_a, r.image_b) for r in overlap.edges(flight.footprints(images), 0.3).collect())
    of, gone = {}, set()
    for r in d:
        w, h = size.get(r.image_id, (0, 0))
        of.setdefault(r.image_id, []).append((r.det_key, r.class_name, np.sqrt(((r.x1 + r.x2) / 2 - w / 2) ** 2 + ((r.y1 + r.y2) / 2 - h / 2) ** 2)))
    for a, b in links:
        for k, name, far in sorted(of.get(a, [])):
            for j, other, there in sorted(of.get(b, [])):
                if name == other and k not in gone and j not in gone:
                    gone.add(j if far < there else k)
    got = {r.det_key for r in windows.w04_duel(images, found).collect()}
    assert any(k // 100 % 4 for k in gone) and got == {r.det_key for r in d} - gone
