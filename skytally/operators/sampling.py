"""Samples with fixed results: every random choice is an order by a hash that any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(*columns, seed: int = 42) -> Column:
    """A pseudo-random order: the MD5 of seed and values as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).cast("binary"))


def cascade(rows: DataFrame, tests: list[Column], by: str, most: int, order: list | None = None) -> DataFrame:
    """Of each group at most so many rows that pass all tests; if none does, the last test is dropped, and so on."""
    w = W.partitionBy(by)
    fits = F.lit(True)
    for n in range(1, len(tests) + 1):
        both = tests[0]
        for t in tests[1:n]:
            both = both & t
        fits = F.when(F.bool_or(both).over(w), both).otherwise(fits)
    rows = rows.withColumn("_fits", fits).where("_fits").drop("_fits")
    return rows.withColumn("nth", F.row_number().over(w.orderBy(*(order or [F.desc("confidence"), "det_key"])))).where(F.col("nth") <= most)


def target_count(counts: DataFrame, method: str = "mean", exclude_extremes: bool = True) -> DataFrame:
    """One row, target: the mean (half to even) or least class count; with three classes or more the first and last by size are left out."""
    order = W.orderBy("n", "class_name")  # one row a class
    n = counts.withColumn("_at", F.row_number().over(order)).withColumn("_all", F.count("*").over(W.partitionBy()))
    if exclude_extremes:
        n = n.where("_all < 3 OR (_at > 1 AND _at < _all)")
    value = F.bround(F.avg(F.col("n").cast("double"))).cast("long") if method == "mean" else F.min("n")
    return n.agg(value.alias("target"))


def undersample(rows: DataFrame, key: str, method: str = "mean", seed: int = 42) -> DataFrame:
    """At most target_count() rows of each class, chosen by hash of key. Only rows of classes above the target are ranked by class; salted ranks come first, so that no class is sorted in one task."""
    counts = rows.groupBy("class_name").agg(F.count("*").alias("n"))
    target = F.broadcast(target_count(counts, method))  # one row
    order = shuffle_key(key, seed=seed)
    salted = rows.withColumn("_key", order).withColumn("_part", F.substring("_key", 1, 2)).crossJoin(target)
    # a row beyond the target in its 256th part of the class is beyond it in the class too
    first = salted.withColumn("_nth", F.row_number().over(W.partitionBy("class_name", "_part").orderBy("_key", key))).where("_nth <= target")
    sizes = first.groupBy("class_name", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("class_name").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("class_name", "_part", before.alias("_before"))
    return first.join(offsets, ["class_name", "_part"]).where("_before + _nth <= target").select(*rows.columns)


def positives_and_negatives(images: DataFrame, ratio: float, seed: int = 41) -> DataFrame:
    """All images with labels (is_empty = false), and ratio times as many without, chosen by hash."""
    sizes = images.agg(F.count_if("is_empty").alias("_empty"), F.count_if(~F.col("is_empty")).alias("_full"))
    rows = images.crossJoin(F.broadcast(sizes))  # one row
    most = F.least((F.col("_full") * ratio).cast("long"), F.col("_empty"))
    empty = rows.where("is_empty").withColumn("_key", shuffle_key("image_id", seed=seed))
    part = W.partitionBy(F.substring("_key", 1, 2)).orderBy("_key", "image_id")
    ranked = empty.withColumn("_part", F.substring("_key", 1, 2)).withColumn("_nth", F.row_number().over(part))
    parts = empty.groupBy(F.substring("_key", 1, 2).alias("_part")).agg(F.count("*").alias("_n"))  # 256 rows
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    chosen = ranked.join(F.broadcast(offsets), "_part").where(F.col("_before") + F.col("_nth") <= most)
    return rows.where("NOT is_empty").select(*images.columns).unionByName(chosen.select(*images.columns))


def equal_bins(rows: DataFrame, by: str, order: str, key: str, bins: int, seed: int = 7) -> DataFrame:
    """One row of each of so many equally filled bins, by distance, of every group."""
    w = W.partitionBy(by)
    binned = rows.withColumn("bin", F.ntile(bins).over(w.orderBy(order, key)))
    return binned.withColumn("_nth", F.row_number().over(W.partitionBy(by, "bin").orderBy(shuffle_key(key, seed=seed)))).where("_nth = 1").drop("_nth")


def allocation(counts: DataFrame, total: int) -> DataFrame:
    """How many of a total each group gets: its share, floored, and one more."""
    return counts.withColumn("quota", (F.floor(F.col("n") / F.sum("n").over(W.partitionBy()) * total) + 1).cast("long"))


def negative_tiles(tiles: DataFrame, ratio: float, most_if_none: int, seed: int = 42) -> DataFrame:
    """Tiles with annotations, and per image ratio times as many without, or so many if it has none with."""
    w = W.partitionBy("image_id")
    limit = F.when(F.count_if("has_annotation").over(w) > 0, (F.count_if("has_annotation").over(w) * ratio).cast("long")).otherwise(F.lit(most_if_none))
    rows = tiles.withColumn("_limit", limit).withColumn("_nth", F.row_number().over(W.partitionBy("image_id", "has_annotation").orderBy(shuffle_key("image_id", "tile", seed=seed))))
    return rows.where("has_annotation OR _nth <= _limit").drop("_limit", "_nth")


def clusters(rows: DataFrame, features: str, ks: tuple[int, ...] = (3, 5, 7, 9), seed: int = 42) -> DataFrame:
    """rows with cluster and k: of k-means for each k, that with the best silhouette; features: a column of arrays of numbers. Rows with a null in them have no cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    usable = F.col(features).isNotNull() & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    data = rows.where(usable).withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    best = None
    for k in ks:
        found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data).transform(data)
        score = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(found) if found.select("cluster").distinct().count() > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, found.withColumn("k", F.lit(k)))
    return best[1].drop("_v")
