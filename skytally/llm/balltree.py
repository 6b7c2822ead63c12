"""Exact top-k inner products by ball-tree branch and bound in shards.

The vectors are dealt by hash of their row into shards of bounded size and the queries into blocks. For each pair of a shard and a block a task builds the shard's ball tree
(centre and radius of each node) and visits the leaves of each query in the order of the nodes' upper bounds `<q, c> + |q| r`, until the bound of the next
is below the query's current kth result. The shards of a block are searched in waves of one, then WAVES times as many as before; after each wave the queries' kth results are shared with all tasks of the next,
which so begin with a bound. All queries against all vectors are inherently queries x shards rows of work; no task holds more than a shard and a block.

Defined results. Each component x becomes floor(scale * x), with x as double. Vectors that are null, or hold a null or non-finite component (also one that scaling makes infinite), and rows without an id take no part.
Vectors are compared with those of equal length only; an empty vector has the product 0 with others such. A query's candidates are all rows but its own: a row that repeats it, or another of its id, is a candidate, and rows that share an id and are
queries each have a ranking. Ties go to the smaller id. Products are exact; beyond the range of a long they stand at its end, and are ties there. Columns of other names are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import is_small, materialise, shared_folder

#: Rows of a shard and of a block at least; values of a shard at most, and shards up to which they are as small as that; growth of the waves.
SHARD_ROWS, BLOCK_ROWS, SHARD_VALUES, FEW_SHARDS, LEAF, WAVES = 4096, 2048, 4 << 20, 256, 64, 4
FOUND = "query long, query_id long, vec_id long, score long"
#: Whole numbers and their sums are exact as doubles below.
EXACT = 2.0**52
ABSENT = np.iinfo(np.int64).max


class BallTree:
    """Points (rows of whole numbers as float64), their ids and row numbers; nodes with centre, radius and parent; leaves of points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, numbers: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        points, ids, numbers = points[order], ids[order], numbers[order]
        self.centres, self.radii, self.parent, self.leaves = [], [], [], []
        rows = np.arange(len(ids))
        pieces, todo = [], [(rows, -1)]
        while todo:
            own, parent = todo.pop()
            p = points[own]
            centre = p.mean(0)
            away = np.sqrt(np.square(p - centre).sum(1))
            me = len(self.radii)
            self.centres.append(centre)
            self.radii.append(away.max())
            self.parent.append(parent)
            if len(own) <= leaf or not 0 < away.max() < np.inf:
                for k in range(0, len(own), 4 * leaf):  # equal points need no smaller ball
                    pieces.append(own[k : k + 4 * leaf])
                    self.leaves.append((me, len(pieces) - 1))
                continue
            a = p[away.argmax()]
            b = p[np.square(p - a).sum(1).argmax()]
            side = np.argsort(p @ (b - a), kind="stable")
            half = len(own) // 2
            todo += [(own[side[half:]], me), (own[side[:half]], me)]
        self.points, self.ids, self.numbers = ([x[p] for p in pieces] for x in (points, ids, numbers))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the inner products per leaf (columns), no greater than those of the nodes above; and the leaves' least ids."""
        length = np.sqrt(np.square(queries).sum(1))[:, None]
        node = queries @ self.centres.T + length * self.radii
        node += 1e-9 * length * (np.sqrt(np.square(self.centres).sum(1)) + self.radii) + 1e-6
        node[np.isnan(node)] = np.inf
        for k, up in enumerate(self.parent):
            if up >= 0:
                np.minimum(node[:, k], node[:, up], out=node[:, k])
        at = [k for k, _ in self.leaves]
        return node[:, at], np.array([self.ids[x].min() for _, x in self.leaves])


def products(queries: np.ndarray, points: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products as longs; if they may exceed the doubles' exact range, of whole numbers, and held within the longs' range."""
    if not whole:
        return (queries @ points.T).astype(np.int64)
    q, p = ([[int(v) for v in row] for row in x] for x in (queries, points))
    hold = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    return np.array([[hold(sum(a * b for a, b in zip(x, y, strict=True))) for y in p] for x in q], np.int64).reshape(len(q), len(p))


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray, whole: bool):
    """Scores and ids (rows: queries) of the k best points, absent ones with the id ABSENT; only those better than (floor_score, floor_id) matter, where floor_id isn't ABSENT. own: the queries' row numbers."""
    bounds, least = tree.bounds(queries)
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = -(2**63)
    best, which = np.full((len(queries), k), none, np.int64), np.full((len(queries), k), ABSENT)
    active = np.arange(len(queries))
    for nth in range(len(tree.leaves)):
        leaf = order[active, nth]
        bound = bounds[active, leaf]
        kth, kth_id = best[active, -1], which[active, -1]
        shared = (floor_id[active] != ABSENT) & ((floor_score[active] > kth) | (kth_id == ABSENT) | ((floor_score[active] == kth) & (floor_id[active] < kth_id)))
        kth, kth_id = np.where(shared, floor_score[active], kth), np.where(shared, floor_id[active], kth_id)
        # beyond the longs' range all products are ties, so a bound there rules nothing out
        wanted = (bound >= kth.astype(np.float64)) | (np.abs(bound) >= 2.0**62) | (kth_id == ABSENT)
        active, leaf, bound, kth, kth_id = (x[wanted] for x in (active, leaf, bound, kth, kth_id))  # the next bounds are no greater
        if not len(active):
            break
        # a leaf that can only tie, with greater ids, is passed over
        visit = ~((np.floor(bound) <= kth.astype(np.float64)) & (np.abs(bound) < EXACT) & (least[leaf] > kth_id))
        for x in np.unique(leaf[visit]):
            q = active[visit & (leaf == x)]
            at = tree.leaves[x][1]
            score = products(queries[q], tree.points[at], whole)
            name = np.broadcast_to(tree.ids[at], score.shape).copy()
            mine = own[q][:, None] == tree.numbers[at][None, :]
            score[mine], name[mine] = none, ABSENT
            score, name = np.hstack([best[q], score]), np.hstack([which[q], name])
            top = np.lexsort((name, -score.astype(np.float64)) if not whole else (name, ~score), axis=1)[:, :k]
            best[q], which[q] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
    return best, which


def task(k: int):
    def run(left, right):
        import pyarrow as pa

        schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()

        def numbers(t, name):
            return t.column(name).to_numpy().astype(np.int64)

        def matrix(t):
            return np.ascontiguousarray(t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))

        points, queries = matrix(left), matrix(right)
        top = lambda x: float(np.abs(x).max()) if x.size else 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            whole = not top(points) * top(queries) * max(1, points.shape[1]) < EXACT
            floor_id = right.column("kth_id").fill_null(ABSENT).to_numpy().astype(np.int64)
            floor_score = right.column("kth").fill_null(0).to_numpy().astype(np.int64)
            tree = BallTree(points, numbers(left, "vec_id"), numbers(left, "number"))
            best, which = search(tree, queries, numbers(right, "query"), k, floor_score, floor_id, whole)
        row, col = np.nonzero(which != ABSENT)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (numbers(right, "query")[row], numbers(right, "query_id")[row], which[row, col], best[row, col])], schema=schema)

    return run


def best_of(found: list[DataFrame], k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order))
    return every.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query (rows of vectors where is_query) with all other vectors."""
    folder = shared_folder(vectors.sparkSession)
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < float("inf")))
    rows = vectors.where(vectors["vec_id"].isNotNull() & vectors["embedding"].isNotNull()).where(usable)
    # ceil and floor of Spark return whole numbers that may overflow, so x - pmod(x, 1) stands for floor
    component = lambda x: scaled(x) - F.pmod(scaled(x), F.lit(1.0))
    rows = rows.select(F.monotonically_increasing_id().alias("number"), vectors["vec_id"].cast("long").alias("vec_id"), F.transform("embedding", component).alias("q"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = materialise(rows.withColumn("dim", F.size("q")), folder, "vectors")
    n, n_queries, wide = rows.agg(F.count("*"), F.count_if("is_query"), F.max("dim")).first()
    # larger shards and blocks where there are many, since each vector is sent once a block and each query once a shard
    most = max(shard_rows, SHARD_VALUES // max(1, wide or 1))
    shard_rows, block_rows = (min(most, max(least, math.ceil(many / FEW_SHARDS))) for least, many in ((shard_rows, n), (block_rows, n_queries)))
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    shard = F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "number"), F.lit(blocks)).cast("int")
    points = rows.select("number", "vec_id", "q", "dim", shard.alias("shard"))
    queries = rows.where("is_query").select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"), *[F.col(c).alias(c) for c in ("q", "dim")], block.alias("block"))  # columns of their own, for the cogroup
    on = ["dim", "shard", "block"]
    found: list[DataFrame] = []
    begin, end = 0, 1
    while begin < shards:  # the shards that stand so far behind a block's own in the ring of shards
        steps = F.sequence(F.lit(begin), F.lit(min(end, shards) - 1))
        if found:
            kth = best_of(found, k).where(F.col("rank") == k).select("query", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
            kth = materialise(kth, folder, f"kth{begin}")
            asked = queries.join(F.broadcast(kth) if is_small(kth, 24) else kth, "query", "left")
        else:
            asked = queries.select("*", F.lit(None).cast("long").alias("kth"), F.lit(None).cast("long").alias("kth_id"))
        asked = asked.withColumn("shard", F.explode(F.transform(steps, lambda s: (F.col("block") + s) % shards)))
        places = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (F.pmod(F.col("shard") - b, F.lit(shards)) >= begin) & (F.pmod(F.col("shard") - b, F.lit(shards)) < end))
        placed = points.withColumn("block", F.explode(places))
        wave = placed.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(task(k), FOUND)
        found = [materialise(best_of([*found, wave], k).drop("rank"), folder, f"best{begin}")]
        begin, end = end, end * WAVES
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
