"""Links within buckets without all pairs, and connected groups of links. Used by the two near-duplicate operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, is_empty, is_small, lookup, lookup_hot, materialise, measured, shared_folder

#: Members up to which all pairs of a bucket are tested at once; leaders of a larger one, about, in the first round after that of one leader; GROWTH times as many in each that follows.
DIRECT, LEADERS, GROWTH = 4, 16, 16
#: Members up to which those that the least id has not connected are held against each other; a larger bucket waits for tokens, or is led. Ids up to which those of a token are.
CROWD = 32
#: Members of a crowded bucket that are compared by their marks in one task, or with as many others.
BLOCK = 8192
#: A text is cut before every STEP characters where the next ANCHOR characters are found in the other text, at most SLACK from where the cut before lets expect them.
STEP, SLACK, ANCHOR = 32, 24, 8
#: Of a struct s of texts x and y: the characters both begin with, up to a 64th of the shorter one; and s without these, reversed.
ALIKE = "aggregate(array(2, 4, 8, 16, 32, 64), 0, (p, k) -> p + if(substring(s.x, p + 1, cast(least(length(s.x), length(s.y)) div k as int)) = substring(s.y, p + 1, cast(least(length(s.x), length(s.y)) div k as int)), cast(least(length(s.x), length(s.y)) div k as int), 0))"
REST = f"s -> element_at(transform(array({ALIKE}), p -> named_struct('x', reverse(substring(s.x, p + 1)), 'y', reverse(substring(s.y, p + 1)))), 1)"
AT = f"(k * {STEP} + 1)"
PLACE = f"locate(substring(s.x, {AT}, {ANCHOR}), substring(s.y, w, t.q + {AT} - t.p + {SLACK + ANCHOR} - w))"
CUT = f"named_struct('p', {AT}, 'q', coalesce(w + j - 1, 0), 'd', coalesce(t.d + levenshtein(substring(s.x, t.p, {AT} - t.p), substring(s.y, t.q, w + j - 1 - t.q)), 0))"
#: Whether the pieces between the cuts of s.x and s.y have at most s.most edits together, p and q being the last cuts. The texts then have no more; where there is no cut, or more edits, nothing is known.
PIECES = f"""aggregate(sequence(0, cast(length(s.x) div {STEP} as int)), named_struct('p', 1, 'q', 1, 'd', 0), (t, k) -> if(t.d > s.most, t, element_at(transform(
    array(greatest(t.q, t.q + {AT} - t.p - {SLACK})), w -> element_at(transform(array({PLACE}), j -> if(j > 0, {CUT}, t)), 1)), 1)),
    t -> if(t.p > 1 and t.d <= s.most, levenshtein(substring(s.x, t.p), substring(s.y, t.q), s.most - t.d) >= 0, false))"""
#: Links up to which their connected groups are found on the driver (16 bytes each); more are connected by Spark.
LOCAL_EDGES = 300_000

Verify = Callable[[DataFrame], DataFrame]
Verifier = Callable[[str, DataFrame], Verify]
#: (id, tokens array<long>, marks binary) of the ids in members: any two ids that verify would pass have a token in common; marks: a bit for the hash of each of an id's size elements.
Tokens = Callable[[str, DataFrame], DataFrame]


def lengths_fit(a: str, b: str, similarity: float) -> Column:
    """Whether texts of the lengths a and b can be edit similar."""
    return F.abs(F.col(a) - F.col(b)) <= F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9)


def link(items: DataFrame, keys: Sequence[Column], verifier: Verifier, folder: str, similarity: float = 0.8, tokens: Tokens | None = None) -> DataFrame | None:
    """(id, root), the least id of its group, of all ids that have a link; None if there are no links.

    Linked are ids that share a bucket and pass verify. items: (id long, size int, ...), a written table; keys: columns of arrays of buckets, taken one after another, so that what an earlier one
    has connected costs a later one nothing. verifier(folder, members) gives the test of pairs, (a, b) to (a, b), of the ids in members.

    In buckets of at most DIRECT members every two are held against each other. In a larger one whose members are not all connected yet, all are held against the least id, so large groups of copies are
    connected by as many pairs as there are members. Where that leaves several groups, every two members of different groups are held against each other in buckets of at most CROWD members. The members of larger ones
    wait until all keys have been taken: held against each other are then ids that share one of such buckets and a token, since ids without a common token cannot pass (crowded()). Without tokens,
    every member is a leader in its turn, LEADERS and more at a time in the order of a hash, and is held against all later members that are not connected with it. So each pair that shares a bucket is tested, connected
    already, or ruled out by its sizes, tokens or marks. Without tokens a bucket of n unlike members costs up to n * n / 2 tests, with tokens as many comparisons of marks of those that have a token of more than CROWD ids."""
    spark = items.sparkSession
    rooted, at, waiting = items.withColumn("root", F.col("id")), "", []

    def step(rooted: DataFrame, at: str, maps: list[DataFrame], name: str) -> tuple[DataFrame, str]:
        if not maps:
            return rooted, at
        rooted = materialise(moved(rooted, composed(maps, f"{folder}/{name}")), folder, f"rooted-{name}")
        if at:
            drop_table(spark, at)
        return rooted, f"{folder}/rooted-{name}"

    for nth, key in enumerate(keys):
        own = f"{folder}/key{nth}"
        rows = rooted.select(F.explode(key).alias("bucket"), "id", "size", "root")
        maps, crowd = link_once(rows, verifier, own, similarity, tokens is not None)
        if crowd is not None:
            waiting.append(materialise(crowd, folder, f"crowd{nth}"))
        rooted, at = step(rooted, at, maps, f"key{nth}")
        drop_table(spark, own)
    if waiting:
        own = f"{folder}/crowds"
        rooted, at = step(rooted, at, crowded(rooted.withColumn("all", F.concat(*keys)), reduce(DataFrame.unionAll, waiting), verifier, own, similarity, tokens), "crowds")
        drop_table(spark, own)
    if not at:
        return None
    roots = rooted.where("root <> id").select("id", "root")
    return materialise(roots.unionAll(roots.select(F.col("root").alias("id"), "root").distinct()), folder, "roots")


def composed(maps: list[DataFrame], folder: str) -> DataFrame:
    """One table (root, now) for several, each of what the one before has left."""
    if len(maps) == 1:
        return maps[0]
    edges = materialise(reduce(DataFrame.unionAll, maps).where("root <> now").toDF("a", "b"), folder, "edges")
    joined = components(edges, folder)
    now = joined.toDF("root", "now")
    now._measured = measured(joined)
    return now


def moved(rows: DataFrame, now: DataFrame) -> DataFrame:
    """rows with the roots that the written table now (root, now) gives theirs."""
    return lookup(rows, now, ["root"], 24, "left", F.col("id")).withColumn("root", F.coalesce("now", "root")).drop("now")


def link_once(rows: DataFrame, verifier: Verifier, folder: str, similarity: float, wait: bool = False) -> tuple[list[DataFrame], DataFrame | None]:
    """What the verified pairs of rows (bucket, id, size, root) make of the roots: tables (root, now), each of what the one before has left. wait: members (bucket, id, n) of buckets
    of more than CROWD are returned, held against their least id only."""
    fits = lengths_fit("size", "size_a", similarity) & (F.col("root") != F.col("root_a"))
    pair = [F.least("id", "id_a").alias("a"), F.greatest("id", "id_a").alias("b"), F.least("root", "root_a").alias("v"), F.greatest("root", "root_a").alias("u")]
    as_head = lambda *names: ["bucket", *[F.col(c).alias(f"{c}_a") for c in names]]
    # pre-aggregated before the shuffle; buckets of one group end here
    first = rows.groupBy("bucket").agg(F.min("id").alias("a"), F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y")
    first = materialise(first.select("bucket", "a", "n", F.col("n").alias("m")), folder, "first", crowded=F.count_if(F.col("n") > DIRECT))
    if is_empty(first):
        return [], None
    members = materialise(lookup_hot(rows, first, ["bucket"], 32, "m"), folder, "members")
    verify = verifier(folder, members)
    few = members.where(F.col("n") <= DIRECT)
    pairs = few.join(few.select(*as_head("id", "size", "root")), "bucket").where((F.col("id") > F.col("id_a")) & fits).select(*pair)
    if measured(first).get("crowded") != 0:
        crowd = members.where(F.col("n") > DIRECT)
        heads = materialise(crowd.where("id = a").select(*as_head("id", "size", "root"), F.col("n").alias("m")).dropDuplicates(["bucket"]), folder, "heads0")
        members = crowd.where("id <> a").drop("a")
        pairs = pairs.unionAll(lookup_hot(members, heads, ["bucket"], 40, "m").where(fits).select(*pair))
    else:
        members = None
    pairs = materialise(pairs.distinct(), folder, "pairs0")
    maps = [x for x in [regrouped(pairs, verify, folder, 0)] if x is not None]
    if members is None:
        return maps, None
    crowd = members.where(F.col("n") > CROWD).select("bucket", "id", "n") if wait else None
    if wait:
        members = members.where(F.col("n") <= CROWD)
    if maps:
        members = moved(members, maps[0])
    # in its bucket, every member but the least id, which all have met
    members = materialise(members, folder, "members1")
    members = still_several(members, ["n"], folder, 1)
    if is_empty(members):
        return maps, crowd
    few = members.where(F.col("n") <= CROWD)
    pairs = few.join(few.select(*as_head("id", "size", "root")), "bucket").where((F.col("id") > F.col("id_a")) & fits).select(*pair)
    now = regrouped(materialise(pairs.distinct(), folder, "pairs1"), verify, folder, 1)
    if now is not None:
        maps.append(now)
    if wait:
        return maps, crowd
    members = members.where(F.col("n") > CROWD)
    if now is not None:
        members = moved(members, now)
    # members lead in the order of a hash, place: about as many stand before it as its value tells
    members = members.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")).drop("n")
    nth, most = 2, LEADERS
    while True:
        members = still_several(materialise(members, folder, f"members{nth}"), [], folder, nth)
        if is_empty(members):
            return maps, None
        heads = materialise(members.where(F.col("place") < most).select(*as_head("id", "size", "root", "place")), folder, f"heads{nth}")
        pairs = members.join(F.broadcast(heads) if is_small(heads, 48) else heads, "bucket").where((F.struct("place", "id") > F.struct("place_a", "id_a")) & fits)
        pairs = materialise(pairs.select(*pair).distinct(), folder, f"pairs{nth}")
        now = regrouped(pairs, verify, folder, nth)
        members = members.where(F.col("place") >= most)
        if now is not None:
            maps.append(now)
            members = moved(members, now)
        nth, most = nth + 1, most * GROWTH


def crowded(items: DataFrame, members: DataFrame, verifier: Verifier, folder: str, similarity: float, tokens: Tokens) -> list[DataFrame]:
    """What link_once() returns, for members (bucket, id, n) of crowded buckets; items: (id, size, root, all), with all buckets of an id.

    Ids that share a token of at most CROWD ids are held against each other if they share a bucket. Those that have another token, and their groups, are compared in their buckets by their marks (alike()); few unlike texts
    have such a token, and members of one group aren't compared."""
    fits = lengths_fit("size", "size_a", similarity) & (F.col("root") != F.col("root_a"))
    pair = [F.least("id", "id_a").alias("a"), F.greatest("id", "id_a").alias("b"), F.least("root", "root_a").alias("v"), F.greatest("root", "root_a").alias("u")]
    ids = materialise(members.select("id").distinct(), folder, "ids")
    items = materialise(items.join(F.broadcast(ids) if is_small(ids, 16) else ids, "id", "left_semi"), folder, "items")
    marked = tokens(folder, items)
    dealt = materialise(marked.join(items.select("id", "size", "root"), "id").select(F.explode("tokens").alias("token"), "id", "size", "root"), folder, "dealt")
    # a token's ids of one group are one row
    by_root = materialise(dealt.groupBy("token", "root").agg(F.count("*").alias("ids")), folder, "by_root")
    shared = by_root.groupBy("token").agg(F.count("*").alias("m"), F.sum("ids").alias("n")).where("m > 1").select("token", "n", "m")
    shared = materialise(shared, folder, "shared")
    if is_empty(shared):
        return []
    scarce = materialise(shared.where(F.col("n") <= CROWD).drop("m"), folder, "scarce")
    held = materialise(lookup_hot(dealt, scarce, ["token"], 16, "n"), folder, "held")
    verify, maps = verifier(folder, items), []

    def in_one_bucket(pairs: DataFrame) -> DataFrame:
        found, all_ = materialise(verify(pairs), folder, "similar"), items.select("id", "all")
        found = found.join(all_.toDF("a", "one"), "a").join(all_.toDF("b", "two"), "b")
        return found.where(F.arrays_overlap("one", "two")).select(*pairs.columns)

    pairs = held.join(held.select("token", *[F.col(c).alias(f"{c}_a") for c in ("id", "size", "root")]), "token").where((F.col("id") > F.col("id_a")) & fits).select(*pair)
    now = regrouped(materialise(pairs.distinct(), folder, "pairs0"), in_one_bucket, folder, 0)
    if now is not None:
        maps.append(now)
        items = materialise(moved(items, now), folder, "items1")
    common = materialise(shared.where(F.col("n") > CROWD).drop("n"), folder, "common")
    hot = materialise(lookup_hot(by_root, common, ["token"], 16, "m").select("root").distinct(), folder, "hot")
    if is_empty(hot):
        return maps
    if now is not None:
        hot = materialise(moved(hot.withColumn("id", F.col("root")), now).select("root").distinct(), folder, "hot1")
    items = items.join(F.broadcast(hot) if is_small(hot, 16) else hot, "root", "left_semi").join(marked.select("id", "marks"), "id")
    items = materialise(items, folder, "items2")
    rows = materialise(members.drop("n").join(items.select("id", "root"), "id"), folder, "members")
    several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y").select("bucket", "n", F.col("n").alias("m"))
    several = materialise(several, folder, "several")
    if is_empty(several):
        return maps
    rows = lookup_hot(rows.drop("root"), several, ["bucket"], 32, "m").join(items, "id")
    pairs = materialise(alike(rows, similarity).distinct(), folder, "pairs1")
    now = regrouped(pairs, verify, folder, 1)
    return maps if now is None else [*maps, now]


def alike(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, v, u) of different roots within each bucket that their sizes and marks do not rule out; rows: (bucket, n, id, size, root, all, marks).

    marks has a bit for the hash of each of size elements. Two ids have no more elements in common than bits, and besides what more elements than bits the one with fewer such has. A bucket of more than BLOCK ids is cut, and any two parts are
    a group. A pair that shares an earlier bucket is left to that one."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("bucket", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "id", "size", "root", "all", "marks")

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("id"), column("size")))
        bucket, part, n, root, ident = column("bucket")[0], column("part")[order], column("size")[order].astype(np.int64), column("root")[order], column("id")[order]
        marks = np.stack([np.frombuffer(x, np.uint64) for x in table.column("marks").to_pylist()])[order]
        lists = table.column("all").to_pylist()
        width = max(map(len, lists))
        every = np.array([x + [0] * (width - len(x)) for x in lists], np.int64)[order]
        spare, most = n - np.bitwise_count(marks).sum(axis=1, dtype=np.int64), np.floor(n * (1 - similarity) + 1e-9).astype(np.int64)
        cross, place = column("i")[0] != column("j")[0], np.arange(len(n))
        names, counts = np.unique(root, return_counts=True)
        largest = root == names[counts.argmax()]
        one, two = [], []
        for x in np.flatnonzero(~largest):
            a, b = np.searchsorted(n, n[x] - most[x]), np.searchsorted(n - most, n[x], "right")
            y = place[a : max(b, x)]
            y = y[(root[y] != root[x]) & (largest[y] | (y > x)) & (np.abs(n[y] - n[x]) <= np.maximum(most[y], most[x]))]
            if cross:
                y = y[part[y] != part[x]]
            common = np.bitwise_count(marks[y] & marks[x]).sum(axis=1, dtype=np.int64) + np.minimum(spare[y], spare[x])
            y = y[np.maximum(n[y], n[x]) - common <= np.maximum(most[y], most[x])]
            # the first bucket that both have is this one
            same = every[y] == every[x]
            y = y[every[x][same.argmax(axis=1)] == bucket] if len(y) else y
            one.append(np.full(len(y), x)), two.append(y)
        one, two = (np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64) for z in (one, two))
        ends = [f(z[one], z[two]) for z in (ident, root) for f in (np.minimum, np.maximum)]
        return pa.table(dict(zip("abvu", map(pa.array, ends), strict=True)))

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, v long, u long")


def still_several(members: DataFrame, keep: list[str], folder: str, nth: int) -> DataFrame:
    """The rows of the written table members whose bucket still has several roots, a written table; keep: columns that the counting brings along anew (n: the rows left of a bucket)."""
    several = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y").select("bucket", "n", F.col("n").alias("m"))
    several = materialise(several, folder, f"several{nth}")
    if is_empty(several):
        return several
    wanted = several if keep else several.drop("n")
    wanted._measured = measured(several)
    return materialise(lookup_hot(members.drop(*keep), wanted, ["bucket"], 32, "m"), folder, f"left{nth}")


def regrouped(pairs: DataFrame, verify: Verify, folder: str, nth: int) -> DataFrame | None:
    """(root, now): the root that those of pairs (a, b, v and u: their roots) that pass make of theirs; None if none does."""
    if is_empty(pairs):
        return None
    good = materialise(verify(pairs).select(F.col("v").alias("a"), F.col("u").alias("b")).distinct(), folder, f"good{nth}")
    if is_empty(good):
        return None
    joined = components(good, folder)
    now = joined.toDF("root", "now")
    now._measured = measured(joined)
    return now


def edit_similar(texts: DataFrame, similarity: float, unique: bool = False, kinds: bool = False) -> Verifier:
    """For link(): keeps the pairs (a, b) whose texts (id, x; several rows of an id are equal, unless unique) are edit similar: distance <= (1 - similarity) * longer length, counted in characters of x.

    What both texts begin and end with is left out. The rest is cut where both texts agree, and the pieces are aligned: they cost a small part of the whole, and no alignment has more edits than the least one. Only where the pieces' edits are too many, the rest is aligned whole. kinds: before any alignment, the different characters that only one of the texts has are counted, since there can
    be no more of them than edits; this pays where characters are words. A leader may have any number of pairs: adaptive execution splits such a key, since both sides of the joins are shuffled as they are."""

    def verifier(folder: str, members: DataFrame) -> Verify:
        wanted = texts.select("id", "x")
        if not unique:
            ids = materialise(members.select("id").distinct(), folder, "ids")
            wanted = wanted.join(F.broadcast(ids) if is_small(ids, 16) else ids, "id", "left_semi").groupBy("id").agg(F.first("x").alias("x"))
            wanted = materialise(wanted, folder, "wanted")

        def verify(pairs: DataFrame) -> DataFrame:
            one, two = wanted.toDF("b", "x"), wanted.toDF("a", "xa")
            if "rows" in measured(pairs) and is_small(pairs, 16):  # only texts of these pairs are shuffled
                one, two = one.join(F.broadcast(pairs.select("b")), "b", "left_semi"), two.join(F.broadcast(pairs.select("a")), "a", "left_semi")
            rows = pairs.join(one, "b").join(two, "a")
            most = F.floor(F.greatest(F.length("x"), F.length("xa")) * (1 - similarity) + 1e-9).cast("int")
            rows = rows.withColumn("most", most).where(F.abs(F.length("x") - F.length("xa")) <= F.col("most"))
            if kinds:
                one, two = F.split("x", ""), F.split("xa", "")
                rows = rows.where((F.size(F.array_except(one, two)) <= F.col("most")) & (F.size(F.array_except(two, one)) <= F.col("most")))
            # what both begin and end with costs no edit; the name of a lambda stands for a value that is computed once
            rest = f"transform(transform(array(named_struct('x', x, 'y', xa)), {REST}), {REST})"
            close = F.expr(f"exists(transform({rest}, s -> named_struct('x', s.x, 'y', s.y, 'most', most)), s -> greatest(length(s.x), length(s.y)) <= s.most or {PIECES} or levenshtein(s.x, s.y, s.most) >= 0)")
            return rows.where(close).select(*pairs.columns)

        return verify

    return verifier


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, root): the least id of the connected group of every id in edges (a, b), a written table. Few measured edges are
    connected on the driver, others by alternating large-star and small-star steps."""
    folder = f"{folder or shared_folder(edges.sparkSession)}/components-{uuid.uuid4().hex}"
    if measured(edges).get("rows", LOCAL_EDGES + 1) <= LOCAL_EDGES:
        return materialise(connected(edges), folder, "roots")
    nth = 0

    def written(links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        table = materialise(links.where("u <> v").distinct(), folder, f"{name}{nth}", total=total)
        state = measured(table) or table.agg(F.count("*").alias("rows"), total.alias("total")).first().asDict()
        return table, (state["rows"], str(state["total"]))

    now, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), folder, f"large{nth}", linked=F.count_if(F.col("m") < F.col("u")))
        linked = measured(least).get("linked") if measured(least) else least.where("m < u").count()
        large = lookup_hot(both.where("v > u"), least, ["u"], 24, "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, after = written(large, "star")
        if after == before and linked == before[0]:  # every id is linked to the least of its group, and to nothing else
            break
        # every u is now linked to smaller ones only
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), folder, f"small{nth}")
        small = lookup_hot(large, least, ["u"], 24, "n")
        now, before = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))), "now")
        nth += 1
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return materialise(roots.unionAll(roots.select(F.col("root").alias("id"), "root").distinct()), folder, "roots")


def connected(edges: DataFrame) -> DataFrame:
    """components() of few edges, on the driver: of the roots of every edge the larger one is hung below the smaller one, until no edge has two."""
    import pyarrow as pa

    found = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
    a, b = found.column(0).to_numpy(), found.column(1).to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (root[one] != root[two]).any():
        x, y = root[one], root[two]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return edges.sparkSession.createDataFrame(pa.table({"id": ids, "root": ids[root]})).coalesce(1)
