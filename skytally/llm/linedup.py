"""Fuzzy line deduplication, in DataFrame operations alone.

Lines are normalised (lower case, runs of ASCII characters other than letters and digits become one space). Each gets a 128-bit SimHash of its features: its words of at least FEATURE characters, or, if it has
fewer than MIN_WORDS of these (short lines, scripts without spaces), its runs of three characters. The SimHash is cut into 8 blocks of 16 bits, and every two of the blocks are a key of 32 bits: hashes that differ in at most 6 bits leave
two blocks equal (pigeonhole), and so do many that differ in more. Lines that share a key are linked if the edit similarity of their normalised characters is at least SIMILARITY (a banded alignment).
So exactly those lines are linked that are edit similar and whose SimHashes agree in two blocks. Equal lines are one from the start.
Of each connected group of lines the first occurrence, by (doc_id, line number), stays and all others go.

SimHash without a row a bit or a feature: 8-bit counters of eight bits of a hash lie in one long, so that 16 sums a line hold the 128 counters. The features of NIBBLE at a time are first summed in 4-bit counters, half as many sums.
A counter may not exceed 127, so a line is summed in runs of RUN features at most; the counters of several runs are added up in 32 bits.

Defined results. Lines end with a line feed. Empty lines and lines without letters, digits and other characters than ASCII stay and are never linked. Null texts stay null. Texts and lines of any length are treated whole.
A text all of whose lines go becomes empty. A null doc_id orders last; rows equal in doc_id and text are the same document and keep the same lines. An empty table gives no rows. All columns pass through, text excepted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, is_small, lookup_hot, materialise, shared_folder
from .linking import edit_similar, link

#: FEATURE: characters of a word that counts for the SimHash; shorter ones are common to most lines.
MIN_WORDS, SIMILARITY, FEATURE, BLOCKS, RUN, NIBBLE = 5, 0.8, 4, 8, 127, 7
#: Listed one by one: Java looks such a class up in a table.
NO_SPACE = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() and chr(c) not in "\n ")
#: Runs of these characters and spaces, but for single spaces, which stay as they are.
OTHER = rf"[{NO_SPACE}][{NO_SPACE}\x20]*+|\x20[{NO_SPACE}\x20]++"
NULL_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    """The normalised lines of a text as an array."""
    flat = F.regexp_replace(F.lower(text), OTHER, " ")
    return F.split(flat, "\n", -1)


def key(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(docs["text"], docs["doc_id"].isNull()).alias("h")]


def line_id(line: Column) -> Column:
    return F.xxhash64(F.lit("line"), line)


def occurrences(docs: DataFrame) -> DataFrame:
    """did, h, nth, line (normalised, not empty) of every line."""
    # no array is empty; of explode() Spark infers a filter that computes the array a second time
    lines = docs.where(docs["text"].isNotNull()).select(*key(docs), F.posexplode_outer(normalised(docs["text"])).alias("nth", "raw"))
    return lines.select("did", "h", "nth", F.trim("raw").alias("line")).where("line <> ''")


LONG_WORDS = f"filter(split(line, ' '), w -> length(w) >= {FEATURE})"
GRAMS = "transform(sequence(1, greatest(length(line) - 2, 1)), i -> substring(line, i, 3))"
#: The name of a lambda stands for a value that is used twice and computed once.
FEATURES = f"element_at(transform(array({LONG_WORDS}), w -> if(size(w) >= {MIN_WORDS}, w, {GRAMS})), 1)"


#: The features in groups of at most NIBBLE.
GROUPS = f"element_at(transform(array({FEATURES}), f -> transform(sequence(0, cast((size(f) - 1) div {NIBBLE} as int)), k -> slice(f, k * {NIBBLE} + 1, {NIBBLE}))), 1)"


def joined_bits(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def simhashes(lines: DataFrame) -> DataFrame:
    """(id, size, s0, s1) of each row of lines (row, id, size, line); s0 and s1 are the halves of its SimHash."""
    # lines that may have more than RUN features: of so many words, or those without enough long words
    enough = F.col("line").rlike(rf"^(?:(?:[^ ]{{1,{FEATURE - 1}}} )*+[^ ]{{{FEATURE},}}+(?: |\z)){{{MIN_WORDS}}}")
    longer = (F.col("size") >= (RUN + 1) * (FEATURE + 1) - 1) | ((F.col("size") > RUN + 2) & ~enough)

    def counted(some: DataFrame, groups: Column, *run: Column) -> DataFrame:
        f = some.select("row", "id", "size", groups)
        there = lambda k: F.size("words") > k
        zero = F.lit(0).cast("long")
        words = f.select("row", "id", "size", *run, "words", *[F.when(there(k), F.xxhash64(F.get("words", F.lit(k)))).otherwise(zero).alias(f"h0_{k}") for k in range(NIBBLE)])
        words = words.select("*", *[F.when(there(k), F.xxhash64(F.lit(1), f"h0_{k}")).otherwise(zero).alias(f"h1_{k}") for k in range(NIBBLE)])
        four = lambda i, b: reduce(lambda x, y: x + y, [F.shiftrightunsigned(f"h{i}_{k}", b).bitwiseAND(F.lit(0x1111111111111111)) for k in range(NIBBLE)])
        words = words.select("row", "id", "size", *[x for x in ["run"] if run], F.size("words").alias("m"), *[four(i, b).alias(f"q{i}_{b}") for i in (0, 1) for b in range(4)])
        sums = [F.sum(F.shiftrightunsigned(f"q{i}_{b % 4}", b // 4 * 4).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))).alias(f"s{i}_{b}") for i in (0, 1) for b in range(8)]
        return words.groupBy("row", "id", "size", *["run"] * len(run)).agg(F.sum("m").alias("n"), *sums)

    # a counter is above half of n if adding 127 - n div 2 to it sets its highest bit
    lift = F.expr("(127L - n div 2) * 16843009L")

    def of_one_run(i: int) -> Column:
        halves = []
        for half in (0, 1):
            parts = [F.shiftrightunsigned(F.col(f"s{i}_{b}"), 32 * half).bitwiseAND(F.lit(0x7F7F7F7F)) for b in range(8)]
            halves.append(joined_bits([F.shiftrightunsigned((p + lift).bitwiseAND(F.lit(0x80808080)), 7 - b) for b, p in enumerate(parts)]))
        return halves[0].bitwiseOR(F.shiftleft(halves[1], 32)).alias(f"s{i}")

    few = counted(lines.where(~longer), F.explode_outer(F.expr(GROUPS)).alias("words")).select("id", "size", of_one_run(0), of_one_run(1))
    # of more runs: two 32-bit counters in a long
    wide = [F.sum(F.shiftrightunsigned(f"s{i}_{b}", 8 * j).bitwiseAND(F.lit(0x000000FF000000FF))).alias(f"t{i}_{b}_{j}") for i in (0, 1) for b in range(8) for j in range(4)]
    many = counted(lines.where(longer), F.posexplode_outer(F.expr(GROUPS)).alias("at", "words"), F.expr(f"at div {RUN // NIBBLE}").alias("run")).groupBy("row", "id", "size").agg(F.expr("sum(n) div 2").alias("half"), *wide)

    def of_more_runs(i: int) -> Column:
        bit = lambda c, at: F.when(c > F.col("half"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
        t = lambda b, j: F.col(f"t{i}_{b}_{j}")
        low = [bit(t(b, j).bitwiseAND(F.lit(0xFFFFFFFF)), b + 8 * j) for b in range(8) for j in range(4)]
        high = [bit(F.shiftrightunsigned(t(b, j), 32), b + 8 * j + 32) for b in range(8) for j in range(4)]
        return joined_bits(low + high).alias(f"s{i}")

    return few.unionAll(many.select("id", "size", of_more_runs(0), of_more_runs(1)))


def block(n: int) -> Column:
    """Block n of the SimHash, an array of two longs."""
    return F.shiftrightunsigned(F.element_at("sim", n * 16 // 64 + 1), n * 16 % 64).bitwiseAND(F.lit(0xFFFF))


def block_keys(apart: int) -> Column:
    """The keys of the blocks that lie so far apart in the ring of blocks."""
    pairs = sorted({tuple(sorted((n, (n + apart) % BLOCKS))) for n in range(BLOCKS)})
    return F.array(*[F.lit((a * BLOCKS + b) << 32).bitwiseOR(F.shiftleft(block(a), 16)).bitwiseOR(block(b)) for a, b in pairs])


def removed(docs: DataFrame) -> DataFrame:
    """did, h and gone, the numbers of the lines that go, of the documents that lose lines."""
    folder = shared_folder(docs.sparkSession)
    lines = occurrences(docs).select(F.monotonically_increasing_id().alias("row"), "did", "h", "nth", line_id(F.col("line")).alias("id"), F.length("line").alias("size"), "line")
    lines = materialise(lines, folder, "lines", compression="lz4_raw")
    once = simhashes(lines).groupBy("id").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("size", "s0", "s1")])
    once = materialise(once.select("id", "n", "size", F.array("s0", "s1").alias("sim")), folder, "once")
    drop_shuffles(docs.sparkSession)
    texts = lines.select("id", F.col("line").alias("x"))
    roots = link(once.select("id", "size", "sim"), [block_keys(k) for k in range(1, BLOCKS // 2 + 1)], edit_similar(texts, SIMILARITY), folder, SIMILARITY)
    # of every group with several occurrences, where the first one is
    if roots is None:
        grouped = once.where("n > 1").select("id", "n", F.col("id").alias("root"))
    else:
        grouped = once.select("id", "n").join(F.broadcast(roots) if is_small(roots, 16) else roots, "id", "left")
        grouped = grouped.where("n > 1 or root is not null").select("id", "n", F.coalesce("root", "id").alias("root"))
    grouped = materialise(grouped, folder, "grouped")
    found = materialise(lookup_hot(lines.select("did", "h", "nth", "id"), grouped, ["id"], 24, "n").select("root", "did", "nth", "h"), folder, "found")
    kept = materialise(found.groupBy("root").agg(F.min(F.struct("did", "nth", "h")).alias("keep"), F.count("*").alias("n")), folder, "kept")
    gone = lookup_hot(found, kept, ["root"], 48, "n").where(F.struct("did", "nth", "h") != F.col("keep"))
    return materialise(gone.groupBy("did", "h").agg(F.collect_set("nth").alias("gone")), folder, "gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with only the lines that stay."""
    gone = removed(docs).select(F.col("did").alias("_did"), F.col("h").alias("_h"), F.col("gone").alias("_gone"))
    did, h = key(docs)
    small = is_small(gone, F.lit(48) + 4 * F.size("_gone"))
    rows = docs.join(F.broadcast(gone) if small else gone, (did == gone["_did"]) & (h == gone["_h"]), "left")
    # the lines are a column of their own, split once and not for each line that stays
    rows = rows.select(*[docs[c] for c in docs.columns], gone["_gone"].alias("_gone_lines"), F.when(gone["_gone"].isNotNull(), F.split(docs["text"], "\n", -1)).alias("_all_lines"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_all_lines") - 1), F.col("_gone_lines")), lambda i: F.get(F.col("_all_lines"), i))
    text = F.when(F.col("_gone_lines").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])
