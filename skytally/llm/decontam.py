"""Benchmark decontamination over a positional inverted index, in DataFrame operations alone.

The postings (document, position, term) of all test terms in all documents are stored as a written table. Each benchmark item is cut into windows of
consecutive words; of each window the rarest terms by their corpus count (fewest postings) are looked up first. Their postings, less the term's
offset in the item, give alignments of the item in a document; only where all of a window's rarest terms meet at one alignment are the lists of the other terms
intersected. Runs of matching positions that are at least a window long are the exact phrase matches. near() has the proximity matches: windows whose terms lie close together in any order, also with some missing.

Defined results. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. An item with fewer words than a window is one window, an item without words none. Null texts have no words.
A null doc_id or item_id is a value of its own (in lists of items the text `null`). Items that share an id count as one. Repeated document rows each return a row.
An empty benchmark leaves all documents clean. Columns of other names are ignored by find(), and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import is_small, lookup, materialise, shared_folder

#: Word characters are digits, ASCII letters of either case (lower-cased after the cut) and all that is not ASCII. Java looks a class of listed characters up in a table, but tries ranges one by one.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stand after a document's last word, so that its length is in the index; the second marks a null doc_id.
END, END_NULL = "", " "


def words(text: Column) -> Column:
    """The words as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def key(docs: DataFrame) -> list[Column]:
    """Two columns that tell documents apart, whatever is null or repeated."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("did"), F.xxhash64(docs["text"], docs["doc_id"].isNull()).alias("h")]


def item_terms(items: DataFrame) -> DataFrame:
    """(item, name, ipos, n, word) of each item; item numbers the distinct (id, words)."""
    w = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("null")).alias("name"), F.transform(words(items["text"]), lowered).alias("w")).where(F.size("w") > 0).distinct()
    return w.select(F.xxhash64("name", "w").alias("item"), "name", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "word"))


def index(docs: DataFrame, vocabulary: DataFrame, folder: str) -> DataFrame:
    """The stored postings (did, h, pos, term) of the words in vocabulary (word, term); they lie in the order of the documents, which keeps them small."""
    end = F.when(docs["doc_id"].isNull(), F.lit(END_NULL)).otherwise(F.lit(END))
    tokens = docs.select(*key(docs), F.array_append(words(docs["text"]), end).alias("w")).select("did", "h", F.posexplode("w").alias("pos", "word"))
    tokens = tokens.withColumn("word", lowered(F.col("word")))
    return materialise(lookup(tokens, vocabulary, ["word"], 64, "inner").select("did", "h", "pos", "term"), folder, "postings")


def rarest(terms: DataFrame, window: int, rare: int) -> DataFrame:
    """The positions (item, ipos, term, n) that are among the rare rarest of some window all of whose terms occur."""
    by_item = W.partitionBy("item").orderBy("ipos")
    ahead = by_item.rowsBetween(0, window - 1)
    length = F.least(F.lit(window), F.col("n"))
    found = F.slice(F.array_sort(F.collect_list(F.struct("count", "ipos")).over(ahead)), 1, rare)
    windows = terms.withColumn("first", found).withColumn("least", F.min("count").over(ahead))
    windows = windows.where((F.col("ipos") <= F.col("n") - length) & (F.col("least") > 0))
    picked = windows.select("item", F.explode("first").alias("x")).select("item", F.col("x.ipos").alias("ipos")).distinct()
    return picked.join(terms.select("item", "ipos", "term", "n"), ["item", "ipos"])


def indexed(docs: DataFrame, items: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored postings of the items' terms in docs, and the terms (item, name, ipos, n, term, count: their postings)."""
    terms = materialise(item_terms(items), folder, "items")
    ends = docs.sparkSession.createDataFrame([(END, 0), (END_NULL, 1)], "word string, term long")
    vocabulary = materialise(terms.select("word").distinct().select("word", F.xxhash64("word").alias("term")).unionAll(ends), folder, "vocabulary")
    if vocabulary.agg((F.count_distinct("term") == F.count("*"))).first()[0] is False:
        raise ValueError("two test terms share a 64-bit number")
    postings = index(docs, vocabulary, folder)
    counts = postings.groupBy("term").agg(F.count("*").alias("count"))
    return postings, materialise(terms.withColumn("term", F.xxhash64("word")).drop("word").join(counts, "term", "left").na.fill(0, ["count"]), folder, "terms")


def near(docs: DataFrame, items: DataFrame, window: int = 10, span: int = 15, missing: int = 1) -> DataFrame:
    """Proximity matches: doc_id, did and h (see key()), name, pos of the stretches of span consecutive words that hold, in any order, all but missing of the different terms of some window of an item.

    pos is the place of a term that such a stretch holds and that is among the missing + 1 rarest of the window, one of which every such stretch must hold: only there the other terms' lists are looked at.
    A window of which fewer than two terms would be left has no proximity matches."""
    folder = shared_folder(docs.sparkSession)
    postings, terms = indexed(docs, items, folder)
    by_item = W.partitionBy("item").orderBy("ipos").rowsBetween(0, window - 1)
    held = F.array_sort(F.array_distinct(F.collect_list(F.struct("count", "term")).over(by_item)))
    windows = terms.withColumn("held", held).where((F.col("ipos") <= F.col("n") - F.least(F.lit(window), F.col("n"))) & (F.size("held") - missing >= 2))
    windows = materialise(windows.select("item", "name", F.transform("held", lambda x: x["term"]).alias("held")).distinct().withColumn("w", F.xxhash64("name", "held")), folder, "windows")
    rare = windows.select("w", F.explode(F.slice("held", 1, missing + 1)).alias("term"))
    anchors = postings.join(rare, "term").select("did", "h", "w", F.col("pos").alias("at"))
    wanted = windows.select("w", F.size("held").alias("kinds"), F.explode("held").alias("term"))
    # what lies within a span of an anchor: at most 2 * span - 1 postings
    cell = F.floor(F.col("at") / span).cast("int")
    close = anchors.join(wanted, "w").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    lists = postings.withColumn("cell", F.floor(F.col("pos") / span).cast("int")).join(close, ["did", "h", "cell", "term"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    found = lists.groupBy("did", "h", "w", "at").agg(F.first("kinds").alias("kinds"), F.collect_set(F.struct("pos", "term")).alias("l"))
    within = lambda s: F.size(F.array_distinct(F.transform(F.filter("l", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + span)), lambda x: x["term"])))
    found = found.where(F.exists("l", lambda s: (s["pos"] <= F.col("at")) & (F.col("at") < s["pos"] + span) & (within(s) >= F.col("kinds") - missing)))
    lengths = postings.where("term in (0, 1)").select("did", "h", F.when(F.col("term") == 0, F.col("did")).alias("doc_id")).distinct()
    return found.join(windows.select("w", "name"), "w").select("did", "h", "name", F.col("at").alias("pos")).distinct().join(lengths, ["did", "h"]).select("doc_id", "did", "h", "name", "pos")


def find(docs: DataFrame, items: DataFrame, window: int = 10, rare: int = 3) -> DataFrame:
    """A row a document: doc_id, did and h (see key()), n_words, n_hit (words inside any occurrence of a window), items (the sorted names of the items with occurring windows)."""
    folder = shared_folder(docs.sparkSession)
    postings, terms = indexed(docs, items, folder)
    seeds = materialise(rarest(terms, window, rare), folder, "seeds")

    at = ["did", "h", "item", "start"]  # start: where in the document the item's first word would be
    met = lookup(postings, seeds, ["term"], 48, "inner", F.struct("did", "h", "pos")).select("did", "h", "item", (F.col("pos") - F.col("ipos")).alias("start"), "ipos", "n")
    met = met.groupBy(*at).agg(F.count_distinct("ipos").alias("met"), F.first("n").alias("n")).where(F.col("met") >= F.least(F.lit(rare), F.col("n"))).select(*at)
    alignments = materialise(met, folder, "alignments")

    probes = alignments.join(F.broadcast(terms) if is_small(terms, 64) else terms, "item").select(*at, "n", "ipos", "term", (F.col("start") + F.col("ipos")).alias("pos"))
    if is_small(alignments, 64 * 40):
        lists = postings.join(F.broadcast(probes), ["did", "h", "pos", "term"])
    else:
        suspects = materialise(alignments.select("did", "h").distinct(), folder, "suspects")
        lists = postings.join(F.broadcast(suspects) if is_small(suspects, 32) else suspects, ["did", "h"], "left_semi").join(probes, ["did", "h", "pos", "term"])
    runs = lists.select(*at, "n", "ipos").distinct().withColumn("run", F.col("ipos") - F.row_number().over(W.partitionBy(*at).orderBy("ipos")))
    runs = runs.groupBy(*at, "n", "run").agg(F.min("ipos").alias("lo"), F.max("ipos").alias("hi")).where(F.col("hi") - F.col("lo") + 1 >= F.least(F.lit(window), F.col("n")))
    runs = materialise(runs.select("did", "h", "item", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")), folder, "runs")

    hits = runs.select("did", "h", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct().groupBy("did", "h").agg(F.count("*").alias("n_hit"))
    names = runs.select("did", "h", "item").distinct().join(terms.select("item", "name").distinct(), "item").groupBy("did", "h").agg(F.array_sort(F.collect_set("name")).alias("items"))
    found = materialise(hits.join(names, ["did", "h"]), folder, "found")
    lengths = postings.where("term in (0, 1)")
    out = lookup(lengths, found, ["did", "h"], F.lit(64) + 16 * F.size("items"), "left", F.col("pos"))
    return out.select(F.when(F.col("term") == 0, F.col("did")).alias("doc_id"), "did", "h", F.col("pos").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that hold a window of an item."""
    found = find(docs, items, window)
    dirty = materialise(found.where("n_hit > 0").select(F.col("did").alias("_did"), F.col("h").alias("_h")).distinct())
    did, h = key(docs)
    return docs.join(F.broadcast(dirty) if is_small(dirty, 32) else dirty, (did == dirty["_did"]) & (h == dirty["_h"]), "left_anti")
