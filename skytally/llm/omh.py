"""Near-duplicate documents by Order MinHash.

A document's k-mers of K words are labelled with their number of occurrence. For each of SKETCHES hash functions the LENGTH labelled k-mers of least hash are taken and put in
their order in the text; documents that agree in such a sketch are candidates, with a probability that grows with their edit similarity and not only with the sets they share. Candidates are
verified by a banded alignment of their words: an edit distance of at most (1 - SIMILARITY) of the longer one. Connected documents form a group.

Documents of equal words are one text from the start, so copies cost nothing further, and a bucket's texts are held against one leader at first (linking.py). Where a
large bucket's texts are unlike that one, only those are held against each other that have one of their rarest pairs of words in common, as similar texts must (rarest()), and where many have it, whose words
may agree by a mark of MARKS bits.
The alignment runs in Spark's banded levenshtein over texts with one character a word: a word's character is drawn from its hash, out of CHARACTERS. Two
different words of a pair meet in one character with a chance of 1 in CHARACTERS.

With scattered changes of single words, at an edit similarity of s about s ** K of the k-mers survive and a share j = s ** K / (2 - s ** K) of all are common, so that two texts agree in one of the sketches with a
probability of 1 - (1 - j ** LENGTH) ** SKETCHES: 0.91 at 0.8, 0.99 at 0.85 and more beyond; the tests and the README have measured figures.

Defined results. Words are runs of letters, digits and all that is not ASCII, with A-Z in lower case. A text of fewer than K words is one k-mer of all its words. A null text is empty; texts without a word are equal to
texts of the same bytes only. The class of a group is its least doc_id, null if all are null. keep() leaves one row of each group: of the least doc_id, of those the least text hash, of equal rows any one. All columns pass keep(). Texts of any
length are treated whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, is_small, lookup, lookup_hot, materialise, shared_folder, slices, text_buffer
from .linking import Tokens, edit_similar, link
from .tokens import ALNUM, LOWER, STEP, mixed, word_hashes, word_spans

K, LENGTH, SIMILARITY = 5, 2, 0.8
#: Sketches that are linked at a time: later ones meet only what earlier ones have not connected.
ROUNDS = (10, 20, 30)
SKETCHES = sum(ROUNDS)
#: Three-byte characters U+3400 to U+D7FF.
FIRST_CHARACTER, CHARACTERS = 0x3400, 0xD800 - 0x3400
CHUNK = 2 << 20
NULL_ID = 2**63 - 1
#: Slots of the counts of word pairs by which rare_grams() orders them.
SLOTS = 1 << 20
#: Bits of a text by which members of crowded buckets are compared before any alignment.
MARKS = 4096


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of its first word (and the end)."""
    first, end, begin = word_spans(data, offsets, ALNUM)
    return word_hashes(data, first, end), begin


def sequence_hash(words: np.ndarray, begin: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order; of its bytes if it has no word."""

    def folded(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        at = np.arange(first[-1]) - np.repeat(first[:-1], n)
        out = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(mixed(values + at.astype(np.uint64) * STEP), first[:-1][some])
        return mixed(out + n.astype(np.uint64))

    with np.errstate(over="ignore"):
        out = folded(words, begin)
        for i in np.flatnonzero(np.diff(begin) == 0):
            own = data[offsets[i] : offsets[i + 1]].astype(np.uint64)
            out[i] = mixed(folded(own, np.array([0, len(own)])) + STEP)[0]
    return out


def sketches(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Order MinHash buckets (rows: texts, columns: sketches); texts without words have zeros."""
    n = np.diff(begin)
    out = np.zeros((len(n), SKETCHES), np.uint64)
    texts = np.flatnonzero(n)
    if not len(texts):
        return out
    with np.errstate(over="ignore"):
        # k-mers: all starts with K words ahead in the text; a shorter text has one
        mers = np.maximum(n[texts] - K + 1, 1)
        first = np.concatenate([[0], np.cumsum(mers)])
        row = np.repeat(np.arange(len(texts)), mers)
        start = np.arange(first[-1]) - first[row] + begin[texts][row]
        ends = begin[texts + 1][row]
        kmer = np.zeros(len(start), np.uint64)
        for j in range(K):
            at = start + j
            kmer = kmer * STEP + np.where(at < ends, words[np.minimum(at, len(words) - 1)], np.uint64(0))
            kmer ^= kmer >> np.uint64(29)
        kmer = mixed(kmer)
        # label of occurrence within the text
        salted = mixed(kmer + row.astype(np.uint64) * STEP)
        order = np.argsort(salted, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = salted[order][1:] == salted[order][:-1]
        if same.any():
            at = np.arange(len(order))
            run = at - np.maximum.accumulate(np.where(same, 0, at))
            label = np.empty(len(order), np.uint64)
            label[order] = run
            kmer = mixed(kmer + label * np.uint64(0xD6E8FEB86659FD93))
        factor = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
        # so low a hash has about 14 k-mers of a text; where there are fewer than LENGTH, all are looked at
        bar = np.where(mers > 28, (14.0 / mers) * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
        bar_of = bar[row]
        for s in range(SKETCHES):
            value = kmer * factor[s]
            value ^= value >> np.uint64(32)
            value *= factor[s]
            low = np.flatnonzero(value <= bar_of)
            few = np.flatnonzero(np.bincount(row[low], minlength=len(texts)) < np.minimum(mers, LENGTH))
            if len(few):
                more = np.concatenate([np.arange(first[i], first[i + 1]) for i in few])
                low = np.union1d(low, more)
            low = low[np.lexsort((value[low], row[low]))]
            r = row[low]
            begins = np.searchsorted(r, np.arange(len(texts)))
            rank = np.arange(len(low)) - begins[r]
            taken = np.sort(low[rank < LENGTH])  # back in text order
            r = row[taken]
            begins = np.searchsorted(r, np.arange(len(texts)))
            nth = (np.arange(len(taken)) - begins[r]).astype(np.uint64)
            out[texts, s] = mixed(np.add.reduceat(mixed(kmer[taken] + nth * STEP), begins) + factor[s])
    return out


def coded(words: np.ndarray) -> bytes:
    """One character a word, in UTF-8."""
    c = (words % np.uint64(CHARACTERS)).astype(np.int64) + FIRST_CHARACTER
    out = np.empty((len(c), 3), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0xE0 | c >> 12, 0x80 | c >> 6 & 63, 0x80 | c & 63
    return out.tobytes()


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"], docs["doc_id"].isNull())


def sketched(docs: DataFrame) -> DataFrame:
    """did, h, id (of the text's words) and buckets of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            data = LOWER[data]
            ids, buckets, sizes = [], [], []
            for a, b in slices(offsets, CHUNK):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, begin = words_of(own, at)
                ids.append(sequence_hash(words, begin, own, at).view(np.int64))
                buckets.append(sketches(words, begin).view(np.int64))
                sizes.append(np.diff(begin).astype(np.int32))
            ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            flat = np.concatenate(buckets).reshape(-1) if buckets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, SKETCHES, dtype=np.int32), pa.array(flat))
            sizes = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), sizes, lists], names=["did", "h", "id", "size", "buckets"])
        give_back()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("did"), text_hash(docs).alias("h"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "did long, h long, id long, size int, buckets array<long>")


def word_texts(docs: DataFrame) -> DataFrame:
    """id and x, the words as characters, of rows (id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            data, out = LOWER[data], []
            for a, b in slices(offsets, CHUNK):
                words, begin = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [coded(words[begin[i] : begin[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["id", "x"])
        give_back()

    return docs.mapInArrow(run, "id long, x string")


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every two neighbours among the characters of the texts and an end, the text of each, and the texts' lengths."""
    data, offsets = text_buffer(column)
    at = data.reshape(-1, 3).astype(np.uint64)  # coded() gives three bytes each
    c = at[:, 0] << np.uint64(16) | at[:, 1] << np.uint64(8) | at[:, 2]
    n = np.diff(offsets) // 3
    after = np.zeros(len(c), np.uint64)
    after[:-1] = c[1:]
    after[np.cumsum(n)[n > 0] - 1] = 0
    with np.errstate(over="ignore"):
        return mixed(c << np.uint64(24) | after), np.repeat(np.arange(len(n)), n), n


def rarest(gram: np.ndarray, row: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text and how many it has: of its grams, labelled with their number of occurrence, the 2 * e + 1 least counted, where e is the edits that its length allows.

    An edit changes two grams at most, so of the longer of two similar texts, m characters, at least m - 2 * e(m) grams are also the other's, no less than n - 2 * e(n) for either. All texts order their grams in the same
    way, so the first 2 * e(n) + 1 of each have one in common, whatever the counts are."""
    order = np.lexsort((gram, row))
    g, r = gram[order], row[order]
    at = np.arange(len(g))
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
    label = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    with np.errstate(over="ignore"):
        token = mixed(g + label * STEP)
    order = np.lexsort((token, counts[(g % np.uint64(len(counts))).astype(np.int64)], r))
    token, r = token[order], r[order]
    take = np.where(n > 0, 2 * np.floor(n * (1 - SIMILARITY) + 1e-9).astype(np.int64) + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    return token[at - first[r] < take[r]], take


def marks(column) -> list[bytes]:
    """MARKS bits of each text: one for the hash of each of its characters, labelled with its number of occurrence."""
    data, offsets = text_buffer(column)
    at = data.reshape(-1, 3).astype(np.uint64)
    c, n = at[:, 0] << np.uint64(16) | at[:, 1] << np.uint64(8) | at[:, 2], np.diff(offsets) // 3
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((c, row))
    c, row, at = c[order], row[order], np.arange(len(c))
    same = np.zeros(len(c), bool)
    same[1:] = (c[1:] == c[:-1]) & (row[1:] == row[:-1])
    label = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    with np.errstate(over="ignore"):
        slot = (mixed(c + label * STEP) % np.uint64(MARKS)).astype(np.int64)
    bits = np.zeros((len(n), MARKS), bool)
    bits[row, slot] = True
    return [x.tobytes() for x in np.packbits(bits, axis=1)]


def rare_grams(sequences: DataFrame) -> Tokens:
    """For link(): the tokens of the texts (id, x), which are the rarer the fewer of the texts asked for have them, and their marks."""

    def tokens(folder: str, members: DataFrame) -> DataFrame:
        ids = materialise(members.select("id").distinct(), folder, "crowd")
        rows = sequences.join(F.broadcast(ids) if is_small(ids, 16) else ids, "id", "left_semi")

        def count(batches):
            import pyarrow as pa

            total = np.zeros(SLOTS, np.int64)
            for batch in batches:
                gram, _, _ = grams(batch.column(0))
                total += np.bincount((gram % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])
            give_back()

        found = rows.select("x").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
        counts = np.zeros(SLOTS, np.int32)
        counts[found.column(0).to_numpy()] = found.column(1).to_numpy()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                token, take = rarest(*grams(batch.column(1)), counts)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(take)]).astype(np.int32), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(marks(batch.column(1)), pa.binary())], names=["id", "tokens", "marks"])
            give_back()

        return materialise(rows.select("id", "x").mapInArrow(run, "id long, tokens array<long>, marks binary"), folder, "tokens")

    return tokens


def grouped(docs: DataFrame) -> DataFrame:
    """did, h, and the least did and its h (first_did, first_h) of the group of each document; a written table."""
    folder = shared_folder(docs.sparkSession)
    rows = materialise(sketched(docs), folder, "sketched")
    texts = rows.groupBy("id").agg(F.min(F.struct("did", "h")).alias("first"), F.max("size").alias("size"), F.count("*").alias("n"), F.first("buckets").alias("buckets"))
    texts = materialise(texts, folder, "texts")
    buckets = texts.select("id", F.explode(F.filter("buckets", lambda x: x != 0)).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).where("a < z").select("bucket", "n")
    ids = materialise(lookup_hot(buckets, materialise(shared, folder, "shared"), ["bucket"], 16, "n").select("id").distinct(), folder, "ids")
    few = F.broadcast(ids) if is_small(ids, 16) else ids
    items = materialise(texts.join(few, "id", "left_semi").select("id", "size", "buckets", F.col("first.did").alias("_did"), F.col("first.h").alias("_h")), folder, "items")
    # the words of one document of each text that has a candidate
    wanted = items.select("id", "_did", "_h")
    did = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID))
    found = docs.join(F.broadcast(wanted) if is_small(wanted, 32) else wanted, (did == wanted["_did"]) & (text_hash(docs) == wanted["_h"])).select(wanted["id"], docs["text"].cast("string").alias("text"))
    sequences = materialise(word_texts(found).dropDuplicates(["id"]), folder, "sequences")  # repeated rows
    keys = [F.filter(F.slice("buckets", sum(ROUNDS[:k]) + 1, n), lambda x: x != 0) for k, n in enumerate(ROUNDS)]
    roots = link(items.select("id", "size", "buckets"), keys, edit_similar(sequences, SIMILARITY, unique=True, kinds=True), folder, SIMILARITY, rare_grams(sequences))
    if roots is None:
        least = texts.select("id", "n", "first")
    else:
        own = texts.select("id", "n", F.col("first").alias("own")).join(F.broadcast(roots) if is_small(roots, 16) else roots, "id", "left")
        own = materialise(own.withColumn("root", F.coalesce("root", "id")), folder, "rooted")
        groups = own.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("m")).where("m > 1")
        groups = materialise(groups, folder, "groups")
        least = lookup(own, groups.drop("m"), ["root"], 40, "left", F.col("id")).select("id", "n", F.coalesce("first", "own").alias("first"))
    least = materialise(least, folder, "least")
    # documents of a text of its own are alone; the other texts are looked up
    rows = lookup_hot(rows.select("did", "h", "id"), least, ["id"], 40, "n")
    return materialise(rows.select("did", "h", F.col("first.did").alias("first_did"), F.col("first.h").alias("first_h")), folder, "grouped")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group) and n_class (documents in the group) of each document."""
    rows = grouped(docs)
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    sizes = materialise(rows.groupBy("first_did", "first_h").agg(F.count("*").alias("n_class")).where("n_class > 1"))
    rows = lookup(rows, sizes, ["first_did", "first_h"], 40, "left", F.struct("did", "h"))
    return rows.select(known("did").alias("doc_id"), known("first_did").alias("class_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def keep(docs: DataFrame) -> DataFrame:
    """docs with one document of each group."""
    rows = grouped(docs)
    is_first = (F.col("did") == F.col("first_did")) & (F.col("h") == F.col("first_h"))
    drop = materialise(rows.where(~is_first).select(F.col("did").alias("_did"), F.col("h").alias("_h")).distinct())
    again = materialise(rows.where(is_first).groupBy("did", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("did").alias("_did"), F.col("h").alias("_h")))
    did, h = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), text_hash(docs)

    def joined(table: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(table) if is_small(table, 32) else table, (did == table["_did"]) & (h == table["_h"]), how)

    if again.isEmpty():
        return joined(drop, "left_anti")
    both = materialise(drop.unionAll(again))
    repeated = joined(again, "left_semi").dropDuplicates(["doc_id", "text"])
    return joined(both, "left_anti").unionAll(repeated)
