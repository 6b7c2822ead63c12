"""Removal of every byte covered by a string of WIDTH bytes that starts at two places of the corpus.

A suffix array of the whole collection, built column by column, sorts as often as the longest document has bytes, each time all that is there so far; the README has figures. The corpus is
therefore cut first into strings that are short and that belong together, and these are compared by window hashes:

1. Every window of WIDTH bytes is assigned to its anchor, the MER bytes of least hash in it (the first of equal ones). Equal windows have equal anchors at equal places, and the windows of
   one anchor follow one another: they lie in one string of less than 2 * WIDTH bytes, the anchor's context. One anchor in about 70 bytes is kept, as a row of fixed size.
2. Anchors that occur once hold no repeat. Equal contexts are counted as one, before the shuffle; a context that occurs twice is repeated as a whole, so large groups of copies end here.
3. The different contexts of an anchor are dealt by anchor; a task compares all windows of its contexts. Anchors with more than COLLECTION different contexts are resolved in rows of one window,
   counted with pre-aggregation, so that no anchor is too large for a task.
4. The marks of a context hold for all its occurrences; their union is removed from the documents.

Defined results. A null text is empty. Texts shorter than WIDTH bytes lose nothing. Rows equal in doc_id and text are different documents, so all their bytes go if there are at least WIDTH. A null doc_id is a value of its own.
Columns of other names are ignored by repeats(), and kept by drop_repeats(). Bytes are compared through 64-bit hashes of an anchor's contexts and windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, is_small, lookup, lookup_hot, materialise, shared_folder, slices, text_buffer
from .tokens import BYTE, mixed

WIDTH, MER = 200, 24
#: Bytes hashed at a time; different contexts that a task compares, about, and of one anchor at most.
CHUNK, STRINGS, COLLECTION = 2 << 20, 4000, 50_000
#: What is joined to whole documents grows with them, so it is broadcast only where it is next to nothing.
FEW_BYTES = 1 << 20
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte values times powers, so that sums[b] - sums[a], times back[a], is a hash of data[a:b]."""
    n = len(data) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n, np.uint64)
        powers, back = np.full(n, STEP, np.uint64), np.full(n, BACK, np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.cumprod(powers), np.cumprod(back)
        np.cumsum(BYTE[data] * powers[:-1], out=sums[1:])
    return sums, back


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values: of a block's suffix and the next block's prefix."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1), np.uint64)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(padded, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of all texts: text, anchor (hash), context (hash), lo (where it begins in the text), at (the anchor's place in the context), windows."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "anchor", "context", "lo", "at", "windows")}
    if len(data) < WIDTH:
        return none
    with np.errstate(over="ignore"):
        sums, back = prefix_sums(data)
        mers = mixed((sums[MER:] - sums[:-MER]) * back[: len(data) - MER + 1])
        places = np.uint64(36)  # bits for the place in the data, at every size: of equal hashes the first counts, and all texts order anchors by the same 28 bits
        low = (np.uint64(1) << places) - np.uint64(1)
        ranked = (mers & ~low) | np.arange(len(mers), dtype=np.uint64)
        least = (sliding_min(ranked, WIDTH - MER + 1) & low).astype(np.int64)
        length = np.diff(offsets)
        long = np.flatnonzero(length >= WIDTH)
        if not len(long):
            return none
        count = length[long] - WIDTH + 1  # windows of each text
        starts = np.repeat(offsets[long] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place, text = least[starts], np.repeat(long, count)
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(starts)))
        lo, text, place = starts[first], text[first], place[first]
        hi = lo + windows - 1 + WIDTH
        at = place - lo
        context = mixed(mixed((sums[hi] - sums[lo]) * back[lo]) + at.astype(np.uint64) * np.uint64(STEP) + windows.astype(np.uint64))
        return {"text": text, "anchor": mers[place].view(np.int64), "context": context.view(np.int64), "lo": lo - offsets[text], "at": at, "windows": windows}


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"], docs["doc_id"].isNull())


def did(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(0))


def anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(offsets, CHUNK):
                x = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                text = x["text"] + a
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[text], hashes[text], x["anchor"], x["context"], x["lo"], x["at"].astype(np.int32), x["windows"].astype(np.int32))], names=["did", "h", "anchor", "context", "lo", "at", "windows"])

    rows = docs.select(did(docs).alias("did"), text_hash(docs).alias("h"), docs["text"].cast("string").alias("text")).where(F.octet_length("text") >= WIDTH)
    return rows.mapInArrow(run, "did long, h long, anchor long, context long, lo long, at int, windows int")


def window_hashes(texts: list[bytes], windows: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of contexts, each salted with its anchor, and the number of the context of each."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), windows)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    with np.errstate(over="ignore"):
        sums, back = prefix_sums(data)
        return mixed((sums[at + WIDTH] - sums[at]) * back[at] + mixed(anchor.view(np.uint64))[of]), of


def covered(repeated: np.ndarray, of: np.ndarray, windows: np.ndarray) -> list[list[dict]]:
    """Runs of bytes [a, b) of each context under its repeated windows."""
    out: list[list[dict]] = [[] for _ in windows]
    first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    hit = np.flatnonzero(repeated)
    if len(hit):
        new = np.ones(len(hit), bool)
        # else the next begins where the last ends, or before
        new[1:] = (np.diff(hit) > WIDTH) | (of[hit][1:] != of[hit][:-1])
        start = np.flatnonzero(new)
        for i, j in zip(hit[start], hit[np.append(start[1:], len(hit)) - 1], strict=True):
            out[of[i]].append({"a": int(i - first[of[i]]), "b": int(j - first[of[i]]) + WIDTH})
    return out


RUNS = "anchor long, context long, runs array<struct<a:int,b:int>>"


def comparing(left):
    import pyarrow as pa

    texts = [x.as_py() for x in left.column("bytes")]
    windows, anchor, n = (left.column(c).to_numpy() for c in ("windows", "anchor", "n"))
    hashes, of = window_hashes(texts, windows.astype(np.int64), anchor)
    _, which = np.unique(hashes, return_inverse=True)
    repeated = np.bincount(which, n[of])[which] > 1
    runs = pa.array(covered(repeated, of, windows.astype(np.int64)), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.table({"anchor": left.column("anchor"), "context": left.column("context"), "runs": runs})


def large(contexts: DataFrame) -> DataFrame:
    """The same in rows of one window, for anchors with very many contexts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                windows, anchor = batch.column(3).to_numpy().astype(np.int64), batch.column(0).to_numpy()
                hashes, of = window_hashes([x.as_py() for x in batch.column(4)], windows, anchor)
                nth = np.arange(len(of)) - np.concatenate([[0], np.cumsum(windows)[:-1]])[of]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), batch.column(2).take(pa.array(of)), pa.array(nth.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["anchor", "context", "n", "nth", "hash"])

    rows = materialise(contexts.select("anchor", "context", "n", "windows", "bytes").mapInArrow(run, "anchor long, context long, n long, nth int, hash long"))
    twice = materialise(rows.groupBy("hash").agg(F.sum("n").alias("t")).where("t > 1").select("hash"))
    hits = lookup(rows, twice, ["hash"], 16, "inner", F.col("context"))
    return hits.groupBy("anchor", "context").agg(F.transform(F.collect_set("nth"), lambda k: F.struct(k.alias("a"), (k + WIDTH).alias("b"))).alias("runs"))


def context_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (anchor, context, n, k, windows, did, h, lo) with the bytes of the contexts, cut out of the documents."""
    lists = materialise(wanted.groupBy("did", "h").agg(F.collect_list(F.struct("anchor", "context", "n", "k", "windows", "lo")).alias("x")).withColumnsRenamed({"did": "_did", "h": "_h"}))
    small = is_small(lists, F.lit(32) + 56 * F.size("x"), FEW_BYTES)
    found = docs.join(F.broadcast(lists) if small else lists, (did(docs) == lists["_did"]) & (text_hash(docs) == lists["_h"])).select(docs["text"].cast("binary").alias("text"), "x")

    def run(batches):
        import pyarrow as pa

        kinds = [("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("k", pa.int64()), ("bytes", pa.binary())]
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_buffer().to_pybytes()
                rows += [{"anchor": c["anchor"], "context": c["context"], "n": c["n"], "k": c["k"], "windows": c["windows"], "bytes": text[c["lo"] : c["lo"] + c["windows"] - 1 + WIDTH]} for c in cuts.as_py()]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return found.mapInArrow(run, "anchor long, context long, n long, windows int, k long, bytes binary")


def repeats(docs: DataFrame) -> DataFrame:
    """did, h and spans (array of [a, b) in bytes, not merged) of the documents that lose bytes; a written table."""
    folder = shared_folder(docs.sparkSession)
    rows = materialise(anchor_rows(docs), folder, "anchors")
    twice = materialise(rows.groupBy("anchor").agg(F.count("*").alias("t")).where("t > 1").select("anchor"), folder, "twice")
    rows = materialise(lookup(rows, twice, ["anchor"], 16, "inner", F.struct("did", "lo")), folder, "repeated")
    drop_table(docs.sparkSession, f"{folder}/anchors")
    contexts = materialise(rows.groupBy("anchor", "context", "windows").agg(F.count("*").alias("n"), F.min(F.struct("did", "h", "lo")).alias("one")), folder, "contexts")
    kinds = materialise(contexts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), folder, "kinds")
    mixed_ones = materialise(lookup(contexts, kinds, ["anchor"], 24, "inner", F.col("context")).select("anchor", "context", "n", "k", "windows", "one.did", "one.h", "one.lo"), folder, "mixed")
    strings = materialise(context_bytes(docs, mixed_ones).dropDuplicates(["anchor", "context"]), folder, "strings")
    few = strings.where(F.col("k") <= COLLECTION)
    tasks = max(1, -(-few.count() // STRINGS))
    marks = few.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks))).groupBy("task").applyInArrow(comparing, RUNS)
    if not strings.where(F.col("k") > COLLECTION).isEmpty():
        marks = marks.unionAll(large(strings.where(F.col("k") > COLLECTION)))
    marks = marks.where(F.size("runs") > 0)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") + (WIDTH - 1)).cast("int").alias("b")))
    copies = contexts.where("n > 1").select("anchor", "context", whole.alias("runs"), "n")
    single = contexts.where("n = 1").select("anchor", "context", "n")
    marks = materialise(marks.join(single, ["anchor", "context"]).unionAll(copies), folder, "marks")
    drop_table(docs.sparkSession, f"{folder}/strings")
    hits = lookup_hot(rows.select("did", "h", "lo", "anchor", "context"), marks, ["anchor", "context"], F.lit(40) + 24 * F.size("runs"), "n")
    spans = hits.select("did", "h", F.explode(F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"]).alias("b")))).alias("span"))
    return materialise(spans.groupBy("did", "h").agg(F.collect_set("span").alias("spans")), folder, "spans")


def apply_spans(docs: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, n_bytes, n_removed, n_spans (maximal removed runs), and kept, the remaining bytes."""
    spans = spans.withColumnsRenamed({"did": "_did", "h": "_h", "spans": "_spans"})
    small = is_small(spans, F.lit(48) + 40 * F.size("_spans"), FEW_BYTES)
    rows = docs.join(F.broadcast(spans) if small else spans, (did(docs) == spans["_did"]) & (text_hash(docs) == spans["_h"]), "left")
    rows = rows.select(*[docs[c] for c in keep], F.coalesce(docs["text"].cast("binary"), F.lit("").cast("binary")).alias("_text"), F.array_sort("_spans").alias("_spans"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]] + ["n_bytes long", "n_removed long", "n_spans long", "kept binary"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for text, cuts in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True):
                text = text.as_buffer().to_pybytes()
                parts, at, n = [], 0, 0
                for cut in cuts.as_py() or ():  # sorted
                    if cut["a"] > at or n == 0:
                        parts.append(text[at : cut["a"]])
                        n += 1
                        at = cut["b"]
                    else:
                        at = max(at, cut["b"])
                parts.append(text[at:])
                left = b"".join(parts)
                size.append(len(text))
                removed.append(len(text) - len(left))
                runs.append(n)
                kept.append(left)
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in (size, removed, runs)] + [pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, schema)


def drop_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns keep) with n_bytes, n_removed, n_spans and kept."""
    return apply_spans(docs, repeats(docs), docs.columns if keep is None else keep)
