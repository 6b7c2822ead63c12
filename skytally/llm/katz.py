"""Language model scoring with Katz backoff (bigrams).

Counts r of unigrams and bigrams up to CUT are discounted after Good and Turing: d_r = (r*/r - q) / (1 - q) with r* = (r + 1) N_(r+1) / N_r and q = (CUT + 1) N_(CUT+1) / N_1. A word after a context h
has d_r r / c(h) if the pair is known, else alpha(h) times its unigram probability, where alpha(h) = (1 - sum of the known words' bigram probabilities) / (1 - sum of their unigram probabilities), so that every
context sums to one over all words, the end and the one class of unknown words. A word after an unknown context has its unigram probability.

A corpus has about as many different bigrams as half its tokens, so nothing here is a row a token: numpy arrays, compressed, travel in rows of (bucket, batch).
1. Each batch of documents asks the unigram partitions (by word) for the counts of its different words; they count all and answer.
2. With the answers each batch sends its tokens to the bigram partitions, by context. A context with more than HOT training tokens is spread by word as well. The same message
   serves for counting (the training documents' share) and for scoring (which documents hold it). Each partition sums what its tokens give to each document; as the discounts are not known
   before all partitions have counted, known pairs of low counts are summed by count, and unknown ones are kept with their context.
3. The counts of counts, and the sums of spread contexts, give discounts and backoff weights; each document adds up its parts.
The driver sees the counts of counts only.

Defined results. A null text is empty: the end alone. A null doc_id is not held out. Without training tokens every token has probability one. Where the counts of counts give no discount between 0 and 1 it is (r - 0.5) / r; a context (or the unigrams)
all of whose counts are above CUT gets one more, unseen, count in the denominator. Repeated rows each return a row. Columns of other names are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, shared_folder, slices, text_buffer
from .langid import held_out
from .tokens import LOWER, SPACED, STEP, mixed, word_hashes, word_spans

CUT = 5
#: Tokens of a batch and of a partition, about; training tokens from which a context is spread.
BATCH_BYTES, PARTITION_TOKENS, HOT = 8 << 20, 1_500_000, 300_000
#: The end's hash among words, and the first context among the words' numbers.
END, START = np.uint64(1), np.uint64(0)
ROWS = "kind int, bucket long, batch long, blob binary"
INFO, TOKENS, ASK, ANSWER, STATS, PARTS, OPEN, SPREAD = range(8)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block; sorted 64-bit numbers are best given as differences."""
    import zstandard

    head = np.array([len(arrays)] + [x for a in arrays for x in (a.dtype.num, len(a))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    kinds = {np.dtype(x).num: np.dtype(x) for x in (np.uint8, np.uint16, np.uint32, np.int32, np.int64, np.uint64, np.float64)}
    for kind, length in head.reshape(-1, 2):
        out.append(np.frombuffer(raw, kinds[int(kind)], int(length), at))
        at += kinds[int(kind)].itemsize * int(length)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0)) if len(x) else x


def table_of(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ("kind", "bucket", "batch", "blob")
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})


def batches_of(stream):
    """Documents of an Arrow stream in batches of about BATCH_BYTES: number, doc_ids, held out, words, first words."""
    from pyspark import TaskContext

    nth = TaskContext.get().partitionId() << 32
    for batch in stream:
        data, offsets = text_buffer(batch.column(2))
        for a, b in slices(offsets, BATCH_BYTES):
            own, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            hashes, begin = [], [np.zeros(1, np.int64)]
            for c, d in slices(at, 2 << 20):
                piece, inner = own[at[c] : at[d]], at[c : d + 1] - at[c]
                first, end, starts = word_spans(piece, inner, SPACED)
                hashes.append(word_hashes(piece, first, end) | np.uint64(4))  # apart from END
                begin.append(starts[1:] + begin[-1][-1])
            words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield nth, batch.column(0)[a:b], batch.column(1)[a:b].to_numpy(zero_copy_only=False).astype(bool), words, np.concatenate(begin)
            nth += 1


def with_ends(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens (words and an END after each text) and the text that each is in."""
    n = np.diff(begin)
    tokens = np.insert(words, begin[1:], END) if len(n) else words
    return tokens, np.repeat(np.arange(len(n)), n + 1)


def asking(partitions: int):
    """Step 1: of each batch its different words with their training counts, by partition."""

    def run(stream):
        for number, _, out, words, begin in batches_of(stream):
            tokens, text = with_ends(words, begin)
            unique, which = np.unique(tokens, return_inverse=True)
            train = np.bincount(which[~out[text]], minlength=len(unique))
            part = (mixed(unique) % np.uint64(partitions)).astype(np.int64)
            rows = []
            for p in range(partitions):
                own = part == p
                rows.append((ASK, p, number, pack(gaps(unique[own]), small(train[own]))))
            yield from table_of(rows).to_batches()

    return run


def answering(left):
    """The unigram counts of a partition: an answer for each batch, with the words' numbers in the partition, and the counts of counts."""
    asked = [(b, *unpack(blob)) for b, blob in zip(left.column("batch").to_pylist(), left.column("blob").to_pylist(), strict=True)]
    words = [np.cumsum(x, dtype=np.uint64) for _, x, _ in asked]
    unique, which = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(which, np.concatenate([c for _, _, c in asked]).astype(np.float64), len(unique)).astype(np.int64)
    p, rows, at = left.column("bucket")[0].as_py(), [], 0
    for (batch, _, _), own in zip(asked, words, strict=True):
        mine = which[at : at + len(own)]
        rows.append((ANSWER, p, batch, pack(small(counts[mine]), small(mine))))
        at += len(own)
    rows.append((STATS, p, -1, pack(np.concatenate([np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3), [counts.sum()]]).astype(np.int64))))
    return table_of(rows)


def telling(stream):
    """Step 2: the tokens of each batch as numbers of its different words, and its documents."""
    import pyarrow as pa

    for number, ids, out, words, begin in batches_of(stream):
        tokens, _ = with_ends(words, begin)
        unique, which = np.unique(tokens, return_inverse=True)
        ids = pa.array(ids) if not isinstance(ids, pa.Array) else ids
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        blob = pack(gaps(unique), small(which), np.diff(begin) + 1, out.astype(np.uint8), ids.fill_null(0).to_numpy().astype(np.int64), null)
        yield from table_of([(TOKENS, -1, number, blob)]).to_batches()


class Unigrams:
    """Discounted unigram probabilities from the counts of counts."""

    def __init__(self, counts_of_counts: np.ndarray, total: int):
        self.total, self.kinds = int(total), int(counts_of_counts[1:].sum())
        self.d = discounts(counts_of_counts)
        kept = self.total - sum((1 - self.d[r]) * r * counts_of_counts[r] for r in range(1, CUT + 1))
        # with no mass left, the unknown words get one count more
        self.below = self.total if kept < self.total else self.total + 1
        self.unknown = 1.0 if not self.total else 1 - kept / self.below

    def __call__(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, self.d[np.minimum(c, CUT + 1)] * c / max(1, self.below), self.unknown)


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0 ... d_(CUT + 1) from N_0 ... N_(CUT + 1); (r - 0.5) / r where the formula gives nothing between 0 and 1."""
    d = np.ones(CUT + 2)
    q = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        x = ((r + 1) * n[r + 1] / (n[r] * r) - q) / (1 - q) if n[r] and q < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def sending(unigrams: Unigrams, ask_partitions: int, partitions: int):
    """What a batch knows of its tokens with the answers: its documents' sums so far, and its messages to the bigram partitions."""

    def run(left):
        kinds = left.column("kind").to_numpy()
        blobs = left.column("blob")
        number = left.column("batch")[0].as_py()
        unique, which, n, out, ids, null = unpack(blobs[int(np.flatnonzero(kinds == TOKENS)[0])].as_py())
        unique, which = np.cumsum(unique, dtype=np.uint64), which.astype(np.int64)
        counts, names, part = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.uint64), (mixed(unique) % np.uint64(ask_partitions)).astype(np.int64)
        for i in np.flatnonzero(kinds == ANSWER):
            p = left.column("bucket")[int(i)].as_py()
            counts[part == p], number_in = unpack(blobs[int(i)].as_py())
            names[part == p] = number_in.astype(np.uint64) * np.uint64(ask_partitions) + np.uint64(p + 1)
        text = np.repeat(np.arange(len(n)), n)
        ends = np.cumsum(n)
        c = counts[which]
        known = np.bincount(text, c > 0, len(n))
        total, kinds_of = unigrams.total, unigrams.kinds
        base = np.bincount(text, np.log10((c + 1) / (total + kinds_of + 1)), len(n))
        # the context of a text's first token is START, which occurs once a training text
        context, c_context = np.empty(len(which), np.uint64), np.empty(len(which), np.int64)
        context[1:], c_context[1:] = names[which[:-1]], c[:-1]
        starts = ends - n
        context[starts], c_context[starts] = START, 1
        p = unigrams(c)
        alone = c_context == 0
        score = np.bincount(text[alone], np.log10(p[alone]), len(n)).astype(np.float64)
        rows = [(INFO, number % partitions, number, pack(ids, null, out, n.astype(np.int64), known.astype(np.int64), base, score))]
        follow = np.flatnonzero(~alone)
        context, c_context, which, text, c = context[follow], c_context[follow], which[follow], text[follow], c[follow]
        word = names[which]
        spread = np.maximum(1, -(-c_context // HOT)).astype(np.uint64)
        spread = np.where(context == START, np.uint64(partitions), spread)
        bucket = ((mixed(context) + mixed(word) % spread) % np.uint64(partitions)).astype(np.int64)
        order = np.lexsort((text, word, context, bucket))
        bucket, context, word, text, c, spread = bucket[order], context[order], word[order], text[order], c[order], spread[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1])
        edges = np.searchsorted(bucket, np.arange(partitions + 1))
        for b in range(partitions):
            lo, hi = edges[b], edges[b + 1]
            if lo == hi:
                continue
            first = np.flatnonzero(new[lo:hi]) + lo
            h, w = context[first], word[first]
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(first, hi))
            rows.append((TOKENS, b, number, pack(small(gaps(h[at])), small(np.diff(np.append(at, len(h)))), (spread[first][at] > 1).astype(np.uint8), small(w), small(c[first]), small(times), small(text[lo:hi]), out)))
        return table_of(rows)

    return run


def counting(unigrams: Unigrams):
    """A bigram partition: counts its pairs and sums what they give to each document."""

    def run(left):
        rows, sent = [], []
        bucket = left.column("bucket")[0].as_py()
        for kind, batch, blob in zip(left.column("kind").to_pylist(), left.column("batch").to_pylist(), left.column("blob"), strict=True):
            if kind == INFO:
                rows.append((INFO, bucket, batch, blob.as_py()))
            else:
                sent.append((batch, unpack(blob.as_py())))
        if not sent:
            return table_of(rows)
        h = np.concatenate([np.repeat(np.cumsum(x[0], dtype=np.uint64), x[1]) for _, x in sent])
        hot = np.concatenate([np.repeat(x[2], x[1]) for _, x in sent])
        w = np.concatenate([x[3].astype(np.uint64) for _, x in sent])
        c_word = np.concatenate([x[4].astype(np.int64) for _, x in sent])
        train = np.concatenate([np.add.reduceat((x[7][x[6]] == 0).astype(np.int64), np.concatenate([[0], np.cumsum(x[5].astype(np.int64))[:-1]])) for _, x in sent])
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        count = np.bincount(pair, train).astype(np.int64)
        h_of, p_word = h[first], unigrams(c_word[first])
        contexts, row = np.unique(h_of, return_inverse=True)
        is_hot = np.zeros(len(contexts), np.uint8)
        is_hot[row] = hot[first]
        del h, w, hot, c_word, train, order, new, first, h_of
        # of each context: the tokens and the known words' unigram probabilities, and what is kept of it by count
        n = len(contexts)
        by_count = np.stack([np.bincount(row[count == r], minlength=n) for r in range(1, CUT + 1)]).astype(np.int64)
        over = np.bincount(row, np.where(count > CUT, count, 0), n).astype(np.int64)
        seen = np.bincount(row, np.where(count > 0, p_word, 0.0), n)
        size = over + sum((r + 1) * by_count[r] for r in range(CUT))
        rows.append((STATS, bucket, -1, pack(np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3).astype(np.int64))))
        lists, at = [], 0
        log_count, log_p = np.log10(np.maximum(count, 1)), np.log10(p_word)
        log_size = np.log10(np.maximum(np.where(over < size, size, size + 1), 1))
        for batch, x in sent:
            mine = np.repeat(pair[at : at + len(x[3])], x[5].astype(np.int64))
            at += len(x[3])
            text, ctx, known = x[6].astype(np.int64), row[mine], count[mine]
            m = int(text.max()) + 1
            # contexts that lie in several partitions get their size later
            value = np.where(known > 0, np.where(known > CUT, log_count[mine], 0.0) - np.where(is_hot[ctx] == 1, 0.0, log_size[ctx]), log_p[mine])
            docs = np.unique(text)
            sums = np.bincount(text, value, m)[docs]
            low = [np.bincount(text[known == r], minlength=m)[docs] for r in range(1, CUT + 1)]
            rows.append((PARTS, bucket, batch, pack(gaps(docs.astype(np.uint64)).astype(np.uint32), sums, *[small(v) for v in low])))
            # what waits for the context: unknown pairs for its weight; known ones of hot contexts for its size
            wait = (known == 0) | (is_hot[ctx] == 1)
            if wait.any():
                lists.append((np.full(int(wait.sum()), batch), ctx[wait], text[wait], known[wait] > 0))
        if lists:
            batch, ctx, text, known = (np.concatenate([x[i] for x in lists]) for i in range(4))
            del lists
            cool = is_hot[ctx] == 0
            used, ctx_of = np.unique(ctx[cool], return_inverse=True)
            order = np.lexsort((text[cool], batch[cool]))
            rows.append((OPEN, bucket, -1, pack(size[used], over[used], seen[used], by_count[:, used].reshape(-1), small(ctx_of[order]), batch[cool][order], small(text[cool][order]))))
            for k in np.flatnonzero(is_hot):
                own = ctx == k
                o = np.lexsort((text[own], batch[own]))
                stats = np.concatenate([[size[k], over[k]], by_count[:, k]]).astype(np.int64)
                rows.append((SPREAD, int(contexts[k].view(np.int64)), -1, pack(stats, seen[k : k + 1], batch[own][o], small(text[own][o]), known[own][o].astype(np.uint8))))
        return table_of(rows)

    return run


def weights(size, over, seen, by_count, d):
    """log10 of the backoff weight, and of the size as a denominator, of contexts."""
    size = np.asarray(size, np.float64)
    kept = np.asarray(over, np.float64) + sum(d[r + 1] * (r + 1) * by_count[r] for r in range(CUT))
    below = np.where(np.asarray(over) < size, size, size + 1)  # without any discount one more count, unseen
    left = np.where(size > 0, 1 - kept / np.maximum(below, 1), 1.0)
    with np.errstate(divide="ignore"):
        return np.log10(left / np.maximum(1 - np.asarray(seen), 1e-300)), np.log10(np.maximum(below, 1))


def closing(d: np.ndarray):
    """Step 3: the parts of documents that waited for their contexts."""

    def per_document(batch, text, value):
        order = np.lexsort((text, batch))
        batch, text, value = batch[order], text[order], value[order]
        new = np.ones(len(batch), bool)
        new[1:] = (batch[1:] != batch[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        sums, batch, text = np.add.reduceat(value, at), batch[at], text[at]
        for b in np.unique(batch):
            own = batch == b
            yield (PARTS, -1, int(b), pack(gaps(text[own].astype(np.uint64)).astype(np.uint32), sums[own], *[np.zeros(0, np.uint8)] * CUT))

    def run(stream):
        for rows in stream:
            found = []
            for blob, stats, seen in zip(*[rows.column(i).to_pylist() for i in range(3)], strict=True):
                if stats is None:
                    size, over, seen, by_count, ctx, batch, text = unpack(blob)
                    alpha, _ = weights(size, over, seen, by_count.reshape(CUT, -1), d)
                    if len(ctx):
                        found += per_document(batch, text.astype(np.int64), alpha[ctx.astype(np.int64)])
                else:
                    _, _, batch, text, known = unpack(blob)
                    alpha, below = weights([stats[0]], [stats[1]], [seen], np.array(stats[2:])[:, None], d)
                    if len(batch):
                        found += per_document(batch, text.astype(np.int64), np.where(known == 1, -below[0], alpha[0]))
            if found:
                yield from table_of(found).to_batches()

    return run


def finishing(d: np.ndarray, total: int):
    def run(left):
        import pyarrow as pa

        kinds, blobs = left.column("kind").to_numpy(), left.column("blob")
        ids, null, out, n, known, base, score = unpack(blobs[int(np.flatnonzero(kinds == INFO)[0])].as_py())
        score = score.copy()
        logs = [math.log10(d[r] * r) for r in range(1, CUT + 1)]
        for i in np.flatnonzero(kinds == PARTS):
            text, sums, *low = unpack(blobs[int(i)].as_py())
            text = np.cumsum(text.astype(np.int64))
            score[text] += sums + sum((log * v.astype(np.float64) for log, v in zip(logs, low, strict=True) if len(v)), np.zeros(len(text)))
        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """The sum of the n statistics of all partitions; only the sums reach the driver."""

    def read(stream):
        import pyarrow as pa

        for batch in stream:
            total = sum((unpack(x.as_py())[0] for x in batch.column(0)), np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["i", "v"])

    found = rows.where(F.col("kind") == STATS).select("blob").mapInArrow(read, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n, np.int64)
    for r in found:
        out[r.i] = r.v
    return out


def numbers(stream):
    """The statistics of contexts that lie in several partitions, out of their blobs."""
    import pyarrow as pa

    for batch in stream:
        found = [unpack(x.as_py())[:2] for x in batch.column(1)]
        stats = pa.array([[int(v) for v in x] for x, _ in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats, pa.array([float(x[0]) for _, x in found], pa.float64())], names=["context", "blob", "stats", "seen"])


def score(docs: DataFrame, mod: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10 probability under the model) of each document."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs, mod, remainder).alias("out"), docs["text"].cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)) + F.count("*")).first()[0]
    partitions = max(4, math.ceil(size / 5 / PARTITION_TOKENS))  # about so many tokens
    asked = rows.mapInArrow(asking(partitions), ROWS)
    answers = materialise(asked.groupBy("bucket").applyInArrow(answering, ROWS), folder, "unigrams")
    stats = summed(answers, CUT + 4)
    unigrams = Unigrams(stats[:-1], stats[-1])
    told = rows.mapInArrow(telling, ROWS).unionAll(answers.where(F.col("kind") == ANSWER))
    sent = told.groupBy("batch").applyInArrow(sending(unigrams, partitions, partitions), ROWS)
    parts = materialise(sent.groupBy("bucket").applyInArrow(counting(unigrams), ROWS), folder, "bigrams")
    d = discounts(summed(parts, CUT + 3))
    hot = materialise(parts.where(F.col("kind") == SPREAD).select(F.col("bucket").alias("context"), "blob").mapInArrow(numbers, "context long, blob binary, stats array<long>, seen double"), folder, "hot")
    whole = hot.groupBy("context").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(CUT + 2)]).alias("stats"), F.sum("seen").alias("seen"))
    waiting = parts.where(F.col("kind") == OPEN).select("blob", F.lit(None).cast("array<long>").alias("stats"), F.lit(None).cast("double").alias("seen"))
    waiting = waiting.unionAll(lookup(hot.select("context", "blob"), materialise(whole, folder, "spread"), ["context"], 120, "inner", F.xxhash64("blob")).select("blob", "stats", "seen"))
    closed = materialise(waiting.mapInArrow(closing(d), ROWS), folder, "closed")
    every = parts.where(F.col("kind").isin(INFO, PARTS)).unionAll(closed)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return every.groupBy("batch").applyInArrow(finishing(d, unigrams.total), out)
