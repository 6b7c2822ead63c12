"""Language identification by partial matching.

For each language the counts of byte n-grams of a bounded training sample form a context tree of up to three bytes. A byte is coded by the longest context seen: a
seen byte costs -log2(c / (n + t)), with n occurrences of the context and t different bytes after it; else an escape of probability t / (n + t) leads to the next
shorter context, from which the bytes already ruled out are excluded, down to a uniform distribution, so that the probabilities of the 256 bytes sum to one in every context.
The statistics are frozen after training. A text's language is the one with the least total code length over the whole text.

Because the statistics are frozen, the code lengths are a table (context, byte) -> bits per language, which is built once in each Python worker from the counts and applied to
whole Arrow buffers. Training takes whole documents whose hash is below a threshold per language, SAMPLE_BYTES of all languages together on average, never more than twice that;
nothing else depends on the size of the corpus. A document longer than its language's share is not a training document; a language all of whose documents are that long is not learned.

Defined results. A null text or one without a letter is `und` with score 0; so is every text if there is nothing to learn from. A null lang is not learned from. A null doc_id is not held out. Ties go
to the language first by code point. Repeated rows each return a row. Columns of other names are ignored.
"""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, text_buffer

#: Bytes of training text at most, over all languages and of one.
SAMPLE_BYTES, LANGUAGE_BYTES = 4 << 20, 512 << 10
#: Bytes of the code length table at most; beyond it the rarest three-byte contexts are left out.
TABLE_BYTES = 64 << 20
ORDER = 3
#: Added columns replace those of the same names.
ADDED = ("lang_pred", "score", "bits_per_byte")
PAD = 10  # the byte that stands before a text


def held_out(docs: DataFrame, mod: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))


def sample(docs: DataFrame, train: Column, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(lang, text) of whole training documents, chosen by hash."""
    size = F.octet_length(docs["text"]).cast("long")
    rows = docs.where(train & docs["lang"].isNotNull() & docs["text"].rlike(r"\p{L}")).select(docs["lang"].alias("lang"), docs["text"].alias("text"), docs["doc_id"].alias("id"), size.alias("size"))
    found = {r["lang"]: r["bytes"] for r in rows.groupBy("lang").agg(F.sum("size").alias("bytes")).collect()}  # one row a language
    if not found:
        return []
    most = min(LANGUAGE_BYTES, sample_bytes // len(found))
    share = F.create_map(*[F.lit(x) for k, v in found.items() for x in (k, min(1.0, most / v))])
    unit = F.pmod(F.xxhash64(F.lit("langid"), "id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where((F.col("size") <= most) & (unit < share[F.col("lang")])).orderBy(F.xxhash64("id", "lang"), "id", "text").select("lang", "text")
    taken, out = dict.fromkeys(found, 0), []
    for lang, text in chosen.toLocalIterator():
        if taken[lang] < 2 * most:
            taken[lang] += len(text.encode())
            out.append((lang, text))
    return out


def train(rows: list[tuple[str, str]]) -> dict:
    """The frozen statistics: for each language the 4-byte strings and their counts."""
    langs = sorted({x for x, _ in rows})
    grams = {}
    for lang in langs:
        data = np.concatenate([np.frombuffer(bytes([PAD] * ORDER) + t.encode(), np.uint8) for x, t in rows if x == lang]).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t.encode()) + ORDER for x, t in rows if x == lang])[:-1]])
        codes = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        inside = np.ones(len(data), bool)
        for k in range(ORDER):  # a string that ends in padding belongs to no text
            inside[starts + k] = False
        codes, counts = np.unique(codes[inside[3:]], return_counts=True)
        grams[lang] = (codes, counts)
    return {"langs": langs, "grams": grams}


class CodeLengths:
    """bits[row * width + symbol, language], and row_of[context]: the row of the longest context that is kept."""

    def __init__(self, model: dict, table_bytes: int = TABLE_BYTES):
        self.langs = model["langs"]
        every = np.unique(np.concatenate([g for g, _ in model["grams"].values()]))
        used = np.unique(np.concatenate([(every >> s) & 255 for s in (0, 8, 16, 24)]))
        n, wide = len(used), len(used) + 1  # the last symbol stands for all bytes that training lacks
        self.width, self.symbol = wide, np.full(256, n, np.int32)
        self.symbol[used] = np.arange(n)
        weight = np.ones(wide)
        weight[n] = 256 - n

        def coded(codes: np.ndarray, order: int) -> np.ndarray:  # contexts of so many bytes, as a number in symbols
            out = np.zeros(len(codes), np.int64)
            for s in range(8 * order, 0, -8):
                out = out * wide + self.symbol[(codes >> s) & 255]
            return out

        contexts = [np.zeros(1, np.int64), np.arange(n, dtype=np.int64)]
        contexts.append(np.unique(coded(every, 2)))
        third, back = np.unique(coded(every, 3), return_inverse=True)
        total = np.zeros(len(third))
        for codes, counts in model["grams"].values():
            np.add.at(total, back[np.searchsorted(every, codes)], counts)
        most = max(0, table_bytes // (4 * wide * len(self.langs)) - sum(map(len, contexts)))
        contexts.append(np.sort(third[np.argsort(-total, kind="stable")[:most]]))
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        bits = np.empty((first[-1], wide, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            codes, counts = model["grams"][lang]
            lower = np.full((1, wide), 1 / 256)
            for order, known in enumerate(contexts):
                at = coded(codes, order)
                row = np.searchsorted(known, at)
                ok = (row < len(known)) & (known[np.minimum(row, len(known) - 1)] == at) if len(known) else np.zeros(len(at), bool)
                c = np.zeros((len(known), wide))
                np.add.at(c, (row[ok], self.symbol[codes[ok] & 255]), counts[ok])
                if order == 0:
                    up = np.zeros(1, np.int64)
                else:  # the context without its first byte
                    up = np.searchsorted(contexts[order - 1], known % wide ** (order - 1)) if order > 1 else np.zeros(len(known), np.int64)
                below, seen = lower[up], c > 0
                n_seen, t = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
                free = (np.where(seen, 0, below) * weight).sum(1, keepdims=True)
                escape = np.where(n_seen > 0, t / np.maximum(n_seen + t, 1), 1.0)
                closed = (free <= 0) & (n_seen > 0)  # no byte is left to escape to
                lower = np.where(seen, c / np.maximum(n_seen + np.where(closed, 0, t), 1), escape * below / np.where(free > 0, free, 1))
                bits[first[order] : first[order + 1], :, j] = -np.log2(np.maximum(lower, 1e-300))
        self.bits = bits.reshape(-1, len(self.langs))
        row_of = np.zeros((wide, wide, wide), np.int32)
        row_of[:, :, :n] = first[1] + np.arange(n)
        a, b = np.divmod(contexts[2], wide)
        row_of[:, a, b] = first[2] + np.arange(len(contexts[2]))
        flat = row_of.reshape(-1)
        flat[contexts[3]] = first[3] + np.arange(len(contexts[3]))
        self.row_of = flat

    def total(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        pad = self.symbol[PAD]
        for a, b in slices(offsets, chunk):
            lo, hi = offsets[a], offsets[b]
            for part in range(lo, hi, 8 * chunk):  # a text longer than a chunk goes in parts
                end = min(hi, part + 8 * chunk)
                s = self.symbol[data[max(lo, part - ORDER) : end]]
                lead = part - max(lo, part - ORDER)
                context = np.zeros(len(s), np.int32)
                starts = offsets[a:b] - (part - lead)
                for k in range(ORDER, 0, -1):
                    before = np.empty_like(s)
                    before[k:], before[:k] = s[:-k] if len(s) > k else s[:0], pad
                    for j in range(k):
                        at = starts[(starts >= 0) & (starts + j < len(s)) & (starts + j < offsets[a + 1 : b + 1] - (part - lead))] + j
                        before[at] = pad
                    context = context * self.width + before
                cost = self.bits[self.row_of[context[lead:]].astype(np.int64) * self.width + s[lead:]]
                edges = np.clip(offsets[a : b + 1] - part, 0, end - part)
                full = np.flatnonzero(edges[1:] > edges[:-1])
                if len(full):
                    out[a + full] += np.add.reduceat(cost, edges[full], axis=0, dtype=np.float64)
        return out


def cached(name: str, make):
    """make(), once in a Python worker for each name; the last two names are kept."""
    store = sys.modules.setdefault("_skytally_worker", types.ModuleType("_skytally_worker")).__dict__.setdefault("kept", {})
    if name not in store:
        while len(store) > 1:
            store.pop(next(iter(store)))
        store[name] = make()
    return store[name]


def predict(docs: DataFrame, model: dict, carry: dict[str, Column]) -> DataFrame:
    """The carried columns with lang_pred, score (posterior of the language under equal priors) and bits_per_byte (of its code)."""
    texts = {k: c for k, c in carry.items() if k == "text"} or {"_text": docs["text"]}  # sent once
    rest = {k: c for k, c in carry.items() if k not in texts}
    keep = docs.select(*[c.alias(k) for k, c in rest.items()], docs["text"].rlike(r"\p{L}").alias("_letter"), *[c.alias(k) for k, c in texts.items()])
    names = [*rest, *(k for k in texts if k in carry)]
    kinds = {f.name: f.dataType.simpleString() for f in keep.schema.fields}
    out = ", ".join([f"`{k}` {kinds[k]}" for k in names] + ["lang_pred string", "score double", "bits_per_byte double"])
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_BYTES

    def score(batches):
        import pyarrow as pa

        table = cached(name, lambda: CodeLengths(shared.value)) if shared.value["langs"] else None
        for batch in batches:
            letter = np.asarray(batch.column(batch.num_columns - 2).fill_null(False).to_numpy(zero_copy_only=False), bool)
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            if table is None or batch.num_rows == 0:
                lang, score, rate = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            else:
                bits = table.total(data, offsets)
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                score = np.where(letter, 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1), 0.0)
                rate = np.where(letter, least / np.maximum(offsets[1:] - offsets[:-1], 1), 0.0)
                lang = [table.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(k)) for k in names] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "bits_per_byte"])
            del batch, data, columns
        give_back()

    return keep.mapInArrow(score, out)


def identify(docs: DataFrame, mod: int = 4, remainder: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Trains on the documents that are not held out (crc32 of doc_id as text, mod, remainder) and predicts all."""
    out = held_out(docs, mod, remainder)
    model = train(sample(docs, ~out))
    return predict(docs, model, {"doc_id": docs["doc_id"], "held_out": out} if keep is None else {c: docs[c] for c in keep if c not in ADDED})
