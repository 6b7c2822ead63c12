"""The training-data operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zipfile
import zlib

import pytest

from skytally.llm import balltree, decontam, katz, langid, mixing, omh, preference, queries, repeats, warczip

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "bravo", "the", "of", "delta", "echo", "fox", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "Él"]


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    base = [text(r, 120) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    near = base[0].split()
    near[50] = "changed"
    rows += [(100, base[0], "en", "s1", 5), (101, " ".join(near), "en", None, 5), (102, None, None, "s0", None), (103, "", "en", "", 0), (104, "!!! ...", "en", "s2", 7), (None, base[3], "en", "s0", 1), (105, text(r, 9000), "en", "s0", 1)]
    rows += [rows[2], rows[2]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing_budgets(spark, docs, none):
    out = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-6
    for rows in by.values():
        assert rows[0].target <= 3 * rows[0].source_size and sum(r.taken for r in rows) == int(rows[0].target)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, ["doc_id", "source"]).collect()))
    assert mixing.mix(none).count() == 0
    clash = docs.withColumnRenamed("n_chars", "size")
    assert set(mixing.mix(clash).columns) == {"doc_id", "text", "lang", "source", *mixing.ADDED}


def test_code_lengths_sum_to_one_and_equal_the_recursion():
    rows = [("a", "abracadabra abrac"), ("b", "xyzzy yzx")]
    model = langid.train(rows)
    table = langid.CodeLengths(model)
    import numpy as np

    p = np.exp2(-table.bits.astype(float)).reshape(-1, table.width, 2)
    weight = np.ones(table.width)
    weight[-1] = 257 - table.width
    assert np.allclose((p * weight[None, :, None]).sum(1), 1, atol=1e-4)

    def counts(lang, order):
        out = {}
        for x, t in rows:
            if x == lang:
                b = bytes([10] * 3) + t.encode()
                for i in range(3, len(b)):
                    out.setdefault(b[i - order : i], {}).setdefault(b[i], 0)
                    out[b[i - order : i]][b[i]] += 1
        return out

    trees = {lang: [counts(lang, k) for k in range(4)] for lang in "ab"}

    def prob(lang, context, order):
        if order < 0:
            return {s: 1 / 256 for s in range(256)}
        below = prob(lang, context, order - 1)
        c = trees[lang][order].get(context[3 - order :])
        if not c:
            return below
        n, t = sum(c.values()), len(c)
        free = sum(below[s] for s in range(256) if s not in c)
        return {s: c[s] / (n + t) if s in c else t / (n + t) * below[s] / free for s in range(256)}

    sample = "abra zyx!"
    b = bytes([10] * 3) + sample.encode()
    want = [sum(-np.log2(prob(lang, b[i - 3 : i], 3)[b[i]]) for i in range(3, len(b))) for lang in "ab"]
    data = np.frombuffer(b"".join([sample.encode(), b"", b"q"]), np.uint8)
    got = table.total(data, np.array([0, 9, 9, 10]))
    assert np.allclose(got[0], want, rtol=1e-5) and (got[1] == 0).all()
    assert np.allclose(table.total(data, np.array([0, 9, 9, 10]), chunk=1), got)


def test_language_held_out(spark, none):
    out = queries.op2_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    tested = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in tested) > 0.98 * len(tested)
    assert langid.identify(none).count() == 0


def test_language_of_odd_texts(spark, docs):
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert out[102].lang_pred == out[104].lang_pred == out[103].lang_pred == "und" and out[102].score == 0
    assert out[5].lang_pred == "en" and all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())


def top_by_brute_force(rows, k=5):
    """Whole numbers of any size, row by row."""
    import math

    usable = [(n, i, [math.floor(256 * v) for v in x]) for n, (i, x) in enumerate(rows) if i is not None and x is not None and all(v is not None and math.isfinite(256 * v) for v in x)]
    want = []
    for n, i, q in usable:
        if i % 50 == 0:
            scores = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), j) for m, j, p in usable if m != n and len(p) == len(q)]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(want)


@pytest.mark.parametrize("large", [False, True])
def test_top_k(spark, large):
    import numpy as np

    r = random.Random(2)
    short = lambda x: [float(np.float32(v)) for v in x]
    rows = [(i, short(r.uniform(-1, 1) for _ in range(8))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(900, None), (901, [float("nan")] * 8), (902, [None] + [0.1] * 7), (None, short([0.1] * 8)), (903, [float("inf")] * 8)]
    rows += [rows[50], (50, rows[51][1]), (100, []), (101, []), (150, short([0.5] * 4)), (151, short([0.25] * 4)), (7, rows[7][1])]
    if large:  # beyond doubles' exact range, and beyond a long
        rows += [(1000 + i, short([r.uniform(-1, 1) * 1e6, *[r.uniform(-1, 1)] * 7])) for i in range(20)] + [(1100, short([1e20] * 8)), (1101, short([-1e20] * 8)), (1102, short([3e38] * 8))]
    v = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "vec_id long, embedding array<float>, q string, number int")
    got = balltree.top_k(v, v["vec_id"] % 50 == 0, shard_rows=60, block_rows=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == top_by_brute_force(rows)
    if not large:
        assert sorted(map(tuple, balltree.top_k(v, v["vec_id"] % 50 == 0).collect())) == top_by_brute_force(rows)
        assert balltree.top_k(v.limit(0), v["vec_id"] % 50 == 0).count() == 0


def test_decontamination(spark, docs, none):
    own = docs.where("doc_id = 5").first().text.split()
    items = spark.createDataFrame([(1, " ".join(own[20:35]).upper().replace("É", "é")), (2, "nothing here"), (3, None), (4, own[3]), (1, "another text of one id")], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.find(docs.where("doc_id is not null"), items).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(lower))
    windows = set()
    for i in items.collect():
        w = cut(i.text)
        n = min(10, len(w))
        windows |= {(str(i.item_id), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    for d in docs.where("doc_id is not null").collect():
        w, hit, names = cut(d.text), set(), set()
        for name, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    names.add(name)
        assert (out[d.doc_id].n_words, out[d.doc_id].n_hit, list(out[d.doc_id].items)) == (len(w), len(hit), sorted(names))
    assert decontam.find(none, items).count() == 0 and decontam.clean(docs, items.limit(0)).count() == docs.count()


def test_proximity_matches(spark):
    r = random.Random(4)
    terms = [f"t{i}" for i in range(10)]
    noise = lambda n: [f"n{r.randrange(200)}" for _ in range(n)]
    mixed = r.sample(terms, 10)
    rows = [(1, noise(20) + mixed[:5] + noise(3) + mixed[5:] + noise(20)), (2, noise(5) + mixed[:9] + noise(30)), (3, noise(5) + mixed[:8] + noise(30)), (4, mixed[:5] + noise(30) + mixed[5:]), (5, noise(40)), (None, mixed)]
    d = spark.createDataFrame([(i, " ".join(w), "x", 0) for i, w in rows] + [(6, None, "x", 0)], "doc_id long, text string, item string, pos int")
    items = spark.createDataFrame([(1, " ".join(terms)), (2, None)], "item_id long, text string")
    got = {(x.doc_id, x.name) for x in decontam.near(d, items).collect()}
    assert got == {(1, "1"), (2, "1"), (None, "1")}
    for x in decontam.near(d, items, missing=0).collect():
        words = dict((str(i), w) for i, w in rows)[str(x.doc_id)]
        assert any(set(terms) <= set(words[s : s + 15]) for s in range(max(0, x.pos - 14), x.pos + 1))
    assert {x.doc_id for x in decontam.near(d, items, missing=0).collect()} == {1, None}
    assert decontam.near(d.limit(0), items).count() == 0 and decontam.near(d, items.limit(0)).count() == 0


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "alone"), (None, 0, None, None), (6, None, "user", "x"), (7, None, "user", "y")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    s = preference.segments(t, (t["conv_id"] / 2).cast("long"), t["conv_id"] % 2 == 0)
    got = sorted((str(r.pair_id), r.part, r.role, r.loss) for r in s.collect())
    assert got == sorted([("0", "prompt", "user", False), ("0", "chosen", "assistant", True), ("0", "rejected", "assistant", True), ("1", "prompt", "user", False), ("2", "chosen", "user", False), ("None", "chosen", "", False), ("3", "chosen", "user", False), ("3", "rejected", "user", False)])
    one = {r.pair_id: r for r in preference.assemble(s).collect()}[0]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.chosen_loss[0]["to"] == len(one.chosen)


class Katz:
    """The model of the docstring, word by word."""

    def __init__(self, texts):
        import collections

        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        self.cut = lambda x: re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(lower)) + [None]  # None: the end
        self.one, self.two = collections.Counter(), collections.defaultdict(collections.Counter)
        for x in texts:
            before = ""
            for w in self.cut(x):
                self.one[w] += 1
                self.two[before][w] += 1
                before = w
        self.total = sum(self.one.values())
        self.d1, self.d2 = self.discounts(self.one.values()), self.discounts([c for x in self.two.values() for c in x.values()])

    @staticmethod
    def discounts(counts):
        n = [sum(c == r for c in counts) for r in range(7)]
        q = 6 * n[6] / n[1] if n[1] else 1.0
        d = {}
        for r in range(1, 6):
            x = ((r + 1) * n[r + 1] / (n[r] * r) - q) / (1 - q) if n[r] and q < 1 else 0
            d[r] = x if 0 < x < 1 else (r - 0.5) / r
        return lambda r: d.get(r, 1.0)

    def unigram(self, w):
        kept = sum(self.d1(c) * c for c in self.one.values())
        below = self.total if kept < self.total else self.total + 1
        return self.d1(self.one[w]) * self.one[w] / below if self.one[w] else 1 - kept / below if self.total else 1.0

    def prob(self, h, w):
        seen = self.two.get(h)
        if not seen:
            return self.unigram(w)
        size, kept = sum(seen.values()), sum(self.d2(c) * c for c in seen.values())
        below = size if min(seen.values()) <= 5 else size + 1
        if w in seen:
            return self.d2(seen[w]) * seen[w] / below
        return (1 - kept / below) / (1 - sum(self.unigram(v) for v in seen)) * self.unigram(w)

    def score(self, x):
        import math

        out, before = 0.0, ""
        for w in self.cut(x):
            out, before = out + math.log10(self.prob(before, w)), w
        return out


@pytest.mark.parametrize("hot", [300_000, 20])
def test_katz_by_brute_force(spark, docs, none, hot, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "PARTITION_TOKENS", 300)
    monkeypatch.setattr(katz, "BATCH_BYTES", 4000)
    r = random.Random(5)
    kinds = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(kinds, [1 / (k + 1) for k in range(60)], k=r.randrange(0, 60))).replace("w1 ", "W1\n")) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "w1 w2 never"), (202, "unseen words only"), rows[3], rows[3], (203, " ".join(r.choices(kinds, k=4000)))]
    d = spark.createDataFrame([(i, x, "x", 1.0) for i, x in rows], "doc_id long, text string, bucket string, score double")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Katz([x for i, x in rows if not held(i)])
    for h in ("", "w0", "w5", "w59", "w30"):  # every context sums to one over all words, the end and the unknown class
        assert abs(sum(model.prob(h, w) for w in [*model.one, "an unknown word"]) - 1) < 1e-9
    got = sorted(((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.score, 7)) for x in katz.score(d).collect()))
    want = sorted((str(i), held(i), len(model.cut(x)), sum(model.one[w] > 0 for w in model.cut(x)), model.total, round(model.score(x), 7)) for i, x in rows)
    assert got == want
    if hot > 20:
        assert katz.score(none).count() == 0 and katz.score(docs).count() == docs.count()


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "http://c/\n", "é" * 5000), (5, "http://c/", "é" * 5000)], "page_id long, url string, html string")
    manifest = warczip.write_archives(pages, f"{tmp_path}/archives")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warczip.read_archives(manifest).collect())
    sha = lambda t: warczip.base32_sha1(t.encode())
    assert got == [(1, "revisit", 2, 4, sha("same")), (2, "response", None, 4, sha("same")), (3, "revisit", 4, 0, sha("")), (4, "response", None, 0, sha("")), (5, "response", None, 10000, sha("é" * 5000)), (5, "response", None, 10000, sha("é" * 5000))]
    for row in manifest.select("path").distinct().collect():
        path = row.path.replace("file:", "")
        with zipfile.ZipFile(path) as z:
            file, ours = warczip.open_archive(row.path)
            assert set(z.namelist()) == {warczip.DATA, warczip.INDEX} == set(ours.members) and z.testzip() is None
            start, length = ours.where(warczip.INDEX)
            file.close()
            with open(path, "rb") as f:
                raw = f.read()
            assert raw[start : start + length] == z.read(warczip.INDEX)
            assert b"PK\x06\x06" in raw[-140:] and b"PK\x06\x07" in raw[-50:]  # the ZIP64 end record and its locator
            assert raw[-12:-2] == b"\xff" * 8 + b"\xff\xff" or raw[-6:-2] == b"\xff" * 4  # the plain record points to them
    assert warczip.read_archives(warczip.write_archives(pages.limit(0))).count() == 0


def test_many_archives_and_slices(spark, tmp_path, monkeypatch):
    """Archives end after so many bytes, indexes are read in parts; a null page_id, and columns of clashing names."""
    monkeypatch.setattr(warczip, "SLICE", 7)
    rows = [(None if i == 5 else i, f"http://h/{i}", f"text {i % 50} " * 40) for i in range(120)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, kind int").repartition(2)
    manifest = warczip.write_archives(pages, f"{tmp_path}/many", archive_bytes=3000)
    assert manifest.select("path").distinct().count() > 4 and manifest.count() > 8
    got = sorted(((str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_bytes) for r in warczip.read_archives(manifest).collect()))
    largest = {}
    for i, _, x in rows:
        largest[x] = max(largest.get(x, -1), -1 if i is None else i)
    want = [(str(i), u, "response" if i == largest[x] else "revisit", None if i == largest[x] else largest[x], len(x)) for i, u, x in rows]
    assert got == sorted(want)


def test_archives_of_other_writers(tmp_path):
    """Without ZIP64 records, with a comment, and with a name that needs them."""
    import io

    for comment in (b"", b"PK\x05\x06 a comment"):
        with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_STORED) as z:
            z.comment = comment
            z.writestr("one", b"1" * 100)
            z.writestr("two", b"22")
        raw = out.getvalue()
        ours = warczip.ZipReader(lambda at, n, raw=raw: raw[at : at + n], len(raw))
        at, n = ours.where("two")
        assert raw[at : at + n] == b"22" and set(ours.members) == {"one", "two"}
    with pytest.raises(ValueError):
        warczip.ZipReader(lambda at, n: b"x" * n, 100)


@pytest.mark.parametrize("most", [50_000, 1])
def test_repeats_by_brute_force(spark, docs, none, most, monkeypatch):
    monkeypatch.setattr(repeats, "COLLECTION", most)
    rows = [(i, r.text) for i, r in enumerate(docs.collect())] + [(500, "ab" * 300), (501, "x" + "ab" * 120 + "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    for r in repeats.drop_repeats(d).collect():
        b = (r.text or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = b"\1" * 200
        assert bytes(r.kept) == bytes(x for x, m in zip(b, cover, strict=True) if not m) and r.n_removed == sum(cover)
        assert r.n_spans == sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
    assert repeats.drop_repeats(none).count() == 0


def test_anchors_do_not_depend_on_the_size_of_the_data(monkeypatch):
    """Hashes that agree in their upper 28 bits tie in data of every size."""
    import numpy as np

    monkeypatch.setattr(repeats, "mixed", lambda x, own=repeats.mixed: own(x) >> np.uint64(28))
    data = np.random.default_rng(5).integers(97, 123, (1 << 24) + 500).astype(np.uint8)
    small = repeats.anchors(data[:400], np.array([0, 400]))
    large = repeats.anchors(data, np.array([0, 400, len(data)]))
    assert [list(small[k]) for k in ("lo", "at")] == [list(large[k][large["text"] == 0]) for k in ("lo", "at")]


def test_one_way_digest_of_kept_text(spark):
    r = queries.op10_repeats(spark, "/root/testdata/sf0.001").first()
    assert len(r.kept_sha256) == len(hashlib.sha256().hexdigest())
