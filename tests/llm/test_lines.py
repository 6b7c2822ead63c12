"""Fuzzy line deduplication against brute force: every pair of lines, SimHashes and distances computed apart."""

import random
import re
import struct

import pytest
import xxhash

from skytally.llm import linedup, linking

SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in ("a", "en", "i", "or", "u")]


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 2, 2, 3, 3, 4])))


def line_of(r, words):
    return " ".join(word(r) for _ in range(words)) if words else "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40))


def edited(r, line, share, by_word):
    """line with about share of its words, or of its characters, changed."""
    parts = line.split(" ") if by_word else list(line)
    for i in r.sample(range(len(parts)), max(1, round(share * len(parts)))):
        parts[i] = word(r) if by_word else r.choice("qxyz")
    return (" " if by_word else "").join(parts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def hashed(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def simhash(line):
    """The 8 blocks, feature by feature and bit by bit."""
    f = [hashed(w.encode()) for w in line.split(" ") if len(w) >= linedup.FEATURE]
    if len(f) < linedup.MIN_WORDS:
        f = [hashed(line[i : i + 3].encode()) for i in range(max(1, len(line) - 2))]
    out = []
    for hashes in (f, [hashed(struct.pack("<Q", x), hashed(struct.pack("<i", 1))) for x in f]):
        bits = [2 * sum(x >> b & 1 for x in hashes) > len(hashes) - len(hashes) % 2 for b in range(64)]
        out += [sum(bits[16 * k + i] << i for i in range(16)) for k in range(4)]
    return out


def normal(line):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", line.lower()).strip(" ")


def brute(rows):
    """The texts that stay: (doc_id, text) in the order of rows, which differ."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    lines = {}
    for i, t in order:
        for nth, x in enumerate((t or "").split("\n") if t is not None else []):
            if normal(x):
                lines.setdefault(normal(x), []).append((i is None, i or 0, nth))
    names = list(lines)
    blocks = [simhash(x) for x in names]
    group = {x: x for x in names}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            if sum(x == y for x, y in zip(blocks[i], blocks[j], strict=True)) >= 2 and distance(a, names[j]) <= int(max(len(a), len(names[j])) * 0.2 + 1e-9):
                group[root(a)] = root(names[j])
    first = {}
    for x in names:
        first.setdefault(root(x), []).extend(lines[x])
    keep = {k: min(v) for k, v in first.items()}
    out = []
    for i, t in rows:
        stay = [x for nth, x in enumerate((t or "").split("\n")) if not normal(x) or keep[root(normal(x))] == (i is None, i or 0, nth)]
        out.append((i, None if t is None else "\n".join(stay)))
    return out


def test_lines_by_brute_force(spark):
    r = random.Random(3)
    base = [line_of(r, n) for n in [0, 1, 2, 4, 6, 9, 15, 15, 30, 30, 60, 140, 400]]
    rows = [(100, None), (101, ""), (102, "\n\n"), (103, "--- !!\n..."), (None, base[8] + "\nonly here " + line_of(r, 8))]
    for i in range(40):
        own = [edited(r, r.choice(base), share, r.random() < 0.5) if share else r.choice(base) for share in r.choices([0, 0.02, 0.05, 0.1, 0.3], k=4)]
        rows.append((i, "\n".join([*own, line_of(r, 12).upper() + "!"])))
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, line string, id int")
    out = linedup.dedup_lines(d)
    assert out.columns == d.columns
    key = lambda x: (x[0] is None, x[0] or 0)
    want = sorted(brute(rows), key=key)
    assert sorted([(x.doc_id, x.text) for x in out.collect()], key=key) == want
    assert sum(len(t or "") for _, t in want) < 0.8 * sum(len(t or "") for _, t in rows)


def test_equal_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "one line\nshort"), (1, "one line\nshort"), (2, "ONE line!")], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in linedup.dedup_lines(d).collect()) == [(1, "one line\nshort"), (1, "one line\nshort"), (2, "")]
    assert linedup.dedup_lines(d.limit(0)).count() == 0


def test_lines_are_hashed_once_whatever_their_features(spark):
    """SimHashes of lines around the bounds of a run; lines of few features aren't read by the branch of many."""
    r = random.Random(11)
    lines = ["abcd " * n + "abcde" for n in (4, 5, 126, 127, 128, 300)] + ["ab " * n + "abcd efgh" for n in (40, 43, 60, 300)] + [line_of(r, n) for n in (3, 4, 5, 30, 100, 130)] + ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) for n in (2, 129, 130, 700)]
    d = spark.createDataFrame([(i, i, len(x), x) for i, x in enumerate(lines)], "row long, id long, size int, line string")
    hashes = linedup.simhashes(d)
    got = {x.id: [(x[f"s{h}"] >> 16 * k) & 0xFFFF for h in (0, 1) for k in range(4)] for x in hashes.collect()}
    assert got == {i: simhash(x) for i, x in enumerate(lines)}
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(hashes).count("filter(split(") == 2  # one for each branch
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert plan(linedup.occurrences(docs)).count("regexp_replace(") == 1


def test_six_bits_always_leave_two_blocks(spark):
    """Pigeonhole: hashes that differ in at most 6 of 128 bits share a key, whichever bits these are."""
    r = random.Random(6)
    rows = []
    for i in range(300):
        a = r.getrandbits(128)
        b = a
        for bit in r.sample(range(128), 6):
            b ^= 1 << bit
        signed = lambda x: [struct.unpack("<q", struct.pack("<Q", x >> s & (1 << 64) - 1))[0] for s in (0, 64)]
        rows.append((i, signed(a), signed(b)))
    d = spark.createDataFrame(rows, "id long, a array<long>, b array<long>")
    from pyspark.sql import functions as F

    keys = F.flatten(F.array(*[linedup.block_keys(k) for k in range(1, linedup.BLOCKS // 2 + 1)]))
    both = d.select("id", F.col("a").alias("sim")).select("id", keys.alias("ka")).join(d.select("id", F.col("b").alias("sim")).select("id", keys.alias("kb")), "id")
    assert both.where("size(ka) = 28 AND arrays_overlap(ka, kb)").count() == 300


#: words of a line (0: 40 characters without spaces), whether words or characters are changed, their share, least share of such pairs that are linked
RECALL = [(40, True, 0.025, 0.65), (40, True, 0.05, 0.35), (20, True, 0.05, 0.35), (20, True, 0.1, 0.1), (10, True, 0.1, 0.1), (5, False, 0.03, 0.1), (0, False, 0.025, 0.2)]


@pytest.mark.parametrize("words,by_word,share,least", RECALL)
def test_similar_lines_meet(words, by_word, share, least):
    """The share of edited pairs that meet; the README has the table."""
    r = random.Random(9)
    lines = [line_of(r, words) for _ in range(300)]
    met = sum(sum(x == y for x, y in zip(simhash(a), simhash(edited(r, a, share, by_word)), strict=True)) >= 2 for a in lines) / 300
    print("recall", words, by_word, share, met)
    assert met >= least


@pytest.mark.parametrize("linked", [{(38, 39)}, {(0, 1), (1, 2)}, {(0, 39), (25, 39), (25, 26)}, {(i, i + 1) for i in range(39)}])
def test_links_of_a_crowded_bucket_of_unlike_members(spark, linked, tmp_path):
    """One shared bucket, 40 members: a link behind unlike leaders is found, and so is one of a member that has joined another."""
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(i, 10, [7, 100 + i]) for i in range(40)] + [(50, 10, [8, 9]), (51, 10, [8])], "id long, size int, one array<long>")
    items = items.withColumn("two", F.array(F.lit(5).cast("long"), F.col("id")))
    truth = spark.createDataFrame(sorted(linked), "a long, b long")
    for keys in (["one"], ["two", "one"]):
        roots = linking.link(items, [F.col(k) for k in keys], lambda folder, members: lambda pairs: pairs.join(truth, ["a", "b"]), f"{tmp_path}/{keys[0]}")
        groups = {}
        for r in roots.collect():
            groups.setdefault(r.root, set()).add(r.id)
        want = [{38, 39}] if (38, 39) in linked and len(linked) == 1 else [{0, 1, 2}] if len(linked) == 2 else [{0, 25, 26, 39}] if len(linked) == 3 else [set(range(40))]
        assert list(groups.values()) == want


def test_equal_ends_are_left_out_of_the_alignment(spark, tmp_path):
    """Pairs of texts that share long ends, or nothing, or one of which lies within the other, against the plain distance; of equal ends a 64th of the text is left at most."""
    from pyspark.sql import functions as F

    r = random.Random(2)
    texts = []
    for n in (1, 2, 7, 40, 130, 300):
        for _ in range(4):
            x = "".join(r.choice("abé漢 ") for _ in range(n))
            at = r.randrange(n)
            texts += [(x, x), (x, x[:at] + "zz" + x[at + 1 :]), (x, x[: n - n // 5]), (x, x[n // 4 :]), (x, x[::-1]), (x, edited(r, x, 0.19, False)), (x, edited(r, x, 0.3, False))]
    rows = spark.createDataFrame([(2 * i + j, t[j]) for i, t in enumerate(texts) for j in (0, 1)], "id long, x string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(texts))], "a long, b long")
    got = {x.a // 2 for x in linking.edit_similar(rows, 0.8, unique=True)(str(tmp_path), rows)(pairs).collect()}
    assert got == {i for i, (x, y) in enumerate(texts) if distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9)}
    one = spark.createDataFrame([("p" * 640 + "one" + "s" * 640, "p" * 640 + "two" + "s" * 640)], "x string, y string").select(F.array(F.struct("x", "y")).alias("s"))
    left = one.select(F.expr(f"transform(transform(s, {linking.REST}), {linking.REST})[0].x").alias("x")).first().x
    assert "one" in left and len(left) < 64


def test_scattered_edits_need_no_whole_alignment(spark):
    """Long lines with words replaced, left out or added here and there are linked by their pieces alone; pieces never link what is too far apart."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    near, far = [], []
    for n in (60, 90, 150):
        for _ in range(6):
            words = line_of(r, n).split(" ")
            other = list(words)
            for i in sorted(r.sample(range(5, n - 5), n // 30), reverse=True):
                other[i : i + 1] = r.choice([[word(r)], [], [word(r), other[i]]])
            near.append((" ".join(words), " ".join(other)))
            far += [(" ".join(words), edited(r, " ".join(words), share, True)) for share in (0.15, 0.25, 0.3, 0.5)]
    rows = [(x, y, int(max(len(x), len(y)) * 0.2 + 1e-9)) for x, y in near + far]
    d = spark.createDataFrame(rows, "x string, y string, most int").select(F.expr(f"transform(array(named_struct('x', x, 'y', y, 'most', most)), s -> {linking.PIECES})[0]").alias("linked"))
    linked = [x.linked for x in d.collect()]
    assert all(linked[: len(near)])
    apart = [distance(x, y) > most for x, y, most in rows]
    assert any(apart) and not any(a and b for a, b in zip(apart, linked, strict=True))


def test_features_are_grouped_and_single_spaces_stay(spark):
    """Features are rows of up to NIBBLE, and what is replaced is punctuation and runs of spaces, not single spaces."""
    assert linedup.NIBBLE <= 7  # a counter of four bits, the highest of which is the sign
    lines = spark.createDataFrame([(" ".join(["abcd"] * n),) for n in (5, 7, 8, 14, 15)], "line string")
    from pyspark.sql import functions as F

    assert [[len(g) for g in x.g] for x in lines.select(F.expr(linedup.GROUPS).alias("g")).collect()] == [[5], [7], [7, 1], [7, 7], [7, 7, 1]]
    assert re.findall(linedup.OTHER, "a b  c, d .e\n f\t\n") == ["  ", ", ", " .", "\t"]
