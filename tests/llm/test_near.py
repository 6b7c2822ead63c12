"""Near-duplicate documents against brute force, and the recall of their sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import omh
from skytally.llm.common import text_buffer
from skytally.llm.tokens import LOWER


#: words of a text, share of them changed, least share of such pairs that meet
RECALL = [(10, 0.05, 0.95), (10, 0.1, 0.6), (20, 0.1, 0.95), (20, 0.15, 0.8), (20, 0.2, 0.55), (40, 0.15, 0.9), (40, 0.2, 0.7), (100, 0.15, 0.95), (100, 0.2, 0.83), (400, 0.1, 0.98), (400, 0.15, 0.97), (400, 0.2, 0.86)]


def words(r, n, kinds=5000):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def edited(r, w, share):
    w = list(w)
    for i in r.sample(range(len(w)), round(share * len(w))):
        how = r.random()
        if how < 0.6:
            w[i] = f"x{r.randrange(10**6)}"
        elif how < 0.8:
            w[i] = ""
        else:
            w[i] += f" y{r.randrange(10**6)}"
    return [x for x in " ".join(w).split(" ") if x]


def sketch(texts):
    import pyarrow as pa

    data, offsets = text_buffer(pa.array(texts))
    return omh.sketches(*omh.words_of(LOWER[data], offsets))


@pytest.mark.parametrize("n,share,least", RECALL)
def test_similar_texts_meet(n, share, least):
    """The share of pairs whose words were changed in scattered places (replaced, left out, added) that agree in a sketch."""
    r = random.Random(n)
    base = [words(r, n) for _ in range(400)]
    a, b = sketch([" ".join(x) for x in base]), sketch([" ".join(edited(r, x, share)) for x in base])
    met = float((a == b).any(axis=1).mean())
    print("recall", n, share, met)
    assert met >= least


def distance(a, b):
    a, b = np.array(a), np.array(b)
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def brute(rows):
    """The sets of places of rows that belong together."""
    cut = [[w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "")).lower().split(" ") if w] for t in rows]
    s = sketch([t or "" for t in rows])
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            meets = cut[i] == cut[j] and (cut[i] or (rows[i] or "") == (rows[j] or "")) or cut[i] and cut[j] and ((s[i] == s[j]) & (s[i] != 0)).any()
            if meets and distance(cut[i], cut[j]) <= int(0.2 * max(len(cut[i]), len(cut[j])) + 1e-9):
                group[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_groups_by_brute_force(spark):
    r = random.Random(12)
    base = [words(r, n) for n in (3, 4, 5, 9, 30, 60, 60, 120, 300)]
    texts = [None, "", "!!!", "!!!", "one", "One"] + [" ".join(x) for x in base]
    passage = " ".join(words(r, 50))
    texts += [" ".join(words(r, 12)) + " " + passage + " " + " ".join(words(r, 3)) for _ in range(30)]  # unlike texts of one passage
    texts += [" ".join(edited(r, r.choice(base), r.choice([0, 0.03, 0.1, 0.2, 0.3]))) for _ in range(120)]
    rows = [(None if i == 20 else i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7])]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, id int, root string")
    root = brute([t for _, t in rows])
    least, many = {}, {}
    for (i, _), g in zip(rows, root, strict=True):
        least[g] = min(least.get(g, 2**63), 2**63 if i is None else i)
        many[g] = many.get(g, 0) + 1
    want = sorted(((i, least[g], many[g]) for (i, _), g in zip(rows, root, strict=True)), key=str)
    got = sorted(((x.doc_id, 2**63 if x.class_id is None else x.class_id, x.n_class) for x in omh.near_duplicates(d).collect()), key=str)
    assert got == want
    kept = omh.keep(d)
    assert kept.columns == d.columns and kept.count() == len(least)
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted(v for v in least.values() if v < 2**63)


def test_nothing_to_link(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string")
    assert {(x.doc_id, x.class_id, x.n_class) for x in omh.near_duplicates(d).collect()} == {(1, 1, 1), (2, 2, 1)}
    assert omh.near_duplicates(d.limit(0)).count() == 0 and omh.keep(d.where(F.lit(False))).count() == 0


def test_similar_texts_have_a_rare_gram_in_common():
    """Whatever the counts are: texts as far apart as is allowed share a token, and a text's tokens differ."""
    import pyarrow as pa

    r = random.Random(4)
    for _ in range(300):
        a = [r.randrange(12 if r.random() < 0.5 else 900) for _ in range(r.randrange(1, 60))]
        b = list(a)
        for _ in range(r.randrange(len(a) // 5 + 2)):
            at, how = r.randrange(len(b) + 1), r.random()
            b[at : at + (how < 0.7)] = [r.randrange(900)] * (how > 0.3)
        if not b or distance(a, b) > int(0.2 * max(len(a), len(b)) + 1e-9):
            continue
        coded = pa.array(["".join(chr(omh.FIRST_CHARACTER + x) for x in t) for t in (a, b, [])])
        counts = np.random.default_rng(len(a)).integers(0, 5, 64)
        token, take = omh.rarest(*omh.grams(coded), counts)
        one, two = set(token[: take[0]].tolist()), set(token[take[0] :].tolist())
        assert take.tolist() == [2 * int(0.2 * len(a) + 1e-9) + 1, 2 * int(0.2 * len(b) + 1e-9) + 1, 0] and len(one) == take[0] and one & two


def test_unlike_texts_of_one_passage_are_not_held_against_each_other(spark, tmp_path):
    """150 texts in one bucket: a chain of three is found, and few of the 11,175 pairs are tested."""
    from skytally.llm import linking

    r = random.Random(5)
    passage = words(r, 30)
    texts = [passage + words(r, 30, 10**6) for _ in range(148)]
    texts += [texts[40][:54] + words(r, 6, 10**6), texts[40][:50] + words(r, 10, 10**6)]
    data, offsets = text_buffer(__import__("pyarrow").array([" ".join(t) for t in texts]))
    hashes, begin = omh.words_of(data, offsets)
    rows = [(i, 60, [1], omh.coded(hashes[begin[i] : begin[i + 1]]).decode()) for i in range(len(texts))]
    items = spark.createDataFrame(rows, "id long, size int, one array<long>, x string")
    tested = []

    def verifier(folder, members):
        verify = linking.edit_similar(items.select("id", "x"), 0.8, unique=True, kinds=True)(folder, members)

        def counted(pairs):
            tested.append(pairs.count())
            return verify(pairs)

        return counted

    roots = linking.link(items.select("id", "size", "one"), [F.col("one")], verifier, f"{tmp_path}/links", 0.8, omh.rare_grams(items.select("id", "x")))
    assert {(x.id, x.root) for x in roots.collect()} == {(40, 40), (148, 40), (149, 40)}
    assert sum(tested) < 400


def crowd(texts):
    """Items (id, size, one, two, x) of texts that all share the bucket 1, and every other one of them one more."""
    hashes, begin = omh.words_of(*text_buffer(__import__("pyarrow").array([" ".join(t) for t in texts])))
    return [(i, len(t), [1], [2 + i % 2], omh.coded(hashes[begin[i] : begin[i + 1]]).decode()) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [8192, 40])
def test_a_large_group_and_unlike_texts_of_its_passage(spark, tmp_path, monkeypatch, block):
    """71 near copies and 15 texts that are farther from these, in one bucket: groups as by brute force, and few of the 1,065 pairs of both kinds are tested."""
    from skytally.llm import linking

    monkeypatch.setattr(linking, "BLOCK", block)
    r = random.Random(8)
    base = words(r, 60)
    texts = [base]
    for n in [3] * 70 + [24] * 15:
        t = list(base)
        for i in r.sample(range(60), n):
            t[i] = f"z{r.randrange(10**6)}"
        texts.append(t)
    texts.append(texts[80][:55] + words(r, 5, 10**6))  # of a text that is unlike the large group
    rows = crowd(texts)
    items, tested = spark.createDataFrame(rows, "id long, size int, one array<long>, two array<long>, x string"), []

    def verifier(folder, members):
        verify = linking.edit_similar(items.select("id", "x"), 0.8, unique=True, kinds=True)(folder, members)

        def counted(pairs):
            tested.append(pairs.count())
            return verify(pairs)

        return counted

    roots = linking.link(items.select("id", "size", "one", "two"), [F.col("one"), F.col("two")], verifier, f"{tmp_path}/links", 0.8, omh.rare_grams(items.select("id", "x")))
    got = {x.id: x.root for x in roots.collect()}
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if distance(texts[i], texts[j]) <= 12 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert got == {i: g for i, g in enumerate(group) if group.count(g) > 1} and group[86] == group[80] != 0
    assert sum(tested) < 400


def test_few_links_are_connected_on_the_driver_as_others_by_spark(spark, tmp_path):
    from skytally.llm import linking
    from skytally.llm.common import materialise

    r = random.Random(6)
    edges = [(r.randrange(400), 1000 + r.randrange(400)) for _ in range(300)] + [(5000 + i, 5001 + i) for i in range(40)] + [(-7, 3)]
    d = spark.createDataFrame(edges, "a long, b long")
    here = linking.components(materialise(d, str(tmp_path), "edges"), str(tmp_path))
    there = linking.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path))
    assert sorted(here.collect()) == sorted(there.collect()) and here.columns == there.columns
