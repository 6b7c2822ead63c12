"""The pipeline: each stage against brute force over its own input, odd tables, and clashing columns."""

import random
import re

import pytest
from test_lines import brute as lines_left
from test_near import brute as near_groups

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, doc string, size long, root long, id long"
LANGS = {"en": "the of and that with from this there which would", "de": "der die und nicht ist auch eine werden sich mit", "fr": "le les des une pour dans que qui avec sont"}


def text(r, lang, n):
    return " ".join(r.choice(LANGS[lang].split()) + r.choice(["", "", "a", "en", "is"]) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    folder = str(tmp_path_factory.mktemp("tables"))
    base = [(i, "\n".join(text(r, lang, 25) for _ in range(4)), lang, f"s{i % 3}") for i, lang in enumerate(list(LANGS) * 14)]
    rows = base + [(100, base[0][1], "en", "s0"), (101, None, None, "s1"), (102, "", "en", None), (103, "12 34 !!", "en", "s1"), (104, text(r, "de", 60), None, None), (None, base[5][1] + " more", "fr", "s2")]
    rows += [(105, " ".join([*base[4][1].split()[:50], "other", *base[4][1].split()[51:]]), "de", "s0"), (3, base[3][1], "en", "s0")]
    full = [(i, t, lang, s, len(t or ""), 7.0, "mine", "d", 3, 4, i) for i, t, lang, s in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(base[7][1].split()[10:30])), (2, "not here at all"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages_by_brute_force(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    plain = lambda df: [r.asDict() for r in df.collect()]
    by_id = lambda rows: {r["doc_id"]: r for r in rows}

    first = stages["language_id"](spark, docs, folder)
    assert first.columns == docs.columns
    one, before = plain(first), plain(docs)
    assert sorted(str(r["doc_id"]) for r in one) == sorted(str(r["doc_id"]) for r in before if re.search("[a-z]", r["text"] or ""))
    assert by_id(one)[104]["lang"] == "de" and all(r == by_id(before)[i] for i, r in by_id(one).items() if i != 104)

    rows = [r for n, r in enumerate(one) if r not in one[:n]]
    second = stages["line_dedup"](spark, spark.createDataFrame(rows, docs.schema), folder)
    assert second.columns == docs.columns
    two = plain(second)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted([(r["doc_id"], r["text"]) for r in two], key=key) == sorted(lines_left([(r["doc_id"], r["text"]) for r in rows]), key=key)
    assert all(r["n_chars"] == len(r["text"]) and r["score"] == 7.0 for r in two)

    third = stages["near_dedup"](spark, docs, folder)  # of all documents, as equal lines are gone from the last
    assert third.columns == docs.columns
    three = plain(third)
    groups = near_groups([r["text"] for r in before])
    assert len(three) == len(set(groups))
    least = {}
    for r, g in zip(before, groups, strict=True):
        least[g] = min(least.get(g, 2**63), 2**63 if r["doc_id"] is None else r["doc_id"])
    assert sorted(2**63 if r["doc_id"] is None else r["doc_id"] for r in three) == sorted(least.values())

    fourth = stages["decontamination"](spark, third, folder)
    assert fourth.columns == docs.columns
    cut = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    windows = {tuple(w[k : k + min(10, len(w))]) for _, t in items for w in [cut(t)] for k in range(max(1, len(w) - 9)) if w}
    dirty = lambda t: any(tuple(w[k : k + n]) in windows for w in [cut(t)] for n in {len(x) for x in windows} for k in range(len(w)))
    four = plain(fourth)
    assert sorted(str(r["doc_id"]) for r in four) == sorted(str(r["doc_id"]) for r in three if not dirty(r["text"])) and len(four) == len(three) - 1

    five = plain(stages["mix_sources"](spark, fourth, folder))
    sizes, goal, words = {}, {}, {}
    for r in four:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    for r in five:
        assert 0 < r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        goal[r["source"]] = r["target"]
        words[r["source"]] = words.get(r["source"], 0) + r["taken"]
    assert all(words[s] == int(goal[s]) for s in goal) and abs(sum(goal.values()) - sum(sizes.values())) < 1e-6


def test_run_and_empty_table(spark, tables, tmp_path):
    folder, _ = tables
    out = pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {7, 101, 102, 103} and ids and all(r.taken > 0 for r in out)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
