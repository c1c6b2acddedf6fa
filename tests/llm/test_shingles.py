"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import shingles


def plain_set(text):
    words = text.encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_stage_keeps_no_near_copies(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SEGMENT", 600)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words, 30))
    texts = ["", "One two", "one TWO", None, *(" ".join(rng.choice(words, 60)) + " " + line for _ in range(25))]
    for _ in range(90):
        own = texts[rng.integers(4, len(texts))].split()
        for _ in range(rng.integers(1, 4)):
            own[rng.integers(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    sets = [plain_set(t or "") for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {i for i, x in enumerate(label) if x == i}
    assert len(want) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs.limit(7)), "")
    rows = [r["doc_id"] for r in got.collect()]
    assert sorted(rows) == sorted(want)
    assert got.columns == docs.columns
    none = docs.where("doc_id < 0")
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.drop_near_duplicates(spark, nulls, "").count() == len(texts)


def test_steps_release_what_made_them(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(shingles, "collect", lambda s: calls.append(s))
    docs = spark.createDataFrame([(k, f"one two three four five six {k % 2}") for k in range(6)], "doc_id long, text string")
    assert {r["component_id"] for r in shingles.components(docs).collect()} == {0, 1}
    assert len(calls) >= 8


def test_shingles_seen_twice_are_frequent(spark):
    docs = spark.createDataFrame([(k, f"one two three four five six w{k}") for k in range(2)], "doc_id long, text string").coalesce(1)
    often, counts = shingles._frequent(docs)
    assert len(often) == 2 and counts.tolist() == [2, 2]
    assert set(often.tolist()) < set(shingles.shingle_set("one two three four five six w0").tolist())


def test_marks_exclude_no_link():
    rng = np.random.default_rng(5)
    told = 0
    for n in (0, 1, 30, 33, 500, 4000):
        for share in (0.0, 0.5, 0.7, 0.79, 0.8, 0.9, 1.0):
            common = round(n * share)
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[:common], rng.integers(0, 1 << 63, (n - common) // 2, dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            found = shingles.may_link(shingles.mark(x), shingles.mark(y))
            assert found == shingles.may_link(shingles.mark(y), shingles.mark(x))
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                assert found
            elif both < 0.6 * (len(x) + len(y) - both) and n >= 30:
                told += not found
    assert told >= 8


def test_a_shared_passage_is_one_list_and_needs_no_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 15)) + " " + passage for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made, sought = [], []
    lists, needed = shingles.shared_lists, shingles._texts
    monkeypatch.setattr(shingles, "shared_lists", lambda placed: made.append(lists(placed)) or made[0])
    monkeypatch.setattr(shingles, "_texts", lambda d, ids: sought.append(ids.count()) or needed(d, ids))
    assert {r["doc_id"]: r["component_id"] for r in shingles.components(docs).collect()} == {i: i for i in range(40)}
    assert sought == [0, 0]  # Jaccard is about 0.4
    holders = [(s, k, 46, 5 + s, 5, k) for s in range(9) for k in range(40)] + [(99, 0, 46, 3, 0, 0), (99, 1, 46, 3, 0, 1), (98, 7, 46, 4, 0, 7)]
    placed = spark.createDataFrame(holders, "s long, key long, n int, i int, h int, root long")
    rows = [tuple(r)[2:] for r in lists(placed).collect()]
    assert sorted(rows) == sorted([(k, 46, k, 5, 5, 13, 9) for k in range(40)] + [(0, 46, 0, 3, 0, 3, 1), (1, 46, 1, 3, 0, 3, 1)])
