"""The pipeline against plain versions of its stages, with the near-duplicate rule of five words and 0.8."""

import hashlib
import os

import corpus_pipeline
import pytest

from loomspan.llm import common, decontaminate
from tests.llm.test_operators import plain_repeats
from tests.llm.test_shingles import plain_set

SMALL = "/root/testdata/sf0.001"


def test_stages_take_five_words_and_eight_tenths(spark):
    if not os.path.exists(SMALL):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL).toPandas()
    rows = sorted((int(i), t) for i, t in zip(kept.doc_id, kept.text))
    sets = {i: plain_set(t or "") for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if j < i and label[i] != label[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if x == old else x for k, x in label.items()}
    rows = [(i, t) for i, t in rows if label[i] == i]
    digest = {r[0]: r[4] for r in plain_repeats(rows)}
    items = [decontaminate._plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = common.made()
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()}
    assert len(set(common.made()) - set(before)) == 1  # the last stage's result; the rest is swept
    cut = corpus_pipeline.cut_repeats(spark, corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(kept), SMALL), SMALL)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(texts) == {i for i, _ in rows}
    whole = [i for i, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == digest[i]]
    assert all(texts[i] == dict(rows)[i] for i in whole)
    clean = {i for i, t in texts.items() if all(decontaminate.edit_distance_within(p, decontaminate._plain(t or "")) > 0.2 * len(p) for p in items)}
    assert got == clean


def test_defined_cases_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, payload string"
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, passage, "en", "s", 1, "a", "p"), (1, passage, "en", "s", 1, "b", "p"), (2, passage, "en", "s", 1, "c", "p"), (None, "free of id", None, None, None, None, None),
        (3, None, "en", "s", 1, "d", "p"), (4, "", "en", "s", 1, "e", "p"), (5, "x" + " long text" * 20_000, "en", "s", 1, "f", "p"),
    ]
    empty = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for case, own in (("rows", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{case}/documents.parquet")
        for name, kind in empty.items():
            spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{case}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert next(r["n_tokens"] for r in got if r["doc_id"] == 3) == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def _full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_heaps_are_collected_before_each_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(3)
    for _, stage in corpus_pipeline.STAGES[2:]:
        before = _full_collections(spark)
        stage(spark, docs, SMALL)
        assert _full_collections(spark) > before + 1  # the driver's, and one a task: here both are in one process


def test_a_cut_collects_much_garbage_first(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "collect", lambda s: calls.append(s))
    monkeypatch.setattr(common, "_live", [0])
    monkeypatch.setattr(common, "GARBAGE", 1 << 60)
    assert common.cut(spark.range(3)).count() == 3 and not calls
    monkeypatch.setattr(common, "GARBAGE", 0)
    assert common.cut(spark.range(3)).count() == 3 and len(calls) == 1
