"""The pipeline against a composition of plain versions of its stages."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomspan.llm import bpe, decontaminate
from tests.llm.test_operators import plain_repeats, plain_simhash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import os

    if not os.path.exists(SMALL):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL).toPandas()
    assert list(kept.columns) == columns and 0 < len(kept) <= docs.count()
    rows = sorted((int(i), t) for i, t in zip(kept.doc_id, kept.text))
    prints = {i: plain_simhash(t) for i, t in rows}
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if label[j] < label[i] and bin(a ^ b).count("1") <= 2:
                    label[i], changed = label[j], True
    rows = [(i, t) for i, t in rows if label[i] == i]
    digest = {r[0]: r[4] for r in plain_repeats(rows)}
    items = [decontaminate._plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    cut = corpus_pipeline.cut_repeats(spark, corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(kept), SMALL), SMALL)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(texts) == {i for i, _ in rows}
    whole = [i for i, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == digest[i]]
    assert all(texts[i] == dict(rows)[i] for i in whole)
    clean = {i for i, t in texts.items() if all(decontaminate.edit_distance_within(p, decontaminate._plain(t)) > 0.2 * len(p) for p in items)}
    assert set(got) == clean
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        assert bytes(r["ids"]) == np.array(plain.encode_ordinary(texts[i]), "<u4").tobytes()
