"""Vantage-point search against brute force; the pipeline's stages on a small table."""

import math
import os

import numpy as np
import pytest

from leadweave.llm import vptree

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q in (i for i in good if i % every == 0):
        d = {}
        for i, v in good.items():
            if i != q:
                s = 0.0
                for x, y in zip(good[q], v, strict=True):
                    s += (x - y) * (x - y)
                d[i] = math.sqrt(s)
        out[q] = sorted((s, i) for i, s in d.items())[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    out = [(i, [float(x) for x in centres[i % 6] + 0.3 * r.normal(size=8)], 0) for i in range(1500)]
    out += [(2000, out[5][1], 0), (2001, out[5][1], 0), (3000, None, 0), (3100, [0.0] * 8, 0), (3200, [float("nan")] * 8, 0), (3300, [1.0, None] + [0.0] * 6, 0), (3400, [1.0], 0), (None, out[0][1], 0), out[100]]
    return out


@pytest.mark.parametrize("shard", [50, 5000])
def test_exact_with_factor_one(spark, rows, shard):
    got = {}
    for r in vptree.nearest(spark.createDataFrame(rows, SCHEMA), shard_rows=shard).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()} == brute(rows)


def test_recall_with_more_pruning(spark, rows):
    got = vptree.nearest(spark.createDataFrame(rows, SCHEMA), shard_rows=100, factor=1.5).collect()
    want = {(q, i) for q, found in brute(rows).items() for _, i in found}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_few_and_no_vectors(spark, rows):
    assert vptree.nearest(spark.createDataFrame(rows[:4], SCHEMA)).count() == 3
    assert vptree.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == docs.count()
