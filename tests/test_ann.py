"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, vectors


def _clustered(spark, n=3000, dim=32, clusters=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim)) * 3
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(clusters, size=n))  # one cluster holds a third of all
    x = (centres[at] + rng.standard_normal((n, dim)) * 0.5).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist(), int(a), "list") for i, (v, a) in enumerate(zip(x, at))], "chunk_id long, embedding array<float>, label int, code2 string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = _clustered(spark)
    path = f"file://{tmp_path_factory.mktemp('ann')}/index"
    ann.build(v, path, ann.AnnConfig(lists=48, held_out=64))
    return v, ann.AnnIndex.load(spark, path)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_few_lists_find_nearly_all(index, metric):
    v, ix = index
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    exact = {(r.qid, r.chunk_id): r.score for r in vectors.dense_topk(v, q, 5, metric, strategy="gemm").collect()}
    got = {(r.qid, r.chunk_id): r.score for r in ann.search(ix, q, 5, metric).collect()}
    assert len(set(exact) & set(got)) >= 0.95 * len(exact)
    assert all(abs(exact[p] - got[p]) < 1e-3 for p in set(exact) & set(got))
    told = ix.meta["measured"][metric]
    assert told["probes"] <= 12 and told["candidates"] <= 0.05 * ix.meta["n"]


def test_all_lists_and_candidates_are_exact_search(index):
    v, ix = index
    q = v.filter("chunk_id % 100 = 0").select(F.col("chunk_id").cast("string").alias("qid"), "embedding")
    for filters in (None, {"label": [1, 2, None]}, {"label": lambda c: c > 5}):
        exact = {(r.qid, r.chunk_id, r["rank"]) for r in vectors.dense_topk(v, q, 4, "l2", filters=filters).collect()}
        got = {(r.qid, r.chunk_id, r["rank"]) for r in ann.search(ix, q, 4, "l2", probes=48, candidates=3000, filters=filters).collect()}
        assert got == exact


def test_only_probed_lists_are_read(index):
    v, ix = index
    q = v.filter("chunk_id = 7").select(F.col("chunk_id").alias("qid"), "embedding")
    near = ann._candidates(ix, q, "l2", 2, 10)
    assert near.select("list").distinct().count() <= 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(list" in plan and "embedding" not in plan


def test_folders_of_other_lists_are_not_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    v = _clustered(spark)
    ix = ann.build(v, f"file://{tmp_path}/shards", ann.AnnConfig(lists=40, held_out=32, sample=500))
    assert ix.meta["shards"] == 10 and ix.codes.count() == 3000
    q = v.filter("chunk_id % 30 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    assert "PartitionFilters: [" in ann._candidates(ix, q.limit(1), "ip", 1, 5)._jdf.queryExecution().executedPlan().toString()
    for metric in ("ip", "l2"):
        exact = {(r.qid, r.chunk_id) for r in vectors.dense_topk(v, q, 5, metric, strategy="gemm").collect()}
        assert len(exact & {(r.qid, r.chunk_id) for r in ann.search(ix, q, 5, metric).collect()}) >= 0.93 * len(exact)


def test_every_good_row_is_indexed(spark, tmp_path):
    rows = [("a", [1.0, 0.0, 2.0]), ("b", [1.0, 0.0, 2.0]), ("c", None), ("d", [0.0, None, 1.0]), ("e", [0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 2.0])]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    ix = ann.build(v, f"file://{tmp_path}/few")
    assert sorted(r.chunk_id for r in ix.codes.collect()) == ["a", "a", "b", "e"]
    q = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "qid int, embedding array<double>")
    assert [(r.chunk_id, r.score) for r in ann.search(ix, q, 3).orderBy("rank").collect()][0] == ("a", 5.0)
    assert ann.search(ix, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        ann.build(v.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        ann.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id int, embedding array<double>"), f"file://{tmp_path}/mixed")
