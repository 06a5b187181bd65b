"""Searches in blocks: exact scores and ties, and buckets that are multiplied without shuffling pairs."""

import numpy as np

from tessera.operators import vectors


def _copies(spark):
    """Vectors of 40 texts, each with seven exact copies in other partitions, and a null one."""
    x = np.random.default_rng(5).standard_normal((40, 19)).astype(np.float32)
    rows = [(i, x[i % 40].tolist()) for i in range(320)]
    return spark.createDataFrame([*rows, (999, None)], "chunk_id long, embedding array<float>").repartition(5, "chunk_id")


def test_blocks_give_exact_scores_and_ties(spark):
    df = _copies(spark)
    asked = df.filter("chunk_id < 40").selectExpr("chunk_id as qid", "embedding")
    for m in ("ip", "l2"):
        want = sorted(map(tuple, vectors.dense_topk(df.filter("embedding is not null"), asked, 5, m).collect()))
        assert sorted(map(tuple, vectors.dense_topk(df, asked, 5, m, strategy="gemm").collect())) == want
    assert {r["score"] for r in vectors.dense_topk(df, asked, 5, "l2", strategy="gemm").collect()} == {0.0}


def test_the_best_of_a_task_are_bounded():
    import pyarrow as pa

    best, r = vectors._Best(3, 2), np.random.default_rng(1)
    score = np.round(r.standard_normal((3, 500)), 1)
    for a in range(0, 500, 50):
        for _ in range(2):  # a pair met twice, as in two tables, counts once
            at, row = np.repeat(np.arange(3), 50), np.tile(np.arange(a, a + 50), 3)
            best.add(at, row, pa.array(row), score[at, row])
        best.settle()
        assert sum(p.num_rows for p in best.parts) <= 6
    for q in range(3):
        want = sorted(((-s, i) for i, s in enumerate(score[q])))[:2]
        assert [(-x["score"], x["id"]) for x in best.parts[0].to_pylist() if x["q"] == q] == want


def test_buckets_are_multiplied_where_vectors_lie(spark):
    df = _copies(spark)
    asked = df.filter("chunk_id < 40").selectExpr("chunk_id as qid", "embedding")
    for m in ("ip", "l2"):
        found = vectors.lsh_topk(df, asked, 5, metric=m)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "bucket" not in plan  # no pair is made to be shuffled
        exact = vectors.dense_topk(df.filter("embedding is not null"), asked, 5, m)
        assert vectors.recall(found, exact).first()["recall"] >= 0.9
        assert set(map(tuple, found.filter("rank = 1").collect())) == set(map(tuple, exact.filter("rank = 1").collect()))
    apart = vectors.lsh_topk(df, asked, 320, bits=6, tables=1)
    assert 0 < apart.count() < 40 * 320  # pairs without a bucket in common are not scored
