"""Calls of a reranking are counted once, and models are loaded once a worker."""

import os
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, vectors
from tessera.plans import providers


def _pool(spark):
    rows = [(q, f"query {q}", f"c{q}{i}", "x" * (i + 1), i + 1) for q in (1, 2) for i in range(5)] + [(3, "query 3", "c3", None, 1)]
    return spark.createDataFrame(rows, "qid int, query string, chunk_id string, chunk_text string, rank int")


def _sender():
    def late(pairs, transport):
        tries = []

        def send():
            tries.append(1)
            if len(tries) == 1:
                raise TimeoutError
            if pairs[0][1] == "xxxxx" and len(tries) < 9:
                raise urllib.error.HTTPError("u", 503, "busy", {}, None)
            return b'{"scores": [' + ",".join(str(len(t)) for _, t in pairs).encode() + b"]}"

        return providers.post_json("u", {"pairs": pairs}, tries=3, sleep=lambda s: None, send=send, transport=transport)["scores"]

    return late


def test_calls_are_counted_by_query(spark):
    best, calls = fusion.rerank_counted(_pool(spark), _sender(), 2, batch=2, forgive=True)
    got = {r.qid: [r.chunk_id for r in sorted(best.filter(F.col("qid") == q).collect(), key=lambda r: r["rank"])] for q in (1, 2, 3) for r in [best.filter(F.col("qid") == q).first()]}
    assert got == {1: ["c13", "c12"], 2: ["c23", "c22"], 3: ["c3"]}  # the batch of c14 and c24 failed for good
    totals = {r.qid: (r.batches, r.requests, r.retries, r.timeouts, r.failures) for r in fusion.transport_totals(calls).collect()}
    assert totals == {1: (3, 7, 4, 3, 1), 2: (3, 7, 4, 3, 1), 3: (1, 2, 1, 1, 0)}
    assert calls.agg(F.sum("pairs")).first()[0] == 11 and calls.filter("bytes_sent = 0").isEmpty()
    with pytest.raises(Exception, match="503"):
        fusion.rerank_counted(_pool(spark), _sender(), 2, batch=2)
    none, no_calls = fusion.rerank_counted(_pool(spark).limit(0), _sender(), 2)
    assert none.count() == 0 and no_calls.count() == 0


def test_a_task_tried_again_counts_once(spark, tmp_path):
    seen = tmp_path / "seen"

    def once_broken(pairs, transport):
        transport.requests += 1
        if pairs[0][0] == "query 2" and not seen.exists():
            seen.write_text("x")
            os._exit(1)  # the worker is lost after other batches of its task were sent
        return [1.0] * len(pairs)

    with pytest.raises(Exception):  # a local master does not try a task again; nothing of it is kept
        fusion.rerank_counted(_pool(spark).coalesce(1), once_broken, 2, batch=2)
    _, calls = fusion.rerank_counted(_pool(spark).coalesce(1), once_broken, 2, batch=2)
    assert calls.agg(F.sum("requests")).first()[0] == 7


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    weights = tmp_path / "weights.bin"
    weights.write_bytes(np.arange(4, dtype=np.float32).tobytes())
    module = tmp_path / "made_model.py"
    module.write_text(
        "import os, uuid\nimport numpy as np\n"
        "def load(folder, path):\n"
        "    open(os.path.join(folder, f'{os.getpid()}-{uuid.uuid4().hex}'), 'w').close()\n"
        "    w = np.frombuffer(open(path, 'rb').read(), dtype=np.float32)\n"
        "    return lambda texts: np.stack([w + len(t) for t in texts])\n"
    )
    spark.sparkContext.addPyFile(str(module))
    import made_model

    loads = tmp_path / "loads"
    loads.mkdir()
    provider = providers.Loaded(made_model.load, (str(loads),), (providers.distribute(spark, str(weights)),))
    chunks = spark.range(4000).repartition(16).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("a"), (F.col("id") % 7).cast("int")).alias("chunk_text"))
    got = vectors.embed(chunks, provider, normalize=False, dim=4)
    assert got.filter(F.element_at("embedding", 2) != 1 + F.col("chunk_id") % 7).isEmpty() and got.count() == 4000
    pids = [f.split("-")[0] for f in os.listdir(loads)]
    assert 1 <= len(pids) == len(set(pids)) <= 8  # workers, not tasks or batches
