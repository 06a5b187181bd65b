"""Operators that work in blocks, ranks without gathering, deep pages, the index written once, and the service."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.stem import porter
from tessera.operators import lexical, qa, vectors
from tessera.plans import providers, scratch
from tessera.plans.retriever import CachedRetriever, Retriever
from tessera.plans.service import BadRequest, NotReady, Service
from tessera.sources import readers, sinks


def test_ranked_values_equal_the_aggregates(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.choice((None, *range(9)))) for _ in range(200)] + [("d", None), ("e", 5)]
    df = spark.createDataFrame(rows, "g string, v int")
    picks = {f"{rule}{p}": (rule, p) for rule in ("nearest", "lower") for p in (5, 50, 95)}
    got = {x["g"]: x for x in V.ranked_values(df, ["g"], "v", picks).collect()}
    want = {x["g"]: x for x in df.groupBy("g").agg(*[(V.nearest_rank if k == "nearest" else V.lower_rank)(F.col("v"), p).alias(n) for n, (k, p) in picks.items()]).collect()}
    assert set(got) == {"a", "b", "c", "e"} and all(got[g][n] == want[g][n] for g in got for n in picks)
    assert V.ranked_values(df.limit(0), [], "v", picks).first().asDict() == dict.fromkeys(picks)


def test_query_blocks_equal_the_expression(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, r.standard_normal(6).tolist()) for i in range(150)], "chunk_id long, embedding array<double>")
    asked = df.select(F.col("chunk_id").alias("qid"), "embedding")
    want = {m: sorted(map(tuple, vectors.dense_topk(df, asked, 4, m).select("qid", "chunk_id", "rank").collect())) for m in ("ip", "l2")}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(vectors, "PASS_BLOCKS", 3)
    for m in ("ip", "l2"):
        assert sorted(map(tuple, vectors.dense_topk(df, asked, 4, m).select("qid", "chunk_id", "rank").collect())) == want[m]
    assert vectors.dense_topk(df, asked.limit(0), 4, strategy="gemm").count() == 0


def test_deep_and_unclosed_pages(spark):
    title, text = readers.html_markdown("<body>" + "<p>word" * 1500, "u")
    assert text.count("word") == 1500 and len(text) < 20_000
    title, text = readers.html_markdown("<main>" + "<div>" * 5000 + "<h1>T</h1><ul><li>a<li>b <b>c</b><li>d</ul>" + "</div>" * 5000, "u")
    assert title == "T" and "- a\n- b c\n- d" in text
    pages = spark.createDataFrame([(1, "u", "<p>fine"), (2, None, None)], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in readers.read_pages(pages, skip_bad=True).collect()}
    assert got[1]["error"] is None and "fine" in got[1]["text"] and got[2]["error"] is None


def test_a_batch_of_another_dimension_is_an_error(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, chunk_text string")
    with pytest.raises(Exception, match="components"):
        vectors.embed(chunks, lambda t: np.ones((len(t), 3 if t == [" "] else 4), np.float32)).collect()


def test_index_is_written_once_while_its_table_is_the_same(spark, tmp_path):
    path, made = str(tmp_path / "documents.parquet"), []

    def write(folder):
        made.append(folder)

    chunks = spark.createDataFrame([("a", "one two")], "chunk_id string, chunk_text string")
    chunks.write.parquet(path)
    assert scratch.once(spark, path, "n", write) == scratch.once(spark, path, "n", write) and len(made) == 1
    chunks.withColumn("more", F.lit(1)).write.mode("overwrite").parquet(path)
    scratch.once(spark, path, "n", write)
    assert len(made) == 2


def test_queries_with_more_terms_than_a_block(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two three")], "chunk_id string, chunk_text string")
    index, queries = lexical.build_index(chunks), spark.createDataFrame([(1, "one three")], "qid int, query string")
    want = lexical.search(index, queries, 5).collect()
    monkeypatch.setattr(lexical, "TERM_BLOCK", 1)
    assert lexical.search(index, queries, 5).collect() == want and len(want) == 2


def test_ladder_text_has_one_header(spark, tmp_path):
    for tag in ("r1", "r2"):
        sinks.append_ladder(spark.createDataFrame([(tag, 0.5)], "run_tag string, mrr double"), str(tmp_path / "l"))
    lines = sinks.ladder_csv(spark, str(tmp_path / "l")).splitlines()
    assert lines[0] == ",".join(sinks.LADDER) and [x.split(",")[1] for x in lines[1:]] == ["r1", "r2"]


def test_service_maps_errors_and_counts():
    def answer(query, top_k, history):
        if query in ("bad", "cold", "slow", "model", "bug"):
            raise {"bad": BadRequest, "cold": NotReady, "slow": TimeoutError, "model": RuntimeError, "bug": KeyError}[query]("x")
        return {"mode": "answer", "answer": query}

    s = Service(answer, {"chunks": lambda: True, "index": None}, ("chunks",), {"index_version": "i"})
    assert [s.chat({"query": q})["status"] for q in ("ok", "bad", "cold", "slow", "model", "bug", " ")] == [200, 400, 503, 504, 502, 500, 422]
    got = s.chat({"query": " x "}, "id7")
    assert got["request_id"] == "id7" and got["body"]["answer"] == "x" and got["body"]["index_version"] == "i" and got["body"]["total_ms"] >= 0
    assert s.metrics()["requests"] == 8 and s.metrics()["answer"] == 2 and s.metrics()["p50_ms"] is not None and s.health()["status"] == "degraded"


def test_cached_retriever(spark):
    texts = [("a", "red apple pie"), ("b", "green pear tart"), ("c", "red car")]
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_text string").cache()
    provider = providers.hashed_embedding(16)
    r = CachedRetriever(Retriever(chunks, vectors.embed(chunks, provider).cache(), lexical.build_index(chunks)), provider, 16, "m")
    one, two, other = r.retrieve("red  apple", 2), r.retrieve("red  apple", 2), r.retrieve("red apple", 1)
    assert one["rows"][0]["chunk_id"] == "a" and two["rows"] == one["rows"] and other["rows"][0]["chunk_id"] == "a"
    assert (one["embedding_hit"], one["retrieval_hit"], two["retrieval_hit"], other["embedding_hit"]) == (False, False, True, True)
    assert r.retrieve(" ")["rows"] == [] and one["retrieve_ms"] > 0
    assert [x["chunk_id"] for x in r.retrieve("red", 5, {"chunk_id": ["c"]})["rows"]][0] == "c"
    with pytest.raises(ValueError, match="shape"):
        CachedRetriever(r.retriever, provider, 8).embed("x")


def test_metric_and_report(spark):
    assert [vectors.metric_of(m) for m in ({"score_mode": "L2"}, {"metric": "inner_product"}, {}, {"metric": "l2"})] == ["l2", "ip", "ip", "l2"]
    rows = spark.createDataFrame([("d", 5, "x", None), ("d", 7, "x", None), ("e", None, None, "ValueError: x")], "doc_id string, token_count int, checksum string, error string")
    got = qa.corpus_report(rows, "/corpus").first()
    assert (got["n_chunks"], got["n_duplicates"], got["n_bad"], got["_corpus_root"]) == (2, 1, 1, "/corpus") and got["_built_at"].endswith("Z")


def test_clients_and_rerank_configuration(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(providers, "post_json", lambda url, body, **options: sent.append((url, body)) or {"response": "ok"})
    assert providers.ollama_generator("http://h/", "m")("s", "u") == "ok" and sent[0][0] == "http://h/api/generate" and sent[0][1]["stream"] is False
    some = spark.createDataFrame([(1, "q", "a", "xx", 1), (1, "q", "b", "xxxx", 2)], "qid int, query string, chunk_id string, chunk_text string, rank int")
    got = providers.RerankConfig(batch=1, max_chars=3).rerank(some, 2, lambda pairs: [len(t) for _, t in pairs]).orderBy("rank").collect()
    assert [(x["chunk_id"], x["score"]) for x in got] == [("b", 3.0), ("a", 2.0)]
    with pytest.raises(ValueError, match="scorer"):
        providers.RerankConfig().rerank(some, 2)


def test_extended_stemmer():
    words = "caresses flies dies mules denied died agreed owned humbled sized meeting stating itemization sensational traditional reference colonizer plotted dying skies geology happy enjoy"
    stems = "caress fli die mule deni die agre own humbl size meet state item sensat tradit refer colon plot die sky geolog happi enjoy"
    assert [porter(w, True) for w in words.split()] == stems.split()
    assert porter("dies") == "di" and porter("dying") == "dy"  # as published


def test_configuration_with_defaults():
    assert readers.with_defaults(readers.read_config("a:\n  b: 1\nc: [x]"), {"a": {"b": 0, "d": 2}, "e": 3}) == {"a": {"b": 1, "d": 2}, "c": ["x"], "e": 3}
