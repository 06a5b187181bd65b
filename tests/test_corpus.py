"""A corpus kept up to date equals one built at once, and only changed documents are worked on."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, lexical
from tessera.plans import providers, runtime
from tessera.plans.corpus import Corpus

POLICY = chunking.Policy(target_tokens=40, overlap_tokens=8, min_tokens=5, max_tokens=60)


def _docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", f"f{i}.md", t) for i, t in texts.items()], "doc_id string, source string, text string")


def _corpus(spark, path, **more):
    return Corpus(spark, f"file://{path}", POLICY, providers.hashed_embedding(16), 16, buckets=8, **more)


def _state(corpus, spark):
    chunks = sorted(map(str, corpus.chunks().select(*[f.split()[0] for f in chunking.SCHEMA.split(", ")]).collect()))
    vectors = sorted((r.chunk_id, r.doc_id, tuple(r.embedding)) for r in corpus.vectors().collect())
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, '"line 3 of"'), (3, "changed words")], "qid int, query string")
    found = sorted(map(tuple, lexical.search(corpus.lexical_index(), asked, 50).collect()))
    return chunks, vectors, found


def test_updates_equal_a_full_build(spark, tmp_path):
    texts = {i: f"# Title {i}\n\n" + "\n\n".join(f"alpha {w} line {j} of text {i}, with beta words and gamma {i * j}." for j, w in enumerate(["one", "two", "three", "four"] * 4)) for i in range(8)}
    corpus = _corpus(spark, tmp_path / "kept")
    first = corpus.update(_docs(spark, texts))
    assert first["added"] == 8 and first["embedded"] == first["chunked"] > 8
    folders = set(runtime.finished_runs(spark, f"file://{tmp_path}/kept/chunks", marker=None))
    assert corpus.update(_docs(spark, texts)) == {"added": 0, "changed": 0, "removed": 0, "unchanged": 8, "buckets": 0, "chunked": 0, "embedded": 0}

    texts[3] = texts[3].replace("line 15", "line changed words")
    second = corpus.update(_docs(spark, texts))
    one = corpus.chunks().filter("doc_id = 'd3'").count()
    assert (second["changed"], second["unchanged"], second["buckets"], second["chunked"]) == (1, 7, 1, one) and 0 < second["embedded"] < one
    new = set(runtime.finished_runs(spark, f"file://{tmp_path}/kept/chunks", marker=None)) - folders
    assert len(new) == 1  # the other buckets' files are as they were

    del texts[5]
    texts[9] = "short and new alpha words for a document that was not there"
    texts[10] = ""
    third = corpus.update(_docs(spark, texts))
    assert (third["added"], third["removed"], third["changed"]) == (2, 1, 0)
    whole = _corpus(spark, tmp_path / "whole")
    whole.update(_docs(spark, texts))
    assert _state(corpus, spark) == _state(whole, spark)
    assert corpus.vacuum() > 0 and _state(corpus, spark) == _state(whole, spark)
    assert {r.doc_id for r in corpus.documents().collect()} == {f"d{i}" for i in texts}

    again = _corpus(spark, tmp_path / "kept", settings={"model": "b"}).update(_docs(spark, texts))
    assert again["changed"] == len(texts) and again["unchanged"] == 0
    emptied = corpus.update(_docs(spark, texts).limit(0))
    assert emptied["removed"] == len(texts) and corpus.chunks().count() == 0


def test_an_unfinished_commit_is_not_taken(spark, tmp_path):
    corpus = _corpus(spark, tmp_path / "c")
    corpus.update(_docs(spark, {1: "alpha beta " * 30}))
    before = corpus.commit()
    torn = tmp_path / "c" / "commits" / "000000000099"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    assert corpus.commit() == before and corpus.chunks().count() > 0
    assert runtime.newest_run(spark, f"file://{tmp_path}/nowhere") is None


def test_documents_need_ids_of_their_own(spark, tmp_path):
    two = spark.createDataFrame([("a", "s", "x"), ("a", "s", "y")], "doc_id string, source string, text string")
    with pytest.raises(ValueError, match="id"):
        _corpus(spark, tmp_path / "c").update(two)
    with pytest.raises(ValueError, match="id"):
        _corpus(spark, tmp_path / "c").update(two.withColumn("doc_id", F.lit(None).cast("string")).limit(1))


def test_a_failed_update_leaves_the_last_commit(spark, tmp_path):
    corpus = _corpus(spark, tmp_path / "c")
    corpus.update(_docs(spark, {1: "alpha beta " * 30}))

    def broken(texts):
        raise RuntimeError("no model")

    other = Corpus(spark, f"file://{tmp_path}/c", POLICY, broken, 16, buckets=8)
    before = sorted(map(str, corpus.chunks().collect()))
    with pytest.raises(Exception, match="no model"):
        other.update(_docs(spark, {1: "alpha gamma " * 30, 2: "new"}))
    assert sorted(map(str, corpus.chunks().collect())) == before
    assert corpus.update(_docs(spark, {1: "alpha gamma " * 30}))["changed"] == 1
