"""The written lexical index: phrases by places, and searches that prune by blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical

WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "eta", "zeta", "iota", "kappa"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(WORDS + [f"w{j}" for j in range(40)], weights=[60, 40, 12, 8, 6, 4, 3, 2, 2, 1, *[1] * 40], k=rng.randrange(0, 60)))) for i in range(1500)]
    rows += [(5000 + i, "the alpha beta the alpha beta") for i in range(30)] + [(9000, None), (9001, "")]
    return spark.createDataFrame(rows, "chunk_id long, chunk_text string").cache()


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('lexical')}/index"
    lexical.build_index(chunks).save(path)
    return lexical.LexicalIndex.load(spark, path)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS + ["w1", "w2", "nowhere"], k=rng.randrange(0, 8)))) for i in range(40)]
    rows += [(100, 'the "alpha beta" of'), (101, '"beta the alpha" "the the" "nowhere alpha"'), (102, '"alpha" "alpha"'), (103, '"" iota "?!"'), (104, 'x"the alpha'), (105, None)]
    return spark.createDataFrame(rows, "qid long, query string")


def test_pruned_search_gives_the_same_rows(index, queries):
    for k in (1, 7, 2000):
        plain = sorted(map(tuple, lexical.search(index, queries, k, prune=False).collect()))
        assert sorted(map(tuple, lexical.search(index, queries, k, prune=True).select("qid", "chunk_id", "score", "rank").collect())) == plain


def test_pruned_search_reads_less(spark, index):
    queries = spark.createDataFrame([(1, "the of kappa"), (2, "the iota"), (3, "of zeta kappa w7")], "qid long, query string")
    weights = lexical._weights(index, lexical.query_terms(queries, index.config), index.term_stats)
    best, read = lexical.pruned(index, weights, 5)
    of = {r.step: r.n for r in read.collect()}
    every = index.term_stats.filter(F.col("term").isin("the", "of", "kappa", "iota", "zeta", "w7")).agg(F.sum("df")).first()[0]
    assert best.count() == 15 and of["needed"] < 0.5 * every


def test_phrases_by_places(index, chunks, queries):
    texts = {r.chunk_id: (r.chunk_text or "").split() for r in chunks.collect()}
    want = {}
    for qid, phrases in ((100, ["alpha beta"]), (101, ["beta the alpha", "the the", "nowhere alpha"]), (102, ["alpha", "alpha"]), (103, ["iota"])):
        for c, toks in texts.items():
            n = sum(any(toks[i : i + len(p.split())] == p.split() for i in range(len(toks))) for p in phrases)
            if n:
                want[qid, c] = n
    assert {(r.qid, r.chunk_id): r.n for r in lexical.phrase_hits(index, queries).collect()} == want
    plan = lexical.phrase_hits(index, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "toks#" not in plan.split("Relation")[-1].split("\n")[0]


def test_blocks_hold_every_posting_once(index):
    flat = index.blocks.select("term", "level", "slice", "n", "peak", F.size("tf").alias("m"), F.inline(F.arrays_zip("chunk_id", "tf", "dl", "at")))
    assert flat.count() == index.postings.count() == index.levels.agg(F.sum("n")).first()[0]
    told = flat.join(index.levels.select("term", "level", "slices", F.col("peak").alias("most")), ["term", "level"])
    assert told.count() == flat.count() and told.filter("slice >= slices OR peak > most OR tf <> size(at)").isEmpty()
    assert flat.filter("n <> m").isEmpty() and flat.select("term", "chunk_id").distinct().count() == flat.count()
    with pytest.raises(ValueError, match="k1"):
        other = lexical.LexicalIndex(lexical.LexicalConfig(k1=2.0), index.postings, index.doc_stats, index.term_stats, index.corpus, index.blocks, index.levels)
        lexical.search(other, index.doc_stats.sparkSession.createDataFrame([(1, "the")], "qid long, query string"), 3, prune=True)


def test_no_block_outgrows_its_size(index):
    assert index.blocks.agg(F.max("n")).first()[0] <= lexical.BLOCK < index.term_stats.filter("term = 'the'").first()["df"]


def test_phrases_met_where_chunks_lie(spark, index, queries, monkeypatch):
    want = sorted(map(tuple, lexical.phrase_hits(index, queries).select("qid", "chunk_id", "n").collect()))
    found = lexical.phrases_met(index, queries)
    assert sorted(map(tuple, found.select("qid", "chunk_id", "n").collect())) == want
    assert "at#" not in found._jdf.queryExecution().optimizedPlan().toString()  # no posting is shuffled
    assert lexical.phrases_met(index, queries.filter("qid = 105")).isEmpty()
    unknown = spark.createDataFrame([(1, '"nowhere at all"')], "qid long, query string")
    assert lexical.phrases_met(index, unknown).isEmpty()
    monkeypatch.setattr(lexical, "PHRASES", 2)
    assert sorted(map(tuple, lexical.phrases_met(index, queries).select("qid", "chunk_id", "n").collect())) == want


def test_boosted_queries_are_pruned_too(spark, index, monkeypatch):
    queries = spark.createDataFrame([(100, 'the "alpha beta" of'), (101, '"beta the alpha" "the the"')], "qid long, query string")
    plain = [sorted(map(tuple, lexical.search(index, queries, k, prune=False).collect())) for k in (1, 7, 2000)]
    monkeypatch.setattr(lexical, "phrase_hits", None)  # places, and all postings of the terms, are not asked for
    assert [sorted(map(tuple, lexical.search(index, queries, k, prune=True).collect())) for k in (1, 7, 2000)] == plain


def test_results_are_searched_once(index, queries):
    plan = lexical.search(index, queries, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
