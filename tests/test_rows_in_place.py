"""Stems and postings are made where rows lie."""

from collections import Counter

from tessera.functions.stem import porter, stem_lists
from tessera.operators import lexical

ROWS = [("a", "Running runs skies flies ponies"), ("b", None), ("c", ""), ("d", "the the cats ponies dying")]


def _shuffles(df) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_stems_and_postings_need_no_shuffle(spark):
    texts = spark.createDataFrame(ROWS, "chunk_id string, chunk_text string")
    for extended in (False, True):
        config = lexical.LexicalConfig(stemming=True, extended_stemmer=extended, stopwords=("the",))
        toks = lexical.tokenize(texts, "chunk_id", "chunk_text", config)
        want = {k: [porter(w, extended) for w in (t or "").lower().split() if w != "the"] for k, t in ROWS}
        assert not _shuffles(toks) and {r["chunk_id"]: r["toks"] for r in toks.collect()} == want
    docs = spark.createDataFrame([("a", 4, ["x", "y", "x", "z"], 7), ("b", 0, [], 8), ("c", 1, ["y"], 9)], "chunk_id string, dl int, toks array<string>, more int")
    made = lexical.postings_of(docs)
    assert not _shuffles(made)
    assert Counter((r["term"], r["chunk_id"], r["tf"], r["dl"], tuple(r["at"]), r["more"]) for r in made.collect()) == Counter([("x", "a", 2, 4, (0, 2), 7), ("y", "a", 1, 4, (1,), 7), ("z", "a", 1, 4, (3,), 7), ("y", "c", 1, 1, (0,), 9)])
    assert stem_lists(docs.select("chunk_id", "toks"), "toks").count() == 3
