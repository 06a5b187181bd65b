"""Token budgets by a vocabulary against the library's own counts."""

import base64
import random

import pytest
import tiktoken

from tessera.functions import vocabulary as V
from tessera.operators import chunking


@pytest.fixture(scope="module")
def library():
    with open(V.installed("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=V.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("pattern", [V.PATTERN, r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"])
def test_any_stretch_counts_as_the_library_counts(library, pattern):
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    known, rng = V.Vocabulary(V.installed("byte_bpe_50k.tiktoken"), pattern, limit=200), random.Random(2)
    alphabet = ["the ", "a", " ", "  ", "\n", "\n\n", "I'll", "'s", "don't", "é漢", "😀", "12345", "...", "!", "xyzzy", "\t", " of", "\r\n"]
    for _ in range(60):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        tokens = V.VocabularyTokens(text, known)
        for _ in range(60):
            a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
            assert tokens.count(a, b) == len(own.encode_ordinary(text[a:b]))
    assert V.VocabularyTokens("", known).count(0, 0) == 0


def test_chunks_have_the_library_s_sizes(spark, library):
    rows = [(i, "s.md", t) for i, t in enumerate([None, "", "# T\n\n" + "word salad, isn't it? " * 900, "x" * 3000, "- a\n- b\n\n" + "| a | b |\n" * 400, "été déjà vu. " * 500])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = chunking.chunk_corpus(docs, vocabulary=V.installed("byte_bpe_50k.tiktoken")).collect()
    texts = {str(i): chunking.normalize(t or "") for i, _, t in rows}
    assert len(got) > 8 and all(r.token_count == len(library.encode_ordinary(texts[r.doc_id][r.start_offset : r.end_offset])) for r in got)
    assert all(r.token_count <= 750 for r in got if r.doc_id in "24")
    plain = {r.chunk_id: r.token_count for r in chunking.chunk_corpus(docs).collect()}
    assert set(plain) != {r.chunk_id for r in got}
