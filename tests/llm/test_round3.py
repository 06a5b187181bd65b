"""Codec, collocations and source divergence against the library, brute force, and the odd rows each must bear."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import collocations, divergence, embedding_dedup, piece_codec, pieces, pretoken
from tessera.llm.queries import tokenizer_path

LONG = "lorem ipsum, dolor " * 20_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "short"), (5, LONG), (6, "x" * 50_000), (7, "tie tie"), (7, "tie tie"), (8, "naïve ▁𝄞 text\0"), (None, "no id here, really")]
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", k, k, "z") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, a long, term string")


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def test_codec_equals_library_with_spans():
    library, model, rng = _library(), pieces.Pieces(tokenizer_path(MODEL), limit=50), random.Random(3)
    alphabet = "ab ▁ ,.é漢\U0001f600\n\t\0'd<0x41>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1000)]
    for text in [*texts, "", " ", " " * 3000, "a" * 5000, "▁", "</s> <unk> <0x0A>", "漢" * 1000]:
        ids, starts, ends = model.encode(text)
        told = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in told.pieces]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in told.pieces]
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
    for ids in ([1, 2, 0], [3 + 0xE4, 3 + 0xBD], [300, 3 + 0xFF, 3 + 0xC3], [29871, 29871, 300], [3 + 32, 300], [0, 300], [300, 0], []):
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_map_takes_longest_prefix_and_keeps_offsets(rule):
    import sentencepiece

    rng, alphabet = random.Random(5), "ab  ｱ①　Ａﬁ漢é́​\n\tÅ가▁ß"
    for strip in (True, False):
        for dummy in (True, False):
            library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=strip, escape_whitespaces=True)
            own = pieces.Normalizer(library.serialized_normalizer_spec())
            for _ in range(300):
                text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
                norm, offsets = library.normalize(text, with_offsets=True)
                ours, source = own(text)
                place = {len(text[:i].encode()): i for i in range(len(text) + 1)}
                assert ours == norm and [place.get(int(s)) for s in source] == list(offsets)


def test_codec_bears_odd_rows(spark, odd):
    library = _library()
    got = piece_codec.encode(odd, tokenizer_path(MODEL), decoded=True).collect()
    assert len(got) == len(ODD)
    want = collections.Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in ODD)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    for r in got:
        spans = list(zip(r.starts, r.ends, strict=True))
        assert all(a <= b for a, b in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    back = piece_codec.decode(spark.createDataFrame([(1, None), (2, [300, 301])], "doc_id long, ids array<int>"), tokenizer_path(MODEL)).collect()
    assert {r.doc_id: r.text for r in back} == {1: "", 2: library.decode([300, 301])}
    assert piece_codec.digest(piece_codec.encode(odd.limit(0), tokenizer_path(MODEL), decoded=True)).count() == 0


def test_digest_bears_texts_without_ids(spark, odd):
    library = _library()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = piece_codec.digest(piece_codec.encode(odd, tokenizer_path(MODEL), decoded=True)).collect()
    want = collections.Counter()
    for i, t in ODD:
        ids = library.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())] += 1
    assert any(n == 0 for _, n, *_ in want)
    assert collections.Counter(map(tuple, got)) == want


def _brute_phrases(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for d in range(1, 6):
                f[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least}
        scored = []
        for p, a in kept.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items())
            if len(p) > 1 and not inside:
                s, k = min((int(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["The", "of", "a", "new", "YORK", "york", "É", "é", "in\tthe", "x\0y", "city", "sea.", "end,", "\x0bz", "q"]
    rows = [(rng.choice(["en", "fr", None, "und"]), " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(60)))) for _ in range(300)]
    rows += [("en", "one very common line of words here")] * 500 + [("en", None), (None, "")]
    docs = spark.createDataFrame([(i, lang, text, 1, "w") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, w1 string").repartition(7)
    for least, top in ((100, 2000), (7, 40), (3, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())
        assert got == _brute_phrases(rows, least, top)


def test_growth_adds_up_over_any_cut():
    rng = np.random.default_rng(2)
    c = rng.integers(1, 4, (400, 5))
    for i in range(1, 5):
        c[:, i] = np.where((c[:, i - 1] == 0) | (rng.random(400) < 0.2), 0, c[:, i])
    c = c[np.lexsort(c.T[::-1])]
    n = rng.integers(1, 5, 400)
    want = collections.Counter()
    for row, m in zip(c.tolist(), n.tolist(), strict=True):
        for d in range(2, 6):
            if row[d - 1]:
                want[tuple(row[:d])] += m
    for cuts in ([0, 400], [0, 1, 399, 400], [0, 50, 51, 52, 200, 400]):
        got = collections.Counter()
        for a, b in zip(cuts, cuts[1:]):
            for ids, m in collocations._grow(c[a:b], n[a:b], 30):
                got[tuple(ids)] += m
        assert {k: v for k, v in got.items() if v >= 30} == {k: v for k, v in want.items() if v >= 30}


def test_numbers_agree_with_spark(spark):
    rows = [("en", "word"), ("und", "é"), ("fr", "x" * 100), ("", "ab\0c")]
    told = spark.createDataFrame(rows, "lang string, word string").select("lang", "word", collocations.word_number(3).alias("id")).collect()
    for r in told:
        assert int.from_bytes(collocations._numbers(r.lang, 3)[r.word.encode()], "little", signed=True) == r.id


def test_collocations_bear_odd_rows(odd):
    got = sorted(tuple(r) for r in collocations.collocations(odd, least=2).collect())
    assert got == _brute_phrases([(r.lang, r.text) for r in odd.collect()], 2, 2000)
    assert collocations.collocations(odd.limit(0)).count() == 0


def _brute_divergence(rows, least, top):
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {k[0] for k in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        share = {}
        for source in {k[1] for k in groups if k[0] == lang} | {None}:
            c = groups[lang, source] if source is not None else sum((groups[k] for k in groups if k[0] == lang), collections.Counter())
            total = sum(c[t] for t in kept)
            share[source] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for source in share:
            if source is None:
                continue
            pairs = [(-sum(abs(share[source][t] - share[o][t]) for t in kept), o) for o in share if o not in (None, source)]
            terms = [(share[None][t] - share[source][t], t) for t in kept if groups[lang, source][t] and share[source][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, source, part, item, -v, r + 1) for r, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())))]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "É", "é", "don't", "x1y", "gamma", "delta", "漢字", "k_b", *[f"{a}{b}" for a in "pqrs" for b in "tuvw"]]
    rows = [(rng.choice(["en", None, "fr"]), rng.choice([None, *[f"s{i}" for i in range(9)]]), " ".join(rng.choices(words, k=rng.randrange(20)))) for _ in range(400)]
    rows += [("en", "s1", "alpha beta")] * 300 + [("xx", "only", None), ("xx", "other", "!"), ("en", "bare", "123"), ("yy", None, "z")]
    docs = spark.createDataFrame([(i, *r, 1, "v") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, v string").repartition(5)
    for least, top, block, side in ((30, 50, 2048, 128), (5, 3, 4, 3), (1, 50, 7, 2), (10_000, 5, 7, 2)):
        got = sorted(tuple(r) for r in divergence.divergence(docs, least, top, block, side).collect())
        assert got == _brute_divergence(rows, least, top)


def test_shares_are_exact_beyond_64_bit_products():
    count, total = np.array([0, 3, 10**13, 9 * 10**14]), np.array([10**15] * 4)
    assert divergence.share(count, total, np.array([10**6])).tolist() == [1 + 10**9 * (c + 5) // (10**15 + 5 * 10**6) for c in count.tolist()]


def test_divergence_bears_odd_rows(odd):
    got = sorted(tuple(r) for r in divergence.divergence(odd, least_docs=1).collect())
    assert got == _brute_divergence([(r.lang, r.source, r.text) for r in odd.collect()], 1, 50)
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_own_links(spark):
    """(1, A), (1, B), (2, near A): B links with nothing, whatever its id's other row does."""
    a = np.zeros(16)
    a[0] = 1.0
    b, near = np.roll(a, 1), a + 0.01
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, near.tolist(), 0)]
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_code_bits_bound_the_angle():
    """Of pairs at the threshold hardly any differ by more code bits than `most_apart`; random pairs nearly all do."""
    rng = np.random.default_rng(3)
    for dim in (2, 64, 200):
        a = rng.standard_normal((4000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((4000, dim))
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        pair = 0.98 * a + math.sqrt(1 - 0.98**2) * b
        bits = lambda x, y: (embedding_dedup.encode(x)[0] != embedding_dedup.encode(y)[0]).sum(1)
        assert (bits(a, pair) <= embedding_dedup.most_apart(dim, 0.98, 1e-9)).all()
        if dim > 2:
            assert (bits(a, b) > embedding_dedup.most_apart(dim, 0.98, 1e-9)).mean() > 0.95


def test_ids_of_long_white_space_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    own, library = pretoken.Texts(path), pretoken._load(path)[0]
    wide = 1_100_000
    for text in ("a b" + " " * wide + "c d 12", "\n" * wide, "x y\t " + "\t " * (wide // 2), "word " * 120_000 + "," * 600_000 + " it's  so " + " " * 9):
        assert own.plain(text) and own.ids(text) == library.encode(text, add_special_tokens=False).ids
