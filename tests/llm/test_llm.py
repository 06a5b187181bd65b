"""The corpus operators on small fixtures: brute force, round trips, and the odd rows each must bear."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, embedding_dedup, line_dedup, mixing, ngram_join, packing, pii, pretoken, quality_classifier, quality_rules, substring_dedup, token_counts
from tessera.llm import queries
from tessera.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "short"), (5, LONG), (6, "x" * 50_000), (7, "tie tie"), (7, "tie tie"), (8, "naïve 𝄞 text\nnaïve 𝄞 text"), (None, "no id here at all, really")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, a null id, and columns whose names clash with inner ones."""
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", k, "z") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, v string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 1), (7, 0, 1), (99, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def _prose(n, seed, size=60):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return [" ".join(r.choice(words) for _ in range(r.randint(size // 2, size))) for _ in range(n)]


def _edited(text, r, share):
    return " ".join(w if r.random() > share else "zz" + str(r.randint(0, 999)) for w in text.split())


# --- token counts and packing ----------------------------------------------------------------------------------------


def test_pretokens_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    counter, library = pretoken.Counter(path), pretoken._load(path)[0]
    r = random.Random(1)
    letters = [chr(i) for i in range(0x221)] + list(" \n\t'’—€ͅ𝄞") * 20 + ["'s", " the", "  ", "<|endoftext|>", "\x1c", "\x85"] * 5
    for _ in range(2000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        want = library.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(want) and counter.ids(t) == want, t
    assert counter.count(LONG) == len(library.encode(LONG, add_special_tokens=False).ids)
    counter.limit = 3
    assert [counter.count(t) for t in ("qzx wvk", "jjkq", "qzx wvk")] == [len(library.encode(t).ids) for t in ("qzx wvk", "jjkq", "qzx wvk")]


def test_token_counts_of_odd_rows(odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    got = token_counts.count_tokens(odd, path).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_bytes"], by[1]["n_tokens"], by[1]["over_limit"]) == (0, 0, False) and by[5]["over_limit"] and by[8]["n_bytes"] == len(ODD[8][1].encode())
    assert token_counts.count_tokens(none, path).count() == 0


def _check_packing(rows, texts, library):
    ids = collections.Counter()
    whole = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts]
    parts = collections.Counter()
    for i, w in whole:
        parts[(i, len(w))] += len(w)
    sequences = collections.defaultdict(list)
    for r in rows:
        ids[(r["doc_id"], r["doc_tokens"])] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(i == r["doc_id"] and len(w) == r["doc_tokens"] and zlib.crc32(np.array(w[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for i, w in whole)
    assert ids == parts
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048  # full or a power of two


def test_packing_round_trip(spark, odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    library = pretoken._load(path)[0]
    _check_packing(packing.pack(odd, path).collect(), ODD, library)
    assert packing.pack(none, path).count() == 0
    texts = [(i, " ".join(["word"] * (i % 50 * 20 + 3))) for i in range(400)]
    _check_packing(packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), path).collect(), texts, library)


def test_least_squares_plan_fills_windows():
    plan = packing.Plan({1500: 90, 548: 60, 1024: 41, 700: 30, 2048: 3}, 2048)
    placed = [(length, k, plan.place(length, k)) for length, n in ((1500, 90), (548, 60), (1024, 41), (700, 30), (2048, 3)) for k in range(n)]
    assert all(sum(p[0] for p in parts) == length for length, _, parts in placed)
    used = collections.defaultdict(list)
    for _, _, parts in placed:
        for n, s, o in parts:
            used[s].append((o, n))
    assert all(sum(n for _, n in v) & (sum(n for _, n in v) - 1) == 0 for v in used.values())
    assert sum(len(p) == 1 for *_, p in placed) > 150  # most pieces stay whole


# --- rules and classifier --------------------------------------------------------------------------------------------


def _rules(t):
    ws = WORD.findall(t or "")
    seen, marked = collections.Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7)), set()
    for k in range(len(ws) - 7):
        if seen[tuple(ws[k : k + 8])] > 1:
            marked.update(range(k, k + 8))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in ws), len(lines) - len(set(lines)), len(marked)


def test_quality_rules_by_brute_force(spark, odd, none):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab cd# ef| gh\n ij").strip() + " " for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(r.choice(("aa", "bb")) for _ in range(80)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        x, want = got[i], _rules(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x["kept"] and x["base_failed"])
    odds = quality_rules.quality_rules(odd).collect()
    assert len(odds) == len(ODD) and not next(x for x in odds if x["doc_id"] == 1)["kept"]
    assert quality_rules.quality_rules(none).count() == 0


def test_outliers_are_rejected_and_others_kept(spark):
    rows = [(i, t, "en", "s0" if i % 3 else f"s{i % 5}") for i, t in enumerate(_prose(400, 3))]
    rows += [(1000 + i, " ".join(w + "###$$$" for w in t.split()), "en", "s0") for i, t in enumerate(_prose(20, 4))]
    got = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(400)) >= 392 and not any(got[1000 + i] for i in range(20))


def test_classifier_on_held_out_rows(spark, odd, none, labels):
    r = random.Random(5)
    rows, marks = [], []
    for i, t in enumerate(_prose(600, 6)):
        bad = r.random() < 0.3
        rows.append((i, t + (" vile scum" if bad else "") if i % 2 else (t.upper() + "!!" if bad else t), "en", f"s{i % 7}"))
        marks.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in quality_classifier.classify(docs, known.filter("doc_id % 4 < 2"), bound=250).collect()}
    held = [(got[i], q == 1) for i, q, _ in marks if i % 4 >= 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    odds = quality_classifier.classify(odd, labels).collect()
    assert len(odds) == len(ODD) and all(x["posterior"] is not None for x in odds)
    assert all(x["kept"] for x in quality_classifier.classify(odd, labels.limit(0)).collect())
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_classifier.keep_good(odd, quality_classifier.classify(odd, labels)).columns == odd.columns


def test_sparse_sites_shrink(spark):
    rows = [(i, t, "en", "big") for i, t in enumerate(_prose(80, 7))] + [(900, _prose(1, 8)[0], "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_classifier.classify(docs, known).collect()}
    assert abs(got[900]["path_prior"] - got[0]["path_prior"]) < 0.1


# --- duplicates ------------------------------------------------------------------------------------------------------


def _components(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    good = [x for x in links if None not in x and x[0] != x[1]]
    assert got == _components({n for x in good for n in x}, good)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_by_brute_force(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((60, 64))
    rows = [(i, (base[i % 20] + r.standard_normal(64) * 0.12 * (i % 3)).astype("f4").tolist(), i % 2) for i in range(300)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, None, 0), (503, [0.0] * 64, 0), (504, [float("nan")] * 64, 0), (505, rows[0][1], None), (506, [1.0, None], 0), (507, [], 1), (508, [3.0, 4.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<float>, label int, id int, links string")
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(df, block=64).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for (a, x, l), (b, y, m) in itertools.combinations(good, 2) if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    n = collections.Counter(i for p in links for i in p)
    comp = _components([i for i, *_ in rows if i is not None], links)
    assert len(links) > 500
    for i, x in got.items():
        assert (x["n_links"], x["component_id"], x["kept"]) == ((n[i], comp[i], comp[i] == i) if i is not None else (0, None, True)), i
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 64))
    x[1::2] = x[::2] + 0.1 * x[1::2]
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    codes, factors = embedding_dedup.encode(unit)
    turned = unit @ embedding_dedup.rotation(64, 0).T
    estimate = np.where(codes, 1, -1) / 8 @ turned.T / factors[:, None]
    truth = unit @ unit.T
    assert abs((estimate - truth)[~np.eye(400, dtype=bool)].mean()) < 0.002
    assert embedding_dedup.possible(codes, factors, unit, 0.98, 6.0)[truth >= 0.98].all()
    assert embedding_dedup.possible(codes, factors, unit, 0.98, 6.0).mean() < 0.05


def _shingles(t):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def test_ngram_join_by_brute_force(spark, odd, none):
    r = random.Random(11)
    rows = list(enumerate(_prose(40, 12)))
    rows += [(100 + i, _edited(rows[i % 10][1], r, 0.04)) for i in range(120)] + [(300 + i, rows[i % 5][1].upper()) for i in range(30)] + [(400, "a b"), (401, "A  b"), (402, ""), (403, None), (404, "b a")]
    got = {x["doc_id"]: x for x in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = _components(sets, links)
    assert len(links) > 300
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), comp[i]), i
    odds = ngram_join.similar_documents(odd).collect()
    assert len(odds) == len(ODD) and [x["component_id"] for x in odds if x["doc_id"] == 7] == [7, 7]
    assert ngram_join.similar_documents(none).count() == 0


def test_line_dedup_by_brute_force(spark, odd, none):
    r = random.Random(3)
    docs = [(i, "\n".join(" ".join(r.choice(("aa", "bb", "Cc")) for _ in range(r.randint(3, 8))) for _ in range(4))) for i in range(60)]
    lines = [(i, k, tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line.lower()) if x)) for i, t in docs for k, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]

    def close(a, b):
        front = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        back = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return abs(len(a) - len(b)) < 2 and front + back >= max(len(a), len(b)) - 1

    want = {}
    for i, k, w in lines:
        hits = [(j, m) for j, m, v in lines if (j, m) < (i, k) and close(v, w)]
        if hits:
            want[i, k] = min(hits)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["line"]): (x["of_doc"], x["of_line"]) for x in line_dedup.repeated_lines(df).collect()}
    assert set(got) == set(want) and len(want) > 50
    exact = {(x["doc_id"], x["line"]) for x in line_dedup.repeated_lines(df, max_edits=0).collect()}
    first = set()
    assert exact == {(i, k) for i, k, w in lines if w in first or first.add(w)}
    rest = line_dedup.remove_lines(odd, line_dedup.repeated_lines(odd))
    assert rest.columns == odd.columns and rest.count() == len(ODD)
    assert line_dedup.by_document(odd, line_dedup.repeated_lines(odd)).count() == len(ODD)
    assert line_dedup.repeated_lines(none).count() == 0


def test_copies_go_and_short_lines_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nok"), (2, "One  two three four five\nok"), (3, "one two THREE x five\nnew line of some words here\nok")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs)).collect()}
    assert got == {1: "one two three four five\nok", 2: "ok", 3: "new line of some words here\nok"}


def test_short_lines_repeat_exactly(spark, tmp_path):
    rows = [(1, "All rights reserved.\nok\n\none two three four five"), (2, "all  rights reserved.\n\nall rights observed.\none two THREE x five"), (3, "OK\nall rights\nok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): (r["of_doc"], r["of_line"], r["near"]) for r in line_dedup.repeated_lines(docs, exact_words=1).collect()}
    assert got == {(2, 0): (1, 0, False), (2, 3): (1, 3, True), (3, 0): (1, 1, False), (3, 2): (1, 1, False)}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    by = {r["doc_id"]: r["removed_lines"] for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert by == {1: "", 2: "0,3", 3: "0,2"}
    pipeline = pytest.importorskip("corpus_pipeline")
    assert {r["doc_id"]: r["text"] for r in pipeline.lines(spark, docs, str(tmp_path)).collect()} == {1: rows[0][1], 2: "\nall rights observed.", 3: "all rights"}


def test_substring_dedup_by_brute_force(spark, odd, none):
    r = random.Random(4)
    bank = [s.capitalize() + "." for s in _prose(80, 13, 14)]
    docs = [(i, "".join(r.choice(bank) + r.choice((" ", "\n")) for _ in range(r.randint(1, 9)))) for i in range(60)] + [(70, "So. So. So."), (71, "So.")]
    got = {x["doc_id"]: x for x in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), 20).collect()}
    seen = set()
    for i, t in docs:
        own, marked = set(), []
        for k, (a, b, ws) in enumerate(substring_dedup.units(t)):
            unit = " ".join(ws).lower()
            if unit in seen or unit in own:
                marked.append((k, a, b, len(ws)))
            own.add(unit)
        seen |= own
        assert [(s["start"], s["stop"]) for s in got[i]["spans"]] == [(a, b) for a, b, _ in substring_dedup.runs(marked, 20)], i
    assert substring_dedup.repeated_spans(odd).count() == len(ODD) and substring_dedup.repeated_spans(none).count() == 0
    assert substring_dedup.remove_repeats(odd).columns == odd.columns


def test_planted_passage_goes_from_the_later_document(spark):
    a, b, passage = (" ".join(s.capitalize() + "." for s in _prose(6, k, 16)) for k in (21, 22, 23))
    docs = spark.createDataFrame([(1, f"{a} {passage}"), (2, f"{passage}\n{b}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1] == f"{a} {passage}" and got[2].strip() == b


# --- personal data ---------------------------------------------------------------------------------------------------

_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _spans(t):
    out = []
    for kind, pattern in _KINDS.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            if {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".") if p.isdigit()), "card": 16 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_spans_by_brute_force(spark, odd, none):
    r = random.Random(6)
    bits = ["a@b.com", "x_y@q.w-e.org", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "7", " ", "-", "é", "𝄞", "(", "word", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["1" * 20_000 + "@x.y", "a@" + "b." * 9_000 + "c", "+1" + "(" * 9_000, "9" * 50 + ".1.1.1", None, ""]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in pii.span_digest(pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        want = _spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i]["spans"])
        assert got[i]["n_email"] == want.count("email:") and got[i]["spans"].startswith(want)
    assert pii.sanitize(odd).count() == len(ODD) and pii.sanitize(none).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"A{i} projekt B{i} Zebulon C{i} number {i} mail head@zeb.org and b{i} sky.") for i in range(6)] + [(100 + i, f"Plain sky {i} number text and mail") for i in range(30)]
    rows += [(200 + i, "copied words with own@mail.org only copied") for i in range(5)]
    got = {x["doc_id"]: x for x in pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([t["value"] for t in got[i]["terms"]] == ["projekt", "Zebulon"] for i in range(6))
    assert got[0]["sanitised"] == "A0  B0  C0 number 0 mail [email] and b0 sky."
    assert not any(got[i]["terms"] for i in got if i >= 100) and got[100]["sanitised"] == rows[6][1]


def test_constant_signatures_disclose_and_near_copies_do_not(spark):
    prose = _prose(400, 31, 40)
    rows = [(i, f"{prose[i]}\nRegards, Jane Zebulon jane@zeb.org") for i in range(50)]
    # a name in ten different texts, and 200 near copies of another text with the same address
    rows += [(100 + i, f"Quillon {prose[60 + i]} sent from m@quill.org") for i in range(10)]
    r = random.Random(32)
    copied = prose[80] + " " + prose[81]
    rows += [(200 + i, f"{_edited(copied, r, 0.02)} sent from m@quill.org") for i in range(200)]
    rows += [(500 + i, prose[90 + i]) for i in range(300)]
    got = {x["doc_id"]: [t["value"].lower().strip(",") for t in x["terms"]] for x in pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({"jane", "zebulon"} <= set(got[i]) for i in range(50))
    assert all("quillon" in got[100 + i] for i in range(10))
    assert not any(w.startswith("zz") for i in range(200) for w in got[200 + i]) and not any(got[500 + i] for i in range(300))


def test_near_copies_alone_disclose_nothing(spark):
    r = random.Random(33)
    prose = _prose(240, 34, 60)
    rows = [(i, f"{_edited(prose[0], r, 0.03)} Peregrin own@mail.org") for i in range(40)] + [(100 + i, t) for i, t in enumerate(prose[1:])]
    assert not any(x["terms"] for x in pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect())


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_rates_bring_totals_to_targets(spark, odd, none, labels):
    marker = {"high": "fine", "low": "dull", "toxic": "scum"}
    rows = [(i, t + f" {marker[d]}" * 3, d) for i, (t, d) in enumerate(zip(_prose(300, 14), ["high"] * 150 + ["low"] * 100 + ["toxic"] * 50, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    rates, report = mixing.mix(docs.drop("domain"), docs.filter("doc_id % 2 = 0").select("doc_id", "domain"), {"high": 0.8, "low": 0.15, "toxic": 0.05})
    got = dict(zip(report["domains"], report["after"], strict=True))
    assert got["low"] / got["high"] == pytest.approx(0.15 / 0.8, rel=0.05) and got["toxic"] / got["high"] == pytest.approx(0.05 / 0.8, rel=0.08)
    by = {r["doc_id"]: r for r in rates.collect()}
    assert all(r["rate"] >= 0 for r in by.values()) and min(by[i]["rate"] for i in range(150)) > 0.9 and max(by[i]["rate"] for i in range(250, 300)) < 0.7
    # the rates solve the same problem as a dense solver's
    p = np.array([by[i]["p"] for i in range(300)])
    n = np.array([by[i]["tokens"] for i in range(300)], dtype=float)
    w, goal, total = np.ones(300), np.array(report["target"]), n.sum()
    for _ in range(20_000):
        w = np.maximum(0, w - 0.5 * (p @ ((w * n) @ p - goal) / total + 2e-4 * (w - 1)))
    assert np.abs(w - np.array([by[i]["rate"] for i in range(300)])).max() < 0.05
    drawn = mixing.draw(docs, rates)
    assert drawn.columns == docs.columns and drawn.filter("domain = 'high'").select("doc_id").distinct().count() == 150
    odds, _ = mixing.mix(odd, mixing.quality_domains(labels), {"high": 1.0})
    assert odds.count() == len(ODD) and mixing.draw(odd, odds).columns == odd.columns
    assert mixing.mix(none, mixing.quality_domains(labels), {"high": 1.0})[0].count() == 0
    assert all(r["rate"] == 1.0 for r in mixing.mix(odd, mixing.quality_domains(labels).limit(0), {})[0].collect())


@pytest.mark.parametrize("rate", [0.8, 0.985, 1.1, 1.99])
def test_draw_follows_the_rates(spark, rate):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    drawn = mixing.draw(docs, docs.select("doc_id", F.lit(rate).alias("rate")))
    assert drawn.count() / 20_000 == pytest.approx(rate, abs=0.01)


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = _prose(120, 15, 90)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)] + [(500, prose[3], "en", "s0", 1), (501, "short " + prose[4], "en", "s1", 1), (502, None, None, None, None)]
    rows += [(600 + i, "vile scum " + t.upper() + "!!!", "en", "s0", 1) for i, t in enumerate(_prose(40, 16))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(600 + i, 0, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            docs.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r["doc_id"] for r in docs.collect()})
    assert all(set(range(120)) <= s for s in seen) and not any(i >= 600 for i in seen[0]) and 500 not in seen[1] and 501 not in seen[2]
    assert docs.count() > 0 and pipeline.run(spark, str(tmp_path)).agg(F.count_distinct("doc_id")).first()[0] >= 120
