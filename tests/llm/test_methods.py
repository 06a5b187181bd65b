"""The corpus operators' methods against brute force, and rows that share an id."""

import collections
import math
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _common, embedding_dedup, line_dedup, logistic, mixing, ngram_join, pii, quality_classifier, quality_rules, queries, spans, substring_dedup


def _prose(n, seed, size=60, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(words) for _ in range(r.randint(size // 2, size))) for _ in range(n)]


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, (tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())))


# --- expressions on spans --------------------------------------------------------------------------------------------


def test_running_folds_and_replacement(spark):
    r = random.Random(1)
    arrays = [[r.randint(-5, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 16, 17, 300)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, v array<int>")
    got = {x["i"]: x for x in df.select("i", spans.running(F.col("v"), lambda a, b: a + b).alias("s"), spans.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()}
    for i, a in enumerate(arrays):
        assert got[i]["s"] == [sum(a[:k]) for k in range(len(a))] and got[i]["m"] == [max([0, *a[:k]]) for k in range(len(a))]
    rows = []
    for i, n in enumerate((0, 1, 50, 4096, 4097, 20_000)):
        text = "".join(r.choice("ab𝄞é\n ") for _ in range(n))
        own = sorted({(a := r.randint(0, n), min(n, a + r.randint(1, 6000 if i == 5 else 9))) for _ in range(min(n, 25))})
        rows.append((i, text, [{"start": a, "stop": b} for a, b in own if b > a]))
    df = spark.createDataFrame(rows, "i int, text string, cut array<struct<start:int,stop:int>>")
    got = {x["i"]: x["t"] for x in df.select("i", spans.replaced(F.col("text"), F.col("cut"), lambda s: F.lit("[x]")).alias("t")).collect()}
    for i, text, own in rows:
        out, at = "", 0
        for s in own:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[x]"
            at = max(at, s["stop"])
        assert got[i] == out + text[at:], i


# --- personal data ---------------------------------------------------------------------------------------------------


def _bare(text):
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in re.split(r"[\x20\x09-\x0D]+", text.lower())]
    return {w for w in words if len(w) >= 3}


def test_disclosing_terms_by_brute_force(spark):
    """Every (entity, term) of a random table: mutual information, different texts, and chance among all pairs."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("bcdfgaeiou") for _ in range(5)) for _ in range(900)]
    rows = []
    for i in range(260):
        words = [r.choice(vocabulary) for _ in range(14)]
        if i % 6 == 0:
            words.insert(3, f"u{i}@host{i % 4}.org")
            words += ["Signed", f"branch{i % 4}"]
        if i % 13 == 0:
            words += [f"+1 (555) 555-{1000 + i}", "dial."]
        rows.append((i, " ".join(words)))
    docs = _texts(spark, rows)
    got = {(x["entity"], x["term"]): x["bits"] for x in pii.disclosing_terms(pii._rows(docs).cache(), 0.8, 3).collect()}
    entities = collections.defaultdict(set)
    for i, t in rows:
        for m in re.finditer(r"[a-z0-9]+@([a-z0-9.]+)", t):
            entities[f"email:{m[0]}"].add(i), entities[f"email family:{m[1]}"].add(i), entities["email"].add(i), entities["any"].add(i)
        for m in re.finditer(r"\+1 \(555\) 555-(\d+)", t):
            entities[f"phone:{m[0]}"].add(i), entities["phone family:1555"].add(i), entities["phone"].add(i), entities["any"].add(i)
    terms, total = {i: _bare(t) for i, t in rows}, len(rows)
    of_term = collections.Counter(w for ws in terms.values() for w in ws)
    looked = math.log(sum(len(terms[i]) for e, ids in entities.items() if len(ids) >= 3 or e in pii.WHOLE for i in ids))
    want = {}
    for e, ids in entities.items():
        p = len(ids) / total
        for w, n in collections.Counter(w for i in ids for w in terms[i]).items():
            q = n / of_term[w]
            chance = n * (math.log(q / p) + ((1 - q) / q * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))
            if n >= 3 and q > 0.5 and math.log(q / p) >= -0.8 * math.log(p) and chance >= looked:
                want[e, w] = math.log2(q / p)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ("any", "signed") in want and ("email family:host2.org", "branch2") in want and ("phone", "dial") in want


def test_announced_values_by_brute_force(spark):
    """Keys after a disclosing word go in every document, copied or not; what others announce, and common words, stay."""
    r = random.Random(8)
    prose = _prose(1000, 9, 40)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(32))
    rows, planted = [], {}
    for i in range(60):
        planted[i] = key()
        rows.append((i, f'{prose[i]} token = "{planted[i]}"### n{i}@mail.org'))
    rows += [(100 + i, rows[7][1]) for i in range(30)]  # copies of one document
    planted |= {100 + i: planted[7] for i in range(30)}
    for i in range(10):  # without other personal data, and the key once more before its announcement
        planted[200 + i] = key()
        rows.append((200 + i, f"{planted[200 + i]} {prose[100 + i]} token: {planted[200 + i]}"))
    rows += [(300 + i, f'{prose[150 + i]} colour = "{key()}" and {prose[200 + i]}') for i in range(40)]
    rows += [(400 + i, f"{prose[250 + i]} token common {prose[300 + i]} m{i}@mail.org") for i in range(8)] + [(500 + i, f"{prose[350 + i]} common") for i in range(60)] + [(1000 + i, prose[450 + i]) for i in range(500)]
    rows += [(600, f"{prose[420]} token p@q.org after")]
    got = {x["doc_id"]: x for x in pii.sanitize(_texts(spark, rows)).collect()}
    for i, text in rows:
        values = [(t["start"], t["stop"]) for t in got[i]["terms"] if t["kind"] == "value"]
        assert values == ([m.span() for m in re.finditer(planted[i], text)] if i in planted else []), (i, values)
        assert [t["value"] for t in got[i]["terms"] if t["kind"] == "term"] == re.findall("token", text)
    assert planted[3] not in got[3]["sanitised"] and '= "[value]"' in got[3]["sanitised"]


def test_terms_go_wherever_they_stand(spark):
    prose = _prose(300, 6, 40)
    rows = [(i, f"{prose[i]} secret key, n{i}@mail.org") for i in range(40)] + [(100 + i, prose[40 + i]) for i in range(200)] + [(900, f"{prose[250]} (Secret) KEY. it was")]
    got = {x["doc_id"]: x for x in pii.sanitize(_texts(spark, rows)).collect()}
    assert [t["value"] for t in got[900]["terms"]] == ["Secret", "KEY"] and got[900]["sanitised"] == f"{prose[250]} () . it was"
    assert got[0]["sanitised"] == f"{prose[0]}  , [email]" and not any(got[100 + i]["terms"] for i in range(200))


def test_capital_i_with_dot_and_terms_beside_spans(spark):
    rows = [(i, f"word{i} İstanbul, zeb@x.org ({i}) x{i}@zeb.org") for i in range(12)] + [(100 + i, t) for i, t in enumerate(_prose(150, 8, 20))]
    got = {x["doc_id"]: x for x in pii.sanitize(_texts(spark, rows)).collect()}
    assert all("İstanbul" in [t["value"] for t in got[i]["terms"]] for i in range(12))
    for x in got.values():
        assert not any(a["start"] < b["stop"] and b["start"] < a["stop"] for a in x["base"] for b in x["terms"])


@pytest.mark.parametrize("n", [16_000])
def test_many_spans_of_one_text_are_not_quadratic(spark, n):
    docs = _texts(spark, [(1, " ".join(f"a{i}@x.org" for i in range(n)))])
    pii.span_digest(pii.sanitize(_texts(spark, [(1, "a@x.org")]))).collect()  # compiled
    begun = time.time()
    found = pii.base_spans(docs).select(F.size("base").alias("n"), spans.replaced(F.col("text"), pii._placed(F.col("base")), lambda s: F.lit("@")).alias("t")).collect()[0]
    assert found["n"] == n and found["t"] == " ".join("@" * n) and time.time() - begun < 15


# --- rows that share an id -------------------------------------------------------------------------------------------


def test_rows_that_share_an_id_lose_only_their_own(spark):
    long_a, long_b = ". ".join(s.capitalize() for s in _prose(6, 21, 16)) + ".", ". ".join(s.capitalize() for s in _prose(6, 22, 16)) + "."
    rows = [(1, long_a), (7, long_a + " Own words here."), (7, long_b + " and a wholly different end."), (None, long_a), (None, long_b), (None, long_b)]
    got = sorted((str(r["doc_id"]), r["text"].strip()) for r in substring_dedup.remove_repeats(_texts(spark, rows)).collect())
    assert ("1", long_a) in got and ("7", "Own words here.") in got
    later = [t for i, t in got if i == "None"]
    assert all(long_b[:-1].split(". ")[0] not in t for t in later)  # the one with id 7 is the earlier
    assert any(i == "7" and t.startswith(long_b[:40]) and t.endswith("different end.") for i, t in got)


def test_units_of_any_length_go_by_brute_force(spark):
    r = random.Random(3)
    bank = ["So.", "Yes.", "No way!", "All rights reserved", *(s.capitalize() + "." for s in _prose(30, 13, 10))]
    docs = [(r.choice((None, *range(20))), "".join(r.choice(bank) + r.choice((" ", "\n")) for _ in range(r.randint(0, 7)))) for _ in range(80)]
    found = substring_dedup.repeated_spans(_texts(spark, docs)).collect()
    assert len(found) == len(docs)
    key = {(x["doc_id"], x["text_id"]) for x in found}
    assert len(key) == len({(i, t) for i, t in docs})
    hashed = dict(zip(sorted({t for _, t in docs}), [x["k"] for x in spark.createDataFrame([(t,) for t in sorted({t for _, t in docs})], "text string").select(_common.text_key().alias("k")).collect()], strict=True))
    order = sorted({((1 << 63) - 1 if i is None else i, hashed[t], i, t) for i, t in docs}, key=lambda x: x[:2])
    seen, want = set(), {}
    for _, k, i, t in order:
        own, marked = set(), []
        for at, (a, b, ws) in enumerate(substring_dedup.units(t)):
            unit = " ".join(ws).lower()
            if unit in seen or unit in own:
                marked.append((at, a, b, len(ws)))
            own.add(unit)
        seen |= own
        want[i, k] = [(a, b) for a, b, _ in substring_dedup.runs(marked, 1)]
    assert {(x["doc_id"], x["text_id"]): [(s["start"], s["stop"]) for s in x["spans"]] for x in found} == want and sum(map(len, want.values())) > 50


def test_hot_units_are_joined_back(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 5)  # a unit in more than one of five is hot
    rows = [(i, f"Hello. Unit {i % 9} is here. Mine {i}.") for i in range(60)]
    got = {x["doc_id"]: x["n_repeated"] for x in substring_dedup.repeated_spans(_texts(spark, rows)).collect()}
    assert got == {i: (i > 0) + (i >= 9) for i in range(60)}


def test_lines_and_decisions_of_rows_that_share_an_id(spark):
    rows = [(1, "all of this line is repeated"), (7, "all of this line is repeated\nkept one"), (7, "my own line that stands nowhere else\nkept two"), (8, None)]
    docs = _texts(spark, rows).withColumn("__gone", F.lit(1)).withColumn("id", F.lit("x")).withColumn("a.b", F.lit(2))
    out = line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs, exact_words=1))
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [(1, rows[0][1]), (7, "kept one"), (7, rows[2][1])]
    decided = docs.select("doc_id", _common.text_key().alias("text_id"), (F.col("text").contains("own line") | F.col("text").isNull()).alias("kept"))
    kept = quality_classifier.keep_good(docs, decided.withColumn("kept", F.coalesce("kept", F.lit(True))))
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(7, rows[2][1]), (8, "")]


def test_near_copies_that_share_an_id(spark):
    a, b = _prose(2, 41, 80)
    rows = [(1, a), (7, a + " x"), (7, b), (9, b + " y")]
    got = {(r["doc_id"], r["n_shingles"] == len(set(zip(*[b.split()[k:] for k in range(5)], strict=False)))): r["component_id"] for r in ngram_join.similar_documents(_texts(spark, rows)).collect()}
    assert got == {(1, False): 1, (7, False): 1, (7, True): 7, (9, False): 7}


def test_common_shingles_are_dealt_by_sets(spark):
    levels = np.zeros(1 << 22, dtype=np.uint8)
    shingles = np.arange(1, 50, dtype=np.uint64) << np.uint64(40)
    levels[ngram_join._cell(shingles[:9], len(levels))] = 3
    assert (ngram_join._salt(shingles, 77, levels)[:9] == 1 + 77 % ngram_join.SALTS).all() and not ngram_join._salt(shingles, 77, levels)[9:].any()
    one = ngram_join.set_id(shingles)
    assert ngram_join.named(shingles, frozenset()) == one[0] and ngram_join.named(shingles, frozenset([one[0]])) == one[1]


# --- classifier and rules --------------------------------------------------------------------------------------------


def _odds(p):
    return np.log(p / (1 - p))


def test_site_priors_by_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for host, share in enumerate((0.95, 0.9, 0.6, 0.15)):
        for path in range(5):
            own = share * (0.2 if path == 0 else 1.0)
            rows += [(float(r.normal(1.5 if r.random() < own else -1.5, 1.0)), f"h{host}", f"p{path}") for _ in range(int(r.integers(5, 120)))]
    got = {(x["host"], x["path"]): x for x in quality_classifier.site_priors(spark.createDataFrame(rows, "evidence double, host string, path string"), 0.6).collect()}
    e, hosts, paths = np.array([x[0] for x in rows]), [x[1] for x in rows], [x[1:] for x in rows]

    def varies(n, s, prior):
        seen, chance, whole = (n * (s / n - prior) ** 2).sum(), (prior * (1 - prior)).sum(), (n * prior * (1 - prior)).sum()
        return min(max((seen - chance) / (whole - chance), 0.0), 1.0)

    def shrink(v, n, s, prior):
        return prior + (v * n / (v * n + 1 - v)) * (s / n - prior)

    own = np.full(len(rows), 0.6)
    names, sites = sorted(set(hosts)), sorted(set(paths))
    for _ in range(3):
        p = 1 / (1 + np.exp(-(e + _odds(own))))
        prior = p.mean()
        n, s = (np.array([sum(w for w, h in zip(ws, hosts, strict=True) if h == x) for x in names]) for ws in (np.ones(len(p)), p))
        host = dict(zip(names, shrink(varies(n, s, np.full(len(n), prior)), n, s, prior), strict=True))
        up = np.array([host[h] for h, _ in sites])
        n, s = (np.array([sum(w for w, h in zip(ws, paths, strict=True) if h == x) for x in sites]) for ws in (np.ones(len(p)), p))
        path = dict(zip(sites, shrink(varies(n, s, up), n, s, up), strict=True))
        own = np.array([path[x] for x in paths])
    assert all(got[x]["host_prior"] == pytest.approx(host[x[0]], abs=1e-9) and got[x]["path_prior"] == pytest.approx(path[x], abs=1e-9) for x in sites)
    assert host["h0"] - host["h3"] > 0.3 and path["h2", "p1"] - path["h2", "p0"] > 0.05  # both levels tell


def test_equal_texts_are_judged_by_their_sites(spark):
    """Without the host's level the same text would be judged alike everywhere; without the path's, alike within a host."""
    r = random.Random(9)
    rows, marks = [], []
    for i in range(900):
        site = r.choice(("good/a", "bad/a", "bad/b"))
        bad = r.random() < {"good/a": 0.03, "bad/a": 0.9, "bad/b": 0.15}[site]
        words = ["alpha" if r.random() < (0.55 if bad else 0.45) else "beta" for _ in range(6)] + ["vile" if r.random() < (0.75 if bad else 0.1) else "kind"]
        rows.append((i, " ".join(words), f"http://{site.split('/')[0]}.org/{site.split('/')[1]}/{i}"))
        marks.append((i, 0 if bad else 1, 0))
    probe = "alpha beta alpha beta alpha beta vile"
    rows += [(2000 + k, probe, f"http://{s}/x") for k, s in enumerate(("good.org/a", "bad.org/a", "bad.org/b", "new.org/a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
    host, path = quality_classifier.site_of(F.col("url"))
    got = {x["doc_id"]: x for x in quality_classifier.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), host=host, path=path).collect()}
    assert len({round(got[2000 + k]["evidence"], 9) for k in range(4)}) == 1
    assert got[2000]["posterior"] > got[2002]["posterior"] > got[2001]["posterior"] and got[2000]["host_prior"] > got[2001]["host_prior"] + 0.1
    assert got[2002]["path_prior"] > got[2001]["path_prior"] + 0.1 and got[2000]["kept"] and not got[2001]["kept"]
    corpus = sum(x["posterior"] for x in got.values()) / len(got)
    assert abs(got[2003]["path_prior"] - corpus) < abs(got[2001]["path_prior"] - corpus)  # one document draws its site little


def test_determinant_is_least_by_brute_force(spark):
    r = np.random.default_rng(11)
    p = quality_rules.P
    mix = r.standard_normal((p, p)) * 0.15
    x = np.vstack([r.standard_normal((160, p)) @ mix + 0.5, r.standard_normal((40, p)) * 0.05 + 1.6])  # a cluster beside
    best = min(quality_rules.concentrate(x, x[i].mean(0), np.cov(x[i].T, bias=True), 0.75)[0] for i in (r.choice(len(x), p + 1, replace=False) for _ in range(500)))
    found, mu, cov = quality_rules.least_determinant(x)
    assert found <= best + 1e-6 and np.abs(mu - 0.5).max() < 0.1
    h = math.ceil(0.75 * len(x))
    scale = quality_rules.consistency()
    d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov * scale + quality_rules._RIDGE), x - mu)
    assert np.allclose(x[np.argsort(d, kind="stable")[:h]].mean(0), mu)  # the subset is that of its own estimate
    rows = spark.createDataFrame([(i, "en", "s", v.tolist()) for i, v in enumerate(x)], "doc_id long, lang string, source string, x array<double>")
    got = quality_rules.robust_estimates(rows).first()
    assert got["logdet"] == pytest.approx(found, abs=0.1) and np.abs(np.array(got["mu"]) - mu).max() < 0.03 and got["n"] == h


def test_small_groups_lean_on_their_language(spark):
    r = np.random.default_rng(12)
    p = quality_rules.P
    rows = [(i, "en", f"s{i % 3}", (r.standard_normal(p) * 0.2).tolist()) for i in range(900)] + [(1000 + i, "en", "tiny", [3.0] * p) for i in range(3)] + [(2000 + i, "en", "own", (r.standard_normal(p) * 0.2 + 1.5).tolist()) for i in range(600)]
    best = quality_rules.shrunk(quality_rules.robust_estimates(spark.createDataFrame(rows, "doc_id long, lang string, source string, x array<double>")), 50.0)
    mu = {x["source"]: np.array(x["mu"]) for x in best.collect()}
    assert np.abs(mu["tiny"] - 0.7).max() < 0.4 and np.abs(mu["own"] - 1.45).max() < 0.2 and np.abs(mu["s0"] - 0.1).max() < 0.2


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_rates_solve_the_least_squares(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet((0.6, 0.3, 0.2), 400).round(4)
    p[:, 2] = (1 - p[:, 0] - p[:, 1]).round(4)
    n = r.integers(1, 900, 400).astype(float)
    cells = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n double, p array<double>").cache()
    total, before = n.sum(), n @ p
    goal = before * np.array([1.0, 0.2, 0.05])
    for ridge in (1e-2, 1e-4):
        pull, off = mixing.solve(cells, goal, total, ridge, 60, 1e-10)
        w = np.maximum(0, 1 - p @ pull / ridge)
        assert off < 1e-10 and (w == 0).any() and (w > 0).any()
        slope = p @ ((w * n) @ p - goal) / total + ridge * (w - 1)
        assert np.abs(slope[w > 0]).max() < 1e-7 and slope[w == 0].min() > -1e-7  # the conditions of the minimum
    # projected gradient descent on the rates themselves comes to the same
    w, ridge = np.ones(400), 1e-2
    for _ in range(4000):
        w = np.maximum(0, w - 0.9 * (p @ ((w * n) @ p - goal) / total + ridge * (w - 1)))
    pull, _ = mixing.solve(cells, goal, total, ridge, 60, 1e-10)
    assert np.abs(w - np.maximum(0, 1 - p @ pull / ridge)).max() < 1e-6


def test_posteriors_are_calibrated_and_targets_met(spark):
    r = random.Random(4)
    rows = []
    for i, t in enumerate(_prose(900, 14)):
        d = r.choices(("high", "low", "toxic"), (0.8, 0.13, 0.07))[0]
        mark = {"high": "fine", "low": "dull", "toxic": "scum"}[d] if r.random() < 0.9 else "plain"
        rows.append((i, f"{t} {mark}", d))
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    own = docs.filter("doc_id % 2 = 0").select("doc_id", "domain")
    rates, report = mixing.mix(docs.drop("domain"), own, {"high": 0.9, "low": 0.07, "toxic": 0.03}, ridge=5e-5)
    assert report["missed"] == [] and report["off"] < 1e-9
    assert report["shares"] == pytest.approx([0.9, 0.07, 0.03], abs=0.002)
    held = rates.join(docs.select("doc_id", "domain"), "doc_id").filter("doc_id % 2 = 1")
    for i, d in enumerate(report["domains"]):
        row = held.agg(F.avg(F.get("p", F.lit(i))).alias("p"), F.avg((F.col("domain") == d).cast("double")).alias("y")).first()
        assert row["p"] == pytest.approx(row["y"], abs=0.035)
    _, free = mixing.mix(docs.drop("domain"), own, {"high": 0.9, "low": 0.1}, ridge=5e-5)
    assert free["target"][2] == free["before"][2] and free["missed"] == []
    counted = docs.select("doc_id", F.lit(10).alias("n_tokens"))
    assert {x["tokens"] for x in mixing.mix(docs.drop("domain"), own, {"high": 1.0}, counted=counted)[0].collect()} == {10}


def test_unreachable_targets_are_reported(spark):
    rows = [(i, t + (" scum" if i % 2 else " fine"), "toxic" if i % 2 else "high") for i, t in enumerate(_prose(100, 15))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    _, report = mixing.mix(docs.select("doc_id", "text"), docs.select("doc_id", "domain"), {"high": 0.5, "toxic": 50.0}, ridge=1.0)
    assert report["missed"]


def test_softmax_by_gradient():
    r = np.random.default_rng(1)
    x, y = r.standard_normal((300, 3)), r.integers(0, 3, 300)
    w = logistic.fit_softmax(x, y, 3)
    design = np.hstack([x, np.ones((300, 1))])
    z = np.exp(design @ w.T)
    slope = (z / z.sum(1, keepdims=True) - np.eye(3)[y]).T @ design
    slope[:, :-1] += w[:, :-1]
    assert np.abs(slope[:, :-1]).max() < 1e-3


# --- vectors ---------------------------------------------------------------------------------------------------------


def test_one_large_label_and_repeated_rows(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 32))
    rows = [(i, (base[i % 300] + r.standard_normal(32) * 0.05).astype("f4").tolist(), 0) for i in range(2400)]
    rows += [(5000 + i, r.standard_normal(32).astype("f4").tolist(), 1 + i) for i in range(40)] + [(9000, [1.0, 2.0], 3), (9000, [1.0, 2.0], 3)]
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=128).collect()}
    x = np.array([v for _, v, l in rows if l == 0], dtype="f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert links.sum() > 5000 and [got[i]["n_links"] for i in range(2400)] == links.tolist()
    assert got[9000]["n_links"] == 0 and all(got[5000 + i]["n_links"] == 0 for i in range(40))


# --- scratch tables --------------------------------------------------------------------------------------------------


def test_scratch_tables_go(spark):
    root = _common.scratch_root(spark).removeprefix("file://")
    docs = _texts(spark, [(i, t) for i, t in enumerate(_prose(20, 51))] + [(100, "a@b.org here")])
    before = set(os.listdir(root))
    for operator in (pii.sanitize, substring_dedup.repeated_spans, ngram_join.similar_documents, line_dedup.repeated_lines):
        result = operator(docs)
        left = set(os.listdir(root)) - before
        assert len(left) == len({f.split("tessera-")[1].split("/")[0] for f in result.inputFiles() if "tessera-" in f}) and result.count() >= 0
        before |= left


@pytest.mark.parametrize("stage", range(4))
def test_stages_bear_odd_tables(spark, tmp_path, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = _prose(30, 61, 40)
    rows = [(i, t, "en", f"s{i % 2}", 1, "x", 7) for i, t in enumerate(text)] + [(3, text[3], "en", "s1", 1, "x", 7)] * 2 + [(None, text[4], None, None, None, None, None), (40, None, "en", "s", 0, "", 0), (41, "", "en", "s", 0, "", 0), (42, "z" * 100_000, "en", "s", 0, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, `times` long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 10 > 0, False) for i in range(30)], "doc_id long, quality boolean, toxic boolean").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).write.parquet(str(tmp_path / "labels.parquet"))
    run = pipeline.STAGES[stage][1]
    out = run(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() > 0 and run(spark, docs.limit(0), str(tmp_path)).count() == 0
