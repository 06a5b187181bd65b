"""Soft-membership mixing: document rates whose expected domain tokens match target weights."""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import packed, table, text_key, texts, tidy, unpacked
from .logistic import fit_logistic, fit_softmax, scores

_SPLIT = r"[^\p{L}\p{N}]+"


def _marks(text: Column) -> Column:
    """Style as words that no text holds: capitals, symbols and columns in more than a few of a text's characters."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda letters: (F.length(text) - F.length(F.translate(text, letters, ""))) / size
    flag = lambda holds, name: F.when(holds, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    capitals, symbols = share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("#*$%&|<>!")
    return F.concat(flag(capitals > 0.25, "<capitals>"), flag(symbols > 0.01, "<symbols>"), flag(symbols > 0.06, "<many symbols>"))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _SPLIT)


def train(documents: DataFrame, labelled: DataFrame, bound: int = 4000, vocabulary: int = 200, least_z: float = 4.0, folds: int = 3) -> dict:
    """A classifier of domains from at most `bound` labelled documents (doc_id, domain).

    The sample is the labelled ids of least hash. Its words are counted in Spark; the `vocabulary` words and style marks
    whose presence tells the domains apart best come to the driver with the sample's hits, and one ridge logistic
    regression for each domain is fitted there. Their scores are calibrated by a softmax regression on scores that models
    of the other `folds` gave each document, so that the posteriors of a set of documents sum to its domains' shares.
    Returns {"domains": [...], "base": [...], "words": {word: [weight by domain]}, "softmax": [[...]]}: a document's score of
    a domain is the base plus its words' entries, and a row of `softmax` turns all scores into a domain's log odds.
    """
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    sample = texts(documents).join(F.broadcast(chosen), "doc_id")  # bounded by the parameter
    present = table(sample.select("doc_id", "domain", F.array_distinct(F.concat(_words(F.col("text")), _marks(F.col("text")))).alias("w")), "sample")
    sizes = {r["domain"]: r["n"] for r in present.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    domains, total = list(sizes), sum(sizes.values())
    if len(domains) < 2:
        return {"domains": domains, "base": [0.0] * len(domains), "words": {}, "softmax": []}
    counts = present.select("domain", F.explode("w").alias("word")).filter("word <> ''").groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    n = [F.col(f"n{i}") for i in range(len(domains))]
    every = n[0]
    for c in n[1:]:
        every = every + c
    share = every / total
    z = F.greatest(*[F.abs(c / sizes[d] - share) / F.sqrt(share * (1 - share) / sizes[d] + 1e-12) for c, d in zip(n, domains, strict=True)])
    rows = counts.filter(every >= 5).withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(vocabulary).collect()
    words = [r["word"] for r in rows]
    number = {w: i for i, w in enumerate(words)}
    hits = present.select("doc_id", "domain", F.array_sort(F.array_intersect("w", _listed(words))).alias("hits")).collect()
    hits.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["domain"], r["hits"]))
    found, truth = [[number[w] for w in r["hits"]] for r in hits], [r["domain"] for r in hits]

    def fit(keep: list[int], d: str) -> np.ndarray:
        return fit_logistic([(found[i], truth[i] == d) for i in keep], len(words))

    held = np.zeros((len(hits), len(domains)))
    for f in range(folds):
        out, rest = list(range(f, len(hits), folds)), [i for i in range(len(hits)) if i % folds != f]
        for k, d in enumerate(domains):
            held[out, k] = scores([found[i] for i in out], fit(rest, d)) if rest else 0.0
    softmax = fit_softmax(np.clip(held, -20, 20), np.array([domains.index(d) for d in truth]), len(domains))
    weights = [fit(list(range(len(hits))), d) for d in domains]
    return {"domains": domains, "base": [float(w[-1]) for w in weights], "words": {w: [float(x[i]) for x in weights] for i, w in enumerate(words)}, "softmax": softmax.tolist()}


def _listed(words: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def posteriors(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, text_id, tokens (words of letters and digits), p: the posterior of each domain, to four decimals, summing to 1."""
    domains, words = model["domains"], model["words"]
    text = F.col("text")
    base = texts(documents, text_key().alias("text_id")).select("doc_id", "text_id", _words(text).alias("w"), _marks(text).alias("m"))
    tokens = F.size("w") - F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0) - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    entries = F.from_json(F.lit(json.dumps(words)), "map<string,array<double>>")
    hits = F.array_intersect(F.concat("w", "m"), _listed(list(words)))
    out = base.select("doc_id", "text_id", tokens.cast("long").alias("tokens"), hits.alias("hits"))
    add = lambda i: lambda s, w: s + F.get(F.element_at(entries, w), F.lit(i))
    score = [F.aggregate("hits", F.lit(b), add(i)) for i, b in enumerate(model["base"])]
    out = out.select("doc_id", "text_id", "tokens", F.array(*score).alias("s"))
    k = len(domains)
    score = [F.greatest(F.least(F.get("s", F.lit(i)), F.lit(20.0)), F.lit(-20.0)) for i in range(k)]
    logits = []
    for row in model["softmax"]:
        z = F.lit(row[-1])
        for w, x in zip(row[:-1], score, strict=True):
            z = z + w * x
        logits.append(z)
    out = out.select("doc_id", "text_id", "tokens", F.array(*logits).alias("z"))
    out = out.select("doc_id", "text_id", "tokens", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    first = [F.round(F.get("e", F.lit(i)) / total, 4) for i in range(len(domains) - 1)]
    rest = F.lit(1.0)
    for f in first:
        rest = rest - f
    return out.select("doc_id", "text_id", "tokens", F.array(*first, F.round(rest, 4)).alias("p"))


def _rate(p: Column, pull: np.ndarray, ridge: float) -> Column:
    """The rate of a document with posterior p: the projection on rates >= 0 of 1 less what the domains' surplus takes."""
    rate = F.lit(1.0)
    for i, x in enumerate(pull.tolist()):
        rate = rate - F.get(p, F.lit(i)) * (x / ridge)
    return F.greatest(F.lit(0.0), rate)


def solve(cells: DataFrame, goal: np.ndarray, total: float, ridge: float, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """The domains' surpluses a token, r, at the least squares solution over cells (p, n), and how far they are from it.

    At the solution every rate is max(0, 1 - p.r / ridge), so it is enough to find r with r = (sum(n p rate) - goal) / total.
    A round is a projected gradient step in the metric of the documents whose rate is above zero (the two-metric projection,
    or projected Newton method): one distributed sum of their totals and of their k x k Gram matrix, for a whole step and
    for shorter ones, of which the one with the least objective is taken. The objective is convex and piecewise quadratic,
    so that few rounds reach `tolerance`.
    """
    k = len(goal)
    p = [F.get("p", F.lit(i)) for i in range(k)]

    def sums(pulls: list[np.ndarray]) -> list[tuple]:
        rates = [_rate(F.col("p"), r, ridge).alias(f"w{c}") for c, r in enumerate(pulls)]
        held, out = cells.select("n", "p", *rates), []
        for c in range(len(pulls)):
            w = F.col(f"w{c}")
            free = F.when(w > 0, F.col("n")).otherwise(0.0)
            out += [F.sum(F.col("n") * w * x).alias(f"t{c}_{i}") for i, x in enumerate(p)]
            out += [F.sum(free * p[i] * p[j]).alias(f"g{c}_{i}_{j}") for i in range(k) for j in range(i, k)]
            out.append(F.sum(F.col("n") * w * w).alias(f"q{c}"))
        row = held.agg(*out).first()
        value = lambda name: float(row[name] or 0)
        found = []
        for c, r in enumerate(pulls):
            t = np.array([value(f"t{c}_{i}") for i in range(k)])
            gram = np.array([[value(f"g{c}_{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
            objective = r @ r / 2 + r @ goal / total + ridge / 2 * value(f"q{c}") / total
            found.append((objective, r, r - (t - goal) / total, gram / total))
        return found

    _, r, off, gram = sums([np.zeros(k)])[0]
    for _ in range(rounds):
        if np.abs(off).max() < tolerance:
            break
        step = np.linalg.solve(np.eye(k) + gram / ridge, off)
        tried = sums([r - size * step for size in (1.0, 0.5, 0.2, 0.05)])
        _, r, off, gram = min(tried, key=lambda x: x[0])
    return r, float(np.abs(off).max())


@tidy
def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], bound: int = 4000, ridge: float = 2e-4, rounds: int = 40, tolerance: float = 1e-9, training: DataFrame | None = None, counted: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """A rate for each document: how often to take it so that expected domain tokens match `targets`.

    A classifier trained on at most `bound` labelled rows (doc_id, domain; texts from `training`, by default from the
    documents themselves) gives every document a calibrated posterior over domains. With n tokens and posterior p, rates
    w >= 0 minimise the squared distance of the domain totals sum(w n p) from the targets, plus `ridge` times the
    token-weighted squared distance of w from 1, by projected gradient steps (`solve`) until the optimality conditions hold
    to `tolerance`. The targets are scaled so that the domain of largest weight keeps its present total; its documents
    stay near rate 1. A domain without a target keeps its present total too.

    Tokens are runs of letters and digits, or where `counted` (doc_id, n_tokens) is given, such as a tokenizer's counts
    by `token_counts`, those; rows it lacks have none. Steps depend on a document only through p, so documents are first
    summed by p (four decimals); each round is one distributed sum over that table. Built-in expressions only.

    Returns a DataFrame (doc_id, text_id (a hash of the text), tokens, p array in order of the domains' names, rate), one row for each input row, and
    a report {"domains", "before", "target", "after" (token totals), "shares" (of the total after), "missed" (domains
    more than 2 in 100 off their target, which no rates near 1 reach), "off" (what the conditions lack)}. Null and empty
    texts have no tokens and their prior's posterior. Targets of domains without a label are left out.
    With fewer than two labelled domains all rates are 1. Rows that repeat, null ids and empty tables pass through.
    """
    model = train(documents if training is None else training, labelled, bound)
    domains = model["domains"]
    if len(domains) < 2:
        out = texts(documents, text_key().alias("text_id")).select("doc_id", "text_id", F.size(F.filter(_words(F.col("text")), lambda w: w != "")).cast("long").alias("tokens"), F.array(*[F.lit(1.0) for _ in domains]).cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
        return out, {"domains": domains, "before": [], "target": [], "after": [], "shares": [], "missed": [], "off": 0.0}
    scored = posteriors(documents, model)
    if counted is not None:
        own = counted.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("n_tokens").cast("long").alias("counted"))
        scored = scored.join(own, "doc_id", "left").select("doc_id", "text_id", F.coalesce("counted", F.lit(0).cast("long")).alias("tokens"), "p")
    scored = table(scored, "posteriors")
    cells = table(scored.groupBy("p").agg(F.sum("tokens").alias("n")), "cells")
    k = len(domains)
    pi = [F.get("p", F.lit(i)) for i in range(k)]
    totals = lambda w: cells.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * w * x).alias(f"t{i}") for i, x in enumerate(pi)]).first()
    row = totals(F.lit(1.0))
    total = float(row["n"] or 0) or 1.0
    before = np.array([float(row[f"t{i}"] or 0) for i in range(k)])
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    main = int(weight.argmax())
    goal = np.where([d in targets for d in domains], weight / max(weight[main], 1e-300) * before[main], before) if weight[main] > 0 else before
    pull, off = solve(cells, goal, total, ridge, rounds, tolerance)
    rate = _rate(F.col("p"), pull, ridge)
    row = totals(rate)
    after = np.array([float(row[f"t{i}"] or 0) for i in range(k)])
    missed = [d for d, x, y in zip(domains, after, goal, strict=True) if abs(x - y) > 0.02 * max(y, 1.0)]
    report = {"domains": domains, "before": before.tolist(), "target": goal.tolist(), "after": after.tolist(), "shares": (after / max(after.sum(), 1e-12)).tolist(), "missed": missed, "off": off}
    return scored.select("doc_id", "text_id", "tokens", "p", rate.alias("rate")), report


def draw(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more with the probability of the rest, by a
    hash of its id and text, so that expected totals are those of the rates. Rows are matched by id, and by text where
    `rates` tells it (text_id). All columns stay; rows without a rate stay once."""
    by_text = "text_id" in rates.columns
    keys = [F.col("doc_id").cast("long").alias("r_id"), *([F.col("text_id").alias("r_key")] if by_text else [])]
    rate = rates.select(*keys, "rate").groupBy("r_id", *(["r_key"] if by_text else [])).agg(F.max("rate").alias("rate"))
    rate = rate if by_text else rate.filter("r_id is not null")
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")) if by_text else F.col("id") == F.col("r_id")
    chance = F.pmod(F.xxhash64(F.lit("draw"), "id", "key"), F.lit(1_000_000)) / 1_000_000
    joined = packed(documents).join(rate, same, "left").withColumn("times", F.coalesce(F.floor(F.col("rate") + chance).cast("int"), F.lit(1)))
    return unpacked(joined.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), documents)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table with quality and toxic marks: toxic, low or high."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("domain"))
