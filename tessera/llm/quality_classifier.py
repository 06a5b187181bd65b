"""Hierarchical empirical Bayes: a document classifier's evidence combined with host and path posteriors."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, packed, slices, table, text_key, texts, tidy, unpacked
from .logistic import fit_logistic
from .quality_rules import statistics

_WORD = re.compile(r"[^\W\d_]+")
#: Steps at which each statistic of `quality_rules.statistics` becomes a yes-or-no feature.
STEPS = {"log_word_length": (1.0, 1.3, 2.1, 2.4), "symbol_share": (0.004, 0.02, 0.08), "repeat_line_share": (0.1, 0.3), "repeat_word_share": (0.1, 0.3, 0.6), "capital_share": (0.1, 0.3, 0.6), "mark_share": (0.004, 0.02, 0.08)}
LENGTHS = (4, 12, 30)


#: Lengths of word beginnings that are features like words, so that inflected and compound forms count together.
BEGINNINGS = (4, 5, 6, 7)


def _words(text: str) -> set[str]:
    """Distinct lower-case words, and beginnings of longer words, which end in a star."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


def _style(all_texts: list[str]) -> list[list[int]]:
    """Numbers of the style features that hold for each text."""
    out = []
    for n, *_, x in statistics(all_texts):
        found, k = [], 0
        for value, steps in [*zip(x, STEPS.values(), strict=True), (-n, tuple(-s for s in LENGTHS))]:
            found += [k + i for i, s in enumerate(steps) if value > s]
            k += len(steps)
        out.append(found)
    return out


N_STYLE = sum(map(len, STEPS.values())) + len(LENGTHS)


def _sample(documents: DataFrame, labels: DataFrame, good: Column, bound: int) -> DataFrame:
    """doc_id, text, good of at most `bound` labelled documents, those with the least hashes of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return texts(documents).join(F.broadcast(chosen), "doc_id")  # bounded by the parameter


def train(documents: DataFrame, labels: DataFrame, good: Column, bound: int = 10_000, vocabulary: int = 400, least_z: float = 5.0) -> dict:
    """A classifier of good documents, fitted on the driver from a sample of at most `bound` labelled documents.

    Features are style steps and the at most `vocabulary` words and word beginnings whose presence differs most between good and other
    documents of the sample (two-proportion z of at least `least_z`). Returns {"words": {word: number}, "weights":
    [...], "odds": log odds of good in the sample}. Without documents of both kinds nothing is learnt: no words, and
    weights that give every document the same.
    """
    sample = table(_sample(documents, labels, good, bound), "sample")

    def present(batches):
        for batch in slices(batches):
            words, marks = [], []
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                own = _words(text)
                words += own
                marks += [mark] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.bool_())], names=["word", "good"])

    n = sample.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("other")).first()
    blank = {"words": {}, "weights": [0.0] * (N_STYLE + 1), "odds": 0.0}
    if not n["good"] or not n["other"]:
        return blank
    counts = map_arrow(sample, present, "word string, good boolean").groupBy("word").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
    both = (F.col("a") + F.col("b")) / (n["good"] + n["other"])
    z = F.abs(F.col("a") / n["good"] - F.col("b") / n["other"]) / F.sqrt(both * (1 - both) * (1 / n["good"] + 1 / n["other"]) + 1e-12)
    chosen = counts.filter("a + b >= 5").withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(vocabulary).collect()
    words = {r["word"]: N_STYLE + i for i, r in enumerate(chosen)}

    def features(batches):
        lookup = _Lookup(words)
        for batch in slices(batches):
            found = _features(batch.column("text").to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("good")], names=["features", "good"])

    found = map_arrow(sample, features, "features array<int>, good boolean").toArrow().combine_chunks()  # bounded
    lists = found.column("features").combine_chunks()
    cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [(flat[a:b], g) for a, b, g in zip(cuts[:-1], cuts[1:], found.column("good").to_pylist(), strict=True)]
    weights = fit_logistic(rows, N_STYLE + len(words))
    return {"words": words, "weights": weights.tolist(), "odds": math.log(n["good"] / n["other"])}


class _Lookup:
    """The features of a word, itself and its beginnings, remembered for up to `limit` words; nothing else is built."""

    def __init__(self, words: dict[str, int], limit: int = 200_000):
        self.whole = {w: i for w, i in words.items() if not w.endswith("*")}
        self.begin = {n: {w[:-1]: i for w, i in words.items() if w.endswith("*") and len(w) == n + 1} for n in BEGINNINGS}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def __call__(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            own = [self.whole[word]] if word in self.whole else []
            own += [known[word[:n]] for n, known in self.begin.items() if len(word) > n and word[:n] in known]
            if len(self.seen) >= self.limit:
                self.seen.clear()
            self.seen[word] = found = tuple(own)
        return found


def _features(all_texts: list[str], lookup: _Lookup) -> list[list[int]]:
    out = []
    for style, text in zip(_style(all_texts), all_texts, strict=True):
        out.append(style + sorted({i for w in set(_WORD.findall(text.lower())) for i in lookup(w)}))
    return out


def evidence(documents: DataFrame, model: dict, *more: Column) -> DataFrame:
    """doc_id, evidence (log likelihood ratio of good) and `more` for every document."""
    packed = json.dumps(model)
    base = texts(documents, *more)
    names = [c for c in base.columns if c not in ("doc_id", "text")]

    def run(batches):
        m = json.loads(packed)
        weights, lookup = np.array(m["weights"]), _Lookup(m["words"])
        for batch in slices(batches):
            ratio = [float(weights[f].sum() + weights[-1] - m["odds"]) for f in _features(batch.column("text").to_pylist(), lookup)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ratio, pa.float64()), *[batch.column(c) for c in names]], names=["doc_id", "evidence", *names])

    return map_arrow(base, run, ", ".join(["doc_id long, evidence double", *[f"{c} {t}" for c, t in base.dtypes if c in names]]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address, for `classify` over tables that have one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def between(groups: DataFrame, prior: Column) -> float:
    """How much true shares vary between groups, in units of prior * (1 - prior), by moments: the groups' (n, s) squared
    deviations from the prior less what chance adds to them. 0 where they vary no more than by chance."""
    share = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * F.pow(share - prior, 2)).alias("seen"), F.sum(prior * (1 - prior)).alias("chance"), F.sum(F.col("n") * prior * (1 - prior)).alias("whole")
    ).first()
    if not row["whole"] or row["whole"] <= row["chance"]:
        return 0.0
    return min(max((row["seen"] - row["chance"]) / (row["whole"] - row["chance"]), 0.0), 1.0)


def shrunk(varies: float, prior: Column) -> Column:
    """A group's share, drawn toward the prior: one group in which shares vary by `varies` counts as (1 - varies) / varies
    documents of the prior, so that groups that vary by chance alone all keep the prior."""
    own = F.lit(varies) * F.col("n") / (F.lit(varies) * F.col("n") + F.lit(1.0 - varies))
    return prior if varies == 0 else prior + own * (F.col("s") / F.col("n") - prior)


def site_priors(scored: DataFrame, prior: float, rounds: int = 3) -> DataFrame:
    """host, path, host_prior, path_prior of (evidence, host, path) rows.

    Each round gives documents their posteriors under the last round's path priors (at first the corpus prior), sums them
    by path and host, and shrinks: hosts toward the mean over the corpus, paths toward their host's.
    """
    priors = None
    for turn in range(rounds):
        joined = scored if priors is None else scored.join(priors.select("host", "path", "path_prior"), ["host", "path"])
        p = _expit(F.col("evidence") + _logit(F.lit(prior) if priors is None else F.col("path_prior")))
        paths = table(joined.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), f"paths{turn}")
        hosts = table(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), f"hosts{turn}")
        row = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        prior = row["s"] / row["n"] if row["n"] else prior
        hosts = hosts.select("host", shrunk(between(hosts, F.lit(prior)), F.lit(prior)).alias("host_prior"))
        paths = table(paths.join(hosts, "host"), f"joined{turn}")
        priors = table(paths.select("host", "path", "host_prior", shrunk(between(paths, F.col("host_prior")), F.col("host_prior")).alias("path_prior")), f"priors{turn}")
    return priors


@tidy
def classify(documents: DataFrame, labels: DataFrame, good: Column | None = None, host: str | Column = "source", path: str | Column = "lang", bound: int = 10_000, threshold: float = 0.5) -> DataFrame:
    """Posterior probability that a document is good, and whether it is kept.

    A document's evidence is a log likelihood ratio from a classifier trained on at most `bound` labelled rows
    (`train`). A host's prior is its documents' mean posterior shrunk toward the corpus's; a path's (host and path) is
    shrunk toward its host's (`site_priors`). How far follows from the variation between groups, so sparse sites stay near
    the prior. Posterior: evidence plus the path prior's log odds. Documents at or above `threshold` are kept. Hosts and
    paths are columns or their names; of tables with addresses take `site_of`.

    All documents are scored and counted; sites are summed before any shuffle, and their priors are joined by Spark's
    own size limits and skew handling. Labels: `good` defaults to quality = 1 and toxic = 0; ids without a document
    are ignored, and an id labelled twice counts as good only if it is so in each row.

    Returns doc_id, text_id (a hash of the text), evidence, host_prior, path_prior, posterior, kept: one row for each input
    row. A null text counts as empty. Null hosts and paths are sites of their own, and so is a missing column. Without
    labels of both kinds all evidence is 0 and everything is kept. Other columns are left out; an empty table gives an
    empty result.
    """
    if good is None:
        good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)

    def site(c: str | Column, name: str) -> Column:
        missing = isinstance(c, str) and c not in documents.columns
        return (F.lit("\0") if missing else F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\0"))).alias(name)

    model = train(documents, labels, good, bound)
    scored = table(evidence(documents, model, text_key().alias("text_id"), site(host, "host"), site(path, "path")), "evidence")
    priors = site_priors(scored, 1 / (1 + math.exp(-model["odds"])))
    out = scored.join(priors, ["host", "path"]).withColumn("posterior", _expit(F.col("evidence") + _logit(F.col("path_prior"))))
    kept = F.col("posterior") >= threshold if model["words"] or any(model["weights"]) else F.lit(True)
    return out.select("doc_id", "text_id", "evidence", "host_prior", "path_prior", "posterior", kept.alias("kept"))


def keep_good(documents: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents without those decided against, by id and text, so that rows that share an id go or stay each by
    itself; all columns stay."""
    gone = decided.filter("not kept").select(F.col("doc_id").alias("g_id"), F.col("text_id").alias("g_key")).distinct()
    return unpacked(packed(documents).join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")), "left_anti"), documents)
