"""Quality rules and robust multivariate outliers (minimum covariance determinant for each language and source)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, map_arrow, slices, table, texts, tidy

#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
STATISTICS = ("log_word_length", "symbol_share", "repeat_line_share", "repeat_word_share", "capital_share", "mark_share")
#: Least standard deviation of each transformed statistic: a source whose documents agree more closely is no reason to
#: reject. Its square is added to every variance, which also keeps statistics that never vary from a zero determinant.
FLOORS = (0.08, 0.07, 0.11, 0.11, 0.07, 0.07)
#: The share of a group's rows that an estimate rests on.
SHARE = 0.75
#: Rows that choose a group's start, by hash, and random starts among them.
START_ROWS, RANDOM_STARTS = 2000, 8
#: Distances are summed by bins of this relative size.
FINE = 64

_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?;:\"'~^=_\\/@"
_BASE = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"
_SCHEMA = pa.schema([(n, t) for n, t in zip(("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"), (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.float64())), strict=True)])


def repeated_words(words: list[list[bytes]], window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, how many words lie in a window of `window` words (a power of two) found twice or more in it.

    Windows get exact ranks by doubling: a rank for each pair of neighbouring ranks, so no hash can collide.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    if total < window:
        return np.zeros(len(words), dtype=np.int64)
    flat = np.empty(total, dtype=object)
    flat[:] = [w for ws in words for w in ws]
    rank = pd.factorize(flat)[0].astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    width = 1
    while width < window:
        left, right = rank[:-width], rank[width:]
        rank = pd.factorize(left * (int(rank.max()) + 1) + right)[0].astype(np.int64)
        width *= 2
    starts = np.flatnonzero(owner[: len(rank)] == owner[window - 1 :])
    key = pd.factorize(rank[starts] * len(words) + owner[starts])[0]
    twice = starts[np.bincount(key, minlength=1)[key] > 1] if len(starts) else starts
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=len(words))


def statistics(all_texts: list[str]) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, STATISTICS) of each text."""
    raw = [t.encode() for t in all_texts]
    words = [b.split() for b in raw]
    rows = []
    for t, b, ws, n_repeat in zip(all_texts, raw, words, repeated_words(words).tolist(), strict=True):
        n = len(ws)
        chars = len(t) - sum(map(t.count, ASCII_SPACE))
        symbols = len(b) - len(b.translate(None, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(ASCII_SPACE)]
        same = len(lines) - len(set(lines))
        size = max(chars, 1)
        x = [
            math.log(max(chars, 1) / max(n, 1)),
            symbols / size,
            same / max(len(lines), 1),
            n_repeat / max(n, 1),
            (len(b) - len(b.translate(None, _CAPITALS))) / size,
            (len(b) - len(b.translate(None, _MARKS))) / size,
        ]
        rows.append((n, chars, symbols, same, n_repeat, x))
    return rows


def transformed(x: list[float]) -> list[float]:
    """The logarithm as it is, and the arcsine of each share's root, whose variance does not depend on the share."""
    return [x[0], *(math.asin(math.sqrt(min(max(v, 0.0), 1.0))) for v in x[1:])]


def _measure(batches):
    for batch in slices(batches):
        rows = [(*r[:-1], transformed(r[-1])) for r in statistics(batch.column("text").to_pylist())]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SCHEMA)[3:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *columns], schema=_SCHEMA)


def _chi2_cdf(x: float, freedom: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def _chi2_quantile(q: float, freedom: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, freedom) < q else (low, mid)
    return high


P = len(STATISTICS)
_KEYS = ["lang", "source"]
_RIDGE = np.diag(np.square(FLOORS))
_UPPER = np.triu_indices(P)


def consistency(share: float = SHARE) -> float:
    """What the scatter of the `share` of normal rows nearest to the centre is multiplied by to estimate that of all."""
    return share / _chi2_cdf(_chi2_quantile(share, P), P + 2)


def scatter(n: float, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a count, sums and the upper triangle of summed products."""
    mu, cov = s / n, np.zeros((P, P))
    cov[_UPPER] = ss / n - mu[_UPPER[0]] * mu[_UPPER[1]]
    return mu, np.triu(cov) + np.triu(cov, 1).T


def concentrate(x: np.ndarray, mu: np.ndarray, cov: np.ndarray, share: float, most: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, mean, covariance) after concentration steps until the subset stays the same."""
    h, scale, subset = max(1, math.ceil(share * len(x))), consistency(share), None
    for _ in range(most):
        d = x - mu
        d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov * scale + _RIDGE), d)
        new = np.sort(np.argsort(d2, kind="stable")[:h])
        if subset is not None and np.array_equal(new, subset):
            break
        subset = new
        mu, cov = x[subset].mean(0), np.cov(x[subset].T, bias=True).reshape(P, P)
    return float(np.linalg.slogdet(cov * scale + _RIDGE)[1]), mu, cov


def starts(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and scatters to concentrate from: medians with quartile scales, with correlations of ranks, of signs, and
    of random subsets."""
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scale = np.maximum((high - low) / 1.349, FLOORS)
    z = (x - mid) / scale
    out = [(mid, np.diag(scale**2))]
    squashed = np.tanh(z)
    out.append((mid, scale[:, None] * (squashed.T @ squashed / len(x)) * scale[None, :]))
    signs = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    out.append((mid, scale[:, None] * (signs.T @ signs / len(x)) * P * scale[None, :]))
    for k in range(RANDOM_STARTS if len(x) > 2 * P else 0):
        own = x[np.random.default_rng((7, k)).choice(len(x), P + 1, replace=False)]
        out.append((own.mean(0), np.cov(own.T, bias=True)))
    return out


def least_determinant(x: np.ndarray, share: float = SHARE) -> tuple[float, np.ndarray, np.ndarray]:
    """The minimum covariance determinant of rows x: the least of all starts, each run until its subset settles."""
    x = x[np.lexsort(x.T[::-1])]  # the order of rows decides nothing
    return min((concentrate(x, mu, cov, share) for mu, cov in starts(x)), key=lambda e: e[0])


def _start(rows: pa.Table) -> pa.Table:
    _, mu, cov = least_determinant(np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, P))
    return pa.table({**{k: rows.column(k).slice(0, 1) for k in _KEYS}, **_estimate(mu, cov, 0.0)}, schema=_ESTIMATE)


_ESTIMATE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("mu", pa.list_(pa.float64())), ("prec", pa.list_(pa.float64())), ("logdet", pa.float64()), ("n", pa.float64()), ("s", pa.list_(pa.float64())), ("ss", pa.list_(pa.float64()))])
_ESTIMATE_DDL = "lang string, source string, mu array<double>, prec array<double>, logdet double, n double, s array<double>, ss array<double>"


def _estimate(mu: np.ndarray, cov: np.ndarray, n: float) -> dict:
    whole = cov * consistency() + _RIDGE
    return {
        "mu": [mu.tolist()], "prec": [np.linalg.inv(whole)[_UPPER].tolist()], "logdet": [float(np.linalg.slogdet(whole)[1])],
        "n": [n], "s": [(mu * n).tolist()], "ss": [((cov + np.outer(mu, mu))[_UPPER] * n).tolist()],
    }


def _concentrated(rows: pa.Table) -> pa.Table:
    """One group's next estimate from its counts, sums and products by bins of distance: whole bins from the nearest on, and
    of the last bin the share that makes up the subset's size."""
    order = np.argsort(np.array(rows.column("bin").to_pylist()), kind="stable")
    n = np.array(rows.column("n").to_pylist(), dtype=float)[order]
    s = np.array(rows.column("s").to_pylist(), dtype=float).reshape(-1, P)[order]
    ss = np.array(rows.column("ss").to_pylist(), dtype=float).reshape(-1, len(_UPPER[0]))[order]
    h = max(1.0, math.ceil(SHARE * n.sum()))
    weight = np.clip((h - (np.cumsum(n) - n)) / n, 0.0, 1.0)
    mu, cov = scatter(h, weight @ s, weight @ ss)
    return pa.table({**{k: rows.column(k).slice(0, 1) for k in _KEYS}, **_estimate(mu, cov, h)}, schema=_ESTIMATE)


def _distance() -> Column:
    """Squared Mahalanobis distance of x from `mu` under the upper triangle of the precision matrix `prec`."""
    d = [F.element_at("x", i + 1) - F.element_at("mu", i + 1) for i in range(P)]
    terms = [F.element_at("prec", k + 1) * d[i] * d[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(zip(*_UPPER, strict=True))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def robust_estimates(rows: DataFrame, steps: int = 12, settled: float = 1e-4) -> DataFrame:
    """Minimum covariance determinant of x in every (lang, source): lang, source, mu, prec, logdet, n, s, ss of the subset.

    Each group's start is the least determinant of about START_ROWS of its rows (chosen by hash; all, if it has no more),
    from several deterministic and random starts, each run until its subset settles. Concentration steps over all rows
    follow, until no group's log determinant moves by more than `settled`, at most `steps`. A step sums counts, values and
    products by (group, bin of distance) where the rows lie, so that a group of any size is a few thousand rows to the
    task that picks its subset; the determinant can rise only by the width of a bin.
    """
    sizes = rows.groupBy(*_KEYS).agg(F.count("*").alias("total"))
    drawn = F.pmod(F.xxhash64(F.lit("start"), "x", "doc_id"), F.lit(1 << 30)) / float(1 << 30) * F.col("total") < F.lit(START_ROWS)
    few = rows.join(sizes, _KEYS).filter(drawn).select(*_KEYS, "x")
    now = table(few.groupBy(*_KEYS).applyInArrow(_start, _ESTIMATE_DDL), "starts")
    x = [F.element_at("x", i + 1) for i in range(P)]
    for step in range(steps):
        near = rows.join(now.select(*_KEYS, "mu", "prec"), _KEYS).withColumn("d2", _distance())
        near = near.withColumn("bin", F.round(F.log(F.greatest("d2", F.lit(1e-6))) * FINE).cast("int"))
        sums = near.groupBy(*_KEYS, "bin").agg(
            F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in zip(*map(np.ndarray.tolist, _UPPER), strict=True)]
        ).select(*_KEYS, "bin", "n", F.array(*[f"s{i}" for i in range(P)]).alias("s"), F.array(*[f"p{i}_{j}" for i, j in zip(*map(np.ndarray.tolist, _UPPER), strict=True)]).alias("ss"))
        new = table(sums.groupBy(*_KEYS).applyInArrow(_concentrated, _ESTIMATE_DDL), f"step{step}")
        moved = new.join(now.select(*_KEYS, F.col("logdet").alias("before")), _KEYS).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        now = new
        if moved is None or moved < settled:
            break
    return now


def shrunk(estimates: DataFrame, prior: float) -> DataFrame:
    """lang, source, mu, prec of every group, drawn toward its language, and that toward the corpus.

    A language's and the corpus's estimates pool the subsets of their groups. Sums of the parent count as `prior` rows of
    the child, so that an estimate from few rows is mostly its parent's and one from many its own, without a limit between.
    """
    kinds = ["n", "s", "ss"]
    add = lambda c: F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(P if c == "s" else len(_UPPER[0]))]).alias(c)
    langs = estimates.groupBy("lang").agg(F.sum("n").alias("n"), add("s"), add("ss"))
    corpus = langs.agg(F.sum("n").alias("n"), add("s"), add("ss"))
    wide = estimates.join(langs.select("lang", F.struct(*kinds).alias("own_lang")), "lang").crossJoin(F.broadcast(corpus.select(F.struct(*kinds).alias("corpus"))))  # corpus is one row

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parent = (1.0, np.array(row["corpus"]["s"]) / row["corpus"]["n"], np.array(row["corpus"]["ss"]) / row["corpus"]["n"])
                for level in (row["own_lang"], row):
                    n = level["n"] + prior
                    parent = (1.0, (np.array(level["s"]) + prior * parent[1]) / n, (np.array(level["ss"]) + prior * parent[2]) / n)
                mu, cov = scatter(*parent)
                out.append((row["lang"], row["source"], mu.tolist(), np.linalg.inv(cov * consistency() + _RIDGE)[_UPPER].tolist()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=[*_KEYS, "mu", "prec"])

    return map_arrow(wide, run, "lang string, source string, mu array<double>, prec array<double>")


@tidy
def quality_rules(documents: DataFrame, confidence: float = 0.9995, prior: float = 50.0) -> DataFrame:
    """Base rules, then robust outliers within each language and source.

    A document fails the base rules with fewer than 20 words or with over 30 in 100 words in repeated 8-word windows.
    Of the others, statistics of words, lines, symbols, capitals and marks (`transformed`) are compared with the minimum
    covariance determinant estimates of their (language, source), which are drawn toward the language's and the corpus's as
    by `prior` rows. A squared distance over the chi-square quantile `confidence` rejects.

    All documents count in the estimates. Only sums, and counts by bin, are shuffled for them; groups of any size are
    summed where they lie. Estimates of few groups are broadcast by Spark's own size limit, of many joined.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (null
    for base failures): one row for each input row. Null texts have no words and fail; null languages and sources are
    groups of their own; other columns are left out; an empty table gives an empty result.
    """
    column = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in documents.columns else F.lit("\0")).alias(c)
    rows = table(map_arrow(texts(documents, column("lang"), column("source")), _measure, _BASE), "statistics")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    best = table(shrunk(robust_estimates(rows.filter(~failed).select("doc_id", *_KEYS, "x")), prior), "estimates")
    out = rows.withColumn("base_failed", failed).join(best, _KEYS, "left")
    distance = F.when(~F.col("base_failed"), _distance())
    limit = _chi2_quantile(confidence, P)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(~F.col("base_failed") & (distance <= limit), F.lit(False)).alias("kept"), distance.alias("distance"),
    )
