"""Hybrid blending, rank fusion and reranking of result tables (qid, chunk_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ascii_tokens
from tessera.operators.vectors import top_k
from tessera.plans.providers import Transport
from tessera.plans.scratch import fresh, kept
from tessera.plans.ship import ship_package


#: Chunks of a result up to which the rest of a corpus is filtered by a broadcast of them.
FEW = 200_000


def min_max(score: str = "score", by: str = "qid") -> Column:
    """A query's scores on 0..1; all 1 where they don't differ."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, 1.0).otherwise((F.col(score) - low) / (high - low))


def blend(dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.6) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical after each side's min-max; a side that lacks a chunk counts 0."""
    a = dense.select("qid", "chunk_id", min_max().alias("d"))
    b = lexical.select("qid", "chunk_id", min_max().alias("l"))
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))
    joined = a.join(b, ["qid", "chunk_id"], "full_outer").select("qid", "chunk_id", F.round(score, 9).alias("score"))
    return kept(top_k(joined, k), "blend")


def reciprocal_ranks(systems: list[DataFrame], limit: int = 250, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over the systems that rank a chunk."""
    every = reduce(DataFrame.unionByName, [s.select("qid", "chunk_id", "rank") for s in systems])
    fused = every.groupBy("qid", "chunk_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"))
    return top_k(fused, limit)


def hydrate(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their chunks' columns; a result without a chunk is an error."""
    names = [c for c in chunks.columns if c not in results.columns or c == "chunk_id"]
    wanted = results.select("chunk_id").distinct()
    if wanted.limit(FEW + 1).count() <= FEW:  # then other chunks are dropped where they are read
        chunks = chunks.join(F.broadcast(wanted), "chunk_id", "left_semi")
    marked = chunks.select(*names, F.lit(True).alias("__found"))
    found = F.coalesce(F.col("__found"), F.raise_error(F.concat(F.lit("no chunk "), F.col("chunk_id").cast("string"))).cast("boolean"))
    return results.join(marked, "chunk_id", "left").filter(found).drop("__found")


def overlap(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text holds."""
    q, t = F.array_distinct(ascii_tokens(query)), F.array_distinct(ascii_tokens(text))
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))


def _reranked(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), F.asc("rank"), F.asc("chunk_id"))
    return candidates.withColumn("before", F.col("rank")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank_overlap(candidates: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, query, chunk_id, chunk_text, rank) by token overlap; ties in their order."""
    return _reranked(candidates.withColumn("score", F.round(overlap(F.col("query"), F.col("chunk_text")), 9)), k)


def rerank_model(candidates: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], k: int, max_chars: int = 2000, batch: int = 16, normalize: bool = False) -> DataFrame:
    """Candidates by a scorer of (query, text) pairs, called in batches on the executors; none in, none out."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        pairs = [(q, (t or "")[:max_chars]) for q, t in zip(query, text, strict=True)]
        out: list[float] = []
        for i in range(0, len(pairs), batch):
            part = list(map(float, scorer(pairs[i : i + batch])))
            if len(part) != len(pairs[i : i + batch]):
                raise ValueError("a scorer must return one score for each pair")
            out += part
        return pd.Series(out, dtype="float64")

    scored = candidates.withColumn("score", score("query", "chunk_text"))
    if normalize:
        scored = scored.withColumn("score", min_max())
    return _reranked(scored, k)


def rerank_counted(
    candidates: DataFrame, scorer: Callable, k: int, max_chars: int = 2000, batch: int = 16, normalize: bool = False, forgive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Candidates by a scorer of (pairs, transport=...), and its calls: (qid, pairs, requests, retries, timeouts, failures,
    bytes_sent, bytes_received), one row a batch of one query's pairs.

    Scores and calls are rows of one pass, written once under the shared folder: a task that is tried again is counted
    once, as only the rows of its last try are kept. With `forgive` a batch that fails for good leaves its scores null (and
    last) and its call counted; else it ends the job.
    """
    spark = candidates.sparkSession
    ship_package(spark)
    types = dict(candidates.dtypes)
    counters = [f.name for f in fields(Transport)]
    schema = f"kind string, qid {types['qid']}, chunk_id {types['chunk_id']}, score double, pairs long, " + ", ".join(f"{c} long" for c in counters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for qid, own in rows.groupby("qid", sort=False, dropna=False):
                for i in range(0, len(own), batch):
                    part, t = own.iloc[i : i + batch], Transport()
                    pairs = [(q, (x or "")[:max_chars]) for q, x in zip(part["query"], part["chunk_text"], strict=True)]
                    try:
                        scores = list(map(float, scorer(pairs, transport=t)))
                        if len(scores) != len(pairs):
                            raise ValueError("a scorer must return one score for each pair")
                    except Exception:
                        if not forgive:
                            raise
                        scores = [None] * len(pairs)
                    out += [("score", qid, c, s, None, *[None] * len(counters)) for c, s in zip(part["chunk_id"], scores, strict=True)]
                    out.append(("call", qid, None, None, len(pairs), *astuple(t)))
            made = pd.DataFrame(out, columns=["kind", "qid", "chunk_id", "score", "pairs", *counters])
            integers = [n for n, t in (("qid", types["qid"]), ("chunk_id", types["chunk_id"])) if t in ("bigint", "int")]
            yield made.astype({n: "Int64" for n in ["pairs", *counters, *integers]} | {"score": "float64"})

    path = fresh(spark, "rerank")
    dealt = candidates.select("qid", "query", "chunk_id", "chunk_text", "rank").repartition("qid").sortWithinPartitions("qid", "rank", "chunk_id")  # a query's pairs go together
    dealt.mapInPandas(run, schema).write.parquet(path)
    both = spark.read.schema(schema).parquet(path)
    scored = candidates.drop("score").join(both.filter("kind = 'score'").select("qid", "chunk_id", F.nanvl("score", F.lit(None)).alias("score")), ["qid", "chunk_id"])
    if normalize:
        scored = scored.withColumn("score", min_max())
    return _reranked(scored, k), both.filter("kind = 'call'").select("qid", "pairs", *counters)


def same_candidates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, lost, added): queries whose reranked candidates are not those before; none if the reranker keeps its contract."""
    both = before.select("qid", "chunk_id").distinct().withColumn("b", F.lit(1)).join(after.select("qid", "chunk_id").distinct().withColumn("a", F.lit(1)), ["qid", "chunk_id"], "full_outer")
    return both.groupBy("qid").agg(F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("added")).filter("lost > 0 or added > 0")


def with_scores(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """Pool rows with their rerank scores; null where a score is missing."""
    return pool.join(scores.select("qid", "chunk_id", F.col("score").alias("rerank_score")), ["qid", "chunk_id"], "left")


def rerank_pool(pool: DataFrame, scores: DataFrame, k: int = 15) -> DataFrame:
    """The k best of each pool (qid, chunk_id, rank) by rerank score, missing scores last, ties in their order."""
    scored = with_scores(pool.select("qid", "chunk_id", "rank"), scores).withColumnRenamed("rerank_score", "score")
    return _reranked(scored, k)


def transport_totals(calls: DataFrame, by: str = "qid") -> DataFrame:
    """Counters of a scorer's batches (requests, retries, time-outs, failures, bytes as far as the columns are there), summed by query."""
    counters = [c for c in ("requests", "retries", "timeouts", "failures", "bytes_sent", "bytes_received") if c in calls.columns]
    return calls.groupBy(by).agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in counters])


def hybrid_rerank(blended: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, candidates: int = 25) -> DataFrame:
    """The best of the first max(candidates, k) blended results by token overlap."""
    some = blended.filter(F.col("rank") <= max(candidates, k)).drop("score")
    return rerank_overlap(hydrate(some, chunks.select("chunk_id", "chunk_text")).join(queries.select("qid", "query"), "qid"), k).select("qid", "chunk_id", "score", "rank", "before")
