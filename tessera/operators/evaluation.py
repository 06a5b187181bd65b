"""Golden sets, retrieval metrics and the result ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import ranked_values

KS = (1, 3, 5, 10)


def first_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """(qid, first_hit): rank of the first relevant result of every golden query; null without one.

    A query's results must not repeat a chunk.
    """
    once = results.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank"), F.count("*").alias("__n"))
    once = once.filter(F.when(F.col("__n") > 1, F.raise_error(F.lit("a query's results repeat a chunk")).cast("boolean")).otherwise(True))
    hits = once.join(golden.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"])
    return golden.select("qid").distinct().join(hits.groupBy("qid").agg(F.min("rank").alias("first_hit")), "qid", "left")


def recall_mrr(results: DataFrame, golden: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, n_queries, recall, mrr) in long form; queries without a hit stay in the denominator."""
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    hit = F.coalesce(F.col("first_hit") <= F.col("k"), F.lit(False))
    return first_hits(results, golden).select("first_hit", cut).groupBy("k").agg(
        F.count("*").alias("n_queries"), F.round(F.avg(hit.cast("double")), 6).alias("recall"), F.round(F.avg(F.when(hit, 1 / F.col("first_hit")).otherwise(0.0)), 6).alias("mrr")
    )


def latency(observations: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, p50 and p95 (nearest rank) by group."""
    means = observations.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean_ms"))
    ranks = ranked_values(observations, list(by), value, {"p50": ("nearest", 50), "p95": ("nearest", 95)})
    joined = means.join(ranks, list(by), "left") if by else means.crossJoin(F.broadcast(ranks))  # one row each
    return joined.select(*by, "n", "mean_ms", F.round("p50", 6).alias("p50_ms"), F.round("p95", 6).alias("p95_ms"))


def ladder(systems: dict[str, DataFrame], golden: DataFrame, k: int = 5, timings: DataFrame | None = None) -> DataFrame:
    """One row for each named result set: recall and mean reciprocal rank at k, and of `timings` (run_tag, retrieve_ms) the
    median and 95th percentile."""
    rows = [recall_mrr(r, golden, (k,)).select(F.lit(tag).alias("run_tag"), "n_queries", F.col("recall").alias(f"recall_at_{k}"), "mrr") for tag, r in systems.items()]
    out = reduce(DataFrame.unionByName, rows)
    return out if timings is None else out.join(latency(timings, "retrieve_ms", "run_tag").select("run_tag", "p50_ms", "p95_ms"), "run_tag", "left")


def per_query(results: DataFrame, golden: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, query, relevant_chunk_ids, retrieved_chunk_ids, first_hit) of every golden query, to be written line by line."""
    relevant = golden.groupBy("qid").agg(F.sort_array(F.collect_set(F.col("chunk_id").cast("string"))).alias("relevant_chunk_ids"))
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("c"))))
    retrieved = results.groupBy("qid").agg(F.transform(ranked, lambda s: s["c"]).alias("retrieved_chunk_ids"))
    out = relevant.join(retrieved, "qid", "left").join(first_hits(results, golden), "qid").join(queries.select("qid", "query"), "qid")
    return out.select("qid", "query", "relevant_chunk_ids", F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")).alias("retrieved_chunk_ids"), "first_hit")


def golden_from_items(items: DataFrame) -> DataFrame:
    """(qid, query, gold) from (qid, query, best_chunk, chunk_ids): the union without repetition, empty ones dropped."""
    best = F.when(F.col("best_chunk").isNotNull(), F.array("best_chunk")).otherwise(F.array().cast("array<string>"))
    gold = F.array_distinct(F.filter(F.concat(best, F.coalesce("chunk_ids", F.array().cast("array<string>"))), lambda c: c.isNotNull()))
    return items.select("qid", "query", gold.alias("gold")).filter(F.size("gold") > 0)


def compile_golden(labels: DataFrame) -> DataFrame:
    """(qid, best_chunk, chunk_ids) from a label sheet (qid, candidate_rank, chunk_id, label, is_best).

    Relevant are rows with label 1, in order of their rank; the best is the first marked, else the first relevant. A
    marked best that isn't relevant is put in front. Queries without a relevant chunk are dropped.
    """
    rows = labels.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("candidate_rank", "chunk_id", "label", "is_best"))).alias("rows"))
    relevant = F.transform(F.filter("rows", lambda r: r["label"] == 1), lambda r: r["chunk_id"])
    marked = F.get(F.transform(F.filter("rows", lambda r: r["is_best"] == 1), lambda r: r["chunk_id"]), F.lit(0))
    out = rows.select("qid", relevant.alias("relevant"), marked.alias("marked")).filter((F.size("relevant") > 0) | F.col("marked").isNotNull())
    best = F.coalesce("marked", F.get("relevant", F.lit(0)))
    return out.select("qid", best.alias("best_chunk"), F.when(F.array_contains("relevant", best), F.col("relevant")).otherwise(F.concat(F.array(best), "relevant")).alias("chunk_ids"))


def golden_from_ranks(ranks: DataFrame, sheet: DataFrame) -> DataFrame:
    """(qid, chunk_ids) from chosen ranks (qid, at, rank) and a sheet (qid, candidate_rank, chunk_id)."""
    joined = ranks.join(sheet.select("qid", F.col("candidate_rank").alias("rank"), "chunk_id"), ["qid", "rank"])
    return joined.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids"))


def cache_hits(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """A log with `hit`: whether an equal key came earlier (a cache without bound)."""
    return log.withColumn("hit", F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1)
