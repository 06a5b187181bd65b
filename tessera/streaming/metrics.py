"""Request metrics, in batch and (as an extension) over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 500


def request_metrics(log: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row from (ts, request_id, mode, schema_valid, total_ms, embedding_hit, retrieval_hit, failed): counts by outcome,
    rates (null without a denominator) and interpolated percentiles of the last `samples` latencies."""
    rate = lambda hit: F.round(F.count_if(hit) / F.nullif(F.count(hit), F.lit(0)), 6)
    ok = log.filter("not failed")
    counts = ok.agg(
        F.count("*").alias("requests_total"), *[F.count_if(F.col("mode") == m).alias(f"{m}_total") for m in ("answer", "abstain", "parse_error")],
        F.round(F.count_if("schema_valid") / F.nullif(F.count("*"), F.lit(0)), 6).alias("schema_valid_rate"),
        rate(F.col("embedding_hit")).alias("embedding_cache_hit_rate"), rate(F.col("retrieval_hit")).alias("retrieval_cache_hit_rate"),
    )
    last = ok.filter("total_ms is not null").orderBy(F.desc("ts"), F.desc("request_id")).limit(samples)
    latency = last.agg(F.round(F.percentile("total_ms", F.lit(0.5)), 6).alias("p50_ms"), F.round(F.percentile("total_ms", F.lit(0.95)), 6).alias("p95_ms"))
    return counts.crossJoin(log.agg(F.count_if("failed").alias("errors_total"))).crossJoin(latency)  # one row each


def windowed_metrics(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: requests and latencies by event-time window and outcome; works on streams, with a watermark, and on
    tables."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "mode").agg(F.count("*").alias("n"), F.round(F.sum("total_ms"), 4).alias("total_ms")).select(
        F.col("window.start").alias("start"), "mode", "n", "total_ms"
    )


def latest(log: DataFrame, by: str, n: int) -> DataFrame:
    """The last n rows of each group by time."""
    return log.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("request_id")))).filter(F.col("r") <= n).drop("r")
