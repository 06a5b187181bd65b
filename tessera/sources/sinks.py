"""Writers of tables, pools, reports and the ladder."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import preview
from tessera.functions.vectors import norm
from tessera.operators.qa import seeded_sample

LADDER = ("timestamp_utc", "run_tag", "notes", "recall_at_5", "mrr", "unsupported_rate", "abstain_rate", "p50_ms", "p95_ms")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.filter("error is null").drop("error").write.mode("overwrite").parquet(path)


def index_meta(vectors: DataFrame, **more: object) -> DataFrame:
    """One row about a table of vectors: how many, of which dimension, their bytes, whether all have length 1, and what the
    caller adds (model, hash, seconds)."""
    row = vectors.agg(
        F.count("*").alias("num_chunks"), F.max(F.size("embedding")).alias("dim"),
        F.coalesce(F.bool_and(F.abs(norm(F.col("embedding")) - 1) < 1e-3), F.lit(True)).alias("normalized"),
    )
    row = row.withColumn("approx_bytes", F.col("num_chunks") * F.col("dim") * 4).withColumn("approx_mb", F.bround(F.col("approx_bytes") / 1e6, 4))
    for name, value in more.items():
        row = row.withColumn(name, F.bround(F.lit(value), 4) if isinstance(value, float) else F.lit(value))
    return row


def write_vectors(vectors: DataFrame, path: str, **meta: object) -> None:
    """Vectors by id, and a row that says how many, of which dimension, and what the caller adds."""
    vectors.select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    written = vectors.sparkSession.read.parquet(f"{path}/vectors")
    index_meta(written, **meta).withColumn("created_at_unix", F.unix_timestamp()).write.mode("overwrite").json(f"{path}/meta")


def report(one_row: DataFrame) -> str:
    """A report of one row as JSON."""
    return json.dumps(one_row.first().asDict(recursive=True), default=str, indent=2)


def utc_stamp() -> Column:
    """The present time in UTC as ISO text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def append_ladder(rows: DataFrame, path: str) -> None:
    """Rows under the ladder's fixed columns: others dropped, missing ones blank. As ever in a folder of CSV files, each
    part has the header, which readers take off; `ladder_csv` gives one text with it once."""
    columns = [(utc_stamp() if c == "timestamp_utc" and c not in rows.columns else F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in LADDER]
    rows.select(*columns).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_ladder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in LADDER))


def ladder_csv(spark: SparkSession, path: str) -> str:
    """The whole ladder as one text with its header once."""
    rows = read_ladder(spark, path).orderBy("timestamp_utc", "run_tag").collect()
    return "\n".join([",".join(LADDER), *(",".join(x or "" for x in r) for r in rows)]) + "\n"


def pool_rows(fused: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, query, pool): a query's fused candidates in order, nested."""
    listed = fused.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("pool"))
    return queries.select("qid", "query").join(listed, "qid")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def traces(results: DataFrame, queries: DataFrame, limit: int = 240) -> DataFrame:
    """(qid, query, results): a query's hydrated results with a preview of their text."""
    one = F.struct("rank", "chunk_id", "score", preview(F.col("chunk_text"), limit).alias("preview"))
    return results.groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("results")).join(queries.select("qid", "query"), "qid")


def reranked_rows(reranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, query, candidates): a query's reranked pool in order, nested, with the scores."""
    one = F.struct("rank", "chunk_id", F.col("score").alias("rerank_score"))
    return queries.select("qid", "query").join(reranked.groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("candidates")), "qid")


def snapshot_rows(results: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, query, top_k, expected_chunk_ids, expected_doc_ids): what a retriever returned, to be held against later."""
    one = F.struct("rank", F.col("chunk_id").cast("string").alias("c"), F.col("doc_id").cast("string").alias("d"))
    listed = results.filter(F.col("rank") <= k).join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("l"))
    return queries.select("qid", "query").join(listed, "qid").select("qid", "query", F.lit(k).alias("top_k"), F.transform("l", lambda s: s["c"]).alias("expected_chunk_ids"), F.transform("l", lambda s: s["d"]).alias("expected_doc_ids"))


def snapshot_changes(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Queries whose results are no longer those of the snapshot; none if nothing changed."""
    then = snapshot.select("qid", F.col("expected_chunk_ids").alias("then"))
    both = now.select("qid", F.col("expected_chunk_ids").alias("now")).join(then, "qid", "full_outer")
    return both.filter(~F.col("now").eqNullSafe(F.col("then")))


def sample_text(chunks: DataFrame, k: int = 12, seed: int = 42) -> str:
    """k chunks to read, chosen by seed."""
    return "\n\n".join(f"[{r['chunk_id']}] {r['title']} / {r['section_path']} ({r['token_count']} tokens)\n{r['chunk_text']}" for r in seeded_sample(chunks, k, seed).collect())


def log_line(**fields: object) -> str:
    return json.dumps(fields, default=str, sort_keys=True)
