"""Corpus statistics, validity checks and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.functions.vectors import ranked_values


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, token distribution (nearest rank), exact duplicates by checksum."""
    counts = chunks.agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.min("token_count").alias("token_min"),
        F.max("token_count").alias("token_max"), (F.count("*") - F.count_distinct("checksum")).alias("n_duplicates"),
    )
    ranks = ranked_values(chunks, [], "token_count", {"token_median": ("nearest", 50), "token_p95": ("nearest", 95)})
    return counts.crossJoin(F.broadcast(ranks))  # one row each


def corpus_report(chunks: DataFrame, root: str) -> DataFrame:
    """`chunk_stats` of a corpus build's good rows, with the number of files that failed, when and from where."""
    good = chunk_stats(chunks.filter("error is null"))
    bad = chunks.agg(F.count("error").alias("n_bad"))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return good.crossJoin(F.broadcast(bad)).withColumn("_built_at", stamp).withColumn("_corpus_root", F.lit(root))  # one row each


def qa_report(chunks: DataFrame, min_tokens: int, max_tokens: int) -> DataFrame:
    """One row: counts, token distribution, chunks beyond the limits, chunks a document."""
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    a = chunks.agg(
        F.count_distinct("doc_id").alias("total_docs"), F.count("*").alias("total_chunks"), F.min("token_count").alias("token_min"), F.max("token_count").alias("token_max"),
        F.count_if(F.col("token_count") > max_tokens).alias("above_max_tokens"), F.count_if(F.col("token_count") < min_tokens).alias("below_min_tokens"),
    )
    b = ranked_values(chunks, [], "token_count", {"token_median": ("lower", 50), "token_p95": ("lower", 95)})
    c = per_doc.agg(F.min("n").alias("chunks_per_doc_min"), F.max("n").alias("chunks_per_doc_max"))
    d = ranked_values(per_doc, [], "n", {"chunks_per_doc_median": ("lower", 50), "chunks_per_doc_p95": ("lower", 95)})
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(d))  # one row each


def repeated_lines(chunks: DataFrame, top: int = 30, longest: int = 120, letters: int = 5) -> DataFrame:
    """(line, n): the most frequent short lines, of those seen at least max(20, one in a hundred chunks) times."""
    lines = chunks.select(F.explode(F.split("chunk_text", "\n", -1)).alias("raw")).select(strip(F.col("raw")).alias("line"))
    counts = lines.filter((F.length("line") > 0) & (F.length("line") <= longest) & (F.regexp_count("line", F.lit(r"\p{L}")) >= letters)).groupBy("line").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "line").limit(top)
    total = chunks.agg(F.greatest(F.lit(20), F.floor(F.count("*") * 0.01)).alias("least"))
    return best.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.col("least")).select("line", "n")  # total is one row


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; an error where the key repeats."""
    seen = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    ok = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return rows.join(seen, F.col(key) == F.col("__key"), "left").filter(ok).drop("__key", "__n")


def validity(chunks: DataFrame) -> DataFrame:
    """One row of violation counts."""
    return chunks.agg(
        F.count_if(F.col("chunk_id").isNull()).alias("null_ids"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated_ids"),
        F.count_if(F.col("chunk_text").isNull()).alias("null_texts"), F.count_if(strip(F.col("chunk_text")) == "").alias("blank_texts"),
    )


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: SHA-256 over the chunks' ids and texts in order of ids; all text passes through one task."""
    parts = F.sort_array(F.collect_list(F.struct(F.col("chunk_id").cast("string").alias("i"), F.col("chunk_text").alias("t"))))
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return chunks.agg(F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p["i"], zero, p["t"], zero)), ""), 256).alias("fingerprint"))


def set_fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: a fingerprint that doesn't depend on order and needs no gathering; another value than `fingerprint`."""
    h = F.xxhash64(F.col("chunk_id").cast("string"), "chunk_text")
    return chunks.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))


def tree_fingerprint(chunks: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row: the number of chunks and a SHA-256 that doesn't depend on their order, nulls told from empty texts.

    Each chunk is digested by itself (fields preceded by their lengths). Digests are summed as eight 32-bit parts in
    `buckets` by id, and the buckets' sums are digested in order; no task gathers texts.
    """
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    i = F.col("chunk_id").cast("string")
    each = chunks.select(F.pmod(F.xxhash64(i), F.lit(buckets)).alias("bucket"), F.sha2(F.concat(field(i), field(F.col("chunk_text"))), 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = each.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)])
    lines = sums.select("bucket", "n", F.concat_ws(",", "bucket", "n", *[f"s{k}" for k in range(8)]).alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("bucket", "line")))  # as many as buckets at most
    return lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(listed, lambda s: s["line"]), ";"), 256).alias("fingerprint"))


def seeded_sample(chunks: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k chunks in an order that the seed and the ids decide."""
    return chunks.orderBy(F.xxhash64(F.lit(seed), F.col("chunk_id").cast("string")), "chunk_id").limit(k)
