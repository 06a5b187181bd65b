"""Exact and approximate nearest neighbours over a table of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, norm, squared_distance
from tessera.plans.ship import ship_package

#: Query vectors that one pass holds; more are done in blocks.
QUERY_BLOCK = 4096
#: Blocks of queries that one scan of the vectors is multiplied with.
PASS_BLOCKS = 8
#: Pairs that a task multiplies, or holds as found, at a time.
CELLS = 1 << 20


def matches(filters: dict[str, object] | None) -> Column:
    """All of: a value (nulls equal), a list of values, or a function of the column whose null counts as false."""
    condition = F.lit(True)
    for name, wanted in (filters or {}).items():
        column = F.col(name)
        if callable(wanted):
            one = F.coalesce(wanted(column), F.lit(False))
        elif isinstance(wanted, (list, tuple, set, frozenset)):
            values = list(wanted)
            one = F.coalesce(column.isin([v for v in values if v is not None]), F.lit(False)) | (column.isNull() if None in values else F.lit(False))
        else:
            one = column.eqNullSafe(F.lit(wanted))
        condition = condition & one
    return condition


def metric_of(meta: dict) -> str:
    """The metric that a meta row tells, by `score_mode` or else `metric`; inner product where it tells none."""
    told = str(meta.get("score_mode") or meta.get("metric") or "ip").lower()
    return "l2" if "l2" in told or "euclid" in told else "ip"


def top_k(scored: DataFrame, k: int, by: str = "qid", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", filters: dict[str, object] | None = None, strategy: str = "expression") -> DataFrame:
    """(qid, chunk_id, score, rank) from vectors (chunk_id, embedding, ...) and queries (qid, embedding).

    Filters apply before the search. `metric`: ip (inner product) or l2 (negated squared distance), larger is better.
    `strategy`: "expression" joins a checked number of query rows to each vector; "gemm" multiplies blocks of queries
    with Arrow batches and keeps each task's best k, so that little is shuffled.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"unsupported metric {metric}")
    kept = vectors.filter(matches(filters)).select("chunk_id", "embedding")
    if strategy == "gemm":
        return _gemm(kept, queries, k, metric)
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return _gemm(kept, queries, k, metric)
    q = queries.select("qid", F.col("embedding").alias("q_embedding"))
    score = dot(F.col("embedding"), F.col("q_embedding")) if metric == "ip" else F.lit(0.0) - squared_distance(F.col("embedding"), F.col("q_embedding"))
    return top_k(kept.crossJoin(F.broadcast(q)).select("qid", "chunk_id", score.alias("score")), k)  # at most QUERY_BLOCK rows


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column that are not null, and their components as doubles. Lists of unlike length are an error."""
    held = column.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
    lists = column.take(pa.array(held)) if len(held) < len(column) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(held) and len(set(pc.list_value_length(lists).to_numpy())) > 1:
        raise ValueError("vectors must have one length")
    return held, flat.reshape(len(held), -1)


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of paired rows, components added one after the other as the expressions add them, so that ties are ties."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j] if metric == "ip" else (a[:, j] - b[:, j]) ** 2
    return s if metric == "ip" else 0.0 - s


class _Best:
    """The k best rows of each query that a task has met; ties by id. A row met twice counts once."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.waiting = k, np.full(n, -np.inf), [], 0

    def add(self, q: np.ndarray, row: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.parts.append(pa.table({"q": q, "row": row, "id": ids, "score": score}))
        self.waiting += len(q)
        if self.waiting > CELLS:
            self.settle()

    def settle(self) -> None:
        """Only the best stay, and with the k-th a floor for those to come."""
        if not self.waiting:
            return
        every = pa.concat_tables(self.parts)
        every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending"), ("row", "ascending")], null_placement="at_start"))
        q, row = every.column("q").to_numpy(), every.column("row").to_numpy()
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (row[1:] != row[:-1])]).nonzero()[0]
        q = q[once]
        first = np.concatenate([[True], q[1:] != q[:-1]]).nonzero()[0]
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        best = every.take(pa.array(once[rank < self.k])).combine_chunks()
        last = (rank == self.k - 1).nonzero()[0]
        self.floor[q[last]] = every.column("score").to_numpy()[once[last]]
        self.parts, self.waiting = [best], 0


def _gemm(vectors: DataFrame, queries: DataFrame, k: int, metric: str, codes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Queries in blocks of about QUERY_BLOCK by a hash of their id; each pass over the vectors holds PASS_BLOCKS of them.

    With `codes`, which gives each vector one bucket of each of some tables, queries are multiplied only with vectors of
    a bucket of theirs. A task multiplies CELLS pairs at a time, scores those again that reach the k-th best of their query
    so far, and gives out the k best of each query alone. Null vectors are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    ids = dict(vectors.dtypes)["chunk_id"]
    qids = dict(queries.dtypes)["qid"]
    queries = queries.select("qid", "embedding").filter("embedding is not null")
    blocks = -(-queries.count() // QUERY_BLOCK)
    numbered = queries.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(max(blocks, 1))))
    parts = []
    for begin in range(0, blocks, PASS_BLOCKS):
        rows = numbered.filter(F.col("__block").between(begin, begin + PASS_BLOCKS - 1)).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        names, q = rows.column("qid"), _matrix(rows.column("embedding").combine_chunks())[1]

        def run(batches, q=q):
            best, seen = _Best(len(q), k), 0
            square = (q * q).sum(1)
            members = [_dealt(c) for c in (np.zeros((1, len(q)), dtype=np.int64) if codes is None else codes(q).T)]
            for batch in batches:
                held, x = _matrix(batch.column("embedding"))
                if not len(x):
                    continue
                own, norms = batch.column("chunk_id").take(pa.array(held)), (x * x).sum(1)
                slack = 1e-9 * max(1.0, float(square.max()), float(norms.max()))
                theirs = np.zeros((len(x), 1), dtype=np.int64) if codes is None else codes(x)
                for table, column in zip(members, theirs.T, strict=True):
                    for bucket, items in _dealt(column).items():
                        asked = table.get(bucket, ())
                        step, these = max(1, CELLS // len(items)), x[items].T
                        for a in range(0, len(asked), step):
                            at = asked[a : a + step]
                            s = q[at] @ these
                            if metric == "l2":
                                s *= 2
                                s -= square[at][:, None]
                                s -= norms[items][None, :]
                            least = best.floor[at]
                            if s.shape[1] > k and np.isneginf(least).any():
                                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                            i, j = np.nonzero(s >= least[:, None] - slack)
                            if len(i):
                                i, j = at[i], items[j]
                                score = np.concatenate([_exact(q[i[c : c + 65536]], x[j[c : c + 65536]], metric) for c in range(0, len(i), 65536)])
                                best.add(i, j + seen, own.take(pa.array(j)), score)
                    best.settle()
                seen += len(x)
            for part in best.parts:
                for found in part.to_batches(max_chunksize=65536):
                    yield pa.RecordBatch.from_arrays([found.column("q"), found.column("id"), found.column("score")], names=["q", "chunk_id", "score"])

        found = vectors.mapInArrow(run, f"q long, chunk_id {ids}, score double")
        labels = spark.createDataFrame(pa.table({"q": pa.array(range(len(names)), pa.int64()), "qid": names}))
        parts.append(found.join(F.broadcast(labels), "q").select("qid", "chunk_id", "score"))  # PASS_BLOCKS blocks of queries
    if not parts:
        return spark.createDataFrame([], f"qid {qids}, chunk_id {ids}, score double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top_k(every, k)


def _dealt(buckets: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each bucket."""
    order = np.argsort(buckets, kind="stable")
    held = buckets[order]
    cuts = np.concatenate([[0], (held[1:] != held[:-1]).nonzero()[0] + 1, [len(held)]])
    return {int(held[a]): order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a}


def lsh_topk(vectors: DataFrame, queries: DataFrame, k: int, bits: int = 4, tables: int = 24, seed: int = 7, metric: str = "ip") -> DataFrame:
    """Approximate neighbours: sign-bit buckets, exact scores within. Judge by recall.

    By inner product the signs are of unit vectors as they are; by squared distance (l2) of all vectors less their mean,
    around which they lie. Buckets are multiplied where the vectors lie, so that no pair is shuffled.
    """
    first = vectors.filter("embedding is not null").select(F.size("embedding").alias("d")).first()
    if first is None:
        return dense_topk(vectors, queries, k, metric)
    d = first["d"]
    planes = np.random.default_rng(seed).standard_normal((tables, bits, d))
    centre = [0.0] * d
    if metric == "l2":
        means = vectors.select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(d)]).agg(*[F.avg(f"e{i}") for i in range(d)]).first()
        centre = [float(x or 0.0) for x in means]
    beyond, offset = planes.reshape(tables * bits, d).T, (planes @ np.array(centre)).reshape(tables * bits)

    def codes(x: np.ndarray) -> np.ndarray:
        signs = (x @ beyond > offset).reshape(len(x), tables, bits)
        return signs @ (1 << np.arange(bits))

    return _gemm(vectors.select("chunk_id", "embedding"), queries, k, metric, codes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact results that were found."""
    hit = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id").withColumn("hit", F.lit(1)), ["qid", "chunk_id"], "left")
    return hit.agg(F.count_distinct("qid").alias("n_queries"), (F.count("hit") / F.count("*")).alias("recall"))


def self_neighbours(vectors: DataFrame, asked: DataFrame, least: float = 0.9) -> DataFrame:
    """(chunk_id, found, score, ok): whether each asked vector (chunk_id, embedding) is its own nearest, with a score above
    `least`."""
    best = dense_topk(vectors, asked.select(F.col("chunk_id").alias("qid"), "embedding"), 1)
    return best.select(F.col("qid").alias("chunk_id"), F.col("chunk_id").alias("found"), "score", ((F.col("qid") == F.col("chunk_id")) & (F.col("score") > least)).alias("ok"))


def random_queries(spark, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(qid, embedding): unit vectors that depend on the seed alone, for a sanity search."""
    x = np.random.default_rng(seed).standard_normal((n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, embedding array<float>")


def embedding_checks(vectors: DataFrame) -> DataFrame:
    """One row: vectors, distinct ids, dimensions, least and largest norm."""
    return vectors.agg(
        F.count("*").alias("n_vectors"), F.count_distinct("chunk_id").alias("n_ids"), F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"), F.round(F.min(norm(F.col("embedding"))), 6).alias("min_norm"), F.round(F.max(norm(F.col("embedding"))), 6).alias("max_norm"),
    )


def embed(chunks: DataFrame, provider: Callable[[list[str]], np.ndarray], text: str = "chunk_text", normalize: bool = True, dim: int | None = None) -> DataFrame:
    """(chunk_id, embedding) by a provider called once for each Arrow batch; vectors of one length, normalised on demand.

    The length is `dim`, or that of the provider's vector of one blank text; a batch of another length is an error."""
    ship_package(chunks.sparkSession)
    dim = int(np.asarray(provider([" "])).shape[1]) if dim is None else dim
    ids = dict(chunks.dtypes)["chunk_id"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(provider(batch.column("t").to_pylist()), dtype=np.float32)
            if x.ndim != 2 or len(x) != batch.num_rows:
                raise ValueError("a provider must return one vector for each text")
            if dim is not None and x.shape[1] != dim:
                raise ValueError(f"a provider returned vectors of {x.shape[1]} components, not {dim}")
            if normalize:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    return chunks.select("chunk_id", F.col(text).alias("t")).mapInArrow(run, f"chunk_id {ids}, embedding array<float>")
