"""An inverted-file index with product-quantised codes: approximate neighbours over a table of vectors, rescored exactly.

Vectors are dealt to the list of their nearest centroid, and what is left of them is written as a few bytes, one for each
subspace. A search reads the lists nearest to a query, ranks their vectors by what the codes say, and computes the exact
score of the best alone. How many lists and candidates that takes is measured when the index is built.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tessera.functions.vectors import dot, squared_distance
from tessera.operators.vectors import dense_topk, matches, top_k
from tessera.plans.scratch import delete
from tessera.plans.ship import ship_package

#: Query vectors that one scan of the codes holds, and vectors of a folder of codes on average.
ANN_BLOCK, SHARD = 1024, 1 << 17


@dataclass(frozen=True)
class AnnConfig:
    """lists: 0 for the root of the number of vectors, `most_lists` at most. subspaces: 0 for one of every two components.
    sample: vectors that centroids and codebooks are fitted on, at most. held_out: vectors that `probes` and `candidates` are
    measured with, so that `target` of their `k` nearest are found."""

    lists: int = 0
    most_lists: int = 4096
    subspaces: int = 0
    sample: int = 65_536
    held_out: int = 256
    k: int = 10
    target: float = 0.99
    rounds: int = 12
    seed: int = 7


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, dtype=np.int64)])


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; a centre that loses all its vectors moves to one drawn anew."""
    centres = x[rng.choice(len(x), size=k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        at = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres.astype(np.float32)


def _matrix(column) -> np.ndarray:
    """A column of float arrays of one length, without going through Python objects."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _about(centroids: np.ndarray, codebooks: np.ndarray, lists, codes: np.ndarray) -> np.ndarray:
    return centroids[lists] + np.concatenate([codebooks[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)


def _coded(v: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list and the code of each vector."""
    at = _nearest(v, centroids)
    left = (v - centroids[at]).reshape(len(v), len(codebooks), -1)
    return at.astype(np.int32), np.stack([_nearest(left[:, j], codebooks[j]) for j in range(len(codebooks))], axis=1).astype(np.uint8)


@dataclass
class AnnIndex:
    """codes(shard, list, chunk_id, code, embedding, and the vectors' other columns), centroids, codebooks, the lists and codes
    of the vectors they were fitted on, meta."""

    codes: DataFrame
    centroids: np.ndarray
    codebooks: np.ndarray
    drawn: tuple[np.ndarray, np.ndarray]
    meta: dict

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnnIndex:
        """Centroids, codebooks and the codes drawn are read to the driver: their number is bounded by the configuration."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        fitted = {r["name"]: r["data"] for r in spark.read.parquet(f"{path}/fitted").collect()}
        floats = {n: np.frombuffer(fitted[n], dtype=np.float32) for n in ("centroids", "codebooks")}
        drawn = np.frombuffer(fitted["lists"], dtype=np.int32), np.frombuffer(fitted["codes"], dtype=np.uint8).reshape(-1, meta["subspaces"])
        books = floats["codebooks"].reshape(meta["subspaces"], -1, meta["dim"] // meta["subspaces"])
        return cls(spark.read.parquet(f"{path}/codes"), floats["centroids"].reshape(-1, meta["dim"]), books, drawn, meta)

    def about(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return _about(self.centroids, self.codebooks, lists, codes)


def build(vectors: DataFrame, path: str, config: AnnConfig = AnnConfig()) -> AnnIndex:
    """Write the index of vectors (chunk_id, embedding, ...) under `path` and read it back.

    Every row is indexed, but for null vectors and those with a null component; other lengths than the commonest one's
    are an error. Centroids and codebooks are fitted on the rows of least hash of their id, `sample` at most. Codes are
    sorted by list and written in folders of some lists each, so that a search opens few folders, and in them the pages of the
    lists it probes; a list that holds a large part of all vectors is dealt to several files by the hash of ids.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).withColumn("embedding", F.col("embedding").cast("array<float>"))
    told = good.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if not told["n"]:
        raise ValueError("no vectors to index")
    if told["least"] != told["most"] or not told["least"]:
        raise ValueError(f"vectors have {told['least']} to {told['most']} components")
    n, dim = told["n"], told["most"]
    drawn = good.select("embedding", F.xxhash64(F.lit(str(config.seed)), "chunk_id").alias("h")).orderBy("h").limit(config.sample)
    x = _matrix(drawn.select("embedding").toArrow().column("embedding"))
    rng = np.random.default_rng(config.seed)
    lists = min(config.lists or max(1, round(n**0.5)), config.most_lists, len(x))
    subspaces = config.subspaces or next(s for s in range(max(1, dim // 2), 0, -1) if dim % s == 0)
    if dim % subspaces:
        raise ValueError(f"{dim} components do not make {subspaces} equal subspaces")
    centroids = _centres(x, lists, config.rounds, rng)
    rest = (x - centroids[_nearest(x, centroids)]).reshape(len(x), subspaces, -1)
    codebooks = np.stack([_centres(rest[:, j], min(256, len(x)), config.rounds, rng) for j in range(subspaces)])

    shards = min(lists, max(1, round(n / SHARD)))

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("embedding"))
            at, code = _coded(v, centroids, codebooks)
            added = [pa.array((at.astype(np.int64) * shards // lists).astype(np.int32)), pa.array(at), pa.FixedSizeBinaryArray.from_buffers(pa.binary(subspaces), len(v), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "shard", "list", "code"])

    schema = StructType([*good.schema.fields, StructField("shard", IntegerType()), StructField("list", IntegerType()), StructField("code", BinaryType())])
    good.mapInArrow(encode, schema).write.mode("overwrite").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    dealt = encoded.repartitionByRange(F.col("list"), F.xxhash64("chunk_id")).sortWithinPartitions("list")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/codes")
    delete(spark, f"{path}/encoded")
    drawn = _coded(x, centroids, codebooks)
    fitted = [("centroids", bytearray(centroids.tobytes())), ("codebooks", bytearray(codebooks.tobytes())), ("lists", bytearray(drawn[0].tobytes())), ("codes", bytearray(drawn[1].tobytes()))]
    spark.createDataFrame(fitted, "name string, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")
    index = AnnIndex(spark.read.parquet(f"{path}/codes"), centroids, codebooks, drawn, {"n": n, "dim": dim, "lists": lists, "shards": shards, "subspaces": subspaces, "config": asdict(config)})
    index.meta["measured"] = {metric: _measure(index, metric, config) for metric in ("ip", "l2")}
    spark.createDataFrame([(json.dumps(index.meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return index


def _list_scores(q: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    s = q @ centroids.T
    return s if metric == "ip" else 2 * s - (centroids * centroids).sum(1)


def _near(q: np.ndarray, about: np.ndarray, metric: str) -> np.ndarray:
    """What codes say of the scores (of l2 without the query's own part, the same for all)."""
    near = q @ about.T
    return (near if metric == "ip" else 2 * near - (about * about).sum(1)).astype(np.float32)


def _floors(index: AnnIndex, q: np.ndarray, asks: np.ndarray, metric: str, keep: int) -> np.ndarray:
    """A score that more than `keep` of all vectors have by their codes, all but surely: that of the vectors drawn whose rank
    among these, six standard errors added, stands for that many of all. Tasks need not give what lies below."""
    at, codes = index.drawn
    share = len(at) / index.meta["n"]
    rank = keep if share >= 1 else int(np.ceil(keep * share + 6 * np.sqrt(keep * share) + 6))
    out = np.full(len(q), -np.inf, dtype=np.float32)
    if rank > len(at):
        return out
    about = index.about(at, codes)
    for i in range(0, len(q), 64):
        near = np.where(asks[i : i + 64][:, at], _near(q[i : i + 64], about, metric), -np.inf)
        out[i : i + 64] = np.partition(near, -rank, axis=1)[:, -rank]
    return np.where(np.isfinite(out), out - 1e-4 * np.abs(np.where(np.isfinite(out), out, 0)) - 1e-6, -np.inf).astype(np.float32)  # sums in another order


def _measure(index: AnnIndex, metric: str, config: AnnConfig) -> dict:
    """Lists and candidates that hold `target` of the `k` nearest of held-out vectors, found by exact search."""
    asked = index.codes.select(F.col("chunk_id").alias("qid"), "embedding").orderBy(F.xxhash64(F.lit(f"held out {config.seed}"), "qid")).limit(config.held_out)
    rows = asked.toArrow()
    q, names = _matrix(rows.column("embedding")), rows.column("qid").to_pylist()
    asked = index.codes.sparkSession.createDataFrame(rows)
    true = dense_topk(index.codes.select("chunk_id", "embedding"), asked, config.k, metric, strategy="gemm").select("qid", "chunk_id")
    order = np.argsort(np.argsort(-_list_scores(q, index.centroids, metric), axis=1), axis=1)
    where = true.join(index.codes.select("chunk_id", "list"), "chunk_id").toArrow()  # held_out * k rows
    row = {v: i for i, v in enumerate(names)}
    depth = np.sort([order[row[i], c] + 1 for i, c in zip(where.column("qid").to_pylist(), where.column("list").to_pylist(), strict=True)])
    at = max(0, int(np.ceil(config.target**0.5 * len(depth))) - 1)  # both steps together find `target`
    probes = int(depth[at])
    most = min(index.meta["n"], 100 * config.k)
    ranks = top_k(_candidates(index, asked, metric, probes, most), most, score="near").join(true, ["qid", "chunk_id"]).select("rank").toArrow().column("rank").to_numpy()
    ranks = np.sort(np.concatenate([ranks, np.full(max(0, len(depth) - len(ranks)), most)]))
    found = int(np.ceil(config.target * len(depth))) - 1
    return {"probes": probes, "candidates": int(ranks[found]), "held_out": len(names)}


def _candidates(index: AnnIndex, queries: DataFrame, metric: str, probes: int, keep: int, filters: dict[str, object] | None = None) -> DataFrame:
    """(qid, chunk_id, list, near): of each task the `keep` best of each query by codes, among the lists it probes."""
    spark = index.codes.sparkSession
    ship_package(spark)
    ids, qids = dict(index.codes.dtypes)["chunk_id"], dict(queries.dtypes)["qid"]
    centroids, codebooks, lists, shards = index.centroids, index.codebooks, index.meta["lists"], index.meta["shards"]
    blocks = max(1, -(-queries.count() // ANN_BLOCK))
    numbered = queries.select("qid", "embedding").withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    every = None
    for b in range(blocks):
        rows = numbered.filter(F.col("__block") == b).toArrow()
        if not rows.num_rows:
            continue
        names, q = rows.column("qid"), _matrix(rows.column("embedding"))
        scores = _list_scores(q, centroids, metric)
        asks = np.zeros(scores.shape, dtype=bool)
        np.put_along_axis(asks, np.argsort(-scores, axis=1, kind="stable")[:, :probes], True, axis=1)
        wanted = np.flatnonzero(asks.any(0))
        floor = _floors(index, q, asks, metric, keep) if not filters else np.full(len(q), -np.inf, dtype=np.float32)

        def scan(batches, q=q, asks=asks, floor=floor):
            best = [(np.zeros(0, dtype=np.float32), [], np.zeros(0, dtype=np.int32))] * len(q)
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.column("list").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                for one in np.unique(at):
                    mine, who = np.flatnonzero(at == one), np.flatnonzero(asks[:, one])
                    if not len(who):
                        continue
                    near = _near(q[who], _about(centroids, codebooks, np.full(len(mine), one), code[mine]), metric)
                    for i, s in zip(who, near, strict=True):
                        pick = np.flatnonzero(s >= floor[i])
                        if len(pick) > keep:
                            pick = pick[s[pick] >= np.partition(s[pick], -keep)[-keep]]
                        held = best[i]
                        if len(held[0]) >= keep:
                            pick = pick[s[pick] >= held[0].min()]  # the running score of the last that is kept
                        if not len(pick):
                            continue
                        merged = np.concatenate([held[0], s[pick]]), [*held[1], *batch.column("chunk_id").take(pa.array(mine[pick])).to_pylist()], np.concatenate([held[2], np.full(len(pick), one, dtype=np.int32)])
                        if len(merged[0]) > 2 * keep:
                            top = np.flatnonzero(merged[0] >= np.partition(merged[0], -keep)[-keep])
                            merged = merged[0][top], [merged[1][t] for t in top], merged[2][top]
                        best[i] = merged
            n = [len(h[0]) for h in best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(len(q)), n)), pa.array([c for h in best for c in h[1]], type=id_type), pa.array(np.concatenate([h[2] for h in best])), pa.array(np.concatenate([h[0] for h in best])),
                ], names=["q", "chunk_id", "list", "near"])

        id_type = index.codes.select("chunk_id").limit(0).toArrow().schema.field(0).type
        codes = index.codes.filter(matches(filters))
        if len(wanted) < lists:  # folders without such a list are not opened
            codes = codes.filter(F.col("shard").isin(sorted({int(w) * shards // lists for w in wanted})) & F.col("list").isin(wanted.tolist()))
        found = codes.select("list", "chunk_id", "code").mapInArrow(scan, f"q long, chunk_id {ids}, list int, near float")
        labels = spark.createDataFrame(pa.table({"q": pa.array(range(len(names)), pa.int64()), "qid": names}))
        found = found.join(F.broadcast(labels), "q").select("qid", "chunk_id", "list", "near")  # ANN_BLOCK rows
        every = found if every is None else every.unionByName(found)
    return every if every is not None else spark.createDataFrame([], f"qid {qids}, chunk_id {ids}, list int, near float")


def search(index: AnnIndex, queries: DataFrame, k: int, metric: str = "ip", probes: int | None = None, candidates: int | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the best `k` for queries (qid, embedding), with exact scores.

    `probes` lists are read and `candidates` vectors rescored a query, by default as many as the index measured for its
    target (more candidates where k is larger). Filters apply to the index's other columns before anything is ranked.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"unsupported metric {metric}")
    told = index.meta["measured"][metric]
    probes = probes or told["probes"]
    candidates = max(k, candidates or -(-told["candidates"] * max(k, index.meta["config"]["k"]) // index.meta["config"]["k"]))
    near = top_k(_candidates(index, queries, metric, probes, candidates, filters), candidates, score="near").select("qid", "chunk_id", "list")
    exact = near.join(index.codes.select("list", "chunk_id", "embedding"), ["list", "chunk_id"]).join(queries.select("qid", F.col("embedding").alias("q")), "qid")
    score = dot(F.col("embedding"), F.col("q")) if metric == "ip" else F.lit(0.0) - squared_distance(F.col("embedding"), F.col("q"))
    return top_k(exact.select("qid", "chunk_id", score.alias("score")), k)
