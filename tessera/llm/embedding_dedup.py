"""Near-duplicate vectors by randomly rotated binary codes with stored correction factors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, table, tidy
from .components import components

SEED = 20240601


@functools.lru_cache(maxsize=64)
def rotation(dim: int, turn: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every node."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, turn)).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def tables_needed(bits: int, threshold: float, miss: float) -> int:
    """Hash tables of `bits` sign bits so that a pair at the threshold shares no bucket with probability `miss`."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - same)))


@functools.lru_cache(maxsize=64)
def most_apart(dim: int, threshold: float, miss: float) -> int:
    """Differing code bits that a pair at the threshold exceeds with probability `miss` at most.

    After a random rotation each sign of two vectors at angle a differs with probability a/pi, so that the share of
    differing bits estimates a/pi without bias; their number is bounded by the binomial tail.
    """
    p = math.acos(threshold) / math.pi
    tail, k = 1.0, -1
    while k < dim and tail > miss:
        k += 1
        tail -= math.exp(math.lgamma(dim + 1) - math.lgamma(k + 1) - math.lgamma(dim - k + 1) + k * math.log(p) + (dim - k) * math.log1p(-p))
    return k


def bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """[n, tables] sign-bit keys; table t takes `bits` consecutive signs of the concatenated rotations."""
    n, dim = unit.shape
    need = bits * tables
    signs = np.concatenate([unit @ rotation(dim, 1 + k).T > 0 for k in range(math.ceil(need / dim))], axis=1)[:, :need]
    return signs.reshape(n, tables, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes after rotation and each code's correction factor, its cosine with the vector."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return turned > 0, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def possible(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray, threshold: float, z: float) -> np.ndarray:
    """Pairs (i, j) whose inner product may reach the threshold, judged from i's code and j's vector.

    <code_i, x_j> / factor_i estimates <x_i, x_j> without bias; its error is a coordinate of a random direction times
    sqrt(1-<x_i,x_j>^2) sqrt(1-factor_i^2)/factor_i. Of a pair at or above the threshold the estimate falls below the
    limit used here only beyond `z` standard deviations.
    """
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 0).T
    estimate = (np.where(codes, 1, -1).astype(np.float32) / math.sqrt(dim)) @ turned.T / factors[:, None]
    slack = z * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(max(dim - 1, 1)) * math.sqrt(1 - threshold**2)
    return estimate >= (threshold - slack)[:, None] - 1e-5


def _linked(x: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float, z: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) with cosine at or above the threshold, in double precision."""
    norm = np.linalg.norm(x, axis=1)
    unit = (x / norm[:, None]).astype(np.float32)
    for a in range(0, len(x), step):
        i, j = np.nonzero(possible(codes[a : a + step], factors[a : a + step], unit, threshold, z))
        i += a
        keep = i < j
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q])
            yield p[cosine >= threshold], q[cosine >= threshold]


def _close(codes: np.ndarray, side: np.ndarray, within: bool, apart: int, step: int = 512) -> np.ndarray:
    """Which codes (rows of 64-bit words) differ from another's by `apart` bits at most: of any row if `within`, else of a
    row of the other side."""
    hit = np.zeros(len(codes), dtype=bool)
    for a in range(0, len(codes), step):
        bits = np.zeros((len(codes[a : a + step]), len(codes)), dtype=np.uint16)
        for w in range(codes.shape[1]):
            bits += np.bitwise_count(codes[a : a + step, w, None] ^ codes[None, :, w])
        near = bits <= apart
        if within:
            near[np.arange(len(near)), a + np.arange(len(near))] = False
        else:
            near &= side[a : a + step, None] != side[None, :]
        hit[a : a + step] = near.any(1)
    return hit


def _roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Least index that links reach, from the labels so far."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _groups(batches, keys: tuple[str, ...]):
    """Whole groups of rows from sorted batches; the open group is carried over."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, key
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


@tidy
def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, miss: float = 1e-9, z: float = 6.0, block: int = 512) -> DataFrame:
    """Links between vectors of equal label with cosine >= `threshold`, and their connected components.

    Equal vectors of a label are first one representative with a count of their ids. Each gets a rotated binary code, its
    correction factor and its keys in `tables_needed` tables of sign-bit buckets (wider keys for a label of more vectors, so
    buckets stay small whatever the other labels' sizes; a pair at the threshold shares none with probability `miss`). What is
    dealt to buckets is the code alone. A representative whose code differs from all others of its bucket by more bits than a
    pair at the threshold does (`most_apart`) is done with there; only for the others are vector and factor fetched. These
    bound each inner product; pairs whose bound reaches the threshold, and only those, are recomputed in double
    precision, so no link below the threshold is made. A pair is counted in its first common table. Buckets beyond `block`
    vectors are split into tiles of two blocks, so that no task gathers a group of near copies; a tile returns rows, counts
    and one link for each vector, never its pairs.

    Returns vec_id, n_links, component_id, kept: one row for each input row. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label or id, link with nothing and are kept. Vectors of
    different lengths don't link. A row that repeats another's vec_id and vector counts once; rows that repeat a vec_id with
    different vectors are vertices of their own under one id, each with its own links. Other columns are
    left out; an empty table gives an empty result.
    """
    double = dict(embeddings.dtypes)["embedding"] == "array<double>"
    kind = "<f8" if double else "<f4"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    keyed = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    digest = [F.xxhash64("label", "embedding"), F.xxhash64(F.lit("second"), "label", "embedding")]
    keyed = keyed.select("vec_id", "label", "embedding", *[F.when(F.col("valid"), d).alias(f"d{i}") for i, d in enumerate(digest)])
    alike = keyed.filter("d0 is not null").groupBy("d0", "d1").agg(
        F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    ids = keyed.filter("d0 is not null").select("vec_id", "d0", "d1").distinct().groupBy("d0", "d1").agg(F.count("*").alias("copies"))
    reps = table(alike.join(ids, ["d0", "d1"]), "representatives")
    wide = F.ceil(F.log2(F.count("*") / 64 + 1e-9)).cast("int")
    bits_of = reps.groupBy("label").agg(F.least(F.greatest(wide, F.lit(4)), F.lit(24)).alias("bits"))

    def code(batches):
        for batch in batches:
            lists = batch.column("embedding")
            by_kind: dict[tuple[int, int], list[int]] = {}
            for i, kind_of in enumerate(zip(lists.value_lengths().to_pylist(), batch.column("bits").to_pylist(), strict=True)):
                by_kind.setdefault(kind_of, []).append(i)
            for (dim, bits), own in by_kind.items():
                took = batch.take(pa.array(own))
                x = np.array(took.column("embedding").flatten(), dtype=kind).reshape(len(own), dim)
                big = x.astype("f8")
                unit = (big / np.linalg.norm(big / np.abs(big).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(big).max(1, keepdims=True)).astype("f4")
                keys, (codes, factors) = bucket_keys(unit, bits, tables_needed(bits, threshold, miss)), encode(unit)
                packed = np.packbits(np.pad(codes, ((0, 0), (0, -dim % 64))), axis=1)
                raw = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (x, packed)]
                names = ["d0", "d1", "label", "copies", "bits"]
                yield pa.RecordBatch.from_arrays(
                    [*[took.column(c) for c in names], pa.array(np.full(len(own), dim)), *raw, pa.array(factors.astype("f8")), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=[*names, "dim", "x", "code", "factor", "keys"],
                )

    named = reps.join(bits_of, "label").select("d0", "d1", "label", "copies", "bits", "embedding")
    coded = table(map_arrow(named, code, "d0 long, d1 long, label string, copies long, bits int, dim long, x binary, code binary, factor double, keys array<long>"), "coded")
    bucket = ["label", "dim", "bits", "t", "key"]
    dealt = coded.select("label", "dim", "bits", "d0", "d1", "code", F.posexplode("keys").alias("t", "key"))
    large = table(dealt.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n") > block), "large")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("d0", "d1"), F.col("blocks")).cast("int")
    # the other block may be any; a tile is an unordered pair of blocks
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    spread = dealt.join(large, bucket, "left").withColumn("blocks", blocks).withColumn("own", own).withColumn("tile", F.explode(tiles)).select(*bucket, "tile.i", "tile.j", "own", "d0", "d1", "code")
    group = (*bucket, "i", "j")
    spread = spread.repartition(*group).sortWithinPartitions(*group)
    kept = [*group, "own", "d0", "d1"]

    def screen(batches):
        for rows in _groups(batches, group):
            if rows.num_rows < 2:
                continue
            dim, i, j = (rows.column(c)[0].as_py() for c in ("dim", "i", "j"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            hit = _close(codes, rows.column("own").to_numpy(), i == j, most_apart(dim, threshold, miss))
            if hit.any():
                yield from rows.select(kept).filter(pa.array(hit)).combine_chunks().to_batches()

    near = table(map_arrow(spread, screen, "label string, dim long, bits int, t int, key long, i int, j int, own int, d0 long, d1 long"), "near")
    whole = near.join(coded.select("d0", "d1", "copies", "x", "code", "factor", "keys"), ["d0", "d1"])
    whole = whole.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        for rows in _groups(batches, group):
            if rows.num_rows < 2:
                continue
            dim, t, i, j = (rows.column(c)[0].as_py() for c in ("dim", "t", "i", "j"))
            d0, d1, copies, side = (rows.column(c).to_numpy() for c in ("d0", "d1", "copies", "own"))
            x = np.frombuffer(b"".join(rows.column("x").to_pylist()), kind).reshape(-1, dim).astype("f8")
            x /= np.abs(x).max(1, keepdims=True)
            codes = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1), axis=1)[:, :dim].astype(bool)
            keys = np.array(rows.column("keys").to_pylist(), dtype=np.int64)
            links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
            for p, q in _linked(x, codes, rows.column("factor").to_numpy(), threshold, z):
                first = (keys[p] == keys[q]).argmax(1) == t
                across = (side[p] != side[q]) | (i == j)
                p, q = p[first & across], q[first & across]
                links += np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
                root = _roots(len(x), p, q, root)
            hit = np.flatnonzero(links)
            if len(hit):
                to = root[hit]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (d0[hit], d1[hit], links[hit], d0[to], d1[to])], names=["d0", "d1", "links", "to0", "to1"])

    found = table(map_arrow(whole, compare, "d0 long, d1 long, links long, to0 long, to1 long"), "found")
    counts = found.groupBy("d0", "d1").agg(F.sum("links").alias("links"))
    # vertices are vectors, not ids, which rows may share
    vertex = lambda a, b: F.struct(F.col(a).alias("d0"), F.col(b).alias("d1"))
    joined = components(found.select(vertex("d0", "d1").alias("a"), vertex("to0", "to1").alias("b"))).select("id.d0", "id.d1", "component")
    joined = reps.select("d0", "d1", "rep").join(joined, ["d0", "d1"])
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    joined = table(joined.select("d0", "d1", "component").join(least, "component").select("d0", "d1", "least"), "joined")
    of_rep = reps.select("d0", "d1", "rep", "copies").join(counts, ["d0", "d1"], "left").join(joined, ["d0", "d1"], "left").select(
        "d0", "d1", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
    )
    out = keyed.select("vec_id", "d0", "d1").join(of_rep, ["d0", "d1"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
