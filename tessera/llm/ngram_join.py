"""Exact n-gram Jaccard join of documents: prefix tiles by size, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, may_hold, slices, table, text_key, texts, tidy
from .components import components

SKETCH_BITS, SLICE_BITS = 22, 16
BITMAP_WORDS, LARGE_WORDS, LARGE_SET = 16, 128, 1000
_U = np.uint64
_MASK = (1 << 64) - 1
#: Parts into which the postings of a common shingle are dealt.
SALTS = 64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Two odd multipliers (5 modulo 8), for two independent polynomial hashes of a word's bytes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
_VALUES = [np.random.default_rng((7, i)).integers(1, 1 << 64, 256, dtype=np.uint64) for i in range(2)]
for _v in _VALUES:
    _v[65:91] = _v[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _power_table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < size:
        size = max(size, 1 << 19)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t))
        _powers[base] = have = (tables[0], tables[1])
    return have


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of `raw` begins, and its 64-bit hash, of the lower-cased (A-Z) word.

    A word's two polynomial hashes are differences of running sums over the bytes, so no word is touched one by one.
    """
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    out = np.zeros(len(begin), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for base, values in zip(_BASES, _VALUES, strict=True):
            power, inverse = _power_table(base, len(data) + 1)
            run = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values[data] * power[: len(data)], out=run[1:])
            out = _mix(out + (run[end] - run[begin]) * inverse[begin])
    return begin, out


def shingle_sets(all_texts: list[str], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles (the whole sequence of a shorter text)."""
    raw = [t.encode() for t in all_texts]
    begin, flat = word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(begin, np.cumsum([0, *[len(b) + 1 for b in raw]])).tolist()
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(flat) - k + 1, 0), dtype=np.uint64)
        for i in range(k if len(h) else 0):
            h = h * _U(_BASES[0]) + flat[i : i + len(h)]
        h = _mix(h)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = b - a
            if n >= k:
                out.append(np.unique(h[a : b - k + 1]))
            elif n:
                one = np.zeros(1, dtype=np.uint64)
                for w in flat[a:b]:
                    one = one * _U(_BASES[0]) + w
                out.append(_mix(one + _U(n)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """A set's name, and a second one for sets whose first names clash."""
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d & _MASK) - (1 << 63), (d >> 64) - (1 << 63)


def named(shingles: np.ndarray, clashes: frozenset[int]) -> int:
    first, second = set_id(shingles)
    return second if first in clashes else first


def bitmap(shingles: np.ndarray, words: int = BITMAP_WORDS) -> list[int]:
    """Parity of the shingles in each of 64 * words hashed bits: two sets differ in at least as many shingles as bits."""
    bits = np.bincount((shingles >> _U(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _cell(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles >> _U(40)).astype(np.int64) & (cells - 1)


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the global order (commonness level, hash), of which two similar sets must share one."""
    n = len(shingles)
    keep = n - -(-percent * n // 100) + 1
    level = levels[_cell(shingles, len(levels))]
    return shingles[np.lexsort((shingles, level))[:keep]] if level.any() else shingles[:keep]


def _salt(tokens: np.ndarray, v: int, levels: np.ndarray) -> np.ndarray:
    """0 for a shingle that is not common; for a common one a part from 1 on that the set's name decides."""
    return np.where(levels[_cell(tokens, len(levels))] > 0, 1 + v % SALTS, 0).astype(np.int32)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _levels(parts: dict[int, bytes]) -> bytes:
    """For each cell, packed: 0 where its shingles are about as common as chance hashing makes them; beyond that the
    binary logarithm of the count. Slices are opened one by one."""
    counts = lambda i: np.frombuffer(zlib.decompress(parts[i]), np.uint32) if i in parts else np.zeros(1 << SLICE_BITS, np.uint32)
    slices_ = range(1 << (SKETCH_BITS - SLICE_BITS))
    usual = 1.5 * sum(int(counts(i).sum()) for i in slices_) / (1 << SKETCH_BITS) + 8
    out = bytearray()
    for i in slices_:
        c = counts(i)
        out += np.where(c > usual, np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.uint8).tobytes()
    return zlib.compress(bytes(out))


def _measure(k: int):
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        names = ["doc_id", "text_id", "n", "v", "v2", "bits", "large", "slice", "counts"]
        for batch in slices(batches, chars=400_000):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            np.add.at(sketch, _cell(np.concatenate(sets), 1 << SKETCH_BITS), np.uint32(1))
            n, ids = len(sets), [set_id(s) if len(s) else (None, None) for s in sets]
            columns = [batch.column("doc_id"), batch.column("text_id"), pa.array([len(s) for s in sets], kinds[2]), pa.array([a for a, _ in ids], kinds[3]), pa.array([b for _, b in ids], kinds[4]), pa.array([bitmap(s) if len(s) else None for s in sets], kinds[5]), pa.array([bitmap(s, LARGE_WORDS) if len(s) >= LARGE_SET else None for s in sets], kinds[6]), pa.nulls(n, kinds[7]), pa.nulls(n, kinds[8])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if sketch.any():
            parts = sketch.reshape(-1, 1 << SLICE_BITS)
            packed = [zlib.compress(p.tobytes(), 1) for p in parts]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(packed), t) for t in kinds[:7]), pa.array(range(len(packed)), kinds[7]), pa.array(packed, kinds[8])], names=names)

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLICE_BITS, dtype=np.uint64)
    for blob in rows.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(blob), np.uint32)
    return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})


_POSTINGS = pa.schema([(c, pa.int64()) for c in ("token", "v", "n", "pos")])


def _tiles(percent: int):
    """From postings sorted by token, size and set, those that share their tile with another set.

    A tile is a stretch of a token's sets in which each is at most 100/percent times the size of the one before; no
    pair outside a tile can be similar. Only the open tile's last set is held. Postings with a salt, those of common
    shingles, stand apart from others of their shingle and all go on.
    """

    def run(batches):
        token = before = None
        told = False
        for batch in batches:
            common = pc.greater(batch.column("salt"), 0)
            yield batch.filter(common).select(["token", "v", "n", "pos"]).cast(_POSTINGS)
            batch = batch.filter(pc.invert(common))
            if not batch.num_rows:
                continue
            t, v, n, p = (batch.column(c).to_numpy() for c in ("token", "v", "n", "pos"))
            start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            stop = np.append(start[1:], len(t))
            several = stop - start > 1
            several[0] = several[-1] = True  # these may go on in the neighbouring batch
            out = []
            for a, b in zip(start[several].tolist(), stop[several].tolist(), strict=True):
                if t[a] != token:
                    token, before = t[a], None
                for own, size, pos in zip(v[a:b].tolist(), n[a:b].tolist(), p[a:b].tolist(), strict=True):
                    if before is None or 100 * before[1] < percent * size:
                        told = False
                    elif own != before[0]:
                        if not told:
                            out.append((int(token), *before))
                            told = True
                        out.append((int(token), own, size, pos))
                    before = (own, size, pos)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_POSTINGS)

    return run


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose overlap may suffice, bounded from above by the bits in which their bitmaps differ; with
    the least share of shingles in which they differ."""
    slim = [classes.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"), F.col("large").alias(f"large_{c}")) for c in "ab"]
    count = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    differ = F.coalesce(count("large_a", "large_b"), count("bits_a", "bits_b"))
    most = F.least(F.floor((F.col("n_a") + F.col("n_b") - F.col("differ")) / 2), "n_a", "n_b")
    joined = pairs.join(slim[0], "a").join(slim[1], "b").withColumn("differ", differ)
    return joined.filter(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).withColumn("share", F.col("differ") / (F.col("n_a") + F.col("n_b"))).select(*pairs.columns, "share")


def _verified(base: DataFrame, near: DataFrame, classes: DataFrame, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """Those pairs (a, b) of sets that are similar: the texts are fetched, one for each set, and sorted arrays
    intersected."""
    ends = near.select(F.col("a").alias("v")).union(near.select("b")).distinct()
    wanted = table(classes.join(ends, "v").select(F.col("least").alias("doc_id"), "v"), "wanted")

    def fetch(batches):
        for batch in slices(batches, chars=400_000):
            own = shingle_sets(batch.column("text").to_pylist(), k)
            keep = [len(s) > 0 and named(s, clashes) == v for s, v in zip(own, batch.column("v").to_pylist(), strict=True)]
            ids = batch.column("v").filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s, x in zip(own, keep, strict=True) if x], pa.binary())], names=["v", "shingles"])

    sets = table(map_arrow(may_hold(base, "doc_id", wanted, "doc_id").join(wanted, "doc_id"), fetch, "v long, shingles binary"), "sets").dropDuplicates(["v"])
    full = [sets.select(F.col("v").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab"]

    def run(batches):
        for batch in batches:
            keep = [
                _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return table(map_arrow(near.join(full[0], "a").join(full[1], "b").select("a", "b", "s_a", "s_b"), run, "a long, b long"), "similar")


def _favourites(labelled: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each set with the leader of another group that it meets most often.

    A token's two leaders are the sets, of different groups, with most postings left, which are those that share most
    with others: of near copies, the original.
    """
    rank = F.struct("weight", F.xxhash64(F.lit(turn), "v").alias("h"), "v", "n", "label")
    one = labelled.groupBy("token").agg(F.max(rank).alias("one"))
    two = labelled.join(one, "token").filter(F.col("label") != F.col("one.label")).groupBy("token", "one").agg(F.max(rank).alias("two"))
    facing = labelled.join(two, "token").withColumn("first", F.when(F.col("label") != F.col("one.label"), F.col("one")).otherwise(F.col("two")))
    facing = facing.filter((100 * F.col("n") >= percent * F.col("first.n")) & (100 * F.col("first.n") >= percent * F.col("n")))
    often = facing.groupBy("v", F.col("first.v").alias("first")).agg(F.count("*").alias("times"))
    best = often.groupBy("v").agg(F.max(F.struct("times", "first")).alias("best"))
    return best.select(F.least("v", "best.first").alias("a"), F.greatest("v", "best.first").alias("b")).distinct()


def _open(tiles: DataFrame, label: DataFrame) -> DataFrame:
    """The postings of tokens under which sets of different groups stand, with their groups."""
    labelled = table(tiles.join(label, "v", "left").select("token", "v", "n", "pos", "weight", F.coalesce("label", "v").alias("label")), "labelled")
    tokens = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    return labelled.join(tokens, "token", "left_semi")


@tidy
def similar_documents(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their k-word shingle sets of at least `percent` in 100.

    Words are lower-cased (A-Z) and split at ASCII white space; shingles are 64-bit hashes; copies of a set are one
    vertex, told from others by a 128-bit hash of the set. All shingles are put in one global order, rare before common: a hashed
    count sketch of fixed size, added up over all documents, gives each its commonness level. Two similar sets must
    share a shingle of their prefixes in this order and lie in one tile, a size band of that shingle's postings. In
    two rounds each set is paired with the leader of another group that it meets most often; then all pairs of a tile
    not yet connected are taken, the likeliest of two groups first. So a group of near copies is not expanded, and no link between
    groups is lost. Parity bitmaps bound each pair's overlap from above before the sorted arrays are intersected.

    Postings are sorted by the shuffle and read as a stream that holds two sets of the open tile; texts are fetched
    a second time only for pairs that the bitmaps let through. What reaches the driver is the sketch's level for each of 2^22 cells, and the names of sets that clash. Postings of shingles more common than chance are dealt by
    their sets as well, so that no task gets all sets of one.

    Returns doc_id, text_id (a hash of the text), n_shingles, component_id (the smallest doc_id that links reach, itself
    included): one row for each input row. Texts without words, null texts and rows with a null id are linked with nothing.
    Rows that repeat a doc_id with different texts are each in the component of their own text. Other columns are left out; an empty table gives an empty
    result.
    """
    base = texts(documents, text_key().alias("text_id"))
    measured = table(map_arrow(base, _measure(k), "doc_id long, text_id long, n long, v long, v2 long, bits array<long>, large array<long>, slice int, counts binary"), "measured")
    parts = measured.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add_up, "slice int, counts binary").collect()
    packed = _levels({r["slice"]: bytes(r["counts"]) for r in parts})
    # different sets of one 64-bit name, of which n^2 / 2^65 are expected among n, go by their second names
    clashing = measured.filter("v is not null").groupBy("v").agg(F.min("v2").alias("a"), F.max("v2").alias("b")).filter("a <> b").select("v").collect()
    clashes = frozenset(r["v"] for r in clashing)
    if clashes:
        measured = measured.withColumn("v", F.when(F.col("v").isin(list(clashes)), F.col("v2")).otherwise(F.col("v")))

    def post(batches):
        levels, seen = np.frombuffer(zlib.decompress(packed), np.uint8), set()
        for batch in slices(batches, chars=400_000):
            tokens, ids, sizes, places, salts = [], [], [], [], []
            for doc, own in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), k), strict=True):
                if doc is None or not len(own) or (v := named(own, clashes)) in seen:
                    continue
                seen.add(v)  # a task posts a set once
                first = prefix(own, levels, percent)
                tokens.append(first.view(np.int64))
                ids.append(np.full(len(first), v))
                sizes.append(np.full(len(first), len(own), dtype=np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
                salts.append(_salt(first, v, levels))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, ids, sizes, places, salts)], names=["token", "v", "n", "pos", "salt"])

    postings = map_arrow(base, post, "token long, v long, n int, pos int, salt int")
    order = postings.repartition("token", "salt").sortWithinPartitions("token", "n", "v")
    tiles = table(map_arrow(order, _tiles(percent), "token long, v long, n long, pos long"), "tiles")
    docs = measured.filter("slice is null").select("doc_id", "text_id", "n", "v")
    known = measured.filter("v is not null and doc_id is not null")
    classes = table(known.groupBy("v").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("large").alias("large")), "classes")
    weight = tiles.groupBy("v").agg(F.count("*").alias("weight"))
    tiles = table(tiles.join(weight, "v"), "weighted")
    tried = links = None
    label = classes.limit(0).select("v", F.col("v").alias("label"))
    for turn in range(2):
        now = _favourites(_open(tiles, label), turn, percent)
        now = table(now.join(tried, ["a", "b"], "left_anti") if tried else now, f"favourites{turn}")
        similar = _verified(base, table(_possible(now, classes, percent).select("a", "b"), "near"), classes, k, percent, clashes)
        links = table(links.unionByName(similar), f"links{turn}") if links else similar
        tried = table(tried.unionByName(now), f"tried{turn}") if tried else now
        label = table(components(links), "label").select(F.col("id").alias("v"), F.col("component").alias("label"))
    before = F.lag("token").over(Window.partitionBy("v").orderBy("pos"))
    left = table(_open(tiles, label).withColumn("before", before), "open")
    x, y = (left.select("token", F.col("v").alias(c), F.col("n").alias(f"m_{c}"), F.col("pos").alias(f"p_{c}"), F.col("before").alias(f"t_{c}"), F.col("label").alias(f"l_{c}")) for c in "ab")
    # two sets that share the token before this one have met there; at their first common token the rest must suffice
    most = F.least(F.col("m_a") - F.col("p_a"), F.col("m_b") - F.col("p_b"))
    met = x.join(y, "token").filter(
        (F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & F.coalesce(F.col("t_a") != F.col("t_b"), F.lit(True))
    ).filter(100 * most >= percent * (F.col("m_a") + F.col("m_b") - most))
    met = met.select("a", "b", "l_a", "l_b").distinct().join(tried, ["a", "b"], "left_anti")
    rest = table(_possible(met, classes, percent), "rest")
    # the likeliest pairs of two groups first: once they are linked, their other pairs need no sets
    for most in (2, 16, None):
        if rest.isEmpty():
            break
        groups = Window.partitionBy(F.least("l_a", "l_b"), F.greatest("l_a", "l_b")).orderBy("share", "a", "b")
        now = rest.withColumn("turn", F.row_number().over(groups)).filter(F.col("turn") <= most) if most else rest
        now = table(now.select("a", "b"), "now")
        links = table(links.unionByName(_verified(base, now, classes, k, percent, clashes)), "links")
        label = table(components(links), "label").select(F.col("id").alias("v"), F.col("component").alias("label"))
        if most:
            ends = [label.select(F.col("v").alias(c), F.col("label").alias(f"new_{c}")) for c in "ab"]
            after = rest.join(now, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
            rest = table(after.select("a", "b", F.coalesce("new_a", "a").alias("l_a"), F.coalesce("new_b", "b").alias("l_b"), "share").filter("l_a <> l_b"), "rest")
    grouped = classes.select("v", "least").join(label, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = grouped.join(least, "label").select("v", "component_id")
    return docs.join(of_class, "v", "left").select("doc_id", "text_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
