"""Packing token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretoken
from ._common import map_arrow, slices, table, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, ord long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window exactly: every pair, and for each length the triples and
    quadruples in which the others share the rest evenly. Their number is linear in the window."""
    found = {(a, window - a) for a in range(window // 2, window)}
    for a in range(1, window - 1):
        rest = window - a
        for parts in (2, 3):
            if rest >= parts:
                low, more = divmod(rest, parts)
                found.add(tuple(sorted((a, *[low + 1] * more, *[low] * (parts - more)), reverse=True)))
        if window - 2 * a > 0:
            found.add(tuple(sorted((a, a, window - 2 * a), reverse=True)))
    return sorted(found, reverse=True)


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, A[l, j] being how often length l is in combination j.

    Accelerated projected gradient; A is sparse and non-negative, so diag(A'A 1) bounds A'A from above and serves as
    the step for each combination.
    """
    rows = np.array([length for c in combos for length in c])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    usable = np.array([all(histogram[x] > 0 for x in c) for c in combos])
    if not usable.any():
        return np.zeros(len(combos))
    times = lambda x: np.bincount(rows, x[cols], len(histogram))
    back = lambda y: np.bincount(cols, y[rows], len(combos))
    step = np.maximum(back(times(np.ones(len(combos)))), 1)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.where(usable, np.maximum(0, y - back(times(y) - histogram) / step), 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


class Plan:
    """Where the r-th piece of each length goes. Built from the histogram of lengths alone: its size is bounded by
    the window, not by the corpus.

    Whole windows come first, then the combinations with their rounded repeat counts; `slots[length]` holds
    (first rank, rank after the last, first sequence, offset). Pieces beyond a length's slots are residuals: laid end
    to end, longest first, and cut where a window is full. The tail that fills no window is cut to powers of two,
    which need no padding.
    """

    def __init__(self, counts: dict[int, int], window: int):
        self.window = window
        histogram = np.zeros(window + 1)
        for length, n in counts.items():
            histogram[length] = n
        left = histogram.astype(np.int64)
        self.slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        sequence = 0

        def lay(combo: tuple[int, ...], repeats: int) -> None:
            nonlocal sequence
            offset = 0
            for length in combo:
                self.slots[length].append((used[length], used[length] + repeats, sequence, offset))
                used[length] += repeats
                left[length] -= repeats
                offset += length
            sequence += repeats

        if left[window]:
            lay((window,), int(left[window]))
        histogram[window] = 0
        combos = combinations(window)
        wanted = np.floor(solve(histogram, combos) + 1e-9).astype(np.int64)
        for j in np.argsort(-wanted, kind="stable"):
            if wanted[j] < 1:
                break
            repeats = min(int(wanted[j]), *(int(left[x]) // combos[j].count(x) for x in combos[j]))
            if repeats > 0:
                lay(combos[j], repeats)
        self.used = dict(used)
        self.base: dict[int, int] = {}
        at = 0
        for length in range(window, 0, -1):
            if left[length]:
                self.base[length] = at
                at += int(left[length]) * length
        self.first, self.full = sequence, at // window
        self.tail = [0]
        rest = at % window
        for k in reversed(range(window.bit_length())):
            if rest >> k & 1:
                self.tail.append(self.tail[-1] + (1 << k))

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of each part of the rank-th piece of this length."""
        for a, b, sequence, offset in self.slots.get(length, ()):
            if a <= rank < b:
                return [(length, sequence + rank - a, offset)]
        at, parts = self.base[length] + (rank - self.used.get(length, 0)) * length, []
        while length:
            k, offset = divmod(at, self.window)
            room = self.window - offset
            if k < self.full:
                sequence = self.first + k
            else:
                j = int(np.searchsorted(self.tail, offset, side="right")) - 1
                sequence, room, offset = self.first + self.full + j, self.tail[j + 1] - offset, offset - self.tail[j]
            take = min(length, room)
            parts.append((take, sequence, offset))
            at, length = at + take, length - take
        return parts


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> pretoken.Texts:
    return pretoken.Texts(path)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("ord", pa.int64()), ("ids", pa.binary())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(documents: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Cut every document's ids (the tokenizer's, then `end_id`) into pieces and pack them into sequences of at most
    `window` ids.

    A document gives its whole windows and one rest. Repeat counts of shallow length combinations that fill a window
    are solved against the histogram of rests by non-negative least squares and rounded down; rests beyond them are
    packed greedily end to end, cut where a window is full. Every sequence ends full or at a power of two, so nothing
    is padded.

    The corpus is tokenized once. A piece's rank among those of its length is its ordinal within the task that made it
    plus the count in earlier tasks, so that no task gathers a length; only the histogram of at most `window` counts
    comes to the driver, and only the rests' ids (two or four bytes each) are shuffled. The pieces are written to the
    shared scratch folder before ranks are given, so a repeated task can't change them.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text
    counts as empty: its one piece is `end_id`. Repeated rows and null ids are packed like any others; other columns
    are left out. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    if window & (window - 1) or window > 1 << 16:
        raise ValueError("window must be a power of two")

    def tokenize(batches):
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text), end_id], dtype="<u4")
                total = len(ids)
                for start in range(0, total, window):
                    own = ids[start : start + window]
                    n = len(own)
                    kept = None if n == window else (own.astype("<u2") if own.max() < 1 << 16 else own).tobytes()
                    rows.append((doc, start, n, zlib.crc32(own.tobytes()), total, part, seen[n], kept))
                    seen[n] += 1
            yield _arrow(rows, _PIECES)

    pieces = table(map_arrow(texts(documents), tokenize, PIECES), "pieces")
    counts = table(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(lengths, window)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("ord")).alias("rank"), "ids"
    )

    def place(batches):
        for batch in batches:
            rows = []
            for doc, start, length, crc, total, rank, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = plan.place(length, rank)
                if len(parts) == 1:
                    rows.append((doc, start, length, crc, total, *parts[0][1:]))
                    continue
                ids, at = np.frombuffer(kept, "<u2" if len(kept) == 2 * length else "<u4").astype("<u4"), 0
                for n, sequence, offset in parts:
                    rows.append((doc, start + at, n, zlib.crc32(ids[at : at + n].tobytes()), total, sequence, offset))
                    at += n
            yield _arrow(rows, _PLACED)

    return map_arrow(ranked, place, PLACED)

