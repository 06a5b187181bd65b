"""Collocations: frequent phrases by growth of contiguous patterns, scored by their weakest cut."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, slices, table, tidy

#: Words of a phrase at most. A word, or a place without one, is a 64-bit number, and a phrase is up to five of them.
WORDS = 5
#: A-Z lower-cased; the marks that end a piece, and the controls 0x0A to 0x0D, as line ends.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
_units = re.compile(rb"[^ \t\n]+|\n").findall
#: Bits of a filter of numbers at most (2 MB).
MOST_BITS = 1 << 24


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _word_counts(documents: DataFrame, held: int = 200_000) -> DataFrame:
    """(lang, word, n). A task adds up what it meets before rows are shuffled, `held` words at a time."""

    def run(batches):
        counts: dict[str, Counter] = {}

        def rows():
            for lang, c in counts.items():
                words = pa.array(list(c), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), words, pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.encode().translate(_PLAIN).split())
            if sum(map(len, counts.values())) > held:
                yield from rows()
                counts.clear()
        yield from rows()

    return map_arrow(_rows(documents), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_number(seed: int):
    """The number of a word of a language, as an expression over lang and word. `_numbers` gives the same in Python."""
    return F.xxhash64(F.lit(str(seed)), F.col("lang"), F.col("word"))


class _numbers(dict):
    """The number of each word of one language, as eight bytes; eight zero bytes where a piece ends."""

    def __init__(self, lang: str, seed: int, limit: int = 300_000):
        super().__init__({b"\n": bytes(8)})
        self.seed, self.limit = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(str(seed).encode(), 42)), limit

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh64_intdigest(word, self.seed).to_bytes(8, "little")
        if len(self) >= self.limit:
            self.clear()  # what was remembered saves time only
            self[b"\n"] = bytes(8)
        self[word] = value
        return value


def _sequences(batches, seed: int):
    """For each slice of a batch one array of word numbers; 0 ends a piece."""
    known: dict[str, _numbers] = {}
    for batch in slices(batches):
        found = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in known:
                if len(known) >= 8:
                    known.clear()
                known[lang] = _numbers(lang, seed)
            found += [*map(known[lang].__getitem__, _units(text.encode().translate(_PLAIN))), bytes(8)]
        yield np.frombuffer(b"".join(found), dtype=np.int64)


def _bits(numbers: DataFrame, column: str, rows: int) -> np.ndarray | None:
    """A bitmap of numbers, 16 bits each where that is at most MOST_BITS, and None where it would hold fewer than four."""
    if 4 * rows > MOST_BITS:
        return None
    size = min(MOST_BITS, 1 << max(16, (16 * max(rows, 1) - 1).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(size - 1))
    words = numbers.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("v")).toArrow()
    dense = np.zeros(size // 64, dtype=np.int64)
    dense[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return dense


def _in(bits: np.ndarray | None, numbers: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(numbers), dtype=bool)
    at = numbers & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _pair_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two neighbours, mixed so that its low bits depend on all of both."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _frequent_pairs(documents: DataFrame, seed: int, words: np.ndarray | None, least: int, held: int = 1 << 20) -> DataFrame:
    """Numbers of neighbours that stand side by side often enough; two pairs of one number count together, so none is missed."""

    def run(batches):
        waiting, size = [], 0

        def rows():
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for s in _sequences(batches, seed):
            s = np.where(_in(words, s), s, 0)
            both = np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))
            waiting.append(_pair_number(s[both], s[both + 1]))
            size += len(both)
            if size >= held:
                yield rows()
                waiting, size = [], 0
        if size:
            yield rows()

    return map_arrow(_rows(documents), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _occurrences(documents: DataFrame, seed: int, words: np.ndarray | None, pairs: np.ndarray | None, held: int = 1 << 18) -> DataFrame:
    """(w1..w5, n): every place where a frequent pair begins, with the words that follow while neighbours stay frequent
    (0 beyond). A task adds up equal ones, `held` places at a time, so that a line repeated everywhere is one row a task."""

    def run(batches):
        waiting, size = [], 0

        def rows():
            c = np.concatenate(waiting)
            c = c[np.lexsort(c.T[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]).any(1)]))
            n = np.diff(np.concatenate([first, [len(c)]]))
            return pa.RecordBatch.from_arrays([*(pa.array(c[first, i]) for i in range(WORDS)), pa.array(n.astype(np.int64))], names=[*_columns(), "n"])

        for s in _sequences(batches, seed):
            s = np.concatenate([np.where(_in(words, s), s, 0), np.zeros(WORDS, dtype=np.int64)])
            linked = np.zeros(len(s), dtype=bool)
            both = np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))
            linked[both] = _in(pairs, _pair_number(s[both], s[both + 1]))
            at = np.flatnonzero(linked)
            c, on = np.zeros((len(at), WORDS), dtype=np.int64), np.ones(len(at), dtype=bool)
            c[:, 0] = s[at]
            for i in range(1, WORDS):
                on &= linked[at + i - 1]
                c[on, i] = s[at[on] + i]
            waiting.append(c)
            size += len(at)
            if size >= held:
                yield rows()
                waiting, size = [], 0
        if size:
            yield rows()

    return map_arrow(_rows(documents), run, ", ".join(f"{c} long" for c in _columns()) + ", n long")


def _columns() -> list[str]:
    return [f"w{i}" for i in range(1, WORDS + 1)]


def _grow(c: np.ndarray, n: np.ndarray, least: int) -> list[tuple[list[int], int]]:
    """Frequent phrases of two words or more in sorted occurrences, right extensions depth first.

    The occurrences of a prefix are a run of rows, and those of its extensions are runs within it. A run that touches the
    first or the last row may go on outside, so its count is part of one and is given whatever it is.
    """
    out: list[tuple[list[int], int]] = []
    total = np.concatenate([[0], np.cumsum(n)])

    def extend(lo: int, hi: int, depth: int) -> None:
        column = c[lo:hi, depth]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + lo + 1
        starts, ends = np.concatenate([[lo], cuts]), np.concatenate([cuts, [hi]])
        counts = total[ends] - total[starts]
        keep = (c[starts, depth] != 0) & ((counts >= least) | (starts == 0) | (ends == len(c)))
        for a, b, m in zip(starts[keep].tolist(), ends[keep].tolist(), counts[keep].tolist(), strict=True):
            if depth:
                out.append((c[a, : depth + 1].tolist(), m))
            if depth + 1 < WORDS:
                extend(a, b, depth + 1)

    if len(c):
        extend(0, len(c), 0)
    return out


def frequent_phrases(documents: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """phrases (ids, a) of one to five words with a >= least, words (lang, word, n, id) with n >= least, totals (lang, n).

    Words have 64-bit numbers that tell a language's frequent words from all its other words and all other languages';
    the words counted prove it, and where it does not hold another numbering is taken. Occurrences of prefixes are
    sorted by range of prefixes; a task grows those of its range, so that a prefix with a third of all occurrences is shared
    by many tasks, and the few phrases that cross a border of tasks have their parts added up.
    """
    counted = table(_word_counts(documents), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    for seed in range(64):
        numbered = counted.withColumn("id", word_number(seed))
        clash = numbered.groupBy("id").agg(F.count("*").alias("m"), F.max("n").alias("most")).filter(((F.col("m") > 1) & (F.col("most") >= least)) | (F.col("id") == 0))
        if clash.isEmpty():
            break
    else:
        raise ValueError("no numbering tells the words apart")
    words = table(numbered.filter(F.col("n") >= least), "frequent")
    word_bits = _bits(words, "id", words.count())
    pairs = table(_frequent_pairs(documents, seed, word_bits, least), "pairs")
    pair_bits = _bits(pairs, "pair", pairs.count())
    places = table(_occurrences(documents, seed, word_bits, pair_bits), "places")

    def run(batches):
        waiting, size = [], 0

        def rows():
            t = pa.Table.from_batches(waiting)
            c = np.stack([t.column(i).to_numpy() for i in range(WORDS)], axis=1)
            found = _grow(c, t.column(WORDS).to_numpy(), least)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())], names=["ids", "a"])

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                yield rows()
                waiting, size = [], 0
        if size:
            yield rows()

    dealt = places.repartitionByRange(*_columns()).sortWithinPartitions(*_columns())
    grown = map_arrow(dealt, run, "ids array<long>, a long").groupBy("ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return table(grown.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a"))), "phrases"), words, totals


@tidy
def collocations(documents: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The best phrases of each language by the score of their weakest cut.

    A phrase is two to five words in a row within a piece, at least `least` times in its language. For a cut after its
    first k words, with the counts l and r of both parts and the n words of the language, the score is
    floor(1000 * a * n / (l * r)); the lowest counts, of equals that of the smallest k. A phrase within a longer one that
    is as frequent is left out. Counts are exact, and products are decimals of 38 digits.

    Returns lang, rank, phrase, a, l, r, n, score for the first `top` of each language, by score and a descending, then
    phrase. Rows count each, whatever their id; a null language is `und`, a null text is empty, and other columns of the
    input are left out. Languages without such a phrase have no row; an empty table gives an empty result.
    """
    phrases, words, totals = frequent_phrases(documents, least)
    size = F.size("ids")
    longer = phrases.filter(size > 2).select("a", F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"))
    kept = phrases.filter(size > 1).join(longer, ["ids", "a"], "left_anti")  # one word more suffices: counts between are equal too
    parts = [phrases.select(F.col("ids").alias(side), F.col("a").alias(n)) for side, n in (("left", "l"), ("right", "r"))]
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    cuts = cuts.join(parts[0], "left").join(parts[1], "right")
    cuts = cuts.withColumn("id", F.get("ids", F.lit(0))).join(words.select("id", "lang"), "id").join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("n")).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a")]
    first = scored.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= top)
    spelled = first.select("*", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id")
    named = spelled.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    return named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
