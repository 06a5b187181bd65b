"""Repeated passages by unit hashing: sentences and lines, global digests, earliest occurrence kept."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, packed, slices, table, text_key, texts, tidy, unpacked
from .spans import replaced

_END = re.compile(r"[.!?]+(?=\s)|\Z")
_UNITS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("idx", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("again", pa.bool_())])
_UNIT_DDL = "d1 long, d2 long, doc_id long, text_id long, idx int, start int, stop int, words int, again boolean"
_SPANS = "array<struct<start:int,stop:int,words:int>>"
#: The rank of rows without an id.
_LAST = (1 << 63) - 1
#: Digests with more than one in this many units are joined back by broadcast; there are at most as many.
HOT = 10_000


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, stop, words) of each unit with a word: the sentences of every line, lines without a mark whole.

    Offsets are code points of the original text, without the white space around a unit.
    """
    found, at = [], 0
    for line in text.split("\n"):
        begin = 0
        for m in _END.finditer(line):
            part = line[begin : m.end()]
            words = part.split()
            if words:
                lead = len(part) - len(part.lstrip())
                found.append((at + begin + lead, at + begin + len(part.rstrip()), words))
            begin = m.end()
        at += len(line) + 1
    return found


def runs(marked: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, stop, words) of stretches of neighbouring repeated units with at least `least` words together."""
    out: list[list[int]] = []
    last = None
    for idx, start, stop, words in sorted(marked):
        if last is not None and idx == last + 1:
            out[-1][1] = stop
            out[-1][2] += words
        else:
            out.append([start, stop, words])
        last = idx
    return [(a, b, n) for a, b, n in out if n >= least]


@tidy
def repeated_spans(documents: DataFrame, min_words: int = 1) -> DataFrame:
    """Passages that stand earlier in the corpus, by unit hashing.

    Every text is cut into units (sentences within lines). A unit is normalised (lower case, single spaces) and
    hashed to 128 bits; digests are grouped over the whole corpus, the earliest occurrence by (doc_id, text_id, position)
    is kept and every other one goes, of whatever length and number. Neighbouring later occurrences are joined to one span;
    `min_words` above 1 leaves spans of fewer words where they stand. Offsets of the original text are kept.

    Texts are cut and hashed once, and the units written. Digests are counted and their least rank found before the
    shuffle, so a unit of any frequency is one row a task. Digests with more than one in HOT units, of which there are at most
    HOT, are joined back by broadcast where their units lie; others, if they occur twice, by a shuffle.

    Returns doc_id, text_id (a hash that tells texts apart that share an id), n_units, n_repeated (units that stand
    earlier), spans (start, stop, words): one row for each input row. Null and empty texts have no units. Rows that repeat
    an id with the same text are one text; with different texts, the one of lesser text_id is the earlier. Null ids rank
    last. Other columns are left out; an empty table gives an empty result.
    """

    def cut(batches):
        for batch in slices(batches):
            rows = []
            for doc, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "text")), strict=True):
                seen, found = set(), units(text)
                rows.append((None, None, doc, own, len(found), None, None, None, None))
                doc = _LAST if doc is None else doc
                for i, (start, stop, words) in enumerate(found):
                    d = xxhash.xxh3_128_intdigest(" ".join(words).lower().encode())
                    rows.append(((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), doc, own, i, start, stop, len(words), d in seen))
                    seen.add(d)
            columns = zip(*rows, strict=True) if rows else [[] for _ in _UNITS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNITS, strict=True)], schema=_UNITS)

    read = table(map_arrow(texts(documents, text_key().alias("text_id")), cut, _UNIT_DDL), "units")
    heads = read.filter("d1 is null").select("doc_id", "text_id", F.col("idx").cast("long").alias("n_units"))
    every = read.filter("d1 is not null")
    first = table(every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "first")
    total = heads.agg(F.sum("n_units")).first()[0] or 0
    often = F.col("n") * HOT > F.lit(total)
    hot, rare = first.filter(often).drop("n"), first.filter(~often).drop("n")
    joined = every.join(F.broadcast(hot), ["d1", "d2"]).unionByName(every.join(F.broadcast(hot), ["d1", "d2"], "left_anti").join(rare, ["d1", "d2"]))  # hot has at most HOT rows
    # texts that share an id: the least of those that hold the unit is the first
    sharing = table(heads.groupBy(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id")).agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).filter("a <> b").select("doc_id"), "sharing")
    later = (F.col("doc_id") != F.col("first")) | F.col("again")
    if not sharing.isEmpty():
        least = every.join(sharing, "doc_id", "left_semi").groupBy("d1", "d2", "doc_id").agg(F.min("text_id").alias("least"))
        joined = joined.join(least, ["d1", "d2", "doc_id"], "left")
        later = later | F.coalesce(F.col("text_id") != F.col("least"), F.lit(False))
    by_text = joined.filter(later).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("idx", "start", "stop", "words")).alias("marked"))

    def join_up(batches):
        for batch in batches:
            marked = [[(m["idx"], m["start"], m["stop"], m["words"]) for m in ms] for ms in batch.column("marked").to_pylist()]
            spans = [[{"start": a, "stop": b, "words": n} for a, b, n in runs(ms, min_words)] for ms in marked]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array([len(m) for m in marked], pa.int64()), pa.array(spans, kind)], names=["s_doc", "s_text", "n_repeated", "spans"])

    spans = map_arrow(by_text, join_up, f"s_doc long, s_text long, n_repeated long, spans {_SPANS}")
    return heads.join(spans, (F.coalesce(heads.doc_id, F.lit(_LAST)) == F.col("s_doc")) & (F.col("text_id") == F.col("s_text")), "left").select(
        "doc_id", "text_id", "n_units", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )


def span_digest(found: DataFrame, passage: int = 20) -> DataFrame:
    """doc_id, counts, removed_chars, the removed spans written as start:stop, and how many have `passage` words or more."""
    return found.select(
        "doc_id", "n_units", "n_repeated", F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("removed_chars"),
        F.size(F.filter("spans", lambda s: s["words"] >= passage)).cast("long").alias("n_passages"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"),
    )


@tidy
def remove_repeats(documents: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents with their repeated passages cut out of `text`; all columns stay, an emptied text is empty.

    Spans are found again by id and text, so that of rows that share an id each loses its own passages only.
    """
    spans = repeated_spans(documents, min_words).filter(F.size("spans") > 0)
    found = spans.select(F.col("doc_id").alias("s_id"), F.col("text_id").alias("s_key"), "spans").dropDuplicates(["s_id", "s_key"])
    joined = packed(documents).join(found, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(replaced(F.col("row.text"), F.col("spans"), lambda s: F.lit("")))
    return unpacked(joined, documents, text)
