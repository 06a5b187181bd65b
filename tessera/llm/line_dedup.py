"""Near-duplicate lines by a deletion-neighbourhood join, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, may_hold, packed, table, text_key, tidy, unpacked

#: White space that needs tidying before words can be split at single spaces.
_UNTIDY = ("\t", "\x0b", "\f", "\r", "  ", "\n ", " \n")


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """(doc, line, own, w): a hash of the text, and the 64-bit hashes of the lower-cased words of every line with at least `min_words` words."""
    raw = F.col("text").cast("string")
    text = F.lower(raw)
    tidy = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r"(?md)^\x20|\x20$", "")
    untidy = raw.startswith(" ") | raw.endswith(" ")
    for part in _UNTIDY:
        untidy = untidy | raw.contains(part)
    clean = F.when(untidy, tidy).otherwise(text)
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc"), text_key().alias("own"), F.posexplode(F.split(clean, "\n", -1)).alias("line", "raw"))
        .filter("doc is not null and raw <> ''")
        .filter(F.length("raw") - F.length(F.replace("raw", F.lit(" "), F.lit(""))) + 1 >= min_words)
        .select("doc", "line", "own", F.transform(F.split("raw", " "), lambda w: F.xxhash64(w)).alias("w"))
    )


def _digest(w: Column) -> list[Column]:
    return [F.xxhash64(w).alias("d0"), F.xxhash64(F.lit("second"), w).alias("d1")]


def _bound(n: Column, i: int, blocks: int) -> Column:
    """Where block i of a line of n words begins."""
    return F.expr("0") if i == 0 else n if i == blocks else F.floor(n * i / blocks).cast("int")


def _keys(w: Column, n: Column, blocks: int) -> list[tuple[Column, int, Column, Column]]:
    """The line with each of its blocks deleted, as hashed keys: (key, less, first word of the block, its words).

    The grid of blocks is that of a line of m words, m being this line's length or, with `less` 1, one less. In the
    latter the deleted block is one word longer, so that a line and the same line with a word put in share the key.
    """
    def block(m: Column, i: int, shift: int) -> Column:
        return F.xxhash64(F.slice(w, _bound(m, i, blocks) + 1 + shift, _bound(m, i + 1, blocks) - _bound(m, i, blocks)))

    out = []
    for less in (0, 1):
        m = n - less
        left, right = [block(m, i, 0) for i in range(blocks)], [block(m, i, less) for i in range(blocks)]
        for i in range(blocks):
            key = F.xxhash64(F.lit(i), m, *left[:i], *right[i + 1 :])
            out.append((key, less, _bound(m, i, blocks) + 1, _bound(m, i + 1, blocks) - _bound(m, i, blocks) + less))
    return out


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word sequences are at edit distance 1 at most: what they share in front and behind covers the longer
    but for one word."""
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False) - 1
    front, back = same(a, b), same(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) < 2) & ((front < 0) | (front + back >= F.greatest(F.size(a), F.size(b)) - 1))


def _near(documents: DataFrame, distinct: DataFrame, min_words: int, blocks: int) -> DataFrame:
    """(d0, d1, near): distinct lines with the place of an earlier line at edit distance 1."""
    slim = distinct.select("d0", F.explode("keys").alias("key"))
    open_keys = table(slim.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    hits = may_hold(slim, "key", open_keys, "key").join(open_keys, "key").groupBy("d0").agg(F.collect_set("key").alias("open"))
    wanted = table(hits.join(distinct.select("d0", "d1", "place"), "d0").select("d0", "d1", "place.*", "open"), "wanted")
    texts = may_hold(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted, "doc")
    words = _lines(texts, min_words).drop("own").join(wanted, ["doc", "line"])
    # of rows that share a doc_id, the line whose digests were grouped
    held = table(words.filter((F.xxhash64("w") == F.col("d0")) & (F.xxhash64(F.lit("second"), "w") == F.col("d1"))).dropDuplicates(["d0", "d1"]), "held")
    drop_table(wanted)
    named = [F.struct(key.alias("key"), F.lit(less).alias("less"), F.struct(at.alias("at"), size.alias("len")).alias("cut")) for key, less, at, size in _keys(F.col("w"), F.size("w"), blocks)]
    keys = F.filter(F.array(*named), lambda k: F.array_contains("open", k["key"]))
    each = held.select("d0", "d1", F.struct("doc", "line", "own").alias("place"), "w", F.explode(keys).alias("k")).select("d0", "d1", "place", "w", "k.*")
    inner = F.slice("w", F.col("cut.at"), F.col("cut.len"))
    without = F.transform(F.sequence(F.lit(1), F.size(inner)), lambda i: F.struct(i.alias("i"), F.slice(inner, F.lit(1), i - 1).alias("front"), F.slice(inner, i + 1, F.size(inner)).alias("back")))
    variant = lambda kind, longer, *parts: F.struct(F.lit(kind).alias("kind"), F.lit(longer).alias("longer"), F.xxhash64("key", F.lit(kind), *parts).alias("key"))
    # hashing two arrays in turn is hashing them joined
    # a word changed: the same place deleted in both; a word put in: one line as it is, the other less that word
    own = F.concat(F.transform(without, lambda v: variant("changed", False, v["i"], v["front"], v["back"])), F.array(variant("put in", False, inner)))
    less = F.transform(without, lambda v: variant("put in", True, v["front"], v["back"]))
    variants = table(each.select("d0", "d1", "place", F.explode(F.when(F.col("less") == 0, own).otherwise(less)).alias("v")).select("d0", "d1", "place", "v.*"), "variants", "snappy")
    least = variants.groupBy("key", "kind", "longer").agg(F.min(F.struct("place", "d0", "d1")).alias("least"), F.min("d0").alias("lo"), F.max("d0").alias("hi"))
    changed = least.filter("kind = 'changed' and lo <> hi").select("key", F.lit(False).alias("longer"), "least")
    put_in = least.filter("kind = 'put in'").select("key", (~F.col("longer")).alias("longer"), "least")
    # each line looks for the least line under its key, and of a word put in, on the other side
    earlier = variants.join(changed.unionByName(put_in), ["key", "longer"]).filter(F.col("least.place") < F.col("place"))
    best = earlier.groupBy("d0", "d1").agg(F.min("least").alias("least")).select("d0", "d1", F.col("least.place").alias("near"), F.col("least.d0").alias("e0"), F.col("least.d1").alias("e1"))
    a, b = held.select("d0", "d1", F.col("w").alias("w_a")), held.select(F.col("d0").alias("e0"), F.col("d1").alias("e1"), F.col("w").alias("w_b"))
    return best.join(a, ["d0", "d1"]).join(b, ["e0", "e1"]).filter(_within_one(F.col("w_a"), F.col("w_b"))).select("d0", "d1", "near")


@tidy
def repeated_lines(documents: DataFrame, min_words: int = 5, max_edits: int = 1, blocks: int = 3, exact_words: int | None = None) -> DataFrame:
    """Lines that repeat an earlier line of the corpus up to `max_edits` (0 or 1) words put in, left out or changed.

    Lines are compared by their lower-cased words (by 64-bit hashes of them); lines of fewer than `exact_words`
    words (by default `min_words`) are left alone, and those of fewer than `min_words` are only held against equal ones. Equal lines are grouped by 128-bit digests first, each group with its earliest place (doc_id, line). Distinct lines then go
    through the deletion neighbourhood in two steps. First each emits its variants with one of `blocks` blocks of
    words deleted, as hashed keys; a line within one edit of another shares the key of the block that holds the edit.
    Only under keys with two different lines
    are the block's own one-word deletions emitted, again as hashed keys, under which all lines are one edit apart.
    The edit distance of each line to the earliest line found this way is verified word by word. A line is repeated
    if a line within the bound stands earlier, whether or not that one is itself repeated.

    Keys are only ever grouped by sums and minima, so a key under which a third of all lines fall is one row a task;
    no pairs are formed within a group. Only digests and keys are shuffled, and the words of lines that share a key.

    Returns doc_id, text_id (a hash of the whole text), line (from 0), near (whether the earlier line differs), of_doc,
    of_line: one row for each repeated line of each document. Null texts and rows with a null doc_id have none. Rows that
    repeat a doc_id with the same text are one document; with different texts, the lines of one number rank by text_id.
    Other columns are left out; an empty table gives an empty result.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    if min_words <= blocks:
        raise ValueError("a line of min_words words must have more words than blocks")
    place = F.struct("doc", "line", "own")
    floor = min_words if exact_words is None else min(exact_words, min_words)
    hashed = F.array(*[k[0] for k in _keys(F.col("w"), F.size("w"), blocks)]) if max_edits else F.array().cast("array<long>")
    if floor < min_words:  # cut, not chosen by a condition, so that the keys' common parts are still computed once
        hashed = F.slice(hashed, F.lit(1), F.when(F.size("w") >= min_words, 2 * blocks).otherwise(0))
    lines = table(_lines(documents, floor).select("doc", "line", "own", *_digest(F.col("w")), hashed.alias("keys")), "lines", "snappy")
    distinct = table(lines.groupBy("d0", "d1").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("keys").alias("keys")), "distinct", "snappy")
    exact = distinct.filter("n > 1").select("d0", "d1", F.col("place").alias("first"))
    if max_edits:
        decided = exact.join(_near(documents, distinct, min_words, blocks), ["d0", "d1"], "full_outer")
    else:
        decided = exact.withColumn("near", F.lit(None).cast("struct<doc:bigint,line:int,own:bigint>"))
    found = lines.select("doc", "line", "own", "d0", "d1").join(table(decided, "decided"), ["d0", "d1"])
    earlier = F.when(F.col("near").isNotNull(), F.col("near")).when(F.col("first") < place, F.col("first"))
    return found.withColumn("of", earlier).filter("of is not null").select(
        F.col("doc").alias("doc_id"), F.col("own").alias("text_id"), "line", F.col("near").isNotNull().alias("near"), F.col("of.doc").alias("of_doc"), F.col("of.line").alias("of_line")
    )


def by_document(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_near, removed_lines (ascending, comma-joined): one row for each document row."""
    removed = repeated.groupBy(F.col("doc_id").alias("r_doc"), F.col("text_id").alias("r_text")).agg(
        F.array_sort(F.collect_set("line")).alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("n_near")
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_id"))
    return docs.join(removed, (F.col("doc_id") == F.col("r_doc")) & (F.col("text_id") == F.col("r_text")), "left").select(
        "doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines")
    )


def remove_lines(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """The documents without their repeated lines; all columns stay. A document all of whose lines with words are
    repeated, being a copy of earlier ones, goes; one without any repeated line stays as it is. Lines are found again by id
    and text, so that of rows that share an id each loses its own lines only."""
    removed = repeated.groupBy(F.col("doc_id").alias("id"), F.col("text_id").alias("key")).agg(F.collect_set("line").alias("gone"))
    joined = packed(documents).join(removed, ["id", "key"], "left")
    rest = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = joined.withColumn("rest", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(rest))
    return unpacked(out.filter(F.col("gone").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]")), documents, F.col("rest"))
