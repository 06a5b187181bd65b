"""How far the sources of a language lie apart in the terms they use."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, slices, table, tidy

#: Letters A-Z lower-cased and all that is not ASCII, on UTF-8 bytes that `bytes.lower` has been over.
_terms = re.compile(rb"[a-z\x80-\xff]+").findall
#: Terms of a block and groups of a side, on average: a tile of int64 holds 2 MB.
BLOCK, SIDE = 2048, 128
SCALE = 10**9


def _counts(documents: DataFrame, held: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents. A task adds up what it meets, `held` entries at a time."""
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches):
        seen: dict[tuple, tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, docs) in seen.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.array([v] * len(n), pa.string()) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, n)), pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                found = _terms(text.encode().lower())
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in seen.values()) > held:
                yield from out()
                seen.clear()
        yield from out()

    counted = map_arrow(rows, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly: long division by three digits at a time stays within
    64 bits up to 9 * 10^15 occurrences."""
    rest, under, out = count.astype(np.int64) + 5, total.astype(np.int64) + 5 * terms.astype(np.int64), np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // under
        rest = rest % under
    return out + 1


@tidy
def divergence(documents: DataFrame, least_docs: int = 30, top: int = 50, block_terms: int = BLOCK, side_groups: int = SIDE) -> DataFrame:
    """Per (lang, source): its distance to each other source of the language, and the terms it uses more than the language.

    A language keeps the V terms found in at least `least_docs` of its documents. A group (a source, or the language as a
    whole) has for each of them the share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N the group's occurrences of
    kept terms. Part `pair`: each other source of the language, with the sum of the differences of both shares over all
    kept terms (0 without any), at every rank. Part `term`: kept terms that occur in the group and have a greater share
    there than in the language, with the difference, at ranks up to `top`.

    Kept terms are dealt to blocks and groups to sides, so that a task holds dense tiles of groups by terms of bounded
    size, subtracts all pairs of its two sides at once, and gives one partial sum for each pair and the best terms of
    each group; partial sums are added, and the best of the blocks merged. The hot source is one row of a tile.

    Returns lang, source, part, item, value, rank: rank from 1 by value descending, then item by bytes. Rows count each,
    whatever their id; null text, lang and source are ''. Groups whose documents have no term take part. Other columns of
    the input are left out. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    counted = table(_counts(documents), "counts")
    per_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= least_docs)
    kept = table(per_term.select("lang", "term", "n"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    here = counted.join(kept.select("lang", "term"), ["lang", "term"])
    totals = here.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = found.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    many = found.groupBy("lang").agg(F.count("*").alias("g"))
    groups = groups.join(many, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.ceil(F.col("g") / side_groups).alias("sides"),
    )
    side = F.pmod(F.xxhash64(F.lit("side"), "source"), F.col("sides"))
    groups = table(groups.withColumn("side", side).withColumn("blocks", F.ceil(F.col("v") / block_terms)), "groups")

    # every group goes to each block of its language, and as a column or a row to each side's tiles
    facing = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1), lambda o: F.struct(F.least("side", o).alias("a"), F.greatest("side", o).alias("b"))))
    tile = lambda df: df.select("*", facing.alias("t")).select("*", "t.a", "t.b").drop("t")
    whole = kept.join(langs, "lang").join(many.select("lang", F.ceil(F.col("g") / side_groups).alias("sides")), "lang").withColumn("blocks", F.ceil(F.col("v") / block_terms))
    block = F.pmod(F.xxhash64(F.lit("block"), "term"), F.col("blocks"))
    empty = F.lit(None).cast("string")
    alone = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    members = tile(groups.filter("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))).select(
        "lang", "block", "a", "b", "source", "side", empty.alias("term"), F.lit(0).cast("long").alias("n"), "total", "v"
    )
    cells = tile(here.join(groups.select("lang", "source", "side", "sides", "blocks"), ["lang", "source"]).withColumn("block", block)).select(
        "lang", "block", "a", "b", "source", "side", "term", "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("v")
    )
    # the language's own counts go to every tile, so that each has all terms of its block; they have no side
    lone = whole.withColumn("block", block).withColumn("a", alone).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("sides") - 1))).select("lang", "block", "a", "b", empty.alias("source"), F.lit(-1).cast("long").alias("side"), "term", "n", "total", "v")

    def run(_, rows):
        lang, a, b = (rows.column(c)[0].as_py() for c in ("lang", "a", "b"))
        sides = rows.column("side").to_numpy()
        is_cell = rows.column("term").is_valid().to_numpy()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        vocabulary = terms.dictionary
        at_term = np.where(is_cell, terms.indices.fill_null(0).to_numpy(zero_copy_only=False), 0)
        names = rows.column("source").combine_chunks()
        n, total, v = (rows.column(c).to_numpy() for c in ("n", "total", "v"))

        def tile_of(own: int):
            """Names, counts and shares of the groups of a side."""
            mine = np.flatnonzero(sides == own)
            coded = names.take(pa.array(mine)).dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            counts, totals_, size = np.zeros((len(coded.dictionary), len(vocabulary)), dtype=np.int64), np.zeros(len(coded.dictionary), dtype=np.int64), int(v.max())
            cell = is_cell[mine]
            counts[at[cell], at_term[mine[cell]]] = n[mine[cell]]
            totals_[at[~cell]] = total[mine[~cell]]
            return coded.dictionary, counts, share(counts, totals_[:, None], np.array([[size]]))

        parts = []
        if len(vocabulary):
            left, counts, p = tile_of(a)
            right, _, q = (left, counts, p) if a == b else tile_of(b)
            apart = np.stack([np.abs(p[i] - q).sum(1) for i in range(len(left))])
            i, j = np.nonzero(np.ones_like(apart, dtype=bool) if a != b else ~np.eye(len(left), dtype=bool))
            parts.append((left.take(pa.array(i)), "pair", right.take(pa.array(j)), apart[i, j]))
            if a != b:
                parts.append((right.take(pa.array(j)), "pair", left.take(pa.array(i)), apart[i, j]))
            else:
                own = np.flatnonzero(sides == -1)
                of_lang = np.zeros(len(vocabulary), dtype=np.int64)
                of_lang[at_term[own]] = n[own]
                more = np.where(counts > 0, p - share(of_lang, total[own].max(), v[own].max()), 0)
                for g in range(len(left)):
                    least = np.partition(more[g], -top)[-top] if more.shape[1] > top else 0
                    best = np.flatnonzero((more[g] > 0) & (more[g] >= least))  # with all ties of the last
                    parts.append((pa.array([left[g].as_py()] * len(best), pa.string()), "term", vocabulary.take(pa.array(best)), more[g][best]))
        made = [pa.table({"lang": pa.array([lang] * len(x), pa.string()), "source": s, "part": pa.array([kind] * len(x), pa.string()), "item": t, "value": pa.array(x)}) for s, kind, t, x in parts]
        return pa.concat_tables(made) if made else pa.table({**{c: pa.array([], pa.string()) for c in ("lang", "source", "part", "item")}, "value": pa.array([], pa.int64())})

    from tessera.plans.ship import ship_package

    ship_package(spark)
    tiles = members.unionByName(cells).unionByName(lone).groupBy("lang", "block", "a", "b").applyInArrow(run, "lang string, source string, part string, item string, value long")
    tiles = table(tiles, "tiles")
    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    flat = groups.filter("v = 0").select("lang", "source")
    nothing = flat.join(flat.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs.unionByName(nothing)).unionByName(ranked(tiles.filter("part = 'term'")).filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
