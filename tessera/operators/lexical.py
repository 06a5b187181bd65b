"""BM25 over an inverted index held as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stem import porter, stem_lists
from tessera.functions.text import ascii_tokens, phrases, without_words
from tessera.operators.vectors import top_k
from tessera.plans.scratch import fresh, kept
from tessera.plans.ship import batches_of, ship_package


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.5
    b: float = 0.75
    k3: float = 1.2
    phrase_boost: float = 1.5
    stopwords: tuple[str, ...] = ()
    stemming: bool = False
    extended_stemmer: bool = False
    synonym_weight: float = 0.3
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)


def english_stopwords() -> tuple[str, ...]:
    """Spark's own English list."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def tokenize(texts: DataFrame, key: str, text: str, config: LexicalConfig) -> DataFrame:
    """(key, toks): tokens without stop words, stemmed on demand."""
    toks = texts.select(key, without_words(ascii_tokens(F.coalesce(F.col(text), F.lit(""))), list(config.stopwords)).alias("toks"))
    return stem_lists(toks, "toks", config.extended_stemmer) if config.stemming else toks


#: Distinct query terms up to which postings are filtered by a broadcast of them.
TERM_BLOCK = 100_000
#: Postings of a block on average, levels of impact that a term's postings are told apart by, and the number of postings
#: of all query terms from which on a search prunes by blocks.
BLOCK, LEVELS, PRUNE_FROM = 256, 16, 20_000_000
#: Where an index is written: tokens that a task groups at a time, postings of a row at most, and how many tasks rows of
#: SALT_FROM postings and more are dealt to.
GROUP, PIECE, SALTS, SALT_FROM = 1_000_000, 1024, 16, 64


@dataclass
class LexicalIndex:
    """postings(term, chunk_id, tf, dl, at: places of the term), doc_stats(chunk_id, dl, toks), term_stats(term, df),
    corpus(n_docs, avgdl; of a written index the k1 and b that its peaks hold for, too).

    A written index holds its postings in blocks of like impact: blocks(term, level, slice, n, peak, and arrays of the rest), where a
    task numbers the blocks that it cuts from a term's postings of one level, and levels(term, level, slices, n, peak), peak being the
    greatest impact there. Peaks hold for the k1, b and average length that the index was written with.
    """

    config: LexicalConfig
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    blocks: DataFrame | None = None
    levels: DataFrame | None = None

    def save(self, path: str) -> None:
        """Tokens first, so that texts are split once; then blocks, of which all other tables are sums or views.

        A task groups what it meets by term before anything is shuffled, in rows of PIECE postings at most. Rows are dealt by term, long
        ones over SALTS tasks, so that a term of every chunk spreads over many; levels are told apart and blocks cut where rows arrive.
        """
        spark, c = self.postings.sparkSession, self.config
        ship_package(spark)
        compact = lambda df: df.write.mode("overwrite").option("compression", "zstd")
        compact(self.doc_stats).option("parquet.block.size", 8 << 20).parquet(f"{path}/doc_stats")  # so that one file is read by several tasks
        tokens = spark.read.parquet(f"{path}/doc_stats")
        compact(_corpus(c, tokens).select("*", F.lit(c.k1).alias("k1"), F.lit(c.b).alias("b"))).parquet(f"{path}/corpus")
        avgdl = spark.read.parquet(f"{path}/corpus").first()["avgdl"] or 1.0
        ids = dict(tokens.dtypes)["chunk_id"]
        lists = f"chunk_id array<{ids}>, tf array<int>, dl array<int>, at array<array<int>>"

        def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            """Integers of 32 bits as they lie in memory, cut into rows: these cross from Python to Spark and back as they are."""
            offsets = np.concatenate([[0], ends]).astype(np.int32) * 4
            return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, dtype=np.int32))])

        def integers(column: pa.Array) -> np.ndarray:
            offsets, data = np.frombuffer(column.buffers()[1], dtype=np.int32), column.buffers()[2]
            held = np.frombuffer(data, dtype=np.int32, count=data.size // 4)
            return held[offsets[column.offset] // 4 : offsets[column.offset + len(column)] // 4]

        def gathered(batches):
            """Batches put together up to GROUP tokens, which bound what a worker sorts."""
            held, size = [], 0
            for batch in batches:
                n = pc.sum(batch.column("dl")).as_py() or 0
                if held and size + n > GROUP:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
                if batch.num_rows:
                    held.append(batch)
                    size += n
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        def grouped(batches):
            for batch in gathered(batches):
                n = batch.num_rows
                lengths = pc.list_value_length(batch.column("toks")).to_numpy()
                if not lengths.sum():
                    continue
                doc = np.repeat(np.arange(n), lengths)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                words = batch.column("toks").flatten().dictionary_encode()
                keys = words.indices.to_numpy().astype(np.int64) * n + doc
                order = np.argsort(keys, kind="stable")  # by term, then chunk; places ascend
                keys = keys[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                tf, term, row = np.diff(np.concatenate([first, [len(keys)]])), keys[first] // n, keys[first] % n
                within = np.arange(len(term)) - np.searchsorted(term, term)
                begins = np.flatnonzero(within % PIECE == 0)  # a row's size is bounded, however frequent its term is
                ends = np.append(begins[1:], len(term))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), batch.column("chunk_id").take(pa.array(row)))
                both = np.stack([tf, batch.column("dl").to_numpy()[row]], axis=1).ravel()
                made = [words.dictionary.take(pa.array(term[begins])), lists, binary(both, 2 * ends), binary(place[order], np.cumsum(tf)[ends - 1])]
                yield pa.RecordBatch.from_arrays(made, names=["term", "chunk_id", "sizes", "places"])

        def blocks(batches):
            key, after = None, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, sizes = batch.column("chunk_id"), integers(batch.column("sizes"))
                names = batch.column("term")
                coded = names.dictionary_encode().indices.to_numpy()
                first = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]]))  # rows are sorted by term
                run = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
                term = np.repeat(run, pc.list_value_length(ids).to_numpy())
                tf, dl = sizes[0::2].astype(np.int64), sizes[1::2]
                impact = tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * dl / avgdl))
                level = np.minimum(LEVELS - 1, (impact / (c.k1 + 1) * LEVELS).astype(np.int64))
                dealt = np.lexsort((level, term))
                term, level, impact = term[dealt], level[dealt], impact[dealt]
                both = term * LEVELS + level
                within = np.arange(len(both)) - np.searchsorted(both, both)
                begins = np.flatnonzero(within % BLOCK == 0)
                no, offsets = within[begins] // BLOCK, pa.array(np.append(begins, len(both)).astype(np.int32))
                mine, levels = term[begins], level[begins]
                if names[0].as_py() == key:
                    no[mine == 0] += np.array([after.get(x, 0) for x in levels[mine == 0].tolist()], dtype=np.int64)
                last = mine == len(first) - 1
                after = {**(after if len(first) == 1 and names[0].as_py() == key else {}), **dict(zip(levels[last].tolist(), (no[last] + 1).tolist(), strict=True))}
                key = names[-1].as_py()
                at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)), pa.array(integers(batch.column("places"))))
                told = [names.take(pa.array(first[mine])), pa.array(levels.astype(np.int32)), pa.array(no), pa.array(np.diff(np.append(begins, len(both)))), pa.array(np.maximum.reduceat(impact, begins))]
                values = [ids.flatten().take(pa.array(dealt)), pa.array(tf[dealt].astype(np.int32)), pa.array(dl[dealt]), at.take(pa.array(dealt))]
                yield pa.RecordBatch.from_arrays([*told, *(pa.ListArray.from_arrays(offsets, v) for v in values)], names=["term", "level", "slice", "n", "peak", "chunk_id", "tf", "dl", "at"])

        dealt = tokens.mapInArrow(grouped, f"term string, chunk_id array<{ids}>, sizes binary, places binary")
        salt = F.when(F.size("chunk_id") < SALT_FROM, 0).otherwise(F.pmod(F.xxhash64("sizes"), F.lit(SALTS)))
        dealt = dealt.repartition("term", salt).sortWithinPartitions("term")
        cut = dealt.mapInArrow(blocks, f"term string, level int, slice long, n long, peak double, {lists}")
        with batches_of(spark, 5000, 8 << 20):
            compact(cut).parquet(f"{path}/blocks")
        written = spark.read.parquet(f"{path}/blocks")
        levels = written.groupBy("term", "level").agg((F.max("slice") + 1).alias("slices"), F.sum("n").alias("n"), F.max("peak").alias("peak"))
        compact(levels).parquet(f"{path}/levels")
        compact(spark.read.parquet(f"{path}/levels").groupBy("term").agg(F.sum("n").alias("df"))).parquet(f"{path}/term_stats")

    @classmethod
    def load(cls, spark, path: str, config: LexicalConfig | None = None) -> LexicalIndex:
        doc_stats, term_stats, corpus, blocks, levels = (spark.read.parquet(f"{path}/{n}") for n in ("doc_stats", "term_stats", "corpus", "blocks", "levels"))
        made = cls(config or LexicalConfig(), blocks, doc_stats, term_stats, corpus, blocks, levels)
        made.postings = made.flat("chunk_id", "tf", "dl", "at")
        return made

    def flat(self, *columns: str) -> DataFrame:
        """term and some columns of the postings; of blocks no others are read."""
        if self.blocks is None:
            return self.postings.select("term", *columns)
        return _opened(self.blocks, "term", columns=columns)


def _opened(blocks: DataFrame, *keys: str, columns: tuple[str, ...]) -> DataFrame:
    return blocks.select(*keys, F.explode(F.arrays_zip(*columns)).alias("e")).select(*keys, *(f"e.{c}" for c in columns))


def _impact(c: LexicalConfig):
    length = c.k1 * (1 - c.b + c.b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    return F.col("tf") * (c.k1 + 1) / (F.col("tf") + length)


def _term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _corpus(config: LexicalConfig, docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings_of(docs: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl, at, and the other columns) of (chunk_id, dl, toks, ...), made where the rows lie."""
    ship_package(docs.sparkSession)
    types = {n: t for n, t in docs.dtypes if n != "toks"}
    more = [n for n in types if n not in ("chunk_id", "dl")]

    def run(batches):
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):  # bounds what a worker sorts
            n, lists = batch.num_rows, batch.column("toks")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            if not lengths.sum():
                continue
            doc = np.repeat(np.arange(n), lengths)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            words = lists.flatten().dictionary_encode()
            size = len(words.dictionary)
            keys = doc * size + words.indices.to_numpy()
            order = np.argsort(keys, kind="stable")  # by chunk, then term; places ascend
            keys = keys[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
            term, row = keys[cuts[:-1]] % size, pa.array(keys[cuts[:-1]] // size)
            places = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(place[order].astype(np.int32)))
            made = [words.dictionary.take(pa.array(term)), batch.column("chunk_id").take(row), pa.array(np.diff(cuts).astype(np.int64)), batch.column("dl").take(row), places]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(c).take(row) for c in more)], names=["term", "chunk_id", "tf", "dl", "at", *more])

    schema = f"term string, chunk_id {types['chunk_id']}, tf long, dl {types['dl']}, at array<int>"
    return docs.mapInArrow(run, ", ".join([schema, *(f"`{c}` {types[c]}" for c in more)]))


def _from_tokens(config: LexicalConfig, docs: DataFrame) -> LexicalIndex:
    postings = postings_of(docs)
    return LexicalIndex(config, postings, docs, _term_stats(postings), _corpus(config, docs))


def build_index(chunks: DataFrame, config: LexicalConfig | None = None) -> LexicalIndex:
    """From (chunk_id, chunk_text). Chunks without a token count in n_docs and avgdl."""
    config = config or LexicalConfig()
    return _from_tokens(config, tokenize(chunks, "chunk_id", "chunk_text", config).select("chunk_id", F.size("toks").alias("dl"), "toks"))


def query_terms(queries: DataFrame, config: LexicalConfig) -> DataFrame:
    """(qid, term, qtf): terms with their weights, synonyms of a term among them at `synonym_weight` each time."""
    spark = queries.sparkSession
    base = tokenize(queries, "qid", "query", config).select("qid", F.explode("toks").alias("term"))
    weighted = base.withColumn("w", F.lit(1.0))
    if config.synonyms:
        same = (lambda w: porter(w, config.extended_stemmer)) if config.stemming else (lambda w: w)
        rows = [(t, same(s.lower())) for t, ss in config.synonyms.items() for s in ss]
        table = spark.createDataFrame([r for r in rows if r[0] != r[1]] or [("", "")], "term string, other string")
        extra = base.join(F.broadcast(table), "term").select("qid", F.col("other").alias("term"), F.lit(config.synonym_weight).alias("w"))  # the caller's dictionary
        weighted = weighted.unionByName(extra)
    return weighted.groupBy("qid", "term").agg(F.sum("w").alias("qtf"))


def _weights(index: LexicalIndex, terms: DataFrame, term_stats: DataFrame) -> DataFrame:
    """(qid, term, w): what a term's impact is multiplied with, idf = ln(1 + (N - df + .5) / (df + .5)) times the query's
    own weight."""
    n = index.corpus.select("n_docs")
    known = terms.join(term_stats, "term").crossJoin(F.broadcast(n))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return known.select("qid", "term", (idf * (index.config.k3 + 1) * F.col("qtf") / (index.config.k3 + F.col("qtf"))).alias("w"))


def phrase_hits(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(qid, chunk_id, n): how many quoted phrases of a query a chunk holds, from the places of the phrases' terms alone.

    The places of each term, less its place in the phrase, are where the phrase would begin; it does where the lists of
    all its terms meet. Chunks that hold its rarest term are looked up for the others. A phrase given twice counts twice."""
    quoted = queries.select("qid", F.posexplode(phrases(F.col("query"))).alias("nth", "phrase")).withColumn("pid", F.concat_ws("#", F.col("qid").cast("string"), "nth"))
    each = quoted.select("qid", "pid").join(tokenize(quoted, "pid", "phrase", index.config), "pid").select("qid", "pid", F.size("toks").alias("m"), F.posexplode("toks").alias("offset", "term"))
    postings, term_stats, wanted = index.flat("chunk_id", "at"), index.term_stats, each.select("term").distinct()
    if wanted.limit(TERM_BLOCK + 1).count() <= TERM_BLOCK:
        postings, term_stats = (t.join(F.broadcast(wanted), "term", "left_semi") for t in (postings, term_stats))
    rarity = F.row_number().over(Window.partitionBy("qid", "pid").orderBy("df", "offset"))
    each = each.join(term_stats, "term").withColumn("rarity", rarity)
    begins = lambda df: df.select("qid", "pid", "m", "chunk_id", F.transform("at", lambda p: p - F.col("offset")).alias("begins"))
    rare = begins(each.filter("rarity = 1").join(postings, "term"))
    others = each.filter("rarity > 1").select("qid", "pid", "term", "offset").join(rare.select("qid", "pid", "m", "chunk_id"), ["qid", "pid"])  # only chunks that hold the rarest term
    met = rare.unionByName(begins(others.join(postings, ["term", "chunk_id"]))).groupBy("qid", "pid", "m", "chunk_id").agg(F.collect_list("begins").alias("lists")).filter(F.size("lists") == F.col("m"))
    there = F.size(F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))) > 0
    return met.filter(there).groupBy("qid", "chunk_id").agg(F.count("*").alias("n"))


def search(index: LexicalIndex, queries: DataFrame, k: int, prune: bool | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) for queries (qid, query). Only postings of query terms are read on.

    Each quoted phrase of a query that a scored chunk holds adds `phrase_boost` to the factor of its score. Scores are rounded
    to nine decimals, so that ties are ties. `prune`: read the blocks alone that may hold one of the best (see `pruned`); by
    default where the query terms have PRUNE_FROM postings together and the index has blocks. The rows are the same. They are
    written once, so that what reads them twice searches once.
    """
    c = index.config
    terms = query_terms(queries, c)
    wanted, postings, term_stats = terms.select("term").distinct(), index.flat("chunk_id", "tf", "dl"), index.term_stats
    if wanted.limit(TERM_BLOCK + 1).count() <= TERM_BLOCK:  # then other terms' postings are dropped where they are read
        postings, term_stats = (t.join(F.broadcast(wanted), "term", "left_semi") for t in (postings, term_stats))
    weights, plain = _weights(index, terms, term_stats), queries
    if prune is None:
        prune = index.blocks is not None and (term_stats.agg(F.sum("df")).first()[0] or 0) >= PRUNE_FROM
    if prune:
        if index.blocks is None or (told := index.corpus.select("k1", "b").first()) is None or (told["k1"], told["b"]) != (c.k1, c.b):
            raise ValueError("only a written index of the same k1 and b has blocks to prune by")
        some = queries.filter(F.size(phrases(F.col("query"))) > 0)
        best = pruned(index, weights, k)[0]
        if not c.phrase_boost or some.isEmpty():
            return kept(best, "found")
        if c.phrase_boost > 0:
            return kept(_boosted(index, some, weights, best, k), "found")
        plain, some = some, some.select("qid").distinct()  # what lowers scores may raise any other chunk
        best, weights = best.join(some, "qid", "left_anti"), weights.join(some, "qid", "left_semi")
    hits = weights.join(postings, "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one row
    scored = hits.groupBy("qid", "chunk_id").agg(F.sum(F.col("w") * _impact(c)).alias("score"))
    if c.phrase_boost:
        met = phrase_hits(index, plain) if index.blocks is None else phrases_met(index, plain)
        scored = scored.join(met, ["qid", "chunk_id"], "left").withColumn("score", F.col("score") * (1 + c.phrase_boost * F.coalesce("n", F.lit(0)))).drop("n")
    found = top_k(scored.withColumn("score", F.round("score", 9)), k)
    return kept(found.unionByName(best) if prune else found, "found")


#: Terms of at most so many postings are read whole for the floor; of the floor, what the terms left out may add up to.
SEED, SHARE = 512, 0.7
#: Quoted phrases up to which chunks' tokens are searched for all of them at once.
PHRASES = 10_000
#: Bounds and scores are sums in any order; a bound this little below a score still counts.
SLACK = 1e-7


def _held(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf) of the terms asked for, counted where the chunks lie."""
    asked = terms.select("term").distinct()
    if (some := asked.limit(TERM_BLOCK + 1).collect()) and len(some) > TERM_BLOCK:
        return tokens.select("chunk_id", "dl", F.explode("toks").alias("term")).join(asked, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    ship_package(tokens.sparkSession)
    types, words = dict(tokens.dtypes), [r["term"] for r in some]

    def run(batches):
        known = pa.array(words, pa.string())
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            lists = batch.column("toks")
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            keys, tf = np.unique(doc[found >= 0] * max(len(known), 1) + found[found >= 0], return_counts=True)
            row = pa.array(keys // max(len(known), 1))
            made = [batch.column("chunk_id").take(row), batch.column("dl").take(row), known.take(pa.array(keys % max(len(known), 1))), pa.array(tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(made, names=["chunk_id", "dl", "term", "tf"])

    return tokens.select("chunk_id", "dl", "toks").mapInArrow(run, f"chunk_id {types['chunk_id']}, dl {types['dl']}, term string, tf long")


def _whole(index: LexicalIndex, weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) of (qid, chunk_id), from the tokens of these chunks."""
    tokens = index.doc_stats.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rated = _held(tokens, weights).crossJoin(F.broadcast(index.corpus.select("avgdl"))).select("chunk_id", "term", _impact(index.config).alias("impact"))  # one row
    return pairs.join(rated, "chunk_id").join(weights, ["qid", "term"]).groupBy("qid", "chunk_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def phrases_met(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """The rows of `phrase_hits`, from the tokens where the chunks lie, so that no posting is shuffled. A phrase is looked for
    where its rarest term stands. More than PHRASES phrases are met by their places instead."""
    quoted = queries.select("qid", F.posexplode(phrases(F.col("query"))).alias("nth", "phrase")).withColumn("pid", F.concat_ws("#", F.col("qid").cast("string"), "nth"))
    each = quoted.select("qid", "pid").join(tokenize(quoted, "pid", "phrase", index.config), "pid").filter(F.size("toks") > 0)
    rows = each.select("qid", "toks").limit(PHRASES + 1).collect()
    if len(rows) > PHRASES:
        return phrase_hits(index, queries)
    spark, types = queries.sparkSession, {**dict(index.doc_stats.dtypes), "qid": dict(queries.dtypes)["qid"]}
    ship_package(spark)
    words = sorted({t for r in rows for t in r["toks"]})
    df = dict(index.term_stats.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "term string")), "term").collect())  # of PHRASES phrases at most
    number = {w: i for i, w in enumerate(words)}
    there = sorted({tuple(r["toks"]) for r in rows if all(t in df for t in r["toks"])}, key=lambda p: number[min(p, key=lambda t: (df[t], t))])
    given = [(r["qid"], there.index(tuple(r["toks"]))) for r in rows if tuple(r["toks"]) in set(there)]
    rare = [min(p, key=lambda t: (df[t], t)) for p in there]
    anchor = np.array([number[t] for t in rare], dtype=np.int64)
    offset, length = np.array([p.index(t) for p, t in zip(there, rare, strict=True)], dtype=np.int64), np.array([len(p) for p in there], dtype=np.int64)
    terms = np.full((len(there), int(length.max(initial=1))), -1, dtype=np.int64)
    for i, p in enumerate(there):
        terms[i, : len(p)] = [number[t] for t in p]
    begin = np.searchsorted(anchor, np.arange(len(words) + 1))

    def run(batches):
        known = pa.array(words, pa.string())
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            n, lists = batch.num_rows, batch.column("toks")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
            place = np.flatnonzero(found >= 0)
            many = begin[found[place] + 1] - begin[found[place]]  # phrases that have this term as their rarest
            p = np.repeat(begin[found[place]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            place = np.repeat(place, many)
            doc = np.searchsorted(ends, place, side="right")
            start = place - offset[p]
            ok = (start >= np.where(doc > 0, ends[doc - 1], 0)) & (start + length[p] <= ends[doc]) if len(doc) else np.zeros(0, dtype=bool)
            p, doc, start = p[ok], doc[ok], start[ok]
            for j in range(terms.shape[1]):
                ok = (j >= length[p]) | (found[np.minimum(start + j, len(found) - 1)] == terms[p, j]) if len(p) else np.zeros(0, dtype=bool)
                p, doc, start = p[ok], doc[ok], start[ok]
            keys = np.unique(p * n + doc)
            yield pa.RecordBatch.from_arrays([pa.array(keys // n if n else keys), batch.column("chunk_id").take(pa.array(keys % n if n else keys))], names=["p", "chunk_id"])

    met = index.doc_stats.select("chunk_id", "toks").mapInArrow(run, f"p long, chunk_id {types['chunk_id']}")
    asked = spark.createDataFrame(given, f"qid {types['qid']}, p long")
    return met.join(F.broadcast(asked), "p").groupBy("qid", "chunk_id").agg(F.count("*").alias("n"))  # of PHRASES phrases at most


def _boosted(index: LexicalIndex, queries: DataFrame, weights: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The `k` best where phrases raise scores, out of the best without them: a chunk without a phrase that is one of the k best
    is one of `best`, as the others' scores rise only. Chunks with a phrase are scored whole."""
    hits = kept(phrases_met(index, queries), "phrases")
    raised = _whole(index, weights, hits.select("qid", "chunk_id")).join(hits, ["qid", "chunk_id"])
    raised = raised.select("qid", "chunk_id", F.round(F.col("score") * (1 + index.config.phrase_boost * F.col("n")), 9).alias("score"))
    rest = best.select("qid", "chunk_id", "score").join(hits, ["qid", "chunk_id"], "left_anti")
    return top_k(rest.unionByName(raised), k)


def pruned(index: LexicalIndex, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The `k` best of each query, and (step, rows, n): the blocks and their postings, or the chunks and their tokens, that
    each step read.

    1. A query's terms are looked up in their best blocks (all blocks of rare terms). The chunks with the most there are
       scored whole, and the k-th score is a floor: the k best have it at least.
    2. Terms whose greatest scores together stay below the floor are no reason to look at a chunk. Of the other terms, those
       levels are read whose peak, with the best of all other terms, reaches the floor. A chunk of the k best is in every one
       of these terms' blocks that hold it.
    3. Chunks whose score so far, with the best of the terms left out, reaches the floor are scored whole, by their tokens.
    """
    c, spark = index.config, weights.sparkSession
    path = fresh(spark, "bounds")

    def part(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    weights = part(weights, "weights")
    levels = part(index.levels.join(weights.select("term").distinct(), "term", "left_semi"), "levels")
    tops = levels.groupBy("term").agg(F.max("peak").alias("peak"), F.max("level").alias("top"), F.sum("n").alias("all"))
    asked = weights.join(tops, "term").select("qid", "term", "w", "top", "all", (F.col("w") * F.col("peak")).alias("u"))

    def entries(blocks: DataFrame, name: str) -> DataFrame:
        """(term, level, slice, chunk_id, tf, dl) of the blocks named."""
        named = part(blocks.select("term", "level", "slice").distinct(), name)
        found = index.blocks.join(named, ["term", "level", "slice"])
        return _opened(found, "term", "level", "slice", columns=("chunk_id", "tf", "dl")).crossJoin(F.broadcast(index.corpus.select("avgdl"))).withColumn("impact", _impact(c))  # one row

    def whole(pairs: DataFrame, name: str) -> DataFrame:
        return _whole(index, weights, part(pairs, name))

    few = (F.col("level") >= F.col("top") - 1) | (F.col("all") <= SEED)
    first = asked.join(levels, "term").filter(few).select("qid", "term", "w", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("all") <= SEED, F.col("slices") - 1).otherwise(0))).alias("slice"))
    seeds = first.join(entries(first, "first"), ["term", "level", "slice"]).groupBy("qid", "chunk_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    floors = top_k(whole(top_k(seeds, 4 * k).select("qid", "chunk_id"), "seeds"), k).filter(F.col("rank") == k).select("qid", (F.col("score") - SLACK).alias("floor"))
    below = Window.partitionBy("qid").orderBy("u", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).select("*", F.sum("u").over(below).alias("below"), F.sum("u").over(Window.partitionBy("qid")).alias("every"))
    ranked = part(ranked.withColumn("essential", F.col("below") >= SHARE * F.col("floor")), "ranked")
    left = ranked.groupBy("qid").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("u"))), F.lit(0.0)).alias("rest"))

    reach = F.col("w") * F.col("peak") + F.col("every") - F.col("u") + SLACK >= F.col("floor")
    needed = ranked.filter("essential").join(levels, "term").filter(reach).select("qid", "term", "w", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    sums = needed.join(entries(needed, "needed"), ["term", "level", "slice"]).groupBy("qid", "chunk_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    chunks = sums.join(left, "qid").filter(F.col("score") + F.col("rest") + SLACK >= F.col("floor")).select("qid", "chunk_id")
    scored = whole(chunks, "chunks").withColumn("score", F.round("score", 9))

    read = None
    for step in ("first", "needed"):
        named = spark.read.parquet(f"{path}/{step}")
        one = index.blocks.select("term", "level", "slice", "n").join(named, ["term", "level", "slice"]).agg(F.lit(step).alias("step"), F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        read = one if read is None else read.unionByName(one)
    for step in ("seeds", "chunks"):
        named = spark.read.parquet(f"{path}/{step}").select("chunk_id").distinct()
        one = index.doc_stats.join(named, "chunk_id", "left_semi").agg(F.lit(step).alias("step"), F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n"))
        read = read.unionByName(one)
    return top_k(scored, k), read
