"""A chunked, embedded and indexed corpus that is built again for changed documents only.

Documents are dealt to buckets by the hash of their id, and every table lies in one folder for each bucket and version. An update
compares digests of what is given with those of the last finished commit, chunks, embeds and tokenises new and changed
documents alone, and writes new versions of the buckets that these, or removed documents, lie in. A commit is the list of
versions that make the corpus; it counts once its own write has finished, so a reader sees one commit whole, and an update
that fails leaves the last one as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, lexical, vectors
from tessera.plans.runtime import config_hash, finished_runs
from tessera.plans.scratch import delete

TABLES = ("documents", "chunks", "vectors", "tokens", "postings")


class Corpus:
    """`path` lies where all nodes read and write; one update at a time. `settings` names what chunks and vectors depend on
    beside the documents (a model's name and version): all are built again when it changes."""

    def __init__(self, spark: SparkSession, path: str, policy: chunking.Policy | None = None, provider: Callable | None = None, dim: int | None = None, config: lexical.LexicalConfig | None = None,
                 vocabulary: str | None = None, facts: bool = False, skip_bad: bool = False, settings: dict | None = None, buckets: int = 64):
        self.spark, self.path, self.provider, self.dim, self.vocabulary, self.facts, self.skip_bad, self.buckets = spark, path.rstrip("/"), provider, dim, vocabulary, facts, skip_bad, buckets
        self.policy, self.config = policy or (chunking.FACTS if facts else chunking.Policy()), config or lexical.LexicalConfig()
        told = {"policy": asdict(self.policy), "lexical": asdict(self.config), "vocabulary": vocabulary, "facts": facts, "buckets": buckets, "settings": settings, "vectors": provider is not None}
        self.key = config_hash(json.loads(json.dumps(told)))

    # -- reading

    def commit(self) -> str | None:
        """The folder of the last finished commit."""
        runs = finished_runs(self.spark, f"{self.path}/commits")
        return runs[-1] if runs else None

    def _versions(self) -> dict[int, str]:
        last = self.commit()
        return {r["bucket"]: r["part"] for r in self.spark.read.parquet(last).collect()} if last else {}  # `buckets` rows

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        parts = [p for b, p in self._versions().items() if p and (buckets is None or b in buckets)]
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("part").isin(parts)).drop("part")  # other folders are not opened

    def documents(self) -> DataFrame:
        """doc_id, digest."""
        return self._read("documents")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def vectors(self) -> DataFrame:
        """chunk_id, doc_id, embedding."""
        return self._read("vectors")

    def lexical_index(self) -> lexical.LexicalIndex:
        """The postings of all buckets with the statistics of them together."""
        tokens, postings = self._read("tokens").drop("doc_id"), self._read("postings").drop("doc_id")
        corpus = tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).select("*", F.lit(self.config.k1).alias("k1"), F.lit(self.config.b).alias("b"))
        return lexical.LexicalIndex(self.config, postings, tokens, postings.groupBy("term").agg(F.count("*").alias("df")), corpus)

    # -- writing

    def update(self, documents: DataFrame) -> dict[str, int]:
        """Make the corpus that of `documents` (doc_id, source, text; title and url where they have them), all of them.

        Counts added, changed, removed and unchanged documents, buckets written, and chunks made and embedded. Ids must be
        there once each. A chunk that a changed document had before keeps its vector. Nothing is written when nothing changed.
        """
        spark = self.spark
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in documents.columns else F.lit("\0") for c in ("source", "title", "url", "text")]
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        given = documents.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(self.key), *columns), 256))
        versions = self._versions()
        work = f"{self.path}/work/{uuid.uuid4().hex}"
        try:
            now = given.select("doc_id", "digest", F.lit(1).alias("here"))
            before = self.documents().select("doc_id", F.col("digest").alias("old")) if versions else spark.createDataFrame([], "doc_id string, old string")
            status = F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("old"), "changed").otherwise("unchanged")
            now.join(before, "doc_id", "full_outer").select("doc_id", "digest", status.alias("status"), bucket.alias("bucket"), F.col("here").isNotNull().alias("here")).write.parquet(f"{work}/status")
            compared = spark.read.parquet(f"{work}/status")
            faults = compared.filter("here").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
            if not faults.isEmpty():
                raise ValueError("every document needs an id of its own")
            report = {s: 0 for s in ("added", "changed", "removed", "unchanged")} | {r["status"]: r["n"] for r in compared.groupBy("status").agg(F.count("*").alias("n")).collect()}
            touched = sorted(r["bucket"] for r in compared.filter("status <> 'unchanged'").select("bucket").distinct().collect())  # `buckets` at most
            report |= {"buckets": len(touched), "chunked": 0, "embedded": 0}
            if not touched and versions:
                return report
            anew = compared.filter("status IN ('added', 'changed')").select("doc_id")
            same = compared.filter("status = 'unchanged'").select("doc_id")
            version = uuid.uuid4().hex
            part = F.concat(F.format_string("%05d-", bucket), F.lit(version))
            held = [b for b in touched if versions.get(b)]

            def write(name: str, new: DataFrame, source: str | None = None) -> None:
                """The rows of unchanged documents in touched buckets, and the new rows, as new versions of these buckets. Postings are
                made of tokens once these are dealt out, as they are longer."""
                rows = new
                if held:
                    rows = self._read(source or name, held).join(same, "doc_id", "left_semi").unionByName(new)
                rows = rows.select(*new.columns).withColumn("part", part).repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
                rows = lexical.postings_of(rows) if source else rows
                rows.write.mode("append").partitionBy("part").parquet(f"{self.path}/{name}")

            chunking.chunk_corpus(given.join(anew, "doc_id", "left_semi"), self.policy, self.facts, self.skip_bad, self.vocabulary).write.parquet(f"{work}/chunks")
            made = spark.read.parquet(f"{work}/chunks")
            good = made.filter("chunk_id IS NOT NULL")
            write("documents", compared.join(anew, "doc_id", "left_semi").select("doc_id", "digest"))
            write("chunks", made)
            report["chunked"] = good.count()
            if self.provider is not None:
                kept = self._read("vectors", held).join(good.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi") if held else None
                missing = good.select("doc_id", "chunk_id", "chunk_text")
                missing = missing.join(kept.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti") if kept is not None else missing
                key = F.concat_ws("\x1f", "doc_id", "chunk_id")
                embedded = vectors.embed(missing.select(key.alias("chunk_id"), "chunk_text"), self.provider, dim=self.dim)
                cut = F.split("chunk_id", "\x1f")
                embedded.select(F.element_at(cut, -1).alias("chunk_id"), F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), "\x1f").alias("doc_id"), "embedding").write.parquet(f"{work}/vectors")
                found = spark.read.parquet(f"{work}/vectors")
                report["embedded"] = found.count()
                write("vectors", found.unionByName(kept) if kept is not None else found)
            both = good.select(F.struct("chunk_id", "doc_id").alias("both"), "chunk_text")
            tokens = lexical.tokenize(both, "both", "chunk_text", self.config).select("both.chunk_id", F.size("toks").alias("dl"), "toks", "both.doc_id")
            tokens.write.parquet(f"{work}/tokens")
            new_tokens = spark.read.parquet(f"{work}/tokens")
            write("tokens", new_tokens)
            write("postings", new_tokens, "tokens")
            after = {b: versions.get(b) for b in range(self.buckets)} | {b: f"{b:05d}-{version}" for b in touched}
            n = int(self.commit().rsplit("/", 1)[-1]) + 1 if versions else 1
            spark.createDataFrame(list(after.items()), "bucket int, part string").coalesce(1).write.parquet(f"{self.path}/commits/{n:012d}")  # fails where another update was first
            return report
        finally:
            delete(spark, work)

    def vacuum(self) -> int:
        """Delete the versions that the last commit does not name; how many folders went. For when nothing reads earlier commits."""
        live, gone = set(self._versions().values()), 0
        for name in TABLES:
            for folder in finished_runs(self.spark, f"{self.path}/{name}", marker=None):
                if folder.rsplit("part=", 1)[-1] not in live and "part=" in folder:
                    delete(self.spark, folder)
                    gone += 1
        return gone
