"""The retrieval API: dense, lexical, hybrid and reranked results for a table of queries, and answers from them."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import answers, fusion, lexical, vectors
from tessera.plans.providers import EmbeddingProvider
from tessera.plans.runtime import Cache, canonical_query, retrieval_key


@dataclass
class Retriever:
    """Over chunks (chunk_id, chunk_text, ...), vectors (chunk_id, embedding) and a lexical index."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.LexicalIndex
    alpha: float = 0.6
    dense_candidates: int = 100
    lexical_candidates: int | None = None
    rerank_candidates: int = 25

    def dense(self, queries: DataFrame, k: int, filters: dict | None = None, metric: str = "ip", strategy: str = "expression") -> DataFrame:
        """Queries (qid, embedding); filters on chunk columns apply before the search."""
        pool = self.vectors
        if filters:
            kept = self.chunks.filter(vectors.matches(filters)).select("chunk_id")
            pool = pool.join(kept, "chunk_id", "left_semi")
        return vectors.dense_topk(pool, queries, k, metric, strategy=strategy)

    def lexical(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries (qid, query); blank ones have no results."""
        return lexical.search(self.index, queries.filter(F.trim("query") != ""), k)

    def hybrid(self, queries: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
        asked = queries.filter(F.trim("query") != "")
        return fusion.blend(self.dense(asked, max(self.dense_candidates, k), filters), self.lexical(asked, self.lexical_candidates or k), k, self.alpha)

    def reranked(self, queries: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
        n = max(self.rerank_candidates, k)
        return fusion.hybrid_rerank(self.hybrid(queries, n, filters), queries, self.chunks, k, n)

    def answer(self, queries: DataFrame, generate, k: int = 5, repair: bool = True) -> DataFrame:
        """(qid, raw, parsed, answer) by a generator (system, user) -> text, with one repair of outputs that don't parse."""
        hydrated = fusion.hydrate(self.reranked(queries, k), self.chunks)
        for c in ("title", "section_path", "url"):
            if c not in hydrated.columns:
                hydrated = hydrated.withColumn(c, F.lit(None).cast("string"))
        packs = answers.evidence(hydrated)
        history = F.col("history") if "history" in queries.columns else F.lit(None).cast("array<struct<role:string,content:string>>")
        asked = queries.withColumn("summary", answers.conversation_summary(history)).join(packs, "qid")

        @F.pandas_udf("string")
        def call(prompts: pd.DataFrame) -> pd.Series:
            return pd.Series([generate(s, u) for s, u in zip(prompts["system"], prompts["user"], strict=True)])

        tags = F.map_from_arrays(F.transform("items", lambda i: i["tag"]), F.transform("items", lambda i: i["chunk_id"]))
        first = asked.withColumn("raw", call(answers.prompt(F.col("query"), F.col("evidence"), F.col("summary")))).withColumn("tags", tags)
        parsed = first.join(answers.parse_answers(first), "qid")
        if repair:
            bad = parsed.filter("parsed.mode = 'parse_error'")
            again = bad.withColumn("raw", call(answers.repair_prompt(F.col("query"), F.col("evidence"), F.col("summary"), F.col("raw"), F.col("parsed.parse_warnings")))).drop("parsed")
            parsed = parsed.filter("parsed.mode <> 'parse_error'").unionByName(again.join(answers.parse_answers(again), "qid"))
        return parsed.select("qid", "raw", "parsed", answers.answer_text(F.col("parsed")).alias("answer"))


@dataclass
class CachedRetriever:
    """Single questions in one process: query vectors and results are kept in caches of bounded size."""

    retriever: Retriever
    provider: EmbeddingProvider
    dim: int
    model: str = ""
    index: str = ""
    embeddings: Cache = field(default_factory=Cache)
    results: Cache = field(default_factory=Cache)

    def embed(self, query: str) -> list[float]:
        """The query's unit vector, from the cache if an equal query was embedded by this model."""

        def make() -> list[float]:
            x = np.asarray(self.provider([canonical_query(query)]), dtype=np.float32)
            if x.shape != (1, self.dim):
                raise ValueError(f"a provider returned a shape of {x.shape}, not {(1, self.dim)}")
            return (x[0] / max(float(np.linalg.norm(x[0])), 1e-12)).tolist()

        return self.embeddings.get((self.model, canonical_query(query)), make)

    def retrieve(self, query: str, top_k: int = 5, filters: dict | None = None) -> dict:
        """{"rows", "embedding_hit", "retrieval_hit", "retrieve_ms"}; a blank query has no rows. Results with filters are
        not cached."""
        begun = time.perf_counter()
        if not (query or "").strip():
            return {"rows": [], "embedding_hit": False, "retrieval_hit": False, "retrieve_ms": 0.0}
        r, known = self.retriever, (self.embeddings.hits, self.results.hits)

        def search() -> list[dict]:
            spark = r.chunks.sparkSession
            asked = spark.createDataFrame([(0, query, self.embed(query))], "qid long, query string, embedding array<float>")
            return [x.asDict() for x in r.hybrid(asked, top_k, filters).orderBy("rank").select("chunk_id", "score", "rank").collect()]

        key = retrieval_key(query, query, top_k, r.alpha, r.dense_candidates, r.lexical_candidates or top_k, self.index, self.model)
        rows = search() if filters else self.results.get(key, search)
        return {"rows": rows, "embedding_hit": self.embeddings.hits > known[0], "retrieval_hit": self.results.hits > known[1], "retrieve_ms": (time.perf_counter() - begun) * 1000}
