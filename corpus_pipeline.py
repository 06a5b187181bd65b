"""A training corpus from raw documents: quality, repeated lines, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of `documents`, whatever these are called beside doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from tessera.llm._common import drop_table, packed, read, table, tidy, unpacked
from tessera.llm.queries import AFTER_QUALITY, STAGE_RIDGE, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows are judged one by one, by id and text: rows that share an id, or have none, stay or go each by itself. A null text
    counts as empty. Without labels of good and other documents all stay.
    """
    return quality_classifier.keep_good(docs, quality_classifier.classify(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; documents made of such lines alone go.

    Earlier is by id, then line, then a hash of the text. Rows with a null id or text stay as they are; a row that repeats
    another whole has the same place and loses what that one loses.
    """
    return line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs, exact_words=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays.

    Rows without an id or without words stay. Of rows that share an id, those go whose own text belongs to a group with a
    smaller id; a row repeated whole stays as often as it is there.
    """
    groups = ngram_join.similar_documents(docs).filter("doc_id <> component_id")
    gone = groups.select(F.col("doc_id").alias("g_id"), F.col("text_id").alias("g_key")).distinct()
    return unpacked(packed(docs).join(gone, (F.col("id") == F.col("g_id")) & (F.col("key") == F.col("g_key")), "left_anti"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring expected domain tokens to the target weights.

    The classifier learns from the raw corpus, as earlier stages leave few documents of the lesser domains. Good documents
    have rates near 1; those that may be toxic are dropped the more often the likelier they are. Null and empty
    texts have a rate like any other and no tokens; without labels of two domains every row stays once.
    """
    labelled = mixing.quality_domains(read(spark, sf_dir, "labels"))
    rates, _ = mixing.mix(docs, labelled, AFTER_QUALITY, ridge=STAGE_RIDGE, training=read(spark, sf_dir, "documents"))
    return mixing.draw(docs, rates)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Every row is packed, rows that repeat as often as they do; a null text counts as empty."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pack", pack),
]

#: Trained and iterative stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`. Of an empty table every stage makes an empty one. A stage's scratch
    tables, and its result once the next one is written, are deleted."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = tidy(lambda docs=docs, name=name, stage=stage: table(stage(spark, docs, sf_dir), name))()
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
