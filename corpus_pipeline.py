"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
frame that is written and read again as the next one's ``docs``.  All but the last return the
columns of ``docs``; those may be any beside doc_id, text, lang and source.

Defined results: a document without a letter goes in the first stage; one that consists of later
copies only goes in the second; of a group of near copies, and of repeated rows, the one with the
smallest doc_id stays, whether or not doc_ids repeat or are missing; the mix gives a document as
many rows as it is taken; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import encoding, language_id, line_dedup, mixing, ngram_join, packing
from quillstone.llm.common import discard, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with lang as predicted from the text; ``und`` goes."""
    found = language_id.identify(docs, language_id.learn(docs)).where("__lang <> 'und'")
    return found.select(*[F.col("__lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go."""
    left = line_dedup.dedup_lines(docs).where("__n_removed = 0 or __n_removed < __n_lines")
    chars = F.when(F.col("__n_removed") > 0, F.length("text").cast("long"))
    return left.select(*[F.coalesce(chars, F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, a null one last.

    Rows are told by 64 bits of doc_id and text, so that a doc_id may stand on several texts or be
    missing; of several texts under the smallest doc_id the one with the smallest key stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = ngram_join.join_documents(keyed.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__key").alias("__kept"))
    first = keyed.select("__key", "doc_id").distinct().join(groups.distinct(), "__key").groupBy("__group").agg(F.min(place).alias("__first"))
    kept = first.select(F.col("__first.__kept").alias("__kept"))
    return keyed.join(kept, F.col("__key") == F.col("__kept"), "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, encoding.vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Neither a trained model nor token ids can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
