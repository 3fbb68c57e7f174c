"""From raw documents to packed training sequences: quality rules, language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rows without a doc_id can't be named by
near-dedup and decontamination and stay; a doc_id in several rows is one document for near-dedup, of which the row with the least hash stays.
Null and empty texts go with the quality rules; very long ones are treated whole in every stage. Empty tables give empty ones. Columns are kept by
place, so that names that a stage uses inside can't clash with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import decontamination, language_id, line_rules, minhash, packing
from deltaloom.llm.common import table, written

#: Ids to remove are broadcast only if there are at most so many (8 bytes each), else joined by shuffle.
MOST_BROADCAST = 1_000_000

#: Chunks whose ids a Python worker keeps: fewer than packing alone may, as workers and executors come from other stages.
KEPT = 150_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows that have one of the ids (a column doc_id)."""
    ids = written(ids.select("doc_id").distinct(), "removed")
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed, and documents that lose too much or fail the base rules are rejected; repeated rows are judged alike."""
    return line_rules.cleaned(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language reaches language_id.MIN_SCORE, are rejected; without any labels, only those without a letter."""
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the one with the least doc_id.

    Of several rows of one doc_id the one with the least hash of text and other columns stays; equal hashes are equal rows. Rows without a
    doc_id, and texts without words, stay.
    """
    found = written(minhash.near_duplicates(docs), "components")
    left = _without(docs, found.where(~F.col("kept")))
    twice = written(found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if twice.take(1):
        columns = [F.col(f"`{c}`") for c in docs.columns]
        several = left.join(twice, "doc_id", "left_semi").select(docs.columns)
        key = F.struct(F.xxhash64("text"), F.xxhash64(*columns))
        one = several.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*columns), key).alias("_row")).select("_row.*")
        left = left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one)
    return left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, by template or verbatim, go; rows without a doc_id stay, repeated rows go together."""
    return _without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is its end id alone, repeated rows are packed each for itself."""
    return packing.pack_documents(docs, "byte_bpe_50k.json", 1, kept=KEPT)


STAGES = [("quality rules", quality_rules), ("language ID", language), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Models, tokenizers and connected components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
