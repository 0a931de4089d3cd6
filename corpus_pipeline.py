"""A training corpus from raw documents.

Five stages, each on what the one before has kept: toxic documents go, documents of
no known language go, one document of each group of near duplicates stays, documents
with passages of the benchmark go, and the rest is packed into sequences.  A stage
takes (spark, docs, sf_dir) and returns a DataFrame with the columns of `docs`; the
last one returns packed pieces.  Stages set the session's Arrow batches, if it does not
itself: with whole documents in them, the default of 10,000 rows is much memory.

Rows without an id are kept or dropped by their text like others; of near duplicates
without any id, exact copies alone are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import decontam, langid, minhash, packing, toxicity
from ruleweave.llm.queries import tokenizer_file
from ruleweave.llm.scratch import cut, small_batches, table, without


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; those without a text or label are judged like others, and without labels of both classes all stay."""
    small_batches(spark)
    return toxicity.ordinary(docs, table(spark, sf_dir, "labels"))


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null text, or one without letters, goes, and where no language is known all stay."""
    small_batches(spark)
    return langid.recognised(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its shingles or more, the one with the least id; of rows with one id, one text."""
    small_batches(spark)
    found = cut(minhash.near_duplicates(docs, share=80), "near-duplicates")
    stays = F.col("kept") | (F.col("doc_id").isNull() & F.col("component_id").isNull())
    kept = without(docs, cut(found.where(~stays).select("doc_id", "tie").distinct(), "repeated"))
    if found.where(stays).groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null texts stay, and without items all do."""
    small_batches(spark)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, cut(found.where("contaminated").select("doc_id", "tie").distinct(), "contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and places in sequences; a null text is one end id."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", ordinary),
    ("language", recognised),
    ("near_duplicates", unrepeated),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: SQL has no models; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
