"""A corpus for training from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontamination, exact_dedup, language, packing, simhash
from tidewire.llm.columns import aside
from tidewire.runtime import materialise, table

#: A text is kept if the predicted language's filter knows at least this share of its n-grams.
LEAST_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those that no learned language explains (LEAST_SCORE).

    Learns from all labelled rows of docs. Null and empty texts have no letters; rows are judged one by one,
    repeated ones alike. If no row has a language, none is learnt and all are rejected.
    """
    filters = language.fit(docs.select("doc_id", "text", "lang"))
    good = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return aside(docs, ["lang_pred", "score"], lambda rows: language.identify(rows, filters).filter(good))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, null ids last; of rows that tie one stays. Null equals empty."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest doc_id, null ids last, of repeated ids one row."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go; texts without words, and all if there are no items, stay."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return aside(docs, decontamination.ADDED, lambda rows: decontamination.mark(rows, items).filter(~F.col("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every remaining row in sequences of 2048 tokens; null and repeated ids are packed row by row."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language_id", keep_languages), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("best_fit_packing", pack)]
#: Fitted filters, XXH64 fingerprints and a tokenizer's ids have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
