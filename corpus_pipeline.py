"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Defined results, for all stages: all but the last return the columns of their input, names that clash with those of work columns included; an empty
table stays empty; no row is lost but by the stage's own decision. What each stage does with nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftframe.llm import _shared, decontaminate, jaccard, language_id, packing, substring


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier finds ambiguous.

    A text that is null, empty or without letters can't be judged and goes; so does one as unlike all languages, or as much between two, as fewer than 0.5 %
    of the labelled texts of its length. A null doc_id doesn't matter, a null lang only takes no part in fitting, and repeated rows are judged alike.
    Where no row has a label, nothing can be judged and all rows stay.
    """
    return language_id.keep_clear(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays.

    Ties between texts of one id go to the smaller hash of the row. Rows that are the same in id and text are one document: they stay or go together.
    Rows with a null doc_id, and null, empty or punctuation-only texts, stay.
    """
    return jaccard.drop_copies(docs)


def fresh_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has, or an earlier place of the same one; a document with no words left goes.

    Earlier means by doc_id, a null one first, then by position. Rows that share id and text share their place, so neither is cut for the other.
    Texts of fewer than 50 words, null and empty ones included, stay as they are. n_chars follows the text; a null n_chars stays null.
    """
    return substring.cut(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to edits of 6 % of its length.

    Null, empty or punctuation-only texts and items match nothing, so those rows stay; ids, null or repeated, don't matter. Items too short for an edit
    match as whole words.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences of 2,048 words.

    Each row is packed, repeated rows and ids each on their own; null, empty and blank texts get a row without a sequence; a null doc_id is passed on.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", clear_language),
    ("ngram_jaccard", one_of_each),
    ("substring_dedup", fresh_passages),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: The stages fit a classifier, follow chains of near copies and place items one by one: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
