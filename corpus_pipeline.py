"""Stages from raw documents to packed training sequences; each stage's rows are written and read again.

Cases, of every stage but the last: columns beyond the id, the text and n_chars are carried whatever their names; an empty table
gives an empty one with the same columns; repeated rows are rows of their own; a very long text is handled whole.

* quality rules: null and empty texts have no words and go.
* n-gram Jaccard join: rows without words are no copies and all stay; of a group the smallest id stays, null ids only where a
  group has no other, and of equal ids the first row.
* substring dedup: every copy of a repeated passage goes, so a text may become empty; null texts stay null.
* benchmark decontamination: an item of under ten words is one window; null and empty texts and items hit nothing.
* best-fit packing: null and empty texts are one piece, the end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontam, jaccard, packing, quality, substrings
from loomline.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the cascade keep."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start more than once."""
    return substrings.remove_words(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in training sequences."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", packed),
]
#: The token ids of the last stage are beyond SQL; tests/llm compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
