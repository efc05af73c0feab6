"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before has kept, and its decisions take effect: toxic documents and documents without a language go,
one document of each class of near-duplicates stays, repeated passages are cut out, and what is left is packed.

Cases: null texts are empty; an empty text is not toxic, has no language and goes in the second stage; of repeated rows one stays after the third stage; null ids are kept like others; an empty table gives an empty one
in each stage. Without labels of both classes, or without any language to learn from, there is nothing to judge by and a stage keeps all rows. Only doc_id, text, lang and n_chars are read; other columns are passed on, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import common as C
from shoebox.llm import langid, omh, packing, suffixdedup, toxicity

#: A document whose best language is less likely than this has none.
LEAST_LANGUAGE = 0.25


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; an empty text is not. Models are fitted on the labelled documents of this input; without both labels all rows stay."""
    docs = docs if docs is not None else C.table(spark, sf_dir, "documents")
    C.tune(spark)
    return toxicity.clean(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels")))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language of score LEAST_LANGUAGE or more; texts without a letter have none. Without any language to learn from all rows stay."""
    C.tune(spark)
    return langid.known(docs, langid.fit(docs), LEAST_LANGUAGE)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id, null ids last; all empty texts are one class."""
    return omh.representatives(docs)


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without what repeats 100 bytes of an earlier one or of itself; a text that repeats wholly stays as an empty one, and n_chars is counted anew."""
    return suffixdedup.cleaned(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; an empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("language", stage_language),
    ("near_dedup", stage_near_dedup),
    ("suffix_dedup", stage_suffix_dedup),
    ("packing", stage_packing),
]

#: Models and tokenizers are beyond SQL; tests hold the operators of the stages against brute force on small tables, and the stages together to their columns and rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written as Parquet and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
