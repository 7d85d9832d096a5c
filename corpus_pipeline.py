"""From raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, whatever these are called besides doc_id, text
and source. Stages work on everything they are given; an empty table passes through all of them, as do rows with a null
in any column, repeated rows and empty or very long texts, each as its stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoteproof.llm._encode import tokenizer_path
from quoteproof.llm._shared import load, materialise
from quoteproof.llm.op2_mixing import mixed_documents
from quoteproof.llm.op6_jaccard_join import one_of_each
from quoteproof.llm.op7_packing import TOKENIZER, packed
from quoteproof.llm.op9_exact_dedup import drop_copies
from quoteproof.llm.op10_quality import keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier grades good; a null or empty text has the score of no features, and without
    labels all are kept."""
    return keep_good(docs, train(docs, load(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each content: the longest, then the smallest doc_id, a null one last. Null and empty texts are one content."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate component. Texts without words and rows without doc_id
    are linked with nothing and stay."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order; texts without words are taken 0 times and go.
    A null source is a source of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences; a null text is its end id alone."""
    return packed(docs, tokenizer_path(TOKENIZER))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trained weights and tokenizers cannot be said in SQL; tests/llm holds a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
