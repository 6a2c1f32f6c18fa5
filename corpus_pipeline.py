"""Corpus pipeline: from raw documents to token ids of a deduplicated, mixed training set.

Each stage takes the documents that the one before kept and, but for the last, returns documents with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.llm import bpe_chunks, fair_mixing, language_id, line_templates, ngram_jaccard
from quernlog.llm.native import Scratch


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the calibrated model rejects go, texts without a letter too."""
    model = language_id.fit(docs, F.lit(False))
    # the row goes along as one column, so that no name of it meets one of the result
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    found = language_id.identify(rows, model, ["_row"])
    return (found.filter(~F.col("rejected")) if model.languages else found).select("_row.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with lines that recur across them left in one only; ``n_chars``, where there is one, follows the text.

    Null texts and rows without doc_id stay as they are, an empty table stays empty.
    """
    # other columns go along as one, so that no name of them meets one of the result
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = line_templates.without_recurring(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_none"), *others).alias("_row")), whole=True)
    columns = {c: F.col(f"_row.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(columns["n_chars"])
    return rows.select(*[columns[c].alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return ngram_jaccard.one_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document taken twice is there twice."""
    return fair_mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe_chunks.encoded(docs, keep=("doc_id", "source"))


STAGES = [
    ("language ID", identified),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", without_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenized),
]
#: Training, and encoding by a vocabulary, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage returns is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = Scratch(spark)
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.stored(stage(spark, docs, sf_dir))
        before.clear()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)  # reads the last stored documents
