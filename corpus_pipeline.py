"""The corpus pipeline: documents through the training-text operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet in the shared checkpoint folder and reads it back as
the next stage's documents.  All stages but the last return the columns of
``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import bpe, decontaminate, secrets, simhash, toxicity
from revlens.llm.common import prepare, read, stored
from revlens.llm.queries import TOKENIZER


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (fitted on the labelled ones among them) does not reject."""
    prepare(spark)
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"), limit=0.7)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 or more of its five-word shingles)."""
    prepare(spark)
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"), size=5, threshold=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of live-looking credentials replaced; n_chars follows the text."""
    prepare(spark)
    return secrets.with_length(secrets.redacted(docs), "n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, decoded): the token ids of every document and the text they stand for."""
    prepare(spark)
    both = bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"), F.decode("data", "UTF-8").alias("decoded"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("simhash", one_of_near_duplicates),
    ("decontamination", clean_of_benchmarks),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

#: Model scores, fingerprints and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
