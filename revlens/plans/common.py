"""Shared plan fragments: the review table at each stage of the flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import clean
from revlens.sources import fixtures as fx


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.unify(fx.raw_sources(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_reviews(unified(spark, sf_dir))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.first_kept(cleaned(spark, sf_dir), ["review_translate", "entity_name"])


def processed(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Cleaned reviews with sentences and per-sentence tokens (D1-D3); dealt by review where ``rows`` gives their count."""
    df = cleaned(spark, sf_dir)
    if rows is not None:
        df = together(df.select("review_id", "review_translate"), rows)
    return (df.withColumn("review_translate_sentences", T.sentences("review_translate"))
            .withColumn("review_translate_sentences_tokens",
                        T.sentence_tokens(F.col("review_translate_sentences"))))


#: Texts in a partition, at most about, where their tokens are grouped again by the text's key.
TEXTS = 4096


def together(texts: DataFrame, rows: DataFrame, key: str = "review_id") -> DataFrame:
    """``texts`` dealt by ``key``, whole: tokens that are cut from them later are grouped by ``key`` where they are.

    A text is shuffled once as it stands instead of token by token with its keys.  ``rows``: a table whose count is
    about that of the texts and cheap (a scan)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(max(n, -(-rows.count() // TEXTS)), key)


def r6(c):
    """Round a float result to 6 places (order-insensitive value hashes)."""
    return F.round(c, 6)


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 split of the cleaned reviews, strata (dataset_name, rating)."""
    from revlens.operators.sampling import stratified_split
    return stratified_split(cleaned(spark, sf_dir), ["dataset_name", "rating"])
