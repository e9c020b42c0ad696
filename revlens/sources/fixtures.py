"""Review-shaped inputs derived from the driver tables (see FIXTURES.md).

Everything is arithmetic on ids, so the same rows can be produced by the
DuckDB oracle text in ``revlens.plans.fixture_sql``.  Row identity is the
``review_id`` minted here once and carried by every later job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import TOKEN_PATTERN
from revlens.sources.tables import table

# fixed values of the fixture definition
DATASETS = ("hotels", "market", "restaurants")
LEXICON_TAGS = ("NOUN", "VERB", "INFN", "PREP", "CONJ", "NPRO")
N_MEMBERS = 9
N_CLASSES = 5


def _dataset_name(doc_id: Column) -> Column:
    bucket = F.floor(doc_id / 5).cast("bigint") % 10
    return (F.when(bucket < 6, "market").when(bucket < 7, "hotels")
            .otherwise("restaurants"))


def fx_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified review table ``fx_reviews`` of FIXTURES.md."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review"),
        F.when(F.col("doc_id") % 97 == 5, F.lit("#ERROR!"))
         .when(F.col("doc_id") % 2 == 0, F.col("text"))
         .otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("review_translate"),
        F.when(F.col("doc_id") % 53 == 7, F.lit(None).cast("double"))
         .otherwise((1 + F.col("doc_id") % 5).cast("double")).alias("rating"),
        F.col("source").alias("entity_name"),
        _dataset_name(F.col("doc_id")).alias("dataset_name"),
        F.col("lang"),
    )


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three raw source shapes of the reference, one per dataset.

    market: comment / translate / rating / prod_link (entity inside the link);
    hotels: review / translate / overall_rating / hotel_name;
    restaurants: review / title_translate / review_translate / overall_rating / name.
    """
    r = fx_reviews(spark, sf_dir)
    market = r.filter(F.col("dataset_name") == "market").select(
        "review_id",
        F.col("review").alias("comment"),
        F.col("review_translate").alias("translate"),
        "rating",
        F.concat(F.lit("https://shop.example.com/ua/"), F.col("entity_name"),
                 F.lit("/comments/")).alias("prod_link"))
    hotels = r.filter(F.col("dataset_name") == "hotels").select(
        "review_id", "review",
        F.col("review_translate").alias("translate"),
        F.col("rating").alias("overall_rating"),
        F.col("entity_name").alias("hotel_name"))
    restaurants = r.filter(F.col("dataset_name") == "restaurants").select(
        "review_id", "review",
        F.when(F.col("review_id") % 4 == 0, F.lit(None))
         .otherwise(F.substring("review", 1, 12)).alias("title_translate"),
        "review_translate",
        F.col("rating").alias("overall_rating"),
        F.col("entity_name").alias("name"))
    return {"market": market, "hotels": hotels, "restaurants": restaurants}


def fx_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine ensemble members' out-of-fold predictions with planted unanimous errors."""
    d = table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 5).cast("int").alias("y_true"))
    d = d.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(N_MEMBERS - 1))))
    y, i, m = F.col("y_true"), F.col("id"), F.col("m")
    pred = (F.when(i % 13 == 0, (y + 2) % 5)
            .when(i % 17 == 0, (y + 1) % 5)
            .when((i + m) % 7 == 0, (y + 1) % 5)
            .otherwise(y)).cast("int")
    d = d.withColumn("y_pred", pred)
    proba = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
                        lambda k: F.when(k == F.col("y_pred"), F.lit(0.6)).otherwise(F.lit(0.1)))
    return d.select("id", "m", "y_true", "y_pred", proba.alias("y_predicted_proba"))


def fx_tokens(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    """Exploded tokens of every review with a synthetic per-token score."""
    r = reviews if reviews is not None else fx_reviews(spark, sf_dir)
    t = r.select("review_id", F.posexplode(
        F.regexp_extract_all("review", F.lit(TOKEN_PATTERN), 0)).alias("pos", "token"))
    score = ((F.col("review_id") * 7 + F.col("pos") * 13) % 100).cast("double") / 100.0
    return t.select("review_id", F.col("pos").cast("int").alias("pos"), "token",
                    score.alias("score"))


def fx_lexicon(spark: SparkSession, sf_dir: str, tokens: DataFrame | None = None) -> DataFrame:
    """Word -> (POS tag, lemma) lexicon built from the distinct lower-cased tokens."""
    if tokens is None:
        # a text's own repeats go inside its row
        words = F.array_distinct(F.transform(F.regexp_extract_all("review", F.lit(TOKEN_PATTERN), 0), F.lower))
        t = fx_reviews(spark, sf_dir).select(F.explode(words).alias("word"))
    else:
        t = tokens.select(F.lower("token").alias("word"))
    w = t.distinct().filter(F.length("word") > 1)
    tags = F.array(*[F.lit(x) for x in LEXICON_TAGS])
    return w.select("word",
                    F.element_at(tags, (F.length("word") % 6 + 1).cast("int")).alias("pos"),
                    F.substring("word", 1, 4).alias("lemma"))


def fx_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl-state table over the saved pages."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", F.col("url").alias("link"),
                    (F.col("page_id") % 3 == 0).alias("parsed"),
                    (F.col("page_id") % 40).alias("num_overall"),
                    (F.col("page_id") % 37).alias("num_parsed"))
