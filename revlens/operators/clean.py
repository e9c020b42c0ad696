"""Unify the review sources and clean the review table.

Every function is ``DataFrame -> DataFrame`` and usable with ``df.transform``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as T

UNIFIED_COLUMNS = ("review_id", "review", "review_translate", "rating", "entity_name",
                   "dataset_name", "title_translate")


def unify_market(df: DataFrame, tag: str = "market") -> DataFrame:
    """C1 + C2 + C3: marketplace rows, entity taken from the product link."""
    return df.select(
        "review_id",
        F.col("comment").alias("review"),
        F.col("translate").alias("review_translate"),
        F.col("rating").cast("double").alias("rating"),
        T.path_segment("prod_link", -3).alias("entity_name"),
        F.lit(tag).alias("dataset_name"))


def unify_hotels(df: DataFrame, tag: str = "hotels") -> DataFrame:
    return df.select(
        "review_id", "review",
        F.col("translate").alias("review_translate"),
        F.col("overall_rating").cast("double").alias("rating"),
        F.col("hotel_name").alias("entity_name"),
        F.lit(tag).alias("dataset_name"))


def unify_restaurants(df: DataFrame, tag: str = "restaurants") -> DataFrame:
    return df.select(
        "review_id", "review", "title_translate", "review_translate",
        F.col("overall_rating").cast("double").alias("rating"),
        F.col("name").alias("entity_name"),
        F.lit(tag).alias("dataset_name"))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unify(sources: dict[str, DataFrame]) -> DataFrame:
    """The four-source concat of the reference as one plan (no shuffle)."""
    parts = [unify_hotels(sources["hotels"]), unify_market(sources["market"]),
             unify_restaurants(sources["restaurants"])]
    return union_by_name(*parts).select(*UNIFIED_COLUMNS)


def basic_filters(df: DataFrame) -> DataFrame:
    """Null-rating / null-review filter, title fill, translated flag."""
    return (df.filter(F.col("rating").isNotNull())
            .withColumn("title_translate", F.coalesce(F.col("title_translate"), F.lit("")))
            .filter(F.col("review").isNotNull())
            .withColumn("translated", ~F.col("review").eqNullSafe(F.col("review_translate"))))


def percentile_filter(df: DataFrame, column: str = "review_translate", q: float = 0.002) -> DataFrame:
    """keep rows whose text length is strictly above the q-quantile.

    The threshold is a scalar subquery (a one-row aggregate run as its own
    job and inlined as a literal), not a join.  Exact ``percentile`` keeps
    one counter per distinct length, so its state is bounded by the
    longest text, not by the row count.
    """
    threshold = df.select(F.percentile(F.length(column), F.lit(q))).scalar()
    return df.filter(F.length(column) > threshold)


def length_filters(df: DataFrame, max_diff: int = 200) -> DataFrame:
    """C12 + C13: sentinel filter and absolute length difference (taken before stripping)."""
    diff = F.abs(F.length("review") - F.length("review_translate"))
    return (df.withColumn("diff_len", diff)
            .filter(F.col("review_translate") != "#ERROR!")
            .filter(F.col("diff_len") < max_diff)
            .drop("diff_len"))


def normalize_text(df: DataFrame, column: str = "review_translate") -> DataFrame:
    """C14-C17: strip + drop empty, delete newlines, pad punctuation, collapse spaces."""
    c = F.col(column)
    return (df.withColumn(column, T.ustrip(c))
            .filter(F.length(column) > 0)
            .withColumn(column, T.drop_newlines(F.col(column)))
            .withColumn(column, T.space_punct_text(F.col(column)))
            .withColumn(column, T.collapse_ws(F.col(column))))


def clean_reviews(df: DataFrame) -> DataFrame:
    """The whole cleaning stage of the reference, in its order."""
    return (df.transform(basic_filters).transform(percentile_filter)
            .transform(length_filters).transform(normalize_text))


def first_kept(df: DataFrame, keys: list[str], order: str = "review_id") -> DataFrame:
    """I4: distinct on ``keys`` keeping the row with the smallest ``order``.

    Done as ``min(struct(order, ...))`` per key: partial aggregation merges
    duplicates map-side, so a key holding a large share of the rows never
    lands in one task as a list (unlike a ``row_number`` window).
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    packed = F.min(F.struct(order, *rest)).alias("_first")
    # the struct buffer makes this a sort-based aggregate: a leading 64-bit
    # hash of the keys settles almost every comparison without reading the
    # (long) text keys
    h = F.xxhash64(*keys).alias("_kh")
    return df.groupBy(h, *keys).agg(packed).select(*keys, "_first.*").select(*df.columns)
