"""Queries of section L (user functions), each checked against a SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.functions import udfs as U
from revlens.operators import tokens as K
from revlens.plans.common import cleaned, r6
from revlens.plans.fixture_sql import with_fixtures
from revlens.plans.q_text import D12_STOP, _sql_str_list, placed_tokens
from revlens.plans.registry import register
from revlens.sources import fixtures as fx


@register("l01_row_function", with_fixtures("""
SELECT review_id, CAST(list_max(list_transform(string_split(review, ' '), lambda w: length(w))) AS INTEGER) AS longest_word
FROM fx_reviews"""))
def l01(spark, sf_dir):
    """Python row function (longest word of a text) as a pandas UDF."""
    r = fx.fx_reviews(spark, sf_dir)
    return r.select("review_id", U.longest_word_udf("review").alias("longest_word"))


@register("l02_batch_function_extras", with_fixtures(f"""
SELECT review_id, list_filter(regexp_extract_all(lower(review_translate), '{T.TOKEN_PATTERN.replace("'", "''")}'),
                              lambda x: NOT list_contains({_sql_str_list(D12_STOP)}, x)) AS tokens
FROM fx_clean"""))
def l02(spark, sf_dir):
    """Iterator pandas UDF with an extra input (stop-word set) loaded once per task."""
    c = cleaned(spark, sf_dir)
    return c.select("review_id", U.remove_words_udf(D12_STOP)(T.tokenize(F.lower("review_translate"))).alias("tokens"))


@register("l03_one_to_many", with_fixtures("SELECT review_id, pos, token FROM fx_tokens"))
def l03(spark, sf_dir):
    """Python table function: one review -> one row per token."""
    r = fx.fx_reviews(spark, sf_dir).select("review_id", "review")
    return U.TokensUDTF(r.asTable())


@register("l04_partial_operator", with_fixtures("""
SELECT review_id, pos, array_to_string(w, ' ') AS phrase, round(s, 6) AS score FROM (
  SELECT review_id, pos, list(token) OVER win AS w, sum(score) OVER win AS s, count(*) OVER win AS c
  FROM fx_scored WINDOW win AS (PARTITION BY review_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
WHERE c = 2"""))
def l04(spark, sf_dir):
    """Partially applied operator (bigrams, summed scores) used through ``df.transform``."""
    bigrams = U.bind(K.scored_ngrams, n=2, agg="sum")
    g = placed_tokens(spark, sf_dir).transform(bigrams)
    return g.select("review_id", "pos", "phrase", r6(F.col("score")).alias("score"))


@register("l05_row_mean_expression", with_fixtures("""
SELECT review_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))
       / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS row_mean
FROM (SELECT review_id, rating AS a, CASE WHEN review_id % 3 = 0 THEN NULL ELSE CAST(length(review) % 5 AS DOUBLE) END AS b,
             CASE WHEN review_id % 4 = 0 THEN NULL ELSE CAST(review_id % 7 AS DOUBLE) END AS c FROM fx_reviews)"""))
def l05(spark, sf_dir):
    """Row-wise ``apply(axis=1)`` (mean skipping nulls) as column expressions."""
    r = fx.fx_reviews(spark, sf_dir)
    cols = [F.col("rating"),
            F.when(F.col("review_id") % 3 == 0, F.lit(None)).otherwise((F.length("review") % 5).cast("double")),
            F.when(F.col("review_id") % 4 == 0, F.lit(None)).otherwise((F.col("review_id") % 7).cast("double"))]
    tot = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    cnt = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return r.select("review_id", r6(tot / F.when(cnt > 0, cnt)).alias("row_mean"))


@register("l06_grouped_aggregate_udf", with_fixtures("""
SELECT review_id, round(quantile_cont(length(token), 0.5), 6) AS median_token_len FROM fx_tokens GROUP BY review_id"""))
def l06(spark, sf_dir):
    """Grouped-aggregate pandas UDF (median token length) per review.

    A grouped-aggregate UDF holds a whole group in one task, so it is used
    only for groups bounded by construction (one review's tokens); dataset-
    level statistics use built-in aggregates (``percentile``)."""
    t = fx.fx_tokens(spark, sf_dir)
    return t.groupBy("review_id").agg(r6(U.median_udf(F.length("token").cast("double"))).alias("median_token_len"))
