"""Queries of inventory sections C20-C36 (labels, arrays), E (joins),
F1-F12 (aggregations), G (windows, sampling), H (sort) and I (set ops)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import arrays as A
from revlens.functions import text as T
from revlens.operators import clean, sampling
from revlens.operators.ranking import dense_index, rank_within, top_per_group
from revlens.plans.common import cleaned, processed, r6, split_table, unified
from revlens.plans.fixture_sql import FIXTURES, TOKEN_RE, with_fixtures
from revlens.plans.q_clean import sentence_tokens_sql, sentences_sql
from revlens.plans.registry import register
from revlens.sources import fixtures as fx
from revlens.session import bounded_broadcast
from revlens.sources.tables import table

FIXTURES["fx_processed"] = f"""
SELECT *, {sentence_tokens_sql('review_translate_sentences')} AS review_translate_sentences_tokens
FROM (SELECT *, {sentences_sql('review_translate')} AS review_translate_sentences FROM fx_clean)"""

CLASS3_SQL = "CASE WHEN rating < 3 THEN 0 WHEN rating = 3 THEN 1 WHEN rating > 3 THEN 2 END"


def class3(c):
    """C20: rating -> 0 / 1 / 2 (below 3, 3, above 3)."""
    return F.when(c < 3, 0).when(c == 3, 1).when(c > 3, 2)


# ---------------------------------------------------------------- C20-C36

@register("c20_rating_classes", with_fixtures(f"""
SELECT review_id, CAST({CLASS3_SQL} AS INTEGER) AS class012,
       CAST({CLASS3_SQL} + 1 AS INTEGER) AS class123,
       CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS sentiment
FROM fx_clean"""))
def c20(spark, sf_dir):
    """Rating -> three classes in the three encodings of the reference."""
    c = cleaned(spark, sf_dir)
    k = class3(F.col("rating"))
    names = F.create_map(*[F.lit(x) for x in (1, "negative", 2, "negative", 3, "neutral",
                                               4, "positive", 5, "positive")])
    return c.select("review_id", k.cast("int").alias("class012"), (k + 1).cast("int").alias("class123"),
                    F.element_at(names, F.col("rating").cast("int")).alias("sentiment"))


@register("c21_mean_rating_bucket", with_fixtures("""
SELECT dataset_name, entity_name, count(*) AS n, round(avg(rating), 6) AS mean_rating,
       CASE WHEN avg(rating) < 3 THEN '<3' WHEN avg(rating) < 4 THEN '3' ELSE '>3' END AS mapped_rating
FROM fx_clean GROUP BY dataset_name, entity_name"""))
def c21(spark, sf_dir):
    """Mean rating of an entity's reviews mapped to ``<3`` / ``3`` / ``>3``."""
    g = cleaned(spark, sf_dir).groupBy("dataset_name", "entity_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("_m"))
    bucket = F.when(F.col("_m") < 3, "<3").when(F.col("_m") < 4, "3").otherwise(">3")
    return g.select("dataset_name", "entity_name", "n", r6(F.col("_m")).alias("mean_rating"),
                    bucket.alias("mapped_rating"))


C22_SQL = with_fixtures("""
WITH codes AS (SELECT rating, CAST(row_number() OVER (ORDER BY min(review_id)) - 1 AS INTEGER) AS code
               FROM fx_clean GROUP BY rating)
SELECT c.review_id, c.rating, k.code, k2.rating AS decoded
FROM fx_clean c JOIN codes k ON c.rating = k.rating JOIN codes k2 ON k2.code = k.code""")


@register("c22_label_codes", C22_SQL)
def c22(spark, sf_dir):
    """First-appearance label codes and their inverse mapping."""
    c = cleaned(spark, sf_dir)
    codes = sampling.first_appearance_codes(c, "rating")
    codes = bounded_broadcast(codes, 10_000)  # one row per label: never a hot shuffle key
    enc = c.select("review_id", "rating").join(codes, "rating")
    inverse = codes.select(F.col("code"), F.col("rating").alias("decoded"))
    return enc.join(inverse, "code").select("review_id", "rating", "code", "decoded")


@register("c23_label_shift", with_fixtures("""
SELECT review_id, CAST(rating AS INTEGER) - 1 AS y, CAST(rating AS INTEGER) - 1 + 1 AS y_back FROM fx_clean"""))
def c23(spark, sf_dir):
    """Cast to int and shift labels to 0-based before boosting, back after."""
    c = cleaned(spark, sf_dir)
    y = F.col("rating").cast("int") - 1
    return c.select("review_id", y.alias("y"), (y + 1).alias("y_back"))


C24_TEXT_SQL = """CASE WHEN (id + m) % 23 = 0 THEN 'None'
       WHEN id % 29 = 0 THEN '[0.6, oops]'
       ELSE '[' || array_to_string(list_transform(p, lambda x: CAST(x AS VARCHAR)), ', ') || ']' END"""


@register("c24_list_text_parse", with_fixtures(f"""
WITH t AS (SELECT id, m, {C24_TEXT_SQL} AS proba_text
           FROM (SELECT id, m, list_transform(range(0, 5), lambda k: CASE WHEN k = y_pred THEN 0.6 ELSE 0.1 END) AS p
                 FROM fx_predictions)),
share AS (SELECT avg(CASE WHEN starts_with(proba_text, '[') AND ends_with(proba_text, ']') THEN 1.0 ELSE 0.0 END) AS s FROM t)
SELECT id, m, CASE WHEN s <= 0.8 THEN proba_text END AS proba_text, CASE WHEN s > 0.8 THEN TRY_CAST(proba_text AS DOUBLE[]) END AS proba FROM t, share
WHERE share.s <= 0.8 OR TRY_CAST(proba_text AS DOUBLE[]) IS NOT NULL
  AND len(list_filter(TRY_CAST(proba_text AS DOUBLE[]), lambda x: x IS NULL)) = 0"""))
def c24(spark, sf_dir):
    """Text columns that look like lists (>80% ``[...]``) parsed, failing rows dropped; any other column stays text with all its rows."""
    p = fx.fx_predictions(spark, sf_dir)
    txt = (F.when((F.col("id") + F.col("m")) % 23 == 0, F.lit("None"))
           .when(F.col("id") % 29 == 0, F.lit("[0.6, oops]"))
           .otherwise(F.concat(F.lit("["), F.array_join(F.transform("y_predicted_proba", lambda x: x.cast("string")), ", "),
                               F.lit("]"))))
    t = p.select("id", "m", txt.alias("proba_text"))
    looks = (F.col("proba_text").startswith("[") & F.col("proba_text").endswith("]")).cast("double")
    share = t.select(F.avg(looks)).scalar()
    parsed = F.from_json(F.replace(F.col("proba_text"), F.lit("None"), F.lit("null")), "array<double>")
    out = t.select("id", "m", F.when(share <= 0.8, F.col("proba_text")).alias("proba_text"), F.when(share > 0.8, parsed).alias("proba"))
    return out.filter((share <= 0.8) | F.col("proba").isNotNull())


@register("c25_drop_columns", with_fixtures(
    "SELECT * EXCLUDE (review, review_translate, title_translate) FROM fx_clean"))
def c25(spark, sf_dir):
    """Columns dropped by a name pattern (``review*``, ``title*``)."""
    import re
    c = cleaned(spark, sf_dir)
    return c.drop(*[n for n in c.columns if re.match(r"^(review_?(translate)?$|title)", n)])


@register("c26_compound_predicate", with_fixtures("""
SELECT review_id FROM fx_reviews
WHERE (dataset_name = 'market' AND rating IN (1, 2)) OR (dataset_name <> 'market' AND lang IN ('en', 'de'))"""))
def c26(spark, sf_dir):
    """Compound boolean predicates with ``isin``."""
    r = fx.fx_reviews(spark, sf_dir)
    p = (((F.col("dataset_name") == "market") & F.col("rating").isin(1.0, 2.0)) |
         ((F.col("dataset_name") != "market") & F.col("lang").isin("en", "de")))
    return r.filter(p).select("review_id")


VOTES_SQL = """
SELECT id, [count_if(y_pred = 0), count_if(y_pred = 1), count_if(y_pred = 2), count_if(y_pred = 3),
            count_if(y_pred = 4)] AS votes
FROM fx_predictions GROUP BY id"""


@register("c27_argmax_first", with_fixtures(f"""
SELECT id, votes, CAST(list_position(votes, list_max(votes)) - 1 AS INTEGER) AS winner
FROM ({VOTES_SQL})"""))
def c27(spark, sf_dir):
    """Arg-max (first maximum) of per-class ensemble vote counts."""
    p = fx.fx_predictions(spark, sf_dir)
    votes = F.array(*[F.count_if(F.col("y_pred") == k) for k in range(5)])
    v = p.groupBy("id").agg(votes.alias("votes"))
    return v.select("id", "votes", A.argmax_first(F.col("votes")).alias("winner"))


UNANIMOUS_SQL = """
SELECT id, min(y_true) AS y_true, min(y_pred) AS y_pred,
       min(y_pred) = max(y_pred) AND min(y_pred) <> min(y_true) AS unanimous_error
FROM fx_predictions GROUP BY id"""


@register("c28_unanimous_error", with_fixtures(UNANIMOUS_SQL))
def c28(spark, sf_dir):
    """All members agree and differ from the truth; min = max instead of a list."""
    from revlens.operators.metrics import unanimous_errors
    return unanimous_errors(fx.fx_predictions(spark, sf_dir))


@register("c29_large_error", with_fixtures(
    "SELECT id, m, y_true, y_pred FROM fx_predictions WHERE abs(y_true - y_pred) > 1"))
def c29(spark, sf_dir):
    """Predictions more than one class away from the truth."""
    p = fx.fx_predictions(spark, sf_dir)
    return p.filter(F.abs(F.col("y_true") - F.col("y_pred")) > 1).select("id", "m", "y_true", "y_pred")


@register("c30_onehot_smoothed", with_fixtures(f"""
SELECT review_id,
       list_transform(range(0, 3), lambda i: CASE WHEN i = {CLASS3_SQL} THEN 1.0 ELSE 0.0 END) AS onehot,
       list_transform(range(0, 3), lambda i: CASE WHEN i = {CLASS3_SQL} THEN 1 - 0.3 + 0.3 / 3 ELSE 0.3 / 3 END) AS smoothed
FROM fx_clean"""))
def c30(spark, sf_dir):
    """One-hot and label-smoothed (e = 0.3) targets over three classes."""
    c = cleaned(spark, sf_dir)
    y = class3(F.col("rating"))
    return c.select("review_id", A.one_hot(y, 3).alias("onehot"), A.one_hot(y, 3, 0.3).alias("smoothed"))


@register("c31_first_sentence_join", with_fixtures("""
SELECT review_id, array_to_string(review_translate_sentences_tokens[1], ' ') AS first_sentence
FROM fx_processed"""))
def c31(spark, sf_dir):
    """First sentence's tokens joined back to a string."""
    p = processed(spark, sf_dir)
    return p.select("review_id", F.array_join(F.element_at("review_translate_sentences_tokens", 1), " ")
                    .alias("first_sentence"))


@register("c32_flatten", with_fixtures("""
SELECT review_id, CAST(len(flatten(review_translate_sentences_tokens)) AS BIGINT) AS n_tokens,
       flatten(review_translate_sentences_tokens)[-1] AS last_token
FROM fx_processed"""))
def c32(spark, sf_dir):
    """Nested token lists flattened."""
    p = processed(spark, sf_dir).withColumn("_f", F.flatten("review_translate_sentences_tokens"))
    return p.select("review_id", F.size("_f").cast("bigint").alias("n_tokens"),
                    F.element_at("_f", -1).alias("last_token"))


@register("c33_pad_truncate", with_fixtures("""
SELECT review_id,
       CASE WHEN len(ids) > 300 THEN ids[len(ids) - 299:]
            ELSE list_concat(ids, list_transform(range(300 - len(ids)), lambda x: 0)) END AS padded
FROM (SELECT review_id, list_transform(flatten(review_translate_sentences_tokens),
                                       lambda t: CAST(length(t) AS INTEGER)) AS ids FROM fx_processed)"""))
def c33(spark, sf_dir):
    """Post-pad to 300 with 0; longer sequences keep their last 300 ids."""
    p = processed(spark, sf_dir)
    ids = F.transform(F.flatten("review_translate_sentences_tokens"), lambda t: F.length(t).cast("int"))
    return p.select("review_id", A.pad_truncate(ids, 300).alias("padded"))


@register("c34_nested_lengths", with_fixtures("""
SELECT review_id, CAST(len(review_translate_sentences) AS INTEGER) AS n_sentences,
       list_transform(review_translate_sentences_tokens, lambda s: CAST(len(s) AS INTEGER)) AS sentence_lengths
FROM fx_processed"""))
def c34(spark, sf_dir):
    """Array length and nested lengths."""
    p = processed(spark, sf_dir)
    return p.select("review_id", F.size("review_translate_sentences").alias("n_sentences"),
                    F.transform("review_translate_sentences_tokens", F.size).alias("sentence_lengths"))


@register("c35_log_lengths", with_fixtures("""
SELECT review_id, round(log10(length(review_translate)), 6) AS log10_len,
       round(ln(1 + abs(length(review) - length(review_translate))), 6) AS log1p_diff
FROM fx_reviews WHERE length(review_translate) > 0"""))
def c35(spark, sf_dir):
    """log10 of lengths and log1p of length differences."""
    r = fx.fx_reviews(spark, sf_dir).filter(F.length("review_translate") > 0)
    return r.select("review_id", r6(F.log10(F.length("review_translate"))).alias("log10_len"),
                    r6(F.log1p(F.abs(F.length("review") - F.length("review_translate")))).alias("log1p_diff"))


@register("c36_dense_ids", with_fixtures("""
SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS idx FROM fx_clean"""))
def c36(spark, sf_dir):
    """Consecutive 0-based ids after filtering (range-partitioned, no single-task window)."""
    return dense_index(cleaned(spark, sf_dir).select("review_id"), ["review_id"])


# ---------------------------------------------------------------- E: joins

@register("e01_inner_join_key", with_fixtures("""
SELECT r.review_id, r.rating, l.quality, l.toxic FROM fx_reviews r JOIN labels l ON l.doc_id = r.review_id"""))
def e01(spark, sf_dir):
    """Inner equi-join on the row key (planner picks broadcast or sort-merge)."""
    r = fx.fx_reviews(spark, sf_dir).select("review_id", "rating")
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "review_id")
    return r.join(lab, "review_id").select("review_id", "rating", "quality", "toxic")


EXCLUDED_SQL = f"SELECT id FROM ({UNANIMOUS_SQL}) WHERE unanimous_error"


@register("e02_anti_join_exclusions", with_fixtures(f"""
SELECT review_id, dataset_name FROM fx_clean WHERE review_id NOT IN ({EXCLUDED_SQL})"""))
def e02(spark, sf_dir):
    """Reviews minus the exclusion list (left anti join)."""
    from revlens.operators.metrics import unanimous_errors
    bad = unanimous_errors(fx.fx_predictions(spark, sf_dir)).filter("unanimous_error")
    c = cleaned(spark, sf_dir).select("review_id", "dataset_name")
    return c.join(bad.select(F.col("id").alias("review_id")), "review_id", "left_anti")


@register("e03_semi_join", with_fixtures("""
SELECT review_id, dataset_name FROM fx_clean WHERE review_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def e03(spark, sf_dir):
    """Rows whose key is in another table (left semi join)."""
    good = table(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 1")
    c = cleaned(spark, sf_dir).select("review_id", "dataset_name")
    return c.join(good.select(F.col("doc_id").alias("review_id")), "review_id", "left_semi")


E04_SQL = with_fixtures("SELECT id, min(y_true) AS y_true, " + ", ".join(
    f"max(CASE WHEN m = {i} THEN y_pred END) AS m{i}" for i in range(9)) + " FROM fx_predictions GROUP BY id")


@register("e04_members_wide", E04_SQL)
def e04(spark, sf_dir):
    """n-way join of member predictions as one union and one aggregate (one shuffle)."""
    p = fx.fx_predictions(spark, sf_dir)
    member = [F.max(F.when(F.col("m") == i, F.col("y_pred"))).alias(f"m{i}") for i in range(9)]
    return p.groupBy("id").agg(F.min("y_true").alias("y_true"), *member)


@register("e05_attach_by_id", with_fixtures(f"""
SELECT c.review_id, c.rating, t.n_tokens FROM fx_clean c
JOIN (SELECT review_id, CAST(len(regexp_extract_all(review, '{TOKEN_RE}')) AS BIGINT) AS n_tokens FROM fx_reviews) t
ON c.review_id = t.review_id"""))
def e05(spark, sf_dir):
    """Columns computed elsewhere attached by key, not by position."""
    t = fx.fx_reviews(spark, sf_dir).select("review_id", F.size(T.tokenize("review")).cast("bigint").alias("n_tokens"))
    return cleaned(spark, sf_dir).select("review_id", "rating").join(t, "review_id")


E06_SQL = with_fixtures("""
WITH res AS (SELECT url AS link, length(html) % 7 <> 0 AS ok FROM pages WHERE contains(html, '<div class="ad">'))
SELECT c.page_id, CASE WHEN NOT c.parsed THEN coalesce(r.ok, false) ELSE c.parsed END AS parsed
FROM fx_crawl c LEFT JOIN res r ON c.link = r.link""")


@register("e06_lookup_default_state", E06_SQL)
def e06(spark, sf_dir):
    """Lookup with default, applied only to rows still in the unparsed state."""
    c = fx.fx_crawl(spark, sf_dir)
    # crawl results exist only for pages whose saved html has an ad block
    res = (table(spark, sf_dir, "pages", "url", "html").filter(F.col("html").contains('<div class="ad">'))
           .select(F.col("url").alias("link"), (F.length("html") % 7 != 0).alias("ok")))
    j = c.join(res, "link", "left")
    return j.select("page_id", F.when(~F.col("parsed"), F.coalesce("ok", F.lit(False)))
                    .otherwise(F.col("parsed")).alias("parsed"))


# ---------------------------------------------------------------- F: aggregations

@register("f01_value_counts", with_fixtures("""
SELECT dataset_name, rating, count(*) AS n FROM fx_clean GROUP BY dataset_name, rating"""))
def f01(spark, sf_dir):
    """Frequency of values (partial aggregation before the shuffle)."""
    return cleaned(spark, sf_dir).groupBy("dataset_name", "rating").agg(F.count(F.lit(1)).alias("n"))


@register("f02_split_strata_counts", with_fixtures("""
SELECT split, dataset_name, rating, count(*) AS n FROM fx_split GROUP BY split, dataset_name, rating"""))
def f02(spark, sf_dir):
    """Counts per split x dataset x rating (split balance check)."""
    return split_table(spark, sf_dir).groupBy("split", "dataset_name", "rating").agg(
        F.count(F.lit(1)).alias("n"))


@register("f03_distinct_count", with_fixtures("""
SELECT dataset_name, count(DISTINCT entity_name) AS n_entities FROM fx_clean GROUP BY dataset_name"""))
def f03(spark, sf_dir):
    """Distinct entity count per dataset."""
    return cleaned(spark, sf_dir).groupBy("dataset_name").agg(
        F.countDistinct("entity_name").alias("n_entities"))


F04_COLS = ("review", "review_translate", "rating", "entity_name", "dataset_name", "title_translate")


@register("f04_null_counts", with_fixtures("SELECT " + ", ".join(
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in F04_COLS) + " FROM fx_unified"))
def f04(spark, sf_dir):
    """Null count of every column in one pass."""
    u = unified(spark, sf_dir)
    return u.select(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in F04_COLS])


@register("f05_length_stats", with_fixtures("""
SELECT max(length(review_translate)) AS max_len, min(length(review_translate)) AS min_len,
       round(avg(length(review_translate)), 6) AS mean_len,
       round(quantile_cont(length(review_translate), 0.5), 6) AS median_len
FROM fx_clean0"""))
def f05(spark, sf_dir):
    """Max, min, mean and median text length."""
    c = clean.basic_filters(unified(spark, sf_dir))
    L = F.length("review_translate")
    return c.select(F.max(L).alias("max_len"), F.min(L).alias("min_len"), r6(F.avg(L)).alias("mean_len"),
                    r6(F.median(L)).alias("median_len"))


@register("f06_percentiles", """
SELECT round(quantile_cont(length(text), 0.002), 6) AS p0_2, round(quantile_cont(length(text), 0.99), 6) AS p99
FROM documents""")
def f06(spark, sf_dir):
    """Linear-interpolated percentiles 0.2 and 99 (fractions 0.002, 0.99)."""
    d = table(spark, sf_dir, "documents", "text")
    L = F.length("text")
    return d.select(r6(F.percentile(L, F.lit(0.002))).alias("p0_2"), r6(F.percentile(L, F.lit(0.99))).alias("p99"))


@register("f07_percentile_filter", with_fixtures("""
SELECT review_id FROM fx_clean0
WHERE length(review_translate) > (SELECT quantile_cont(length(review_translate), 0.002) FROM fx_clean0)"""))
def f07(spark, sf_dir):
    """Rows above the 0.2th length percentile (scalar subquery, not a join)."""
    c = clean.basic_filters(unified(spark, sf_dir))
    return clean.percentile_filter(c).select("review_id")


@register("f08_conditional_max", with_fixtures("""
SELECT dataset_name, max(CASE WHEN translated THEN abs(length(review) - length(review_translate)) END) AS max_diff
FROM fx_clean0 GROUP BY dataset_name"""))
def f08(spark, sf_dir):
    """Max over rows meeting a condition."""
    c = clean.basic_filters(unified(spark, sf_dir))
    d = F.abs(F.length("review") - F.length("review_translate"))
    return c.groupBy("dataset_name").agg(F.max(F.when(F.col("translated"), d)).alias("max_diff"))


@register("f09_group_positions", with_fixtures("""
SELECT dataset_name, entity_name, review_id, rating,
       row_number() OVER (PARTITION BY dataset_name, entity_name ORDER BY review_id) - 1 AS pos,
       count(*) OVER (PARTITION BY dataset_name, entity_name) AS n
FROM fx_clean"""))
def f09(spark, sf_dir):
    """Group-to-lists kept long: each review with its list position and list size.

    A list per entity would put a hot entity into one row; positions carry
    the same information and stay distributed."""
    c = cleaned(spark, sf_dir).select("dataset_name", "entity_name", "review_id", "rating")
    r = rank_within(c, ["dataset_name", "entity_name"], ["review_id"], pos="pos", size="n")
    return r.select("dataset_name", "entity_name", "review_id", "rating", "pos", "n")


@register("f10_group_size_filter", with_fixtures("""
SELECT dataset_name, entity_name, count(*) AS n FROM fx_clean
GROUP BY dataset_name, entity_name HAVING count(*) > 10"""))
def f10(spark, sf_dir):
    """Entities with more than 10 reviews (HAVING), over all splits of the fixture."""
    s = cleaned(spark, sf_dir)
    return (s.groupBy("dataset_name", "entity_name").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 10))


@register("f12_class_weights", with_fixtures("""
SELECT rating, count(*) AS n_c, round((SELECT count(*) FROM fx_clean) / ((SELECT count(DISTINCT rating) FROM fx_clean) * count(*)), 6) AS weight
FROM fx_clean GROUP BY rating"""))
def f12(spark, sf_dir):
    """Balanced class weights ``n / (k * n_c)``."""
    w = sampling.balanced_class_weights(cleaned(spark, sf_dir), "rating")
    return w.select("rating", "n_c", r6(F.col("weight")).alias("weight"))


@register("f12_sample_weights", with_fixtures("""
WITH w AS (SELECT rating, (SELECT count(*) FROM fx_clean) / ((SELECT count(DISTINCT rating) FROM fx_clean) * count(*)) AS weight
           FROM fx_clean GROUP BY rating)
SELECT c.review_id, round(w.weight, 6) AS weight FROM fx_clean c JOIN w ON c.rating = w.rating"""))
def f12s(spark, sf_dir):
    """Per-row sample weight from the class weight table (small side of the join)."""
    c = cleaned(spark, sf_dir)
    w = sampling.balanced_class_weights(c, "rating")
    return c.select("review_id", "rating").join(bounded_broadcast(w, 10_000), "rating").select("review_id", r6(F.col("weight")).alias("weight"))


@register("f19_share_true", with_fixtures("""
SELECT dataset_name, round(avg(CASE WHEN translated THEN 1.0 ELSE 0.0 END), 6) AS share_translated
FROM fx_clean GROUP BY dataset_name"""))
def f19(spark, sf_dir):
    """Share of rows meeting a predicate."""
    return cleaned(spark, sf_dir).groupBy("dataset_name").agg(
        r6(F.avg(F.col("translated").cast("double"))).alias("share_translated"))


@register("f20_avg_sentence_length", with_fixtures("""
SELECT dataset_name, round(avg(len(s)), 6) AS avg_sentence_tokens
FROM (SELECT dataset_name, unnest(review_translate_sentences_tokens) AS s FROM fx_processed) GROUP BY dataset_name"""))
def f20(spark, sf_dir):
    """Average sentence length in tokens over nested lists."""
    p = processed(spark, sf_dir).select("dataset_name", F.explode("review_translate_sentences_tokens").alias("s"))
    return p.groupBy("dataset_name").agg(r6(F.avg(F.size("s"))).alias("avg_sentence_tokens"))


@register("f21_length_histogram", with_fixtures("""
SELECT CAST(floor(log10(length(review_translate)) / 0.25) AS BIGINT) AS bin, count(*) AS n
FROM fx_clean GROUP BY 1"""))
def f21(spark, sf_dir):
    """Histogram data of log10 text lengths (bin width 0.25)."""
    c = cleaned(spark, sf_dir)
    b = F.floor(F.log10(F.length("review_translate")) / 0.25).cast("bigint")
    return c.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("f24_crawl_success", with_fixtures("""
SELECT link, num_parsed / (num_overall + 1) > 0.8 AS done FROM fx_crawl"""))
def f24(spark, sf_dir):
    """Whole-crawl success ratio ``parsed / (overall + 1) > 0.8``."""
    c = fx.fx_crawl(spark, sf_dir)
    return c.select("link", (F.col("num_parsed") / (F.col("num_overall") + 1) > 0.8).alias("done"))


# ---------------------------------------------------------------- G: windows / sampling

@register("g01_stratified_split", with_fixtures("SELECT review_id, split FROM fx_split"))
def g01(spark, sf_dir):
    """Stratified 80/10/10 split per (dataset, rating) in a seeded order."""
    return split_table(spark, sf_dir).select("review_id", "split")


G02_SQL = with_fixtures("""
WITH codes AS (SELECT rating, row_number() OVER (ORDER BY min(review_id)) - 1 AS code, count(*) AS nc
               FROM fx_clean GROUP BY rating),
c2 AS (SELECT rating, nc, coalesce(sum(nc) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
       FROM codes),
r AS (SELECT review_id, rating, row_number() OVER (PARTITION BY rating ORDER BY review_id) - 1 AS pos FROM fx_clean),
a AS (SELECT r.review_id, r.rating, r.pos,
             (c2.s + c2.nc + 4) // 5 - (c2.s + 4) // 5 AS a0,
             (c2.s + c2.nc + 3) // 5 - (c2.s + 3) // 5 AS a1,
             (c2.s + c2.nc + 2) // 5 - (c2.s + 2) // 5 AS a2,
             (c2.s + c2.nc + 1) // 5 - (c2.s + 1) // 5 AS a3
      FROM r JOIN c2 ON r.rating = c2.rating)
SELECT review_id, rating,
       CAST((pos >= a0)::INT + (pos >= a0 + a1)::INT + (pos >= a0 + a1 + a2)::INT
            + (pos >= a0 + a1 + a2 + a3)::INT AS INTEGER) AS fold
FROM a""")


@register("g02_stratified_kfold", G02_SQL)
def g02(spark, sf_dir):
    """Unshuffled stratified 5-fold assignment (contiguous blocks per class)."""
    return sampling.stratified_kfold(cleaned(spark, sf_dir), "rating", 5)


G03_BODY = """
WITH ent AS (SELECT c.dataset_name, c.entity_name, count(*) AS n, avg(c.rating) AS m, min(c.review_id) AS first_id
             FROM fx_clean c
             GROUP BY c.dataset_name, c.entity_name HAVING count(*) > 10),
eb AS (SELECT *, CASE WHEN m < 3 THEN '<3' WHEN m < 4 THEN '3' ELSE '>3' END AS bucket FROM ent),
b AS (SELECT dataset_name, bucket, count(*) AS size, min(entity_name) AS first_entity FROM eb GROUP BY dataset_name, bucket),
bo AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY first_entity) - 1 AS i,
              count(*) OVER (PARTITION BY dataset_name) AS nb FROM b),
t0 AS (SELECT dataset_name, least(size, 15 // nb) AS take0, 15 - least(size, 15 // nb) AS rem FROM bo WHERE i = 0),
t1 AS (SELECT bo.dataset_name, least(bo.size, t0.rem // (bo.nb - 1)) AS take1, t0.rem - least(bo.size, t0.rem // (bo.nb - 1)) AS rem
       FROM bo JOIN t0 ON bo.dataset_name = t0.dataset_name WHERE bo.i = 1),
t2 AS (SELECT bo.dataset_name, least(bo.size, t1.rem // (bo.nb - 2)) AS take2
       FROM bo JOIN t1 ON bo.dataset_name = t1.dataset_name WHERE bo.i = 2),
q AS (SELECT bo.dataset_name, bo.bucket, CASE bo.i WHEN 0 THEN t0.take0 WHEN 1 THEN t1.take1 ELSE t2.take2 END AS take
      FROM bo LEFT JOIN t0 ON bo.dataset_name = t0.dataset_name LEFT JOIN t1 ON bo.dataset_name = t1.dataset_name
      LEFT JOIN t2 ON bo.dataset_name = t2.dataset_name),
ranked AS (SELECT eb.*, row_number() OVER (PARTITION BY eb.dataset_name, eb.bucket
                                           ORDER BY (eb.first_id * 7919 + 13) % 10007, eb.first_id) - 1 AS pos FROM eb)
SELECT r.dataset_name, r.entity_name, r.bucket AS mapped_rating, r.n
FROM ranked r JOIN q ON r.dataset_name = q.dataset_name AND r.bucket = q.bucket WHERE r.pos < q.take"""
G03_SQL = with_fixtures(G03_BODY)


@register("g03_quota_sample", G03_SQL)
def g03(spark, sf_dir):
    """15 entities per dataset spread over mean-rating buckets, quota carried on."""
    from revlens.operators.explain import sample_entities
    return sample_entities(cleaned(spark, sf_dir), per_dataset=15, min_reviews=10)


@register("g04_position_in_split", with_fixtures("""
SELECT review_id, split, row_number() OVER (PARTITION BY split ORDER BY review_id) - 1 AS pos FROM fx_split"""))
def g04(spark, sf_dir):
    """Row position inside its split."""
    s = split_table(spark, sf_dir).select("review_id", "split")
    return rank_within(s, ["split"], ["review_id"], pos="pos", size=None)


@register("g06_top_n_per_group", with_fixtures("""
SELECT dataset_name, entity_name, review_id, pos FROM (
  SELECT dataset_name, entity_name, review_id,
         row_number() OVER (PARTITION BY dataset_name, entity_name ORDER BY length(review_translate) DESC, review_id) - 1 AS pos
  FROM fx_clean) WHERE pos < 3"""))
def g06(spark, sf_dir):
    """Top 3 longest reviews per entity (total order: length desc, id)."""
    c = cleaned(spark, sf_dir).select("dataset_name", "entity_name", "review_id",
                                      F.length("review_translate").alias("_len"))
    t = top_per_group(c, ["dataset_name", "entity_name"], [F.col("_len").desc(), "review_id"], 3, pos="pos")
    return t.select("dataset_name", "entity_name", "review_id", "pos")


@register("g07_group_cap", """
SELECT host, page_id FROM (
  SELECT string_split(url, '/')[3] AS host, page_id,
         row_number() OVER (PARTITION BY string_split(url, '/')[3] ORDER BY page_id) AS rn FROM pages)
WHERE rn <= 2""")
def g07(spark, sf_dir):
    """Per-group cap: the first 2 pages of each site."""
    p = table(spark, sf_dir, "pages", "page_id", "url").select(
        F.get(F.split("url", "/"), 2).alias("host"), "page_id")
    return top_per_group(p, ["host"], ["page_id"], 2).select("host", "page_id")


@register("g08_dataset_split_sets", with_fixtures("""
SELECT s.dataset_name, s.split, count(*) AS n, round(avg(s.rating), 6) AS mean_rating,
       min(s.review_id) AS first_id, max(s.review_id) AS last_id
FROM fx_split s GROUP BY s.dataset_name, s.split"""))
def g08(spark, sf_dir):
    """Per-dataset train / val / test sets (one row per set)."""
    s = split_table(spark, sf_dir)
    return s.groupBy("dataset_name", "split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("rating")).alias("mean_rating"),
        F.min("review_id").alias("first_id"), F.max("review_id").alias("last_id"))


# ---------------------------------------------------------------- H: sort / sample

@register("h02_sorted_distinct_labels", with_fixtures("SELECT DISTINCT rating FROM fx_clean"))
def h02(spark, sf_dir):
    """Sorted distinct labels."""
    return cleaned(spark, sf_dir).select("rating").distinct().orderBy("rating")


@register("h03_restore_token_order", with_fixtures("""
SELECT review_id, list_transform(list_sort(list(struct_pack(p := pos, t := token))), lambda x: x.t) AS tokens
FROM fx_tokens GROUP BY review_id"""))
def h03(spark, sf_dir):
    """Scored tokens put back in text order (position-keyed sort of each review's tokens)."""
    t = fx.fx_tokens(spark, sf_dir)
    g = t.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_s"))
    return g.select("review_id", F.transform("_s", lambda x: x["token"]).alias("tokens"))


@register("h04_random_example", with_fixtures("""
SELECT rating, review_id FROM (
  SELECT rating, review_id, row_number() OVER (PARTITION BY rating ORDER BY (review_id * 7919 + 13) % 10007, review_id) AS rn
  FROM fx_clean) WHERE rn = 1"""))
def h04(spark, sf_dir):
    """One seeded random example per rating (sampling operator, so a limit of one per group)."""
    c = cleaned(spark, sf_dir).select("rating", "review_id")
    return top_per_group(c, ["rating"], sampling.seeded_order(), 1).select("rating", "review_id")


@register("h05_seeded_shuffle", with_fixtures("""
SELECT review_id, row_number() OVER (ORDER BY (review_id * 7919 + 13) % 10007, review_id) - 1 AS shuffled_pos
FROM fx_clean"""))
def h05(spark, sf_dir):
    """Seeded shuffle as a position in a hash order (distributed sort)."""
    c = cleaned(spark, sf_dir).select("review_id")
    return dense_index(c, sampling.seeded_order(), name="shuffled_pos")


@register("h06_chunks", with_fixtures("""
SELECT review_id, (row_number() OVER (ORDER BY review_id) - 1) // 100 AS chunk FROM fx_clean"""))
def h06(spark, sf_dir):
    """Chunks of 100 consecutive rows."""
    d = dense_index(cleaned(spark, sf_dir).select("review_id"), ["review_id"])
    return d.select("review_id", F.floor(F.col("idx") / 100).cast("bigint").alias("chunk"))


# ---------------------------------------------------------------- I: set operations

@register("i01_union_by_name", with_fixtures("""
SELECT review_id, review AS comment, review_translate AS translate, rating, NULL::VARCHAR AS review,
       NULL::DOUBLE AS overall_rating, NULL::VARCHAR AS hotel_name
FROM fx_reviews WHERE dataset_name = 'market'
UNION ALL
SELECT review_id, NULL, review_translate, NULL, review, rating, entity_name
FROM fx_reviews WHERE dataset_name = 'hotels'"""))
def i01(spark, sf_dir):
    """Union by name of differently shaped sources; missing columns null."""
    s = fx.raw_sources(spark, sf_dir)
    m = s["market"].drop("prod_link")
    return clean.union_by_name(m, s["hotels"])


@register("i03_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def i03(spark, sf_dir):
    """Full-row distinct."""
    return table(spark, sf_dir, "documents", "text", "lang").distinct()


@register("i04_first_kept", with_fixtures("""
SELECT * EXCLUDE (rn) FROM (SELECT review_id, review, entity_name,
  row_number() OVER (PARTITION BY review, entity_name ORDER BY review_id) AS rn FROM fx_reviews) WHERE rn = 1"""))
def i04(spark, sf_dir):
    """Distinct on a key subset keeping the first row (min-struct aggregate)."""
    r = fx.fx_reviews(spark, sf_dir).select("review_id", "review", "entity_name")
    return clean.first_kept(r, ["review", "entity_name"])


@register("i05_todo_difference", with_fixtures("""
SELECT link FROM fx_crawl EXCEPT SELECT link FROM fx_crawl WHERE parsed"""))
def i05(spark, sf_dir):
    """All work minus finished work (EXCEPT DISTINCT on the key)."""
    c = fx.fx_crawl(spark, sf_dir)
    return c.select("link").subtract(c.filter("parsed").select("link"))


@register("c02_source_tag", with_fixtures("""
SELECT dataset_name, count(*) AS n FROM fx_unified GROUP BY dataset_name"""))
def c02(spark, sf_dir):
    """Constant source tag added to each source before the union."""
    return unified(spark, sf_dir).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))


@register("e08_inverse_label_map", with_fixtures("""
WITH codes AS (SELECT rating, CAST(row_number() OVER (ORDER BY min(review_id)) - 1 AS INTEGER) AS code
               FROM fx_clean GROUP BY rating)
SELECT p.id, p.m, k.rating AS y_pred_rating FROM fx_predictions p JOIN codes k ON k.code = p.y_pred"""))
def e08(spark, sf_dir):
    """Predicted codes mapped back through the inverse label table (small side of the join)."""
    codes = sampling.first_appearance_codes(cleaned(spark, sf_dir), "rating")
    p = fx.fx_predictions(spark, sf_dir).select("id", "m", "y_pred")
    return p.join(bounded_broadcast(codes, 10_000).select(F.col("code").alias("y_pred"), F.col("rating").alias("y_pred_rating")), "y_pred").select(
        "id", "m", "y_pred_rating")


@register("i02_union_group_results", with_fixtures("""
SELECT dataset_name, split, count(*) AS n FROM fx_split WHERE dataset_name = 'hotels' GROUP BY ALL
UNION ALL SELECT dataset_name, split, count(*) FROM fx_split WHERE dataset_name = 'market' GROUP BY ALL
UNION ALL SELECT dataset_name, split, count(*) FROM fx_split WHERE dataset_name = 'restaurants' GROUP BY ALL"""))
def i02(spark, sf_dir):
    """Per-group results unioned (one plan: each branch reads the shared split table)."""
    s = split_table(spark, sf_dir)
    parts = [s.filter(F.col("dataset_name") == d).groupBy("dataset_name", "split").agg(F.count(F.lit(1)).alias("n"))
             for d in ("hotels", "market", "restaurants")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
