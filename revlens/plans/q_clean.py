"""Queries of inventory sections A (scan subsets), C (projections, filters,
scalar functions) and the flagship review profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.functions import arrays as A
from revlens.operators import clean
from revlens.plans.common import cleaned, r6, unified
from revlens.plans.fixture_sql import TOKEN_RE, WS, with_fixtures
from revlens.plans.registry import register
from revlens.sources import fixtures as fx
from revlens.sources.tables import table

def ustrip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split_punct_sql(t: str) -> str:
    padded = f"regexp_replace({t}, '([^\\p{{L}}\\p{{N}}''])', ' \\1 ', 'g')"
    return f"list_filter(string_split({ustrip_sql(padded)}, ' '), lambda x: x <> '')"


def sentences_sql(t: str) -> str:
    return (f"string_split(regexp_replace({t}, '([.!?]) ([^.!? ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))")


def sentence_tokens_sql(s: str) -> str:
    return (f"list_transform({s}, lambda s: flatten(list_transform(regexp_extract_all(s, '{TOKEN_RE}'), "
            f"lambda t: {split_punct_sql('t')})))")


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = with_fixtures(f"""
SELECT dataset_name, rating, count(*) AS n_reviews,
       round(avg(n_tok), 6) AS avg_tokens, count(DISTINCT entity_name) AS n_entities,
       max(n_tok) AS max_tokens
FROM (SELECT dataset_name, rating, entity_name,
             CAST(len(regexp_extract_all(review_translate, '{TOKEN_RE}')) AS BIGINT) AS n_tok
      FROM fx_dedup)
GROUP BY dataset_name, rating""")


@register("flagship_review_profile", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Sources -> unified -> cleaned -> first-kept dedup -> tokens -> profile per (dataset, rating)."""
    # only the columns the profile needs travel through the dedup aggregate
    c = cleaned(spark, sf_dir).select("review_id", "review_translate", "entity_name", "dataset_name", "rating")
    df = clean.first_kept(c, ["review_translate", "entity_name"])
    df = df.withColumn("n_tok", F.size(T.tokenize("review_translate")).cast("bigint"))
    return (df.groupBy("dataset_name", "rating")
            .agg(F.count(F.lit(1)).alias("n_reviews"), r6(F.avg("n_tok")).alias("avg_tokens"),
                 F.countDistinct("entity_name").alias("n_entities"),
                 F.max("n_tok").alias("max_tokens")))


# ---------------------------------------------------------------- A: scans

@register("a02_usecols", "SELECT doc_id, source FROM documents")
def a02(spark, sf_dir):
    """Column-subset scan: only two columns reach the Parquet reader."""
    return table(spark, sf_dir, "documents", "doc_id", "source")


@register("a03_conform_to_header", with_fixtures("""
SELECT review_id, review, translate AS review_translate, overall_rating AS rating,
       hotel_name AS entity_name, CAST(NULL AS VARCHAR) AS dataset_name,
       CAST(NULL AS VARCHAR) AS title_translate
FROM (SELECT review_id, review, review_translate AS translate, rating AS overall_rating,
             entity_name AS hotel_name FROM fx_reviews WHERE dataset_name = 'hotels')"""))
def a03(spark, sf_dir):
    """Rows of one source conformed to the unified header; missing columns null."""
    target = unified(spark, sf_dir).schema
    hotels = fx.raw_sources(spark, sf_dir)["hotels"].withColumnsRenamed(
        {"translate": "review_translate", "overall_rating": "rating", "hotel_name": "entity_name"})
    return A.conform(hotels, target)


@register("a07_repeated_header", with_fixtures("""
SELECT id, m, y_pred FROM (
  SELECT CAST(id AS VARCHAR) AS id, CAST(m AS VARCHAR) AS m, CAST(y_pred AS VARCHAR) AS y_pred FROM fx_predictions
  UNION ALL SELECT DISTINCT 'id', 'm', 'y_pred' FROM fx_predictions)
WHERE id <> 'id'"""))
def a07(spark, sf_dir):
    """Appended text files repeat their header; header rows are removed."""
    p = fx.fx_predictions(spark, sf_dir)
    as_text = p.select(*[F.col(c).cast("string").alias(c) for c in ("id", "m", "y_pred")])
    headers = p.select("m").distinct().select(F.lit("id").alias("id"), F.lit("m").alias("m"),
                                               F.lit("y_pred").alias("y_pred"))
    return as_text.unionByName(headers).filter(F.col("id") != "id")


# ---------------------------------------------------------------- C: projections / filters

@register("c01_unify_sources", with_fixtures("SELECT * FROM fx_unified"))
def c01(spark, sf_dir):
    """C1 + C2 + I1: select/rename each source, tag it, union by name."""
    return unified(spark, sf_dir)


@register("c03_path_segment", """
SELECT page_id, string_split(url, '/')[-3] AS seg_m3, string_split(url, '/')[-9] AS seg_m9,
       string_split(string_split(url, '/')[-1], '.')[1] AS stem
FROM pages""")
def c03(spark, sf_dir):
    """``split('/')[-3]`` (null when too few parts) and the file stem of a path."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", T.path_segment("url", -3).alias("seg_m3"),
                    T.path_segment("url", -9).alias("seg_m9"), T.file_stem("url").alias("stem"))


C04_SQL = """
SELECT page_id, href,
       CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN href
            WHEN starts_with(href, '/') THEN root || href
            ELSE root || '/' || href END AS link
FROM (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS root,
             unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@register("c04_resolve_url", C04_SQL)
def c04(spark, sf_dir):
    """Every anchor href of every page, resolved against the page's site root."""
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    e = p.select("page_id", T.site_root("url").alias("root"),
                 F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return e.select("page_id", "href", T.resolve_url(F.col("root"), "href").alias("link"))


@register("c05_strip_ordinal", """
SELECT page_id, trim(array_to_string(string_split(t, '.')[2:], '.')) AS title
FROM (SELECT page_id, CAST(page_id % 30 + 1 AS VARCHAR) || '. ' || regexp_extract(html, '<title>(.*?)</title>', 1) AS t
      FROM pages)""")
def c05(spark, sf_dir):
    """``'12. Name. Two'`` -> ``'Name. Two'`` over numbered page titles."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    t = F.concat((F.col("page_id") % 30 + 1).cast("string"), F.lit(". "),
                 F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return p.select("page_id", T.strip_ordinal(t).alias("title"))


@register("c06_locale_number", with_fixtures("""
SELECT review_id, phrase,
       TRY_CAST(replace(trim(regexp_split_to_array(phrase, 'of|из')[1]), ',', '.') AS DOUBLE) AS value
FROM (SELECT review_id, CAST(CAST(rating AS BIGINT) AS VARCHAR) || ',' || CAST(review_id % 10 AS VARCHAR)
             || CASE WHEN review_id % 2 = 0 THEN ' of 5' ELSE ' из 5' END AS phrase
      FROM fx_reviews WHERE rating IS NOT NULL)"""))
def c06(spark, sf_dir):
    """Locale numbers in rating phrases: ``4,5 of 5`` / ``3,0 из 5``."""
    r = fx.fx_reviews(spark, sf_dir).filter(F.col("rating").isNotNull())
    phrase = F.concat(F.col("rating").cast("bigint").cast("string"), F.lit(","),
                      (F.col("review_id") % 10).cast("string"),
                      F.when(F.col("review_id") % 2 == 0, F.lit(" of 5")).otherwise(F.lit(" из 5")))
    r = r.select("review_id", phrase.alias("phrase"))
    return r.select("review_id", "phrase", T.locale_number("phrase").alias("value"))


@register("c07_char_replace", "SELECT page_id, replace(url, '/', '\\') AS title FROM pages")
def c07(spark, sf_dir):
    """Path separators in titles replaced by backslashes."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", F.replace(F.col("url"), F.lit("/"), F.lit("\\")).alias("title"))


@register("c08_page_url", """
SELECT page_id,
       split_part(u, 'Reviews', 1) || 'Reviews-or' || CAST((page_id % 7) * 5 AS VARCHAR) || split_part(u, 'Reviews', 2) AS hotel_page,
       split_part(u, 'Reviews', 1) || 'Reviews-or' || CAST((page_id % 7) * 10 AS VARCHAR) || split_part(u, 'Reviews', 2) AS restaurant_page
FROM (SELECT page_id, 'https://www.example.com/Hotel_Review-g1-d' || CAST(page_id AS VARCHAR) || '-Reviews-'
             || string_split(url, '/')[3] || '.html' AS u FROM pages)""")
def c08(spark, sf_dir):
    """Pagination URL rewrite with 5 (hotels) or 10 (restaurants) reviews per page."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    u = F.concat(F.lit("https://www.example.com/Hotel_Review-g1-d"), F.col("page_id").cast("string"),
                 F.lit("-Reviews-"), F.element_at(F.split("url", "/"), 3), F.lit(".html"))
    n = F.col("page_id") % 7
    return p.select("page_id", T.page_url(u, n, 5).alias("hotel_page"),
                    T.page_url(u, n, 10).alias("restaurant_page"))


@register("c09_null_filter", with_fixtures(
    "SELECT review_id, rating FROM fx_unified WHERE rating IS NOT NULL AND review IS NOT NULL"))
def c09(spark, sf_dir):
    """Rows with a null rating or review dropped."""
    return unified(spark, sf_dir).na.drop(subset=["rating", "review"]).select("review_id", "rating")


@register("c10_null_fill", with_fixtures(
    "SELECT review_id, coalesce(title_translate, '') AS title_translate FROM fx_unified"))
def c10(spark, sf_dir):
    """Missing titles filled with the empty string."""
    return unified(spark, sf_dir).na.fill("", subset=["title_translate"]).select("review_id", "title_translate")


@register("c11_translated_flag", with_fixtures(
    "SELECT review_id, NOT (review IS NOT DISTINCT FROM review_translate) AS translated FROM fx_unified"))
def c11(spark, sf_dir):
    """``translated = review != review_translate`` with pandas null semantics."""
    u = unified(spark, sf_dir)
    return u.select("review_id", (~F.col("review").eqNullSafe(F.col("review_translate"))).alias("translated"))


@register("c12_sentinel_filter", with_fixtures("""
SELECT review_id, dataset_name FROM fx_reviews
WHERE review_translate <> '#ERROR!' AND coalesce(rating, 1) NOT IN (0, -1)"""))
def c12(spark, sf_dir):
    """Sentinel texts (``#ERROR!``) and sentinel ratings (0, -1) removed."""
    r = fx.fx_reviews(spark, sf_dir)
    return (r.filter(F.col("review_translate") != "#ERROR!")
            .filter(~F.coalesce(F.col("rating"), F.lit(1.0)).isin(0.0, -1.0))
            .select("review_id", "dataset_name"))


@register("c13_length_predicates", with_fixtures("""
SELECT review_id, CAST(abs(length(review) - length(review_translate)) AS BIGINT) AS diff_len
FROM fx_reviews WHERE abs(length(review) - length(review_translate)) < 200 AND length(review) > 100"""))
def c13(spark, sf_dir):
    """Length and absolute length-difference predicates."""
    r = fx.fx_reviews(spark, sf_dir)
    d = F.abs(F.length("review") - F.length("review_translate")).cast("bigint")
    return r.filter((d < 200) & (F.length("review") > 100)).select("review_id", d.alias("diff_len"))


@register("c14_strip_nonempty", with_fixtures(f"""
SELECT review_id, {ustrip_sql('review')} AS review FROM fx_reviews
WHERE length({ustrip_sql('review')}) > 0"""))
def c14(spark, sf_dir):
    """Strip Unicode whitespace and drop empty texts."""
    r = fx.fx_reviews(spark, sf_dir).withColumn("review", T.ustrip("review"))
    return r.filter(F.length("review") > 0).select("review_id", "review")


@register("c15_newline_delete", with_fixtures(f"""
SELECT review_id, {ustrip_sql("replace(review, chr(10), '')")} AS review FROM fx_reviews"""))
def c15(spark, sf_dir):
    """Newlines deleted (``a\\nb`` -> ``ab``), then stripped."""
    r = fx.fx_reviews(spark, sf_dir)
    return r.select("review_id", T.drop_newlines("review").alias("review"))


@register("c16_whitespace_collapse", with_fixtures(f"""
SELECT review_id, regexp_replace(review, '{WS}+', ' ', 'g') AS review FROM fx_reviews"""))
def c16(spark, sf_dir):
    """Runs of whitespace collapsed to one space."""
    return fx.fx_reviews(spark, sf_dir).select("review_id", T.collapse_ws("review").alias("review"))


@register("c16_clean_table", with_fixtures("SELECT * FROM fx_clean"))
def c16_all(spark, sf_dir):
    """The whole cleaning stage: C9-C17 with the percentile filter F7."""
    return cleaned(spark, sf_dir)


@register("c17_punct_space_text", with_fixtures(f"""
SELECT review_id, {ustrip_sql("regexp_replace(review, '([^\\p{L}\\p{N}'' ])', ' \\1 ', 'g')")} AS review
FROM fx_reviews"""))
def c17(spark, sf_dir):
    """Punctuation padded with spaces (text variant keeps spaces)."""
    return fx.fx_reviews(spark, sf_dir).select("review_id", T.space_punct_text("review").alias("review"))


@register("c18_punct_split_tokens", with_fixtures(f"""
SELECT review_id, pos, {split_punct_sql('token')} AS parts FROM fx_tokens"""))
def c18(spark, sf_dir):
    """Token variant: each token split at punctuation into non-empty sub-tokens."""
    t = fx.fx_tokens(spark, sf_dir)
    return t.select("review_id", "pos", T.split_punct_token(F.col("token")).alias("parts"))


@register("c19_lowercase", with_fixtures("""
SELECT review_id, lower(review_translate) AS text_lower,
       list_transform(regexp_extract_all(review_translate, '""" + TOKEN_RE + """'), lambda x: lower(x)) AS tokens_lower
FROM fx_reviews"""))
def c19(spark, sf_dir):
    """Lower-casing of a text and of each token of a token list."""
    r = fx.fx_reviews(spark, sf_dir)
    return r.select("review_id", F.lower("review_translate").alias("text_lower"),
                    F.transform(T.tokenize("review_translate"), F.lower).alias("tokens_lower"))


@register("c04_urljoin_full", C04_SQL)
def c04_full(spark, sf_dir):
    """The same anchors resolved with full URL-join semantics in an Arrow UDF."""
    from revlens.functions.udfs import urljoin_udf
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    e = p.select("page_id", T.site_root("url").alias("root"),
                 F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return e.select("page_id", "href", urljoin_udf(F.col("root"), F.col("href")).alias("link"))
