"""Queries of section B: extraction from the saved pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import extract as XT
from revlens.operators import selectors as SEL
from revlens.plans.fixture_sql import WS
from revlens.plans.registry import register
from revlens.sources.tables import table

# every <p ...> block inside at least one open <article ...>: the page is cut at the container's tags, and the depth
# of a part is the running sum of opening and closing ones that never falls below zero
BLOCKS_SQL = r"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, k) - 1 AS INTEGER) AS block_idx, block FROM (
  SELECT page_id, i, generate_subscripts(b, 1) AS k, unnest(b) AS block FROM (
    SELECT page_id, i, string_split_regex(piece, '(?i)<p(?:\s[^>]*)?>')[2:] AS b FROM (
      SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM (
        SELECT *, sum(CASE WHEN regexp_matches(piece, '(?i)^<article[\s>]') THEN 1 WHEN regexp_matches(piece, '(?i)^</article[\s>]') THEN -1 ELSE 0 END)
                  OVER (PARTITION BY page_id ORDER BY i) AS total FROM (
          SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM (
            SELECT page_id, string_split(regexp_replace(html, '(?i)(</?article[\s>])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM pages))))
    WHERE depth > 0))"""


def pages(spark, sf_dir, *cols):
    return table(spark, sf_dir, "pages", "page_id", *cols)


def block_rows(spark, sf_dir):
    p = pages(spark, sf_dir, "html")
    return p.select("page_id", F.posexplode(XT.blocks(F.col("html"))).alias("block_idx", "block"))


@register("b01_review_blocks", f"""
SELECT page_id, block_idx, trim(regexp_replace(block, '<[^>]+>', '', 'g')) AS text FROM ({BLOCKS_SQL})""")
def b01(spark, sf_dir):
    """Every ``<p>`` block of a page's article -> one row with its text."""
    b = block_rows(spark, sf_dir)
    return b.select("page_id", F.col("block_idx").cast("int").alias("block_idx"), XT.strip_tags(F.col("block")).alias("text"))


@register("b01_parsed_blocks", f"""
SELECT page_id, block_idx,
       trim(regexp_replace(replace(replace(replace(replace(
         regexp_replace(split_part(block, '</p>', 1), '<[^>]+>', '', 'g'),
         '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '{WS}+', ' ', 'g')) AS text
FROM ({BLOCKS_SQL})""")
def b01p(spark, sf_dir):
    """Same blocks by the standard-library HTML parser (entities decoded, script text skipped)."""
    return XT.parse_blocks(pages(spark, sf_dir, "html"), "p")


@register("b02_block_fields", f"""
SELECT page_id, block_idx, CAST(length(trim(regexp_replace(block, '<[^>]+>', '', 'g'))) AS INTEGER) AS n_chars,
       regexp_matches(block, '<b>') AS has_bold, regexp_extract(block, '<b>([^<]*)', 1) AS bold_text
FROM ({BLOCKS_SQL})""")
def b02(spark, sf_dir):
    """Fields inside a block: text length, presence of a child element and its text."""
    b = block_rows(spark, sf_dir)
    return b.select("page_id", F.col("block_idx").cast("int").alias("block_idx"),
                    F.length(XT.strip_tags(F.col("block"))).alias("n_chars"),
                    F.col("block").rlike("<b>").alias("has_bold"),
                    F.regexp_extract("block", "<b>([^<]*)", 1).alias("bold_text"))


@register("b02_page_fields", """
SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
       regexp_extract(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS first_link,
       regexp_extract(html, '<div class="([^"]*)"', 1) AS div_class,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
FROM pages""")
def b02p(spark, sf_dir):
    """Page-level fields: element text, an attribute value and a class token."""
    p = pages(spark, sf_dir, "html")
    h = F.col("html")
    return p.select("page_id", F.regexp_extract(h, "<title>(.*?)</title>", 1).alias("title"),
                    F.regexp_extract(XT.inner(h, "nav"), '<a href="([^"]*)"', 1).alias("first_link"),
                    F.regexp_extract(h, '<div class="([^"]*)"', 1).alias("div_class"),
                    F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("lang"))


@register("b03_bubble_rating", """
SELECT page_id, TRY_CAST(array_to_string(list_filter(string_split(string_split(cls, '_')[-1], ''), lambda x: x <> ''), '.') AS DOUBLE) AS rating
FROM (SELECT page_id, 'ui_bubble_rating bubble_' || CAST(page_id % 5 + 1 AS VARCHAR)
             || CASE WHEN page_id % 2 = 0 THEN '0' ELSE '5' END AS cls FROM pages)""")
def b03(spark, sf_dir):
    """Rating from a class suffix (``bubble_45`` -> 4.5)."""
    p = pages(spark, sf_dir)
    cls = F.concat(F.lit("ui_bubble_rating bubble_"), (F.col("page_id") % 5 + 1).cast("string"),
                   F.when(F.col("page_id") % 2 == 0, F.lit("0")).otherwise(F.lit("5")))
    return p.select("page_id", T.bubble_rating(cls).alias("rating"))


@register("b04_aspect_ratings", """
SELECT page_id, label || '_rating' AS aspect, CAST(length(label) % 5 + 1 AS DOUBLE) AS rating FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1)) AS label
  FROM pages)""")
def b04(spark, sf_dir):
    """Dynamic aspect ratings ``<label>_rating`` per page as a map, emitted long."""
    p = pages(spark, sf_dir, "html")
    nav = XT.inner(F.col("html"), "nav")
    labels = F.regexp_extract_all(nav, F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1)
    entries = F.transform(labels, lambda x: F.struct(F.concat(x, F.lit("_rating")).alias("k"),
                                                      (F.length(x) % 5 + 1).cast("double").alias("v")))
    m = p.select("page_id", entries.alias("_e"))
    # duplicate labels in one page keep every entry, as the long form of the map
    return m.select("page_id", F.explode("_e").alias("e")).select(
        "page_id", F.col("e.k").alias("aspect"), F.col("e.v").alias("rating"))


@register("b04_aspect_map", """
SELECT page_id, map_keys(aspects) AS aspects, map_values(aspects) AS ratings FROM (SELECT page_id, map_from_entries(list_transform(list_sort(list_distinct(labels)),
         lambda x: struct_pack(k := x || '_rating', v := CAST(length(x) % 5 + 1 AS DOUBLE)))) AS aspects
FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
                                         '<a href="[^"]*">([^<]*)</a>', 1) AS labels FROM pages))""")
def b04m(spark, sf_dir):
    """The same aspect ratings as one ``map<string, double>`` per page (repeated labels collapse), its entries in key order."""
    p = pages(spark, sf_dir, "html")
    nav = XT.inner(F.col("html"), "nav")
    labels = F.array_sort(F.array_distinct(F.regexp_extract_all(nav, F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1)))
    entries = F.transform(labels, lambda x: F.struct(F.concat(x, F.lit("_rating")),
                                                      (F.length(x) % 5 + 1).cast("double")))
    # a map has no order once it is collected, so its entries are returned by key
    return p.select("page_id", F.map_from_entries(entries).alias("m")).select(
        "page_id", F.map_keys("m").alias("aspects"), F.map_values("m").alias("ratings"))


@register("b05_anchors", """
SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
       unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages""")
def b05(spark, sf_dir):
    """Anchor (href, text) pairs of every page."""
    p = pages(spark, sf_dir, "html")
    return p.select("page_id", F.explode(XT.anchors(F.col("html"))).alias("a")).select(
        "page_id", F.col("a.href").alias("href"), F.col("a.text").alias("text"))


@register("b06_page_integer", """
SELECT page_id, coalesce(TRY_CAST(regexp_replace(regexp_extract(html, 'track\\(([^)]*)\\)', 1), '[^0-9]', '', 'g') AS INTEGER), 0) AS n
FROM pages""")
def b06(spark, sf_dir):
    """Page-level integer from a pattern, 0 on failure."""
    p = pages(spark, sf_dir, "html")
    return p.select("page_id", XT.page_int(F.col("html"), r"track\(([^)]*)\)").alias("n"))


@register("b07_access_denied_filter", """
SELECT page_id FROM pages
WHERE NOT coalesce(regexp_matches(regexp_extract(html, '<title>(.*?)</title>', 1), '^(Access|The) '), false)""")
def b07(spark, sf_dir):
    """Pages whose title marks a denied page dropped; unparsable titles kept."""
    p = pages(spark, sf_dir, "html")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return p.filter(~F.coalesce(title.rlike("^(Access|The) "), F.lit(False))).select("page_id")


@register("b08_star_count", """
SELECT page_id, coalesce(CASE WHEN nav <> '' THEN CAST(len(regexp_extract_all(nav, '<li>')) AS INTEGER) END,
                         CASE WHEN foot <> '' THEN CAST(len(regexp_extract_all(foot, '&middot;')) AS INTEGER) END, -1) AS stars
FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav,
             regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS foot FROM pages)""")
def b08(spark, sf_dir):
    """Marker count in the first of two selectors that exists, else -1."""
    p = pages(spark, sf_dir, "html")
    h = F.col("html")
    return p.select("page_id", F.coalesce(XT.marker_count(XT.inner(h, "nav"), "<li>"),
                                          XT.marker_count(XT.inner(h, "footer"), "&middot;"),
                                          F.lit(-1)).alias("stars"))


@register("b09_main_extra_text", """
SELECT page_id, CASE WHEN coalesce(extra, '') <> '' THEN main || chr(10) || extra ELSE main END AS comment FROM (
  SELECT page_id, coalesce(regexp_extract(html, '<h1>(.*?)</h1>', 1), '') AS main,
         regexp_extract(html, '<div class="ad">(.*?)</div>', 1) AS extra FROM pages)""")
def b09(spark, sf_dir):
    """Main text plus the extra part after a newline when present."""
    p = pages(spark, sf_dir, "html")
    main = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    extra = F.regexp_extract("html", '<div class="ad">(.*?)</div>', 1)
    return p.select("page_id", XT.join_main_extra(main, extra).alias("comment"))


B10_BAD = "length(trim(regexp_replace(block, '<[^>]+>', '', 'g'))) < 40"


@register("b10_error_skip", f"""
SELECT page_id, block_idx FROM ({BLOCKS_SQL}) WHERE NOT ({B10_BAD})""")
def b10s(spark, sf_dir):
    """Error policy ``skip``: a bad block (short text) is skipped, the rest kept."""
    b = block_rows(spark, sf_dir).withColumn("block_idx", F.col("block_idx").cast("int"))
    bad = F.length(XT.strip_tags(F.col("block"))) < 40
    return XT.apply_error_policy(b, "page_id", "block_idx", bad, "skip").select("page_id", "block_idx")


@register("b10_error_stop", f"""
WITH b AS ({BLOCKS_SQL}),
fb AS (SELECT page_id, min(block_idx) AS first_bad FROM b WHERE {B10_BAD} GROUP BY page_id)
SELECT b.page_id, b.block_idx FROM b LEFT JOIN fb ON b.page_id = fb.page_id
WHERE fb.first_bad IS NULL OR b.block_idx < fb.first_bad""")
def b10t(spark, sf_dir):
    """Error policy ``stop``: the rest of a page is dropped at its first bad block."""
    b = block_rows(spark, sf_dir).withColumn("block_idx", F.col("block_idx").cast("int"))
    bad = F.length(XT.strip_tags(F.col("block"))) < 40
    return XT.apply_error_policy(b, "page_id", "block_idx", bad, "stop").select("page_id", "block_idx")


# ---------------------------------------------------------------- by selector specification

S = SEL.Step


def text_sql(raw):
    """Text of a piece of markup without elements: the pages' character references and white space as the parser reads them."""
    for reference, mark in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        raw = f"replace({raw}, '{reference}', '{mark}')"
    return f"trim(regexp_replace({raw}, '{WS}+', ' ', 'g'))"


ENTRIES_SQL = """
SELECT page_id, CAST(generate_subscripts(li, 1) - 1 AS INTEGER) AS block_idx, unnest(li) AS li FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '(?s)<li[^>]*>(.*?)</li>', 1) AS li FROM pages)"""


@register("b02_selected_records", f"""
SELECT page_id, block_idx, {text_sql("regexp_extract(li, '<a [^>]*>([^<]*)</a>', 1)")} AS label,
       regexp_extract(li, 'href="([^"]*)"', 1) AS href FROM ({ENTRIES_SQL}) WHERE contains(li, '<a ')""")
def b02s(spark, sf_dir):
    """Records of nested elements by a specification: each list entry of a page's menus, the text and address of its link."""
    spec = SEL.Records((S("nav"), S("li")), (SEL.Field("label", (S("a"),)), SEL.Field("href", (S("a", attributes=(("href", None),)),), "@href")))
    return SEL.extract(pages(spark, sf_dir, "html"), spec)


@register("b04_selected_pairs", f"""
SELECT page_id, CAST(0 AS INTEGER) AS block_idx, {text_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
       coalesce(len(list_distinct(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1))), 0)::INTEGER AS n_labels
FROM pages WHERE contains(html, '<nav') AND contains(html, '<h1')""")
def b04s(spark, sf_dir):
    """A page's title with a map of all labels in its menu to their addresses, by a specification; entries are counted."""
    p = pages(spark, sf_dir, "html")
    links = SEL.Pairs("links", S("a"), SEL.Field("label"), SEL.Field("href", take="@href"))
    maps = SEL.extract(p, SEL.Records((S("nav"),), (links,))).where("block_idx = 0").select("page_id", F.size("links").alias("n_labels"))
    titles = SEL.extract(p, SEL.Records((S("html"),), (SEL.Field("title", (S("h1"),)),)))
    return titles.join(maps, "page_id").select("page_id", "block_idx", "title", "n_labels")


BOLD_SQL = f"""
SELECT page_id, block_idx, contains(block, '<b>') AS ok, {text_sql("regexp_extract(block, '<b>([^<]*)', 1)")} AS bold FROM ({BLOCKS_SQL})"""
BOLD = (SEL.Field("bold", (S("b"),)),)


@register("b10_selected_skip", f"SELECT page_id, block_idx, bold FROM ({BOLD_SQL}) WHERE ok")
def b10ss(spark, sf_dir):
    """Policy ``skip`` on a missing field: paragraphs of articles with a bold part, the others left out."""
    return SEL.extract(pages(spark, sf_dir, "html"), SEL.Records((S("article"), S("p")), BOLD, "skip"))


@register("b10_selected_stop", f"""
WITH b AS ({BOLD_SQL}), f AS (SELECT page_id, min(block_idx) AS bad FROM b WHERE NOT ok GROUP BY page_id)
SELECT b.page_id, b.block_idx, b.bold FROM b LEFT JOIN f ON f.page_id = b.page_id WHERE f.bad IS NULL OR b.block_idx < f.bad""")
def b10st(spark, sf_dir):
    """Policy ``stop`` on a missing field: a page's paragraphs up to its first one without a bold part."""
    return SEL.extract(pages(spark, sf_dir, "html"), SEL.Records((S("article"), S("p")), BOLD, "stop"))
