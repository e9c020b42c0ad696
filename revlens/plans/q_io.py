"""Queries of section A (sources and sinks) and K (resumable crawl state).

Each source query first writes its input in the source's file format under
the shared scratch folder (derived from the driver tables), then reads it
back with the library reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import metrics as M
from revlens.plans.common import cleaned, r6
from revlens.plans.fixture_sql import with_fixtures
from revlens.plans.q_extract import BLOCKS_SQL
from revlens.plans.registry import register
from revlens.sources import fixtures as fx
from revlens.sources import io
from revlens.sources.tables import table


def _f17_sql():
    from revlens.plans import q_metrics  # noqa: F401  (registers f17)
    from revlens.plans.registry import REGISTRY
    return REGISTRY["f17_metric_grid"].sql


@register("a01_delimited_scan", with_fixtures("""
SELECT review_id, review AS comment, review_translate AS translate, rating,
       'https://shop.example.com/ua/' || entity_name || '/comments/' AS prod_link
FROM fx_reviews WHERE dataset_name = 'market'"""))
def a01(spark, sf_dir):
    """``;``-separated CSV with quoted multi-line reviews read back with its header."""
    r = fx.raw_sources(spark, sf_dir)["market"]
    path = io.scratch_path(spark, "a01")
    io.write_csv(r, path, sep=";")
    return io.read_reviews_csv(spark, path, sep=";", schema=r.schema)


@register("a04_literal_lines", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations""")
def a04(spark, sf_dir):
    """One Python dict literal per line (with blank lines) -> typed records."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    lines = io.to_python_literal_lines(c)
    blanks = c.filter(F.col("turn") == 0).select(F.lit("").alias("value"))
    path = io.scratch_path(spark, "a04")
    lines.unionByName(blanks).write.mode("overwrite").text(path)
    return io.read_literal_lines(spark, path, "conv_id string, turn string, role string, text string")


def saved_pages(spark, sf_dir):
    """(entity, page, html) of the pages; the tree's sink deals them."""
    return table(spark, sf_dir, "pages", "page_id", "url", "html", spread=False).select(
        F.get(F.split("url", "/"), 2).alias("entity"), F.col("page_id").alias("page"), "html")


@register("a05_page_tree", with_fixtures("""
SELECT string_split(url, '/')[3] AS entity, CAST(page_id AS INTEGER) AS page_no, html FROM pages"""))
def a05(spark, sf_dir):
    """Directory of saved pages per entity -> (entity, page number, html)."""
    p = saved_pages(spark, sf_dir)
    path = io.scratch_path(spark, "a05")
    io.write_page_tree(p, path)
    t = io.read_page_tree(spark, path, entity_level=-3, page_level=-2)
    # the text sink used to lay out the fixture ends every file with one newline
    return t.withColumn("html", F.regexp_replace("html", "\n$", ""))


@register("a06_named_files", with_fixtures("""
SELECT CAST(id AS VARCHAR) AS id, CAST(y_true AS VARCHAR) AS y_true, CAST(y_pred AS VARCHAR) AS y_pred,
       CAST(m AS VARCHAR) AS model FROM fx_predictions"""))
def a06(spark, sf_dir):
    """Prediction files selected by a name fragment; the file stem becomes the model name."""
    p = fx.fx_predictions(spark, sf_dir).select("id", "m", "y_true", "y_pred")
    path = io.scratch_path(spark, "a06")
    p.write.mode("overwrite").partitionBy("m").option("header", True).csv(path)
    return io.read_named_files(spark, f"{path}/m=*/part-*", name_from="dir").select("id", "y_true", "y_pred", "model")


@register("a08_record_lists", with_fixtures("""
SELECT string_split(url, '/')[4] AS category_name, string_split(url, '/')[3] AS subcategory_name, url AS prod_link FROM pages"""))
def a08(spark, sf_dir):
    """Record lists (links per category) persisted as Parquet and loaded back."""
    p = table(spark, sf_dir, "pages", "page_id", "url").select(
        F.get(F.split("url", "/"), 3).alias("category_name"),
        F.get(F.split("url", "/"), 2).alias("subcategory_name"), F.col("url").alias("prod_link"))
    path = io.scratch_path(spark, "a08")
    p.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("a09_word_vectors_text", with_fixtures("""
SELECT 'w' || CAST(vec_id AS VARCHAR) AS token, CAST(len(embedding) AS INTEGER) AS dim,
       round(CAST(embedding[1] AS DOUBLE), 6) AS v0 FROM embeddings"""))
def a09(spark, sf_dir):
    """Word vectors in text word2vec format (header line, then token and values)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    body = e.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")),
                                F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    head = e.groupBy().agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.lit("64")).alias("value"))
    path = io.scratch_path(spark, "a09")
    head.unionByName(body).write.mode("overwrite").text(path)
    v = io.read_word_vectors_text(spark, path)
    return v.select("token", F.size("vector").alias("dim"), r6(F.element_at("vector", 1).cast("double")).alias("v0"))


@register("a10_a11_sinks", with_fixtures("""
SELECT 'm' || CAST(m AS VARCHAR) AS model, count(*) AS n FROM fx_predictions GROUP BY m"""))
def a10(spark, sf_dir):
    """CSV sink (overwrite, no index) and append sink partitioned by model, read back."""
    p = fx.fx_predictions(spark, sf_dir).select("id", "m", "y_pred").withColumn("model", F.concat(F.lit("m"), "m"))
    base = io.scratch_path(spark, "a10")
    io.write_csv(p.drop("model"), base + "/csv")
    for part in (p.filter("m < 4"), p.filter("m >= 4")):
        io.append_rows(part, base + "/appended", "model")
    back = spark.read.parquet(base + "/appended")
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@register("a12_json_documents", _f17_sql())
def a12(spark, sf_dir):
    """Metric documents (F1 and nested confusion matrices) written as JSON and read back."""
    from revlens.plans.q_metrics import eval_table
    g = M.metric_grid(eval_table(spark, sf_dir).withColumnRenamed("m", "trained_on"), [0, 1, 2, 3, 4])
    path = io.scratch_path(spark, "a12")
    io.write_json_docs(g, path)
    return spark.read.schema(g.schema).json(path)


@register("a13_compute_once", with_fixtures("""SELECT * FROM fx_clean"""))
def a13(spark, sf_dir):
    """Build-if-absent cache of the cleaned table (second call loads it)."""
    path = io.scratch_path(spark, "a13")
    first = io.compute_once(spark, path, lambda: cleaned(spark, sf_dir))
    return io.compute_once(spark, path, lambda: cleaned(spark, sf_dir))


def _a15_sql():
    from revlens.plans.q_metrics import HISTORY_SQL
    return with_fixtures(HISTORY_SQL + """
SELECT m AS model, epoch, round(test_hotels, 6) AS test_hotels, round(test_market, 6) AS test_market,
       round(test_restaurants, 6) AS test_restaurants, round(train_f1, 6) AS train_f1, round(val_f1, 6) AS val_f1
FROM wide ORDER BY m, epoch LIMIT 49""")


@register("a15_packed_rows", _a15_sql())
def a15(spark, sf_dir):
    """A one-column ``;``-packed history file split back into typed columns, first 49 rows."""
    from revlens.plans.q_metrics import history
    h = history(spark, sf_dir).groupBy("model", "epoch").pivot("metric").agg(F.first("value"))
    cols = h.columns
    packed = h.select(F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value"),
                      F.col("model").alias("_m"), F.col("epoch").alias("_e"))
    head = spark.range(1).select(F.lit(";".join(cols)).alias("value"), F.lit(-1).alias("_m"), F.lit(-1).alias("_e"))
    path = io.scratch_path(spark, "a15")
    # one file, header first, rows in (model, epoch) order
    (head.unionByName(packed).repartition(1).sortWithinPartitions("_m", "_e").select("value")
     .write.mode("overwrite").text(path))
    r = io.repair_packed_rows(spark, path, keep=49)
    return r.select(*[(F.col(c).try_cast("int") if c in ("model", "epoch") else r6(F.col(c).try_cast("double"))).alias(c)
                      for c in r.columns])


@register("b01_page_tree_flow", f"""
WITH b AS (SELECT string_split(url, '/')[3] AS entity, pages.page_id, block_idx + 1 AS idx, block
           FROM pages JOIN ({BLOCKS_SQL}) x ON x.page_id = pages.page_id),
t AS (SELECT entity, page_id * 1000 + idx AS row_key, trim(regexp_replace(block, '<[^>]+>', '', 'g')) AS text FROM b),
d AS (SELECT entity, text, min(row_key) AS row_key FROM t WHERE text <> '' GROUP BY entity, text)
SELECT entity, count(*) AS n_reviews, count(DISTINCT text) AS n_texts FROM d GROUP BY entity""")
def b01_flow(spark, sf_dir):
    """Pages -> review table flow: directory tree of saved pages (A5) -> review blocks (B1) ->
    first-kept dedup per entity (I4) -> reviews per entity."""
    from revlens.operators import clean
    from revlens.operators import extract as XT
    p = saved_pages(spark, sf_dir)
    path = io.scratch_path(spark, "b01-flow")
    io.write_page_tree(p, path)
    tree = io.read_page_tree(spark, path, entity_level=-3, page_level=-2)
    b = tree.select("entity", "page_no", F.posexplode(XT.blocks(F.col("html"))).alias("idx", "block"))
    t = b.select("entity", (F.col("page_no").cast("long") * 1000 + F.col("idx") + 1).alias("row_key"),
                 XT.strip_tags(F.col("block")).alias("text")).filter(F.col("text") != "")
    d = clean.first_kept(t, ["entity", "text"], order="row_key")
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("text").alias("n_texts"))


# ---------------------------------------------------------------- K: resumable crawl state

K1_SQL = with_fixtures("""
WITH c AS (SELECT string_split(link, '/')[3] AS entity, link, parsed, num_overall, num_parsed FROM fx_crawl),
e AS (SELECT entity, count(*) AS pages_done, max(num_overall) AS overall, min(link) AS first_link FROM c GROUP BY entity)
SELECT entity, pages_done, overall, 10 * pages_done >= overall AS finished,
       'https://www.example.com/Restaurant_Review-' || entity || '-Reviews-or' || CAST(pages_done * 10 AS VARCHAR) || '.html' AS next_page
FROM e""")


@register("k01_resume_state", K1_SQL)
def k01(spark, sf_dir):
    """Resume state per entity: pages done, next page URL, finished flag."""
    from revlens.streaming.resume import resume_state
    c = fx.fx_crawl(spark, sf_dir).withColumn("entity", F.get(F.split("link", "/"), 2))
    return resume_state(c, per_page=10)


K2_SQL = with_fixtures("""
SELECT page_id, link,
       CASE WHEN num_overall = 0 THEN 9999 ELSE num_overall END AS num_overall,
       num_parsed,
       parsed OR (num_parsed / (num_overall + 1) > 0.8) AS parsed,
       parsed OR (num_parsed / (num_overall + 1) > 0.8) AS review_parsed,
       num_parsed > 0 AS page_loaded,
       CASE WHEN parsed OR (num_parsed / (num_overall + 1) > 0.8) THEN NULL ELSE 'incomplete' END AS exception
FROM fx_crawl""")


@register("k02_crawl_normalize", K2_SQL)
def k02(spark, sf_dir):
    """Crawl-result normalization: count fallback, flags set on success, link kept."""
    from revlens.streaming.resume import normalize_results
    return normalize_results(fx.fx_crawl(spark, sf_dir))


@register("k03_incremental_pages", with_fixtures(f"""
SELECT string_split(url, '/')[3] AS entity, count(*) AS pages, coalesce(sum(n), 0) AS blocks
FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM ({BLOCKS_SQL}) GROUP BY page_id) x ON x.page_id = pages.page_id GROUP BY 1"""))
def k03(spark, sf_dir):
    """Structured Streaming ingest of saved pages (available-now trigger, checkpointed, resumable)."""
    from revlens.streaming.resume import ingest_pages_stream
    p = saved_pages(spark, sf_dir)
    src = io.scratch_path(spark, "k03-src")
    io.write_page_tree(p, src)
    out = ingest_pages_stream(spark, src, io.scratch_path(spark, "k03-out"))
    return out.groupBy("entity").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_blocks").alias("blocks"))


def _a14_sql():
    from revlens.plans.q_text import D12_STOP, _sql_str_list
    return with_fixtures(f"""
WITH t AS (SELECT review_id, unnest(list_filter(regexp_extract_all(lower(review_translate), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                       lambda x: NOT list_contains({_sql_str_list(D12_STOP)}, x))) AS term FROM fx_clean),
dt AS (SELECT DISTINCT review_id, term FROM t),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
nd AS (SELECT count(*) AS n FROM fx_clean),
voc AS (SELECT term FROM df, nd WHERE df >= 2 AND df <= 0.9 * n)
SELECT c.review_id, CAST(count(v.term) AS INTEGER) AS n_terms
FROM fx_clean c LEFT JOIN dt ON dt.review_id = c.review_id LEFT JOIN voc v ON v.term = dt.term
GROUP BY c.review_id""")


@register("a11_append_sink", with_fixtures("""
SELECT id, m, y_pred, CAST(id % 3 AS INTEGER) AS fold, 'm' || CAST(m AS VARCHAR) AS model FROM fx_predictions"""))
def a11(spark, sf_dir):
    """Per-fold rows appended one write at a time into a model-partitioned table."""
    p = fx.fx_predictions(spark, sf_dir).select("id", "m", "y_pred").withColumn("model", F.concat(F.lit("m"), "m"))
    path = io.scratch_path(spark, "a11")
    for fold in range(3):
        io.append_rows(p.filter(F.col("id") % 3 == fold).withColumn("fold", F.lit(fold)), path, "model")
    return spark.read.parquet(path).select("id", "m", "y_pred", "fold", "model")


@register("a14_model_save_load", _a14_sql())
def a14(spark, sf_dir):
    """A fitted feature pipeline saved to the shared folder, loaded back and applied."""
    from revlens.operators import models as ML
    from revlens.plans.q_text import D12_STOP
    c = ML.numbered(cleaned(spark, sf_dir))
    path = io.scratch_path(spark, "a14")
    ML.TermFeatures.fit(c, "review_translate", D12_STOP, ngram_max=1, min_df=2.0, max_df=0.9).save(path)
    found = ML.TermFeatures.load(spark, path).transform(c)
    n = found.filter(F.col("weight") != 0).groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("n_terms"))
    return c.select("_row", "review_id").join(n, "_row", "left").select("review_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
