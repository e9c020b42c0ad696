"""Resumable crawl state (K1, K2) and an incremental page ingest.

The reference resumes a crawl from files already saved; here that state is
a batch aggregate over the crawl table, and new pages are picked up by a
Structured Streaming file source whose checkpoint records what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import extract as XT


def resume_state(crawl: DataFrame, per_page: int = 10) -> DataFrame:
    """K1: per entity pages done, overall count, finished flag (``per_page * n >= overall``)
    and the URL of the next page to fetch (C8 rewrite)."""
    e = crawl.groupBy("entity").agg(F.count(F.lit(1)).alias("pages_done"), F.max("num_overall").alias("overall"))
    nxt = F.concat(F.lit("https://www.example.com/Restaurant_Review-"), F.col("entity"), F.lit("-Reviews-or"),
                   (F.col("pages_done") * per_page).cast("string"), F.lit(".html"))
    return e.select("entity", "pages_done", "overall",
                    (per_page * F.col("pages_done") >= F.col("overall")).alias("finished"), nxt.alias("next_page"))


def normalize_results(crawl: DataFrame) -> DataFrame:
    """K2: overall count 0 -> 9999 fallback; on success (flag or ratio > 0.8) the
    four flags are set true and the link is kept; otherwise an exception text."""
    ok = F.col("parsed") | (F.col("num_parsed") / (F.col("num_overall") + 1) > 0.8)
    return crawl.select(
        "page_id", "link",
        F.when(F.col("num_overall") == 0, F.lit(9999)).otherwise(F.col("num_overall")).alias("num_overall"),
        "num_parsed", ok.alias("parsed"), ok.alias("review_parsed"), (F.col("num_parsed") > 0).alias("page_loaded"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("incomplete")).alias("exception"))


#: Files of one micro-batch, at most, and tasks that look them up.
BATCH_FILES, LOOKUP_TASKS = 20_000, 64


def ingest_pages_stream(spark: SparkSession, src: str, out: str) -> DataFrame:
    """Stream saved pages (whole files) into a Parquet table of per-page block
    counts.  ``availableNow`` processes what exists and stops; rerunning with
    the same checkpoint only reads new files (the crawl's resume rule).

    Spark looks up a batch's files with one task a file unless told otherwise; the stream's own session says fewer."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LOOKUP_TASKS)
    stream = (session.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", BATCH_FILES).load(src))
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = stream.select(
        F.element_at(F.split(F.element_at(parts, -3), "="), -1).alias("entity"),
        F.element_at(F.split(F.element_at(parts, -2), "="), -1).cast("long").alias("page"),
        F.size(XT.blocks(F.col("value"))).alias("n_blocks"))
    q = (rows.writeStream.format("parquet").option("checkpointLocation", out + "/_checkpoint")
         .option("path", out + "/data").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out + "/data")
