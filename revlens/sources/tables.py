"""Readers for the Parquet tables the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# row keys of the text tables: used to spread an under-partitioned scan
KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str, spread: bool = True) -> DataFrame:
    """Parquet scan; naming ``columns`` prunes the scan (A2 ``usecols``).

    Text tables carry heavy per-row work (regexes over whole texts).  When a
    scan yields fewer partitions than the cluster has cores (a file with one
    row group reads as one task) the pruned rows are hash-spread by their
    key over ``spark.sql.shuffle.partitions``; large inputs already have
    more splits than cores and are left as scanned (no extra shuffle)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    key = KEYS.get(name)
    if spread and key and key in df.columns:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return df
