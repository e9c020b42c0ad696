"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import ensure_checkpoint_dir, ship_package, stored  # noqa: F401  (stored: used by the operators)

#: A word is a run of anything but ASCII white space.
SPACE = r"[ \x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def prepare(spark: SparkSession) -> None:
    """Name the checkpoint folder and make the package importable on executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Pruned scan of a given table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """Array of the words of ``text`` (runs of anything but ASCII white space)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod ``modulus`` is ``remainder`` (a null id counts as '')."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % modulus == remainder


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for ``df`` if a count proves it has at most ``max_rows`` rows;
    beyond that the planner picks a shuffle join (AQE splits its hot keys)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def commonest(df: DataFrame, count: str, rows: int) -> DataFrame:
    """The rows with the largest counts, at most ``rows`` of them.

    The cut comes from a histogram of the counts in eighths of a doubling (at
    most some 500 rows on the driver), so nothing is sorted or gathered in one task."""
    level = F.floor(8 * F.log2(count))
    total, cut = 0, None
    for r in sorted(df.where(F.col(count) > 0).groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > rows:
            break
        cut = r["level"]
    return df.where((F.col(count) > 0) & (level >= cut)) if cut is not None else df.where("false")


def byte_list(column: pa.Array) -> list:
    """Arrow strings as Python bytes (None for null) without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b: long).

    Alternates large-star and small-star rounds; every round is two joins on
    keys with map-side minima, written once, until the edge set stands still.
    No part of the graph reaches the driver but a count and a checksum."""
    def pairs(df):
        return stored(df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = pairs(edges)
    seen = state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = pairs(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(low.select("a", F.col("m").alias("b"))))
        last, seen = seen, state(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
                  broadcast_rows: int = 2_000_000) -> DataFrame:
    """(id, text, label: 0 or 1) of the labelled rows outside the held-out fold.

    Rows without id or label are left out; of contradicting labels of an id the
    larger holds.  The labels are broadcast only up to ``broadcast_rows`` rows."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id"))
             .agg(F.max(F.col(label).cast("int")).alias("label")))
    rows = docs.where(~held_out(id_col, 3, 1)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(small_side(marks, broadcast_rows), "id")


def sampled(df: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all if there are fewer), chosen by a hash of their id."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def append(df: DataFrame, text_col: str, schema: str, make) -> DataFrame:
    """``df`` with the columns of ``schema`` added; ``make`` turns a list of texts (null: '') into their arrays.

    Added names start with two underscores, so they clash with no given column."""
    from pyspark.sql import types as T
    added = T.StructType.fromDDL(schema)
    kind = T.StructType(df.schema.fields + added.fields)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            columns = make([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *added.fieldNames()])

    return df.mapInArrow(run, kind)
