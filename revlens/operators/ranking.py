"""Exact positions inside groups without putting a group into one task.

``row_number() OVER (PARTITION BY k ORDER BY o)`` sends every row of a key
to one task; with a key holding a third of the rows that task is the whole
job.  ``rank_within`` gets the same numbers from a range shuffle:

1. ``repartitionByRange(keys, order)`` + ``sortWithinPartitions``: a hot key
   is spread over many consecutive partitions, each sorted;
2. ``monotonically_increasing_id`` then numbers rows inside each partition
   in sorted order (partition id in the upper bits);
3. a small table, one row per (partition, key) present, holds the first id
   and the count; a window over that small table (keyed by group, ordered by
   partition) gives the rows of the same key in earlier partitions;
4. position = rows in earlier partitions + (id - first id in this partition).

The numbered rows are stored (as Parquet: a plain checkpoint writes every
row in full width, uncompressed) before they are read twice, so the ids
cannot change between the two reads.

The order must be total (end it with a unique column) for results to be
deterministic, also when tasks are retried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import discarded, stored

#: Rows of the offset table up to which it is broadcast.
MOST_OFFSETS = 100_000


def _order_cols(order) -> list[Column]:
    out = []
    for o in order:
        out.append(F.col(o) if isinstance(o, str) else o)
    return out


def rank_within(df: DataFrame, keys: list[str], order: list, pos: str = "_pos",
                size: str | None = "_n", partitions: int | None = None) -> DataFrame:
    """Add 0-based ``pos`` within ``keys`` by ``order`` (and group size ``size``).

    ``order`` items are column names or ascending/descending Columns.  With
    ``keys=[]`` this is a global dense index over the ordered rows.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # materialize the input once: the range bounds are sampled from it and
    # the shuffle reads it, which would otherwise run the upstream twice
    given = stored(df)
    ocols = _order_cols(order)
    sort_cols = [F.col(k) for k in keys] + ocols
    ranged = given.repartitionByRange(n_parts, *sort_cols).sortWithinPartitions(*sort_cols)
    ids = ranged.withColumn("__rw_rid", F.monotonically_increasing_id())
    ids = ids.withColumn("__rw_pid", F.shiftright(F.col("__rw_rid"), 33))
    # The ids are read twice (offset table and final join).  Re-reading the
    # shuffle is not enough: adaptive execution may coalesce or split its
    # partitions differently per reader, and the ids depend on the task's
    # partition.  Storing them fixes them once (and survives executor loss).
    ids = stored(ids)
    discarded(given)
    # one row per (partition, key): first row id and count
    gcols = ["__rw_pid"] + keys
    small = ids.groupBy(*gcols).agg(F.min("__rw_rid").alias("__rw_first"), F.count(F.lit(1)).alias("__rw_cnt"))
    w = Window.partitionBy(*keys).orderBy("__rw_pid") if keys else Window.orderBy("__rw_pid")
    small = small.withColumn("__rw_before", F.coalesce(
        F.sum("__rw_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size:
        wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
        small = small.withColumn(size, F.sum("__rw_cnt").over(wk))
    keep = ["__rw_first", "__rw_before"] + ([size] if size else [])
    # null-safe: rows with a null key are a group of their own, as in a window
    small = small.select(*[F.col(c).alias(f"__rw_k{i}") for i, c in enumerate(gcols)], *keep)
    # one row per (partition, key): while that is few, the rows stay where they are
    small = stored(small)
    if small.limit(MOST_OFFSETS + 1).count() <= MOST_OFFSETS:
        small = F.broadcast(small)
    same = [F.col(c).eqNullSafe(F.col(f"__rw_k{i}")) for i, c in enumerate(gcols)]
    out = ids.join(small, reduce(lambda a, b: a & b, same)).drop(*[f"__rw_k{i}" for i in range(len(gcols))])
    out = out.withColumn(pos, (F.col("__rw_before") + F.col("__rw_rid") - F.col("__rw_first")).cast("bigint"))
    return out.drop("__rw_rid", "__rw_pid", "__rw_first", "__rw_before")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, pos: str = "_pos",
                  salts: int | None = None) -> DataFrame:
    """Rows ranked below ``n`` in each group (G6, G7, top-k reports).

    Spark drops rows that cannot rank below a small ``n`` before the window's
    shuffle (at most ``n`` rows a group leave a task), so one window ranks a
    hot group too.  A larger ``n`` takes two stages: rows are spread over
    ``salts`` sub-groups by a hash of the whole row, each sub-group keeps its
    own top ``n``, and the exact ranking runs on the at most ``salts * n``
    survivors per group.  The order must be total."""
    spark = df.sparkSession
    if salts is None and n < int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order_cols(order)))
        return df.withColumn(pos, place).filter(F.col(pos) <= n).withColumn(pos, (F.col(pos) - 1).cast("bigint"))
    s = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(s))
    w = Window.partitionBy(*keys, "__tp_salt").orderBy(*_order_cols(order))
    pre = (df.withColumn("__tp_salt", salt).withColumn("__tp_rn", F.row_number().over(w))
           .filter(F.col("__tp_rn") <= n).drop("__tp_salt", "__tp_rn"))
    return rank_within(pre, keys, order, pos=pos, size=None).filter(F.col(pos) < n)


def dense_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Consecutive 0-based ids over the whole ordered table."""
    return rank_within(df, [], order, pos=name, size=None)
