"""Splits, folds, quota samples, label codes and class weights.

Random choices of the reference (unseeded splits, ``sample``) are replaced
by a seeded order: ``pmod(review_id * 7919 + seed, 10007)`` then
``review_id``; the same arithmetic runs in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.ranking import rank_within
from revlens.session import bounded_broadcast


def seeded_order(id_col: str = "review_id", seed: int = 13) -> list[Column]:
    return [F.pmod(F.col(id_col) * 7919 + seed, F.lit(10007)), F.col(id_col)]


def stratified_split(df: DataFrame, strata: list[str], id_col: str = "review_id",
                     seed: int = 13) -> DataFrame:
    """G1: 80/10/10 per stratum with the train/test split sizes of the
    reference (``ceil(0.2 n)`` held out, then half of it, rounded up, to test).
    Returns ``(id_col, split)`` plus the strata columns."""
    r = rank_within(df.select(id_col, *strata), strata, seeded_order(id_col, seed))
    held = F.floor((F.col("_n") + 4) / 5)
    n_train = F.col("_n") - held
    n_test = F.floor((held + 1) / 2)
    n_val = held - n_test
    split = (F.when(F.col("_pos") < n_train, "train")
             .when(F.col("_pos") < n_train + n_val, "val").otherwise("test"))
    return r.select(id_col, *strata, split.alias("split"))


def first_appearance_codes(df: DataFrame, label: str, id_col: str = "review_id",
                           code: str = "code") -> DataFrame:
    """Label -> code by order of first appearance (smallest id).

    One row per distinct label (a tiny table), so the global window over it
    is cheap."""
    firsts = df.groupBy(label).agg(F.min(id_col).alias("_first"))
    return firsts.select(label, (F.row_number().over(Window.orderBy("_first")) - 1)
                         .cast("int").alias(code))


def stratified_kfold(df: DataFrame, label: str, k: int = 5, id_col: str = "review_id") -> DataFrame:
    """Unshuffled stratified k-fold with the reference's allocation.

    Classes are coded by first appearance; over the label-sorted row list,
    fold f receives from class c the positions p in [s_c, s_c + n_c) with
    ``p mod k = f``; the class's rows, in id order, fill folds 0..k-1 as
    consecutive blocks of those sizes."""
    # one aggregation gives code order and class sizes (one row per class)
    per = df.groupBy(label).agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_nc"))
    per = bounded_broadcast(per, 10_000)
    w = Window.orderBy("_first")
    counts = per.select(label, "_nc", F.coalesce(F.sum("_nc").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    r = rank_within(df.select(id_col, label), [label], [F.col(id_col)], size=None)
    r = r.join(counts.select(label, "_nc", "_s"), label)

    def upto(x: Column, f: int) -> Column:  # #{p in [0, x): p mod k = f}
        return F.floor((x - f + k - 1) / k)

    fold = F.lit(0)
    cum = F.lit(0)
    for f in range(k):
        alloc = upto(F.col("_s") + F.col("_nc"), f) - upto(F.col("_s"), f)
        cum = cum + alloc
        if f < k - 1:
            fold = fold + F.when(F.col("_pos") >= cum, 1).otherwise(0)
    return r.select(id_col, label, fold.cast("int").alias("fold"))


def quota_take(sizes: Column, quota: int) -> Column:
    """G3 quota carry over an ordered array of bucket sizes:
    ``take_i = min(size_i, remaining // (nb - i))``; ``remaining -= take_i``."""
    nb = F.size(sizes)
    init = F.struct(F.lit(quota).alias("rem"), F.lit(0).alias("i"),
                    F.array().cast("array<int>").alias("takes"))

    def step(acc, s):
        take = F.least(s, F.floor(acc["rem"] / (nb - acc["i"])).cast("int"))
        return F.struct((acc["rem"] - take).alias("rem"), (acc["i"] + 1).alias("i"),
                        F.concat(acc["takes"], F.array(take)).alias("takes"))

    return F.aggregate(sizes, init, step, lambda acc: acc["takes"])


def balanced_class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (k * n_c)`` per class (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy()
    return counts.select(label, "n_c", (F.sum("n_c").over(tot) /
                                        (F.count(F.lit(1)).over(tot) * F.col("n_c"))).alias("weight"))
