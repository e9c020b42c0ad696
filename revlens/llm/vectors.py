"""Reading of embedding columns, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, keep: Column | None = None) -> DataFrame:
    """(id, v) of the rows whose vector is there and holds only finite numbers.

    Vectors of any other length than the commonest one (of equally common ones
    the shortest) have no coordinates in common with the rest and are left
    out, and so are empty ones.  ``keep`` is a further condition on ``v``."""
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    rows = rows.where(keep) if keep is not None else rows
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == most["d"]) if most else rows


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """The equally long lists of an Arrow column as rows of one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)
