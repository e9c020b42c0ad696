"""The user-function surface (L1-L6) as Arrow-batched pandas UDFs.

Built-in expressions are preferred everywhere; these exist for logic a
user writes in Python (the reference's row and batch functions) and run on
Arrow batches, never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

PY_TOKEN = regex.compile(r"[\p{L}\p{N}_'-]+|[^\p{L}\p{N}_\s'-]+")


def longest_word(text: str) -> int:
    """A user's row function: code points of the longest blank-separated word."""
    return max(map(len, text.split(" ")))


@F.pandas_udf(IntegerType())
def longest_word_udf(s: pd.Series) -> pd.Series:
    """L1: a row function applied to a column, one Arrow batch at a time."""
    return s.map(longest_word, na_action="ignore").astype("Int32")


def remove_words_udf(stop: list[str]):
    """L2: batch function with extras; the extra set is built once per task
    (the closure is shipped once, not per row)."""
    stop_set = frozenset(stop)

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda toks: None if toks is None else [t for t in toks if t not in stop_set])
    return run


#: Texts whose tokens are held at a time.
TEXT_SLICE = 256


@arrow_udtf(returnType=StructType([StructField("review_id", LongType()), StructField("pos", IntegerType()), StructField("token", StringType())]))
class TokensUDTF:
    """L3: one-to-many table function over a table (review_id, text): a text -> one row per token.

    It is called an Arrow batch at a time, not a row at a time."""

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.Table]:
        for start in range(0, texts.num_rows, TEXT_SLICE):
            some = texts.slice(start, TEXT_SLICE)
            found = [[] if t is None else PY_TOKEN.findall(t) for t in some.column(1).to_pylist()]
            n = np.array([len(f) for f in found], dtype=np.int64)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.table({"review_id": some.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), "pos": pa.array(pos, pa.int32()),
                            "token": pa.array(list(chain.from_iterable(found)), pa.string())})


def bind(fn, **params):
    """L4: partially applied operator for ``df.transform``."""
    return partial(fn, **params)


@F.pandas_udf(DoubleType())
def median_udf(v: pd.Series) -> float:
    """Grouped-aggregate function (Series -> scalar), interpolated median."""
    return float(v.median())


@F.pandas_udf(StringType())
def urljoin_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    """C4 with full RFC 3986 resolution (``..``, queries, fragments), Arrow-batched."""
    from urllib.parse import urljoin
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href)])
