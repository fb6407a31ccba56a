"""Python functions over one or more texts as Arrow-backed columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vectorized(f: Callable, kind: T.DataType):
    """f over columns, a batch at a time; a null in gives a null out."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype="object")

    n = f.__code__.co_argcount
    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return F.pandas_udf(one, kind)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(two, kind)
