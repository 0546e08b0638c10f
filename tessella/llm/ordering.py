"""Deal rows out to partitions in the order of an integer key, with bounds the driver knows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "__bucket"


def bounds(df: DataFrame, key: str, n: int) -> np.ndarray:
    """At most n-1 upper bounds that cut the non-null keys into n parts of about one size. Reads only the key."""
    if n < 2:
        return np.zeros(0, np.int64)
    share = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), share, F.lit(10_000)).alias("b")).head()["b"]
    return np.unique(np.array(found or [], np.int64))


def bucket_of(key: Column, upper: np.ndarray) -> Column:
    """Number of bounds below the key; 0 for null, which so comes first."""

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(upper, ids.to_numpy(np.int64), side="left").astype(np.int32))

    # without nulls, as pandas would make floats of the longs next to them
    return bucket(F.coalesce(key.cast("long"), F.lit(np.iinfo(np.int64).min).cast("long")))
