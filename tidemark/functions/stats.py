"""Two-proportion z-test columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """``erfc(|z| / sqrt 2)``. Spark SQL has no error function; callers apply it to report rows."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled z statistic; NULL when a group is empty or the pooled share is 0 or 1."""
    pooled = F.try_divide(k1 + k2, n1 + n2)
    spread = F.sqrt(pooled * (1.0 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    usable = (n1 > 0) & (n2 > 0) & (pooled > 0) & (pooled < 1) & (spread > 0)
    return F.when(usable, (F.try_divide(k1, n1) - F.try_divide(k2, n2)) / spread)


def is_significant(z: Column, alpha: float = 0.05) -> Column:
    """Same decision as ``p < alpha`` without leaving the JVM; NULL where z is."""
    return F.abs(z) > F.lit(NormalDist().inv_cdf(1.0 - alpha / 2.0))
