"""Rank-1 temporal response functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def leading_lags(strf: Column) -> Column:
    """The leading right singular vector of feature-by-lag matrices, its sum not negative; null for a matrix that is empty or lacks a number."""

    def one(m):
        if m is None or len(m) == 0:
            return None
        plane = np.stack([np.asarray(r, float) for r in m])
        if not plane.size or not np.isfinite(plane).all():
            return None
        v = np.linalg.svd(plane, full_matrices=False)[2][0]
        return (v if v.sum() >= 0 else -v).tolist()

    @F.pandas_udf("array<double>")
    def work(strf: pd.Series) -> pd.Series:
        return strf.map(one)

    return work(strf)


def trf(df: DataFrame, strf: str = "STRF", out: str = "TRF") -> DataFrame:
    return df.withColumn(out, leading_lags(F.col(strf)))
