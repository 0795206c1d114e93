"""Expressions on array columns, and Arrow-batched matrix products where expressions would need an explode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _over(a: Column, n: Column) -> Column:
    """a / n, with n worked out once per row: inside a lambda it would be once per element."""
    return F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x / y)


def l2(a: Column, eps: float = 1e-12) -> Column:
    """a / (norm + eps)."""
    return _over(a, norm(a) + eps)


def l2_floor(a: Column, eps: float = 1e-12) -> Column:
    """a / max(norm, eps)."""
    return _over(a, F.greatest(norm(a), F.lit(eps)))


def joint(a: Column, b: Column, share: float) -> Column:
    """Normalised concatenation of sqrt(share) a and sqrt(1 - share) b; share must lie in [0, 1]."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie in [0, 1]")
    left, right = share**0.5, (1 - share) ** 0.5
    return l2_floor(F.concat(F.transform(a, lambda x: x * left), F.transform(b, lambda x: x * right)))


def mean_vector(a: Column) -> Column:
    """Aggregate: element-wise mean (partial sums on the map side)."""
    return vector_to_array(Summarizer.mean(array_to_vector(a)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def to_matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float) if len(series) else np.zeros((0, 0))


def fourier(w: np.ndarray, b: np.ndarray):
    """Scalar pandas function: random Fourier features sqrt(2 / D) cos(W x + b), one matrix product per batch."""

    @F.pandas_udf(DOUBLES)
    def features(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = np.sqrt(2 / len(w)) * np.cos(to_matrix(x) @ w.T + b)
        return pd.Series(list(z))

    return features


def project(p: np.ndarray):
    """Scalar pandas function: products with the rows of p."""

    @F.pandas_udf(DOUBLES)
    def projected(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(to_matrix(x) @ p.T))

    return projected
