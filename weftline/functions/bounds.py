"""Exact one-sided bounds of a proportion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, all elements together."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 1000):
        change = 1.0
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            change = c * d
            out = out * change
        if np.all(np.abs(change - 1) < 1e-14):
            break
    share = np.where(x <= 0, 0.0, front * out)
    return np.where(swap, 1 - share, share)


def upper(hits: np.ndarray, trials: np.ndarray, confidence: float = 0.95) -> np.ndarray:
    """The share under which so few hits are as rare as 1 - confidence. Trials may be an effective number, with a fraction. NaN without trials, 1 if all hit."""
    hits, trials = np.asarray(hits, dtype=float), np.asarray(trials, dtype=float)
    usual = (trials > 0) & (hits < trials)
    a, b = np.where(usual, hits + 1, 1.0), np.where(usual, trials - hits, 1.0)
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_share(middle, a, b) < confidence
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(usual, (low + high) / 2, np.where(trials > 0, 1.0, np.nan))


def exact_upper(hits: Column, trials: Column, confidence: float = 0.95) -> Column:
    """Upper bound of a share, for rows that are already counts by group; null without trials."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        known = (k.notna() & n.notna()).to_numpy()
        found = np.full(len(k), np.nan)
        found[known] = upper(k[known].to_numpy(dtype=float), n[known].to_numpy(dtype=float), confidence)
        return pd.Series([None if math.isnan(x) else x for x in found], dtype="float64")

    return bound(hits.cast("double"), trials.cast("double"))


def effective_trials(weight: Column) -> Column:
    """Trials that unequal weights are worth: the square of their sum over the sum of their squares."""
    return F.sum(weight) * F.sum(weight) / F.sum(weight * weight)
