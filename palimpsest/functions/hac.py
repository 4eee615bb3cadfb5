"""Least squares with autocorrelation-robust (Bartlett kernel) standard errors."""

from __future__ import annotations

import math

import numpy as np


def hac_fit(y: np.ndarray, x: np.ndarray, lags: int) -> dict:
    """Coefficients, their t statistics and normal p-values, and R squared.

    x has a leading column of ones.  No small-sample correction.
    """
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    rest = y - x @ beta
    score = x * rest[:, None]
    middle = score.T @ score
    for lag in range(1, lags + 1):
        gamma = score[lag:].T @ score[:-lag]
        middle += (1 - lag / (lags + 1)) * (gamma + gamma.T)
    t = beta / np.sqrt(np.diag(inverse @ middle @ inverse))
    total = ((y - y.mean()) ** 2).sum()
    return {"beta": beta, "t": t, "p": np.array([math.erfc(abs(v) / math.sqrt(2)) for v in t]), "r2": 1 - (rest**2).sum() / total}
