"""Weights that combine models: for each target the w >= 0 of sum 1 with the least w'Pw, P the mean products of the models' errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .stats import error_moments


def simplex_weights(p: np.ndarray) -> np.ndarray:
    """The least w'Pw on the simplex, by an active set: from the best single model on, each step goes to the stationary point of the models in use, or as far towards it as all weights stay positive; then the model that lowers the value most is let in, until none does."""
    k = len(p)
    p = p + 1e-12 * np.trace(p) / k * np.eye(k)
    w = np.zeros(k)
    w[np.diag(p).argmin()] = 1.0
    used = w > 0
    scale = max(np.abs(p).max(initial=0), 1e-300)
    for _ in range(100 * k + 100):
        while True:
            s = np.flatnonzero(used)
            # stationary on the support: P w = c with the sum 1, as one symmetric system, which holds for singular P too
            system = np.block([[p[np.ix_(s, s)] / scale, np.ones((len(s), 1))], [np.ones((1, len(s))), np.zeros((1, 1))]])
            aim = np.linalg.lstsq(system, np.append(np.zeros(len(s)), 1.0), rcond=None)[0][:-1]
            if (aim > 0).all():
                w[:] = 0
                w[s] = aim / aim.sum()
                break
            low = aim <= 0
            step = (w[s][low] / (w[s][low] - aim[low])).min()
            w[s] = np.maximum(w[s] + step * (aim - w[s]), 0)
            blocked = s[low][np.argmin(w[s][low] / np.maximum(w[s][low] - aim[low], 1e-300))] if step > 0 else s[low][0]
            w[blocked] = 0
            used = used & (w > 0)
            if used.sum() == 1:
                w[used] = 1.0
        slope = p @ w
        value = w @ slope
        slope[used] = np.inf
        best = int(slope.argmin())
        if slope[best] >= value - 1e-12 * scale:
            break
        used[best] = True
    return w / w.sum()


def stacking_weights(errors: DataFrame, row: str, target: str, model: str, error: str = "e") -> DataFrame:
    """(target, model, weight) from long errors (row, target, model, e)."""
    moments = error_moments(errors, row, target, model, error)
    kind, name = errors.schema[target].dataType.simpleString(), errors.schema[model].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        models = sorted(pdf["i"].unique())
        at = {m: k for k, m in enumerate(models)}
        p = np.zeros((len(models), len(models)))
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["p"]):
            p[at[i], at[j]] = v
        return pd.DataFrame({target: [pdf[target].iloc[0]] * len(models), model: models, "weight": simplex_weights(p)})

    return moments.groupBy(target).applyInPandas(solve, f"`{target}` {kind}, `{model}` {name}, weight double")


def two_model_weight(p11: Column, p12: Column, p22: Column) -> Column:
    """The first of two models' weights in closed form; a half each where both are the same."""
    w = F.try_divide(p22 - p12, p11 + p22 - 2 * p12)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)), F.lit(0.5))


def stack_predictions(predictions: DataFrame, truth: DataFrame, row: str, target: str, model: str) -> DataFrame:
    """(target, model, weight) of fitted models: ``predictions`` (row, target, model, p), ``truth`` (row, target, y)."""
    errors = predictions.join(truth, [row, target]).select(row, target, model, (F.col("y") - F.col("p")).alias("e"))
    return stacking_weights(errors, row, target, model)
