"""Forecasters by name: last value, mean, autoregression, empirical quantile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auto_regression(values: np.ndarray, p: int, horizon: int) -> np.ndarray:
    """Least-squares AR(p) with intercept, iterated over the horizon; too short a series repeats its last value."""
    n = len(values)
    if n <= 2 * p + 1:
        return np.full(horizon, values[-1] if n else 0.0)
    x = np.column_stack([np.ones(n - p), *[values[p - 1 - k : n - 1 - k] for k in range(p)]])
    w = np.linalg.lstsq(x, values[p:], rcond=None)[0]
    past, out = list(values[-p:][::-1]), []
    for _ in range(horizon):
        out.append(float(np.clip(w[0] + np.dot(w[1:], past[:p]), 0.0, 1.5 * values.max())))
        past.insert(0, out[-1])
    return np.array(out)


def snarimax(values: np.ndarray, horizon: int, p: int = 3, d: int = 1, q: int = 2, m: int = 24, forget: float = 0.995) -> np.ndarray:
    """Seasonal autoregression on ``d`` differences with moving errors, learnt value by value.

    Each difference is predicted from the ``p`` before it, the last ``q`` errors
    and the one a season of ``m`` ago; recursive least squares (with slow
    forgetting) then takes in what came. Forecasts feed on themselves with errors
    of zero, and are summed back ``d`` times.
    """
    series, last = values.astype(float), []
    for _ in range(d):
        if len(series):
            last.append(series[-1])
            series = np.diff(series)
    n = 2 + p + q
    w, cov = np.zeros(n), np.eye(n) * 1000.0
    past, errors = [], [0.0] * q

    def inputs() -> np.ndarray:
        lags = [past[-k] if len(past) >= k else 0.0 for k in range(1, p + 1)]
        return np.array([1.0, *lags, *errors, past[-m] if len(past) >= m else 0.0])

    for y in series:
        x = inputs()
        error = y - w @ x
        gain = cov @ x / (forget + x @ cov @ x)
        w, cov = w + gain * error, (cov - np.outer(gain, x @ cov)) / forget
        past.append(float(y))
        errors = [float(error), *errors][:q]
    out = []
    for _ in range(horizon):
        past.append(float(w @ inputs()))
        errors = [0.0, *errors][:q]
        out.append(past[-1])
    result = np.array(out)
    for end in reversed(last):
        result = end + np.cumsum(result)
    return result


def empirical_quantile(values: np.ndarray, q: float, context: int, horizon: int) -> np.ndarray:
    """The recent values' quantile; zero below the least context."""
    return np.full(horizon, np.quantile(values[-context:], q) if len(values) >= context else 0.0)


def last_value(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.withColumn("predicted", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def mean_of_last(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    return df.withColumn("predicted", F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)))


#: Horizon forecasters of one series by name. Neural ones are a plug-in: add a function here.
FORECASTERS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "last": lambda v, h: np.full(h, v[-1] if len(v) else 0.0),
    "mean10": lambda v, h: np.full(h, v[-10:].mean() if len(v) else 0.0),
    "ar4": lambda v, h: auto_regression(v, 4, h),
    "snarimax": snarimax,
    "quantile75": lambda v, h: empirical_quantile(v, 0.75, 24, h),
}


def forecast(df: DataFrame, key: str, order: str, value: str, name: str, horizon: int) -> DataFrame:
    """``(key, step, predicted)`` for each series."""
    f = FORECASTERS[name]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = f(pdf.sort_values(order)[value].to_numpy(float), horizon)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": range(1, horizon + 1), "predicted": y})

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, step int, predicted double")
