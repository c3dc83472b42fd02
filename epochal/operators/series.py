"""Ordered folds, windows and series: smoothing, control, capacity, forecasts, alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], init: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, out: str = "folded") -> DataFrame:
    """Order-dependent fold of each key's rows as one JVM expression. A key's rows must fit in one array."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    agg = F.aggregate(rows, init, step, finish) if finish else F.aggregate(rows, init, step)
    return df.groupBy(*keys).agg(agg.alias(out))


def rolling_mean(value: str, keys: list[str], order: list[str], rows: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0))


def sliding_mean(value: str, keys: list[str], seconds: str, width: int) -> Column:
    """Mean of the samples of the last ``width`` seconds, the current one included."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-width, 0))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """Last exponentially weighted mean of each key, seeded with its first value."""
    init = F.lit(None).cast("double")
    return fold(df, keys, order, [value], init, lambda e, r: F.coalesce(e + alpha * (r[value].cast("double") - e), r[value].cast("double")), out="ewma")


def pid(df: DataFrame, keys: list[str], order: list[str], kp: float, ki: float, kd: float, smooth: float = 0.5, limit: float = 100.0) -> DataFrame:
    """Controller over ``backlog / tps`` with a clamped integral and a smoothed derivative; idle samples leave it untouched."""
    init = F.struct(F.lit(0.0).alias("i"), F.lit(None).cast("double").alias("e"), F.lit(0.0).alias("d"), F.lit(0.0).alias("u"))

    def step(s, r):
        e = r["backlog"] / F.when(r["tps"] > 0, r["tps"])
        i = F.greatest(F.lit(-limit), F.least(F.lit(limit), s["i"] + e))
        d = F.lit(1 - smooth) * s["d"] + F.lit(smooth) * (e - F.coalesce(s["e"], e))
        u = F.lit(kp) * e + F.lit(ki) * i + F.lit(kd) * d
        idle = (r["tps"] <= 0) | (r["backlog"] <= 10)
        return F.when(idle, F.struct(s["i"].alias("i"), s["e"].alias("e"), s["d"].alias("d"), F.lit(0.0).alias("u"))).otherwise(F.struct(i.alias("i"), e.alias("e"), d.alias("d"), u.alias("u")))

    return fold(df, keys, order, ["backlog", "tps"], init, step, out="pid")


def capacity_ewma(df: DataFrame, keys: list[str], order: list[str], alpha: float, full: float, least: float) -> DataFrame:
    """Cost per request: batches below ``least`` are skipped, the weight is batch / full, and rises count from half a batch on only."""
    init = F.lit(None).cast("double")

    def step(c, r):
        cost = r["latency"] / r["batch"]
        w = F.least(r["batch"] / full, F.lit(1.0))
        new = F.when(c.isNull(), cost).when((cost > c) & (w < 0.5), c).otherwise(c + alpha * w * (cost - c))
        return F.when((r["batch"] < least) | (r["latency"] <= 0), c).otherwise(new)

    return fold(df, keys, order, ["batch", "latency"], init, step, out="cost")


def gap_buckets(df: DataFrame, keys: list[str], ts: str, width: int) -> DataFrame:
    """Greedy buckets: a new one opens at a time more than ``width`` after the open bucket's start. One row a bucket.

    Each bucket's end is found by bisection in the key's sorted times, so the
    work is linear; a key's distinct times, with their counts, must fit in memory.
    """
    times = df.groupBy(*keys, F.col(ts).cast("long").alias("start")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        t, n = pdf["start"].to_numpy(), np.r_[0, pdf["n"].to_numpy().cumsum()]
        cuts = [0]
        while cuts[-1] < len(t):
            cuts.append(int(np.searchsorted(t, t[cuts[-1]] + width, "right")))
        out = pd.DataFrame({"start": t[cuts[:-1]], "n": np.diff(n[cuts])})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return times.groupBy(*keys).applyInPandas(run, times.select(*keys, "start", "n").schema)


def floor_buckets(ts, width: int) -> Column:
    return F.floor(ts / width) * width


def downsample(df: DataFrame, keys: list[str], order: list[str], value: str, r: int) -> DataFrame:
    """Means of successive groups of ``r`` values; ``n mod r`` values at the front are left out."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "cnt": F.count("*").over(w)})
    d = d.withColumn("k", F.floor((F.col("rn") - 1 - F.col("cnt") % r) / r)).filter("k >= 0")
    return d.groupBy(*keys, "k").agg(F.avg(value).alias("value"))


def upsample(df: DataFrame, r: int) -> DataFrame:
    return df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))


def change_points(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows where the value differs from the one before."""
    return df.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))).filter("diff <> 0")


def rate(df: DataFrame, keys: list[str], seconds: str, value: str, width: int) -> DataFrame:
    """Increase per second over the samples of the last ``width`` seconds; counters that restart are taken as they are."""
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-width, 0)
    dv, dt = F.last(value).over(w) - F.first(value).over(w), F.last(seconds).over(w) - F.first(seconds).over(w)
    return df.withColumn("rate", F.when(dt > 0, dv / dt))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """The right side's last value at or before each left time, by one union and one window."""
    u = left.select(*keys, ts, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(*keys, ts, F.lit(0).alias("side"), value))
    w = Window.partitionBy(*keys).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("side = 1").drop("side")


def scores(df: DataFrame, keys: list[str], order: list[str], actual: str, predicted: str, share: float = 0.34) -> DataFrame:
    """MAE, RMSE and directional accuracy on the last ``share`` of each key's rows."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "cnt": F.count("*").over(w), "before": F.lag(actual).over(w.orderBy(*order))})
    d = d.filter(F.col("rn") > F.floor(F.col("cnt") * (1 - share))).filter(F.col("before").isNotNull() & F.col(predicted).isNotNull())
    e = F.col(predicted) - F.col(actual)
    right = (F.signum(F.col(predicted) - F.col("before")) == F.signum(F.col(actual) - F.col("before"))).cast("double")
    return d.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(right).alias("directional_accuracy"), F.count("*").alias("n"))


def interpolate(known: DataFrame, wanted: DataFrame, x: str, y: str) -> DataFrame:
    """Linear inter- and extrapolation of ``y`` at the wanted ``x``; the known points are few and sorted into one array."""
    points = known.agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    d = wanted.crossJoin(points)  # one row on the right
    i = F.greatest(F.lit(1), F.least(F.size("p") - 1, F.size(F.filter("p", lambda q: q["x"] <= F.col(x)))))
    a, b = F.element_at("p", i), F.element_at("p", i + 1)
    return d.withColumn(y, a["y"] + (F.col(x) - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])).drop("p")
