"""Analysis of a run: latency, throughput, missing and repeated replies, conservation, state differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]


def latencies(requests: DataFrame, output: DataFrame, warmup_ms: int = 0) -> DataFrame:
    """Requests joined with their replies; ``latency`` is null for a missing one. Requests of the warm-up are left out."""
    r = requests
    if warmup_ms:
        start = r.agg(F.min("ts_in").alias("start"))
        r = r.crossJoin(F.broadcast(start)).filter(F.col("ts_in") - F.col("start") >= warmup_ms).drop("start")  # one row
    return r.join(output, "request_id", "left").withColumn("latency", F.col("ts_out") - F.col("ts_in"))


def percentiles(df: DataFrame, value: str, points: list[float] | None = None) -> DataFrame:
    """Interpolated percentiles, one row each, with minimum, maximum and mean as further rows."""
    points = points or PERCENTILES
    a = df.agg(F.percentile(value, F.array(*map(F.lit, points))).alias("p"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), F.avg(value).alias("mean"))
    rows = F.concat(F.transform(F.arrays_zip(F.array(*[F.lit(f"p{round(100 * x)}") for x in points]).alias("n"), F.col("p").alias("v")), lambda z: F.struct(z["n"].alias("name"), z["v"].alias("value"))), F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("min", "max", "mean")]))
    return a.select(F.explode(rows).alias("x")).select("x.name", "x.value")


def bucket_counts(df: DataFrame, ts: str, width: int, out: str) -> DataFrame:
    return df.groupBy((F.floor(F.col(ts) / width) * width).alias("bucket")).agg(F.count("*").alias(out))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key repeats."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(key))).filter("copies > 1")


def conserved(state: DataFrame, value: str, start: int) -> DataFrame:
    """Total, expected total and whether they agree."""
    a = state.agg(F.count("*").alias("keys"), F.sum(value).alias("total"))
    return a.select("keys", "total", (F.col("keys") * start).alias("expected"), (F.col("total") == F.col("keys") * start).alias("consistent"))


def state_diff(expected: DataFrame, observed: DataFrame, key: str = "key") -> DataFrame:
    """Keys with wrong values or missing on a side."""
    e, o = expected.select(key, F.col("value").alias("expected")), observed.select(key, F.col("value").alias("observed"))
    d = e.join(o, key, "full_outer").filter("expected IS NULL OR observed IS NULL OR expected <> observed")
    return d.withColumn("problem", F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("wrong"))


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def extremes(df: DataFrame, keys: list[str], value: str, largest: bool = False) -> DataFrame:
    """All rows that attain a key's least (or largest) value, ties included."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    return df.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(order))).filter("__rank = 1").drop("__rank")


def map_means(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean of a map's values by map key, back as one map a group."""
    e = df.select(*keys, F.explode(column).alias("k", "v")).groupBy(*keys, "k").agg(F.avg("v").alias("v"))
    return e.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def align(df: DataFrame, ts: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One column a series, rows aligned on time."""
    return df.groupBy(ts).pivot(name, names).agg(F.avg(value))


def parameter_grid(spark, grid: dict[str, list], irrelevant: dict[str, dict[str, list]] | None = None) -> DataFrame:
    """All combinations; a parameter that another's value makes irrelevant is null; equal rows count once."""
    df = spark.range(1).drop("id")
    for k, v in grid.items():
        df = df.select("*", F.explode(F.array(*map(F.lit, v))).alias(k))
    for k, when in (irrelevant or {}).items():
        for other, values in when.items():
            df = df.withColumn(k, F.when(~F.col(other).isin(values), F.col(k)))
    return df.distinct()


def behind_first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """All rows but the first ``n`` in an order of all columns."""
    first = rows.orderBy(*order).limit(n).collect()  # n rows
    if len(first) < n:
        return rows.limit(0)
    if not first:
        return rows
    last = first[-1]
    place = F.struct(*order)
    at = F.struct(*[F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    return rows.filter(place > at).unionByName(rows.filter(place == at).offset(first.count(last)))
