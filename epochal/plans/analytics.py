"""Queries over a run's traces: joins, percentiles, buckets, windows, series, forecasts, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import analytics as an
from ..operators import series as se
from ..storage import table
from . import bindings as b
from .registry import query

_HOURS = "h AS (SELECT event_type AS name, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL)"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """A series for each event type: count and total by hour."""
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name"), h.alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


_LAT = "WITH " + b.SQL_OUT + ", lat AS (SELECT request_id, ts_in, ts_out, ts_out - ts_in AS latency FROM cr JOIN outp USING (request_id))"


@query(_LAT + """ SELECT 'p' || [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99][i] AS name, round(v[i], 6) AS value FROM (SELECT quantile_cont(latency, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS v FROM lat), (SELECT unnest(range(1, 12)) AS i)
UNION ALL SELECT 'min', min(latency) FROM lat UNION ALL SELECT 'max', max(latency) FROM lat UNION ALL SELECT 'mean', round(avg(latency), 6) FROM lat""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    lat = an.latencies(b.client_requests(spark, d), b.output(spark, d)).filter("latency IS NOT NULL")
    return an.percentiles(lat, "latency").select("name", F.round("value", 6).alias("value"))


@query(_LAT + " SELECT (ts_in // 86400000) * 86400000 AS bucket, count(*) AS n, round(avg(latency), 6) AS mean_latency, round(median(latency), 6) AS p50 FROM lat GROUP BY 1")
def latency_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    lat = an.latencies(b.client_requests(spark, d), b.output(spark, d)).filter("latency IS NOT NULL")
    return lat.groupBy(se.floor_buckets(F.col("ts_in"), 86_400_000).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.median("latency"), 6).alias("p50"))


@query(_LAT + " SELECT count(*) AS n, round(avg(latency), 6) AS mean FROM lat WHERE ts_in - (SELECT min(ts_in) FROM cr) >= 864000000")
def latency_after_warmup(spark: SparkSession, d: str) -> DataFrame:
    lat = an.latencies(b.client_requests(spark, d), b.output(spark, d), 864_000_000).filter("latency IS NOT NULL")
    return lat.agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean"))


@query("WITH " + b.SQL_OUT + " SELECT (ts_out // 3600000) * 3600000 AS bucket, count(*) AS n FROM outp GROUP BY 1")
def throughput_floor_buckets(spark: SparkSession, d: str) -> DataFrame:
    return an.bucket_counts(b.output(spark, d), "ts_out", 3_600_000, "n")


@query("WITH RECURSIVE " + b.SQL_OUT + """, o AS (SELECT key, ts_in, row_number() OVER (PARTITION BY key ORDER BY ts_in) AS rn FROM cr),
r(key, rn, start, first) AS (SELECT key, rn, ts_in, true FROM o WHERE rn = 1 UNION ALL SELECT o.key, o.rn, CASE WHEN o.ts_in - r.start > 7200000 THEN o.ts_in ELSE r.start END, o.ts_in - r.start > 7200000 FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)
SELECT key, start, count(*) AS n FROM r GROUP BY key, start""")
def throughput_gap_buckets(spark: SparkSession, d: str) -> DataFrame:
    return se.gap_buckets(b.client_requests(spark, d), ["key"], "ts_in", 7_200_000)


@query("WITH " + b.SQL_OUT + ", i AS (SELECT (ts_in // 600000) * 600000 AS bucket, count(*) AS n_in FROM cr GROUP BY 1), o AS (SELECT (ts_out // 600000) * 600000 AS bucket, count(*) AS n_out FROM outp GROUP BY 1) SELECT bucket, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM i FULL JOIN o USING (bucket)")
def in_out_throughput_outer(spark: SparkSession, d: str) -> DataFrame:
    i = an.bucket_counts(b.client_requests(spark, d), "ts_in", 600_000, "n_in")
    return i.join(an.bucket_counts(b.output(spark, d), "ts_out", 600_000, "n_out"), "bucket", "full_outer").na.fill(0, ["n_in", "n_out"])


@query("WITH " + b.SQL_OUT + " SELECT request_id, ts_in FROM cr WHERE request_id NOT IN (SELECT request_id FROM outp)")
def missed_requests(spark: SparkSession, d: str) -> DataFrame:
    return b.client_requests(spark, d).join(b.output(spark, d), "request_id", "left_anti").select("request_id", "ts_in")


@query("WITH " + b.SQL_OUT + " SELECT request_id, ts_out, count(*) OVER (PARTITION BY request_id) AS copies FROM outp QUALIFY copies > 1")
def duplicate_outputs(spark: SparkSession, d: str) -> DataFrame:
    return an.duplicates(b.output(spark, d), "request_id")


@query("WITH " + b.SQL_OUT + " SELECT request_id, ts_out FROM outp ORDER BY ts_out, request_id OFFSET 20")
def skip_first_outputs(spark: SparkSession, d: str) -> DataFrame:
    """All outputs behind the first 20, in no order, so that they needn't pass through one task."""
    return an.behind_first(b.output(spark, d), ["ts_out", "request_id"], 20)


@query(f"WITH {_HOURS} SELECT name, hour, round(avg(total) OVER (PARTITION BY name ORDER BY hour ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS mean15 FROM h")
def rolling_mean_15(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("name", "hour", F.round(se.rolling_mean("total", ["name"], ["hour"], 15), 6).alias("mean15"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def sliding_mean_seconds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.round(se.sliding_mean("value", ["event_type"], "s", 3600), 6).alias("mean"))


@query(f"WITH RECURSIVE {_HOURS}, o AS (SELECT name, total, row_number() OVER (PARTITION BY name ORDER BY hour) AS rn FROM h), r(name, rn, e) AS (SELECT name, rn, total FROM o WHERE rn = 1 UNION ALL SELECT o.name, o.rn, r.e + 0.2 * (o.total - r.e) FROM r JOIN o ON o.name = r.name AND o.rn = r.rn + 1) SELECT name, round(arg_max(e, rn), 6) AS ewma FROM r GROUP BY name")
def ewma_capacity(spark: SparkSession, d: str) -> DataFrame:
    return se.ewma(hourly(spark, d), ["name"], ["hour"], "total", 0.2).select("name", F.round("ewma", 6).alias("ewma"))


@query(f"""WITH RECURSIVE {_HOURS}, o AS (SELECT name, total AS latency, CAST(n AS DOUBLE) AS batch, row_number() OVER (PARTITION BY name ORDER BY hour) AS rn FROM h),
r(name, rn, c) AS (SELECT name, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE) FROM o WHERE rn = 1 UNION ALL
SELECT o.name, o.rn, CASE WHEN batch < 2 OR latency <= 0 THEN c WHEN c IS NULL THEN latency / batch WHEN latency / batch > c AND least(batch / 8.0, 1) < 0.5 THEN c ELSE c + 0.3 * least(batch / 8.0, 1) * (latency / batch - c) END FROM r JOIN o ON o.name = r.name AND o.rn = r.rn + 1)
SELECT name, round(arg_max(coalesce(c, -1), rn), 6) AS cost FROM r GROUP BY name""")
def ewma_worker_cost(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).select("name", "hour", F.col("n").cast("double").alias("batch"), F.col("total").alias("latency"))
    return se.capacity_ewma(h, ["name"], ["hour"], 0.3, 8.0, 2.0).select("name", F.round(F.coalesce("cost", F.lit(-1.0)), 6).alias("cost"))


@query(f"""WITH RECURSIVE {_HOURS}, o AS (SELECT name, total AS backlog, CAST(n AS DOUBLE) AS tps, row_number() OVER (PARTITION BY name ORDER BY hour) AS rn FROM h),
r(name, rn, i, e, d, u) AS (SELECT name, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM o WHERE rn = 1 UNION ALL
SELECT name, rn, CASE WHEN idle THEN i ELSE ni END, CASE WHEN idle THEN e ELSE x END, CASE WHEN idle THEN d ELSE nd END, CASE WHEN idle THEN 0 ELSE 0.5 * x + 0.1 * ni + 0.2 * nd END FROM
(SELECT o.name, o.rn, i, e, d, tps <= 0 OR backlog <= 10 AS idle, backlog / tps AS x, greatest(-100, least(100, i + backlog / tps)) AS ni, 0.5 * d + 0.5 * (backlog / tps - coalesce(e, backlog / tps)) AS nd FROM r JOIN o ON o.name = r.name AND o.rn = r.rn + 1))
SELECT name, round(arg_max(i, rn), 6) AS integral, round(arg_max(u, rn), 6) AS output FROM r GROUP BY name""")
def pid_backlog(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).select("name", "hour", F.col("total").alias("backlog"), F.col("n").cast("double").alias("tps"))
    return se.pid(h, ["name"], ["hour"], 0.5, 0.1, 0.2).select("name", F.round("pid.i", 6).alias("integral"), F.round("pid.u", 6).alias("output"))


@query("SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS workers, min(c) AS bottleneck, min(c) * count(*) AS capacity FROM (SELECT ts, count(*) OVER (PARTITION BY epoch_us(ts) // 86400000000, user_id % 8) AS c, row_number() OVER (PARTITION BY epoch_us(ts) // 86400000000, user_id % 8 ORDER BY event_id) AS rn FROM events) WHERE rn = 1 GROUP BY 1")
def capacity_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    c = table(spark, d, "events").groupBy(day.alias("day"), F.pmod("user_id", F.lit(8)).alias("worker")).agg(F.count("*").alias("c"))
    return c.groupBy("day").agg(F.count("*").alias("workers"), F.min("c").alias("bottleneck")).withColumn("capacity", F.col("workers") * F.col("bottleneck"))


@query(f"WITH {_HOURS} SELECT name, hour, n, n - lag(n) OVER (PARTITION BY name ORDER BY hour) AS diff FROM h QUALIFY diff <> 0")
def scaling_change_points(spark: SparkSession, d: str) -> DataFrame:
    return se.change_points(hourly(spark, d).select("name", "hour", "n"), ["name"], ["hour"], "n")


@query(f"WITH {_HOURS}, o AS (SELECT name, total, row_number() OVER (PARTITION BY name ORDER BY hour) AS rn, count(*) OVER (PARTITION BY name) AS c FROM h) SELECT name, (rn - 1 - c % 6) // 6 AS k, round(avg(total), 6) AS value FROM o WHERE rn - 1 - c % 6 >= 0 GROUP BY ALL")
def downsample_mean(spark: SparkSession, d: str) -> DataFrame:
    return se.downsample(hourly(spark, d), ["name"], ["hour"], "total", 6).select("name", "k", F.round("value", 6).alias("value"))


@query(f"WITH {_HOURS} SELECT name, hour, (hour - min(hour) OVER ()) * 3600 AS seconds FROM h WHERE hour <= (SELECT min(m) FROM (SELECT max(hour) AS m FROM h GROUP BY name))")
def seconds_from_start(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    ends = h.groupBy("name").agg(F.max("hour").alias("m"), F.min("hour").alias("s")).agg(F.min("m").alias("end"), F.min("s").alias("start"))
    return h.crossJoin(F.broadcast(ends)).filter(F.col("hour") <= F.col("end")).select("name", "hour", ((F.col("hour") - F.col("start")) * 3600).alias("seconds"))  # one row


_FORECAST = _HOURS + """, f AS (SELECT name, hour, total AS actual, row_number() OVER w AS rn, count(*) OVER (PARTITION BY name) AS c, lag(total) OVER w AS last, avg(total) OVER (PARTITION BY name ORDER BY hour ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean10 FROM h WINDOW w AS (PARTITION BY name ORDER BY hour))"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("name").orderBy("hour")
    return hourly(spark, d).select("name", "hour", F.col("total").alias("actual"), F.lag("total").over(w).alias("last"), F.avg("total").over(w.rowsBetween(-10, -1)).alias("mean10"))


@query(f"""WITH {_FORECAST} SELECT name, round(avg(abs(mean10 - actual)), 6) AS mae, round(sqrt(avg((mean10 - actual) * (mean10 - actual))), 6) AS rmse, round(avg(CASE WHEN sign(mean10 - last) = sign(actual - last) THEN 1.0 ELSE 0.0 END), 6) AS directional_accuracy, count(*) AS n
FROM f WHERE rn > floor(c * 0.66) AND last IS NOT NULL AND mean10 IS NOT NULL GROUP BY name""")
def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    s = se.scores(forecasts(spark, d), ["name"], ["hour"], "actual", "mean10", 0.34)
    return s.select("name", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "directional_accuracy")], "n")


_TRIALS = """t AS (SELECT p_brand AS model, p_partkey AS trial, p_size AS context, p_retailprice AS mae FROM part)"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Experiments: a model for each brand, its context length and error."""
    return table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("trial"), F.col("p_size").alias("context"), F.col("p_retailprice").alias("mae"))


@query(f"WITH {_TRIALS} SELECT model, trial, context, mae FROM t QUALIFY row_number() OVER (PARTITION BY model ORDER BY mae, trial) = 1")
def best_config_per_model(spark: SparkSession, d: str) -> DataFrame:
    return an.top_n(trials(spark, d), ["model"], ["mae", "trial"], 1).drop("rank")


@query(f"WITH {_TRIALS} SELECT model, trial, context, mae, CAST(row_number() OVER (PARTITION BY model ORDER BY mae, trial) AS INTEGER) AS rank FROM t QUALIFY rank <= 10")
def top10_per_model(spark: SparkSession, d: str) -> DataFrame:
    return an.top_n(trials(spark, d), ["model"], ["mae", "trial"], 10)


@query(f"WITH {_TRIALS} SELECT model, trial, context FROM t QUALIFY rank() OVER (PARTITION BY model ORDER BY context DESC) = 1")
def longest_context_per_model(spark: SparkSession, d: str) -> DataFrame:
    return an.extremes(trials(spark, d), ["model"], "context", largest=True).select("model", "trial", "context")


@query(f"WITH {_TRIALS}, g AS (SELECT model, coalesce(nullif(context % 5, 0), 99) AS ctx, mae FROM t) SELECT model, ctx, count(*) AS n, round(avg(mae), 4) AS mean, round(min(mae), 4) AS best FROM g GROUP BY ALL")
def group_by_parameters(spark: SparkSession, d: str) -> DataFrame:
    g = trials(spark, d).withColumn("ctx", F.coalesce(F.nullif(F.col("context") % 5, F.lit(0)), F.lit(99)))
    return g.groupBy("model", "ctx").agg(F.count("*").alias("n"), F.round(F.avg("mae"), 4).alias("mean"), F.round(F.min("mae"), 4).alias("best"))


@query(f"WITH {_TRIALS} SELECT model, context % 4 AS k, round(avg(mae), 4) AS v FROM t GROUP BY ALL")
def map_mean_by_key(spark: SparkSession, d: str) -> DataFrame:
    m = trials(spark, d).select("model", F.create_map(F.col("context") % 4, F.col("mae")).alias("m"))
    return an.map_means(m, ["model"], "m").select("model", F.explode("m").alias("k", "v")).select("model", "k", F.round("v", 4).alias("v"))


@query(f"WITH {_FORECAST}, e AS (SELECT name, 'last' AS model, avg(abs(last - actual)) / avg(actual) * 100 AS err FROM f WHERE last IS NOT NULL GROUP BY name UNION ALL SELECT name, 'mean10', avg(abs(mean10 - actual)) / avg(actual) * 100 FROM f WHERE mean10 IS NOT NULL GROUP BY name) SELECT name, model, round(err, 6) AS relative_error FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY err, model) = 1")
def relative_error_best(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    e = f.select("name", "actual", F.explode(F.create_map(F.lit("last"), F.col("last"), F.lit("mean10"), F.col("mean10"))).alias("model", "p")).filter("p IS NOT NULL")
    e = e.groupBy("name", "model").agg((F.avg(F.abs(F.col("p") - F.col("actual"))) / F.avg("actual") * 100).alias("err"))
    return an.top_n(e, ["name"], ["err", "model"], 1).select("name", "model", F.round("err", 6).alias("relative_error"))


@query("""SELECT DISTINCT m AS model, c AS context, CASE WHEN m IN ('lstm', 'gru') THEN h END AS hidden FROM (SELECT unnest(['lstm', 'gru', 'mean10', 'last']) AS m), (SELECT unnest([16, 32, 64]) AS c), (SELECT unnest([8, 32]) AS h)""")
def forecast_grid(spark: SparkSession, d: str) -> DataFrame:
    return an.parameter_grid(spark, {"model": ["lstm", "gru", "mean10", "last"], "context": [16, 32, 64], "hidden": [8, 32]}, {"hidden": {"model": ["mean10", "last"]}})


@query(f"WITH {_HOURS} SELECT hour, max(total) FILTER (name = 'click') AS click, max(total) FILTER (name = 'error') AS error, max(total) FILTER (name = 'purchase') AS purchase, max(total) FILTER (name = 'signup') AS signup, max(total) FILTER (name = 'view') AS \"view\" FROM h GROUP BY hour")
def series_pivot_align(spark: SparkSession, d: str) -> DataFrame:
    return an.align(hourly(spark, d), "hour", "name", "total", ["click", "error", "purchase", "signup", "view"])


_COUNTER = _HOURS + ", c AS (SELECT name, hour, hour * 3600 AS s, CAST(sum(n) OVER (PARTITION BY name ORDER BY hour) AS BIGINT) AS v FROM h)"


def counters(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("name").orderBy("hour")
    return hourly(spark, d).select("name", "hour", (F.col("hour") * 3600).alias("s"), F.sum("n").over(w).alias("v"))


@query(f"WITH {_COUNTER} SELECT name, s, round((last(v) OVER w - first(v) OVER w) / nullif(last(s) OVER w - first(s) OVER w, 0), 9) AS rate FROM c WINDOW w AS (PARTITION BY name ORDER BY s RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW)")
def prom_rate(spark: SparkSession, d: str) -> DataFrame:
    return se.rate(counters(spark, d), ["name"], "s", "v", 18000).select("name", "s", F.round("rate", 9).alias("rate"))


@query(f"WITH {_COUNTER}, r AS (SELECT s, (last(v) OVER w - first(v) OVER w) / nullif(last(s) OVER w - first(s) OVER w, 0) AS rate FROM c WINDOW w AS (PARTITION BY name ORDER BY s RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW)) SELECT s, round(sum(rate), 9) AS throughput FROM r GROUP BY s")
def throughput_log(spark: SparkSession, d: str) -> DataFrame:
    return se.rate(counters(spark, d), ["name"], "s", "v", 36000).groupBy("s").agg(F.round(F.sum("rate"), 9).alias("throughput"))


@query("SELECT w AS workers, round(p0.y + (w - p0.x) * (p1.y - p0.y) / (p1.x - p0.x), 4) AS tps FROM (SELECT unnest([1, 3, 6, 12, 24, 40]) AS w), LATERAL (SELECT x, y, nx, ny FROM (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny, row_number() OVER (ORDER BY x) AS rn FROM (VALUES (2, 100.0), (4, 190.0), (8, 350.0), (16, 600.0), (32, 1000.0)) v(x, y)) WHERE nx IS NOT NULL AND (x <= w OR rn = 1) ORDER BY x DESC LIMIT 1) q, LATERAL (SELECT q.x, q.y) p0(x, y), LATERAL (SELECT q.nx, q.ny) p1(x, y)")
def interpolate_throughput(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(2, 100.0), (4, 190.0), (8, 350.0), (16, 600.0), (32, 1000.0)], "workers int, tps double")
    wanted = spark.createDataFrame([(w,) for w in (1, 3, 6, 12, 24, 40)], "workers int")
    return se.interpolate(known, wanted, "workers", "tps").select("workers", F.round("tps", 4).alias("tps"))


@query("WITH " + b.SQL_OUT + ", l AS (SELECT request_id, key, ts_in FROM cr WHERE request_id % 2 = 0), r AS (SELECT key, ts_in, request_id AS seen FROM cr WHERE request_id % 2 = 1) SELECT l.key, l.ts_in, r.seen FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.ts_in >= r.ts_in")
def as_of_last_request(spark: SparkSession, d: str) -> DataFrame:
    c = b.client_requests(spark, d)
    return se.as_of(c.filter("request_id % 2 = 0").select("key", "ts_in"), c.filter("request_id % 2 = 1").select("key", "ts_in", F.col("request_id").alias("seen")), ["key"], "ts_in", "seen")


@query("SELECT t, round(1000 + 200 * cos(2 * pi() * t / 600), 6) AS tps FROM (SELECT unnest(range(0, 3600, 10)) AS t)")
def load_cosine(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 3600, 10).select(F.col("id").alias("t"), F.round(fn.cosine_load(F.col("id"), 1000.0, 200.0, 600.0), 6).alias("tps"))


@query("SELECT t, CAST(100 + 50 * floor(t / 300) AS DOUBLE) AS tps FROM (SELECT unnest(range(0, 3600, 10)) AS t)")
def load_step(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 3600, 10).select(F.col("id").alias("t"), fn.step_load(F.col("id"), 100.0, 50.0, 300.0).cast("double").alias("tps"))


@query("SELECT t, round(100 + 900 * least(t / 1800.0, 1), 6) AS up, round(1000 - 900 * least(t / 1800.0, 1), 6) AS down FROM (SELECT unnest(range(0, 3600, 10)) AS t)")
def load_ramp(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("id")
    return spark.range(0, 3600, 10).select(t.alias("t"), F.round(fn.linear_load(t, 100.0, 1000.0, 1800.0), 6).alias("up"), F.round(fn.linear_load(t, 1000.0, 100.0, 1800.0), 6).alias("down"))


@query(f"WITH {_HOURS}, tr AS (SELECT hour - min(hour) OVER () AS i, CAST(sum(n) AS BIGINT) AS tps FROM h GROUP BY hour) SELECT t, (SELECT tps FROM tr WHERE i <= t // 60 ORDER BY i DESC LIMIT 1) AS tps FROM (SELECT unnest(range(0, 43200, 45)) AS t)")
def load_trace(spark: SparkSession, d: str) -> DataFrame:
    """The trace's rate at an elapsed time, one point a minute, by an as-of join; it clamps to the last point."""
    tr = hourly(spark, d).groupBy("hour").agg(F.sum("n").alias("tps")).withColumn("one", F.lit(0))
    start = tr.agg(F.min("hour").alias("start"))
    tr = tr.crossJoin(F.broadcast(start)).select("one", ((F.col("hour") - F.col("start")) * 60).alias("t"), "tps")
    return se.as_of(spark.range(0, 43200, 45).select(F.lit(0).alias("one"), F.col("id").alias("t")), tr, ["one"], "t", "tps").select("t", "tps")


@query("WITH z AS (SELECT i, 1 / pow(i + 1, 0.9) AS w FROM (SELECT unnest(range(100)) AS i)) SELECT i AS rank, round(sum(w) OVER (ORDER BY i) / (SELECT sum(w) FROM z), 9) AS cdf FROM z")
def zipf_cdf(spark: SparkSession, d: str) -> DataFrame:
    z = spark.range(100).select(F.col("id").alias("rank"), (F.lit(1.0) / F.pow(F.col("id") + 1, F.lit(0.9))).alias("w"))
    total = z.agg(F.sum("w").alias("t"))
    return z.crossJoin(F.broadcast(total)).select("rank", F.round(F.sum("w").over(Window.orderBy("rank")) / F.col("t"), 9).alias("cdf"))  # a hundred rows


@query("SELECT n, s[n // 100 + 1] || s[n // 10 % 10 + 1] || s[n % 10 + 1] AS name FROM (SELECT unnest(range(1000)) AS n, ['BAR', 'OUGHT', 'ABLE', 'PRI', 'PRES', 'ESE', 'ANTI', 'CALLY', 'ATION', 'EING'] AS s)")
def lastname_syllables(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("n"), fn.last_name(F.col("id")).alias("name"))


@query("SELECT n_name AS name FROM nation WHERE contains(n_name, '1') AND contains(n_name, 'N') ORDER BY name")
def find_runs(spark: SparkSession, d: str) -> DataFrame:
    keywords = F.array(F.lit("1"), F.lit("N"))
    return table(spark, d, "nation").filter(F.forall(keywords, lambda k: F.contains(F.col("n_name"), k))).select(F.col("n_name").alias("name")).orderBy("name")


@query("SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, round(value * i, 6) AS predicted FROM events, (SELECT unnest(range(1, 4)) AS i)")
def prediction_log_explode(spark: SparkSession, d: str) -> DataFrame:
    """The predictions of every event."""
    log = table(spark, d, "events").select("event_id", F.to_json(F.array(*[F.col("value") * i for i in (1, 2, 3)])).alias("horizon"))
    x = log.select("event_id", F.posexplode(F.from_json("horizon", "array<double>")).alias("pos", "p"))
    return x.select("event_id", "pos", F.round("p", 6).alias("predicted"))


@query(f"WITH {_HOURS}, c AS (SELECT name, hour, n > 2 AS busy, lag(n > 2) OVER (PARTITION BY name ORDER BY hour) AS was FROM h), s AS (SELECT name, hour, busy, lead(hour) OVER (PARTITION BY name ORDER BY hour) AS next FROM c WHERE busy <> coalesce(was, false)) SELECT name, hour AS started, next AS ended FROM s WHERE busy AND next IS NOT NULL")
def migration_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Start and end of busy times: a change up paired with the next change."""
    w = Window.partitionBy("name").orderBy("hour")
    c = hourly(spark, d).select("name", "hour", (F.col("n") > 2).alias("busy")).withColumn("was", F.coalesce(F.lag("busy").over(w), F.lit(False)))
    s = c.filter("busy <> was").withColumn("ended", F.lead("hour").over(w))
    return s.filter("busy AND ended IS NOT NULL").select("name", F.col("hour").alias("started"), "ended")


@query("WITH g AS (SELECT w AS workers, m AS multi FROM (SELECT unnest([2, 4, 8, 16]) AS w), (SELECT unnest([0, 20, 50, 100]) AS m) WHERE w * m <= 800) SELECT * FROM g EXCEPT SELECT CAST(n_nationkey AS INTEGER), CAST(n_regionkey * 20 AS INTEGER) FROM nation")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    g = an.parameter_grid(spark, {"workers": [2, 4, 8, 16], "multi": [0, 20, 50, 100]}).filter("workers * multi <= 800")
    done = table(spark, d, "nation").select(F.col("n_nationkey").alias("workers"), (F.col("n_regionkey") * 20).alias("multi"))
    return g.join(done, ["workers", "multi"], "left_anti")


@query(f"WITH {_HOURS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hour DESC) AS k FROM h) SELECT name, hour, n FROM r WHERE k <= 60")
def series_ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return an.top_n(hourly(spark, d), ["name"], [F.col("hour").desc()], 60).select("name", "hour", "n")


@query(f"WITH {_HOURS}, t AS (SELECT hour, avg(total) AS m FROM h GROUP BY hour) SELECT hour - (SELECT min(hour) FROM h) - 24 AS rel, round(m, 6) AS mean FROM t WHERE hour - (SELECT min(hour) FROM h) >= 24")
def align_runs(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    start = h.agg(F.min("hour").alias("start"))
    t = h.groupBy("hour").agg(F.avg("total").alias("m")).crossJoin(F.broadcast(start))  # one row
    return t.withColumn("rel", F.col("hour") - F.col("start") - 24).filter("rel >= 0").select("rel", F.round("m", 6).alias("mean"))
