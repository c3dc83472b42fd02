"""Queries over state access, sets, participants, forecasts, generators and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import elasticity, forecast, partitioning, series
from ..operators import state as st
from ..operators import transactions as tx
from ..storage import shared_dir, table
from ..streaming import balances
from . import bindings as b
from .analytics import _HOURS, hourly
from .dataflow import round_robin_assignment
from .registry import query


def _state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.lit("customer").alias("operator"), F.pmod("c_custkey", F.lit(8)).cast("int").alias("part"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("t_id"), F.lit("customer").alias("operator"), F.pmod("o_custkey", F.lit(8)).cast("int").alias("part"), F.col("o_custkey").alias("key"))


@query("SELECT o_orderkey AS t_id, o_custkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE c_acctbal END AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def state_point_reads(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("t_id"), F.lit("customer").alias("operator"), F.col("o_custkey").alias("key"), F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit(0.0).alias("value")), F.struct(F.lit(2).alias("ordinal"), F.col("o_totalprice").alias("value")))).alias("x")).select("t_id", "operator", "key", "x.*")
    return st.get(_asks(spark, d), _state(spark, d), own).select("t_id", "key", "value")


@query("SELECT o_orderkey AS t_id, keys, least, most FROM orders JOIN (SELECT c_custkey % 8 AS part, count(*) AS keys, round(min(c_acctbal), 4) AS least, round(max(c_acctbal), 4) AS most FROM customer GROUP BY 1) ON part = o_custkey % 8")
def state_partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan of every request; a partition's totals are taken once."""
    totals = _state(spark, d).groupBy("operator", "part").agg(F.count("*").alias("keys"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))
    return _asks(spark, d).join(totals, ["operator", "part"]).select("t_id", "keys", "least", "most")


@query("SELECT o_orderkey AS t_id, o_custkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def state_exists(spark: SparkSession, d: str) -> DataFrame:
    return st.exists(_asks(spark, d), _state(spark, d).filter("value > 5000")).select("t_id", "key")


@query("SELECT c_custkey AS key, coalesce(CASE WHEN c_custkey % 3 = 0 THEN -1.0 END, c_acctbal) AS value FROM customer WHERE c_custkey % 10 <> 9 UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE c_custkey % 10 = 9 AND c_custkey % 3 = 0")
def state_batch_insert(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    rows = s.filter("key % 3 = 0").withColumn("value", F.lit(-1.0))
    return st.batch_insert(s.filter("key % 10 <> 9"), rows).select("key", "value")


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 5 <> 0")
def state_delete(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    return st.delete(s, s.filter("key % 5 = 0")).select("key", "value")


@query("WITH " + b.SQL_ACC + " SELECT t_id, string_agg(DISTINCT part::VARCHAR, ',' ORDER BY part::VARCHAR) AS parts, count(DISTINCT part) AS n FROM acc_all GROUP BY t_id")
def chain_participants(spark: SparkSession, d: str) -> DataFrame:
    a = b.accesses(b.requests(spark, d)).groupBy("t_id").agg(F.sort_array(F.collect_set(F.col("part").cast("string"))).alias("p"))
    return a.select("t_id", F.array_join("p", ",").alias("parts"), F.size("p").cast("long").alias("n"))


@query("WITH " + b.SQL_RES + ", ra AS (SELECT DISTINCT key FROM acc WHERE mode = 'r'), wa AS (SELECT DISTINCT key FROM acc WHERE mode = 'w') SELECT key, 'both' AS side FROM (SELECT * FROM ra INTERSECT SELECT * FROM wa) UNION ALL SELECT key, 'one' FROM ((SELECT * FROM ra EXCEPT SELECT * FROM wa) UNION (SELECT * FROM wa EXCEPT SELECT * FROM ra))")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = b.live_accesses(b.requests(spark, d))
    r, w = a.filter("mode = 'r'").select("key").distinct(), a.filter("mode = 'w'").select("key").distinct()
    both = r.intersect(w).withColumn("side", F.lit("both"))
    one = r.withColumn("r", F.lit(1)).join(w.withColumn("w", F.lit(1)), "key", "full_outer").filter("r IS NULL OR w IS NULL").select("key", F.lit("one").alias("side"))
    return both.unionByName(one)


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 150")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    """The verification reads at the end of a run."""
    return table(spark, d, "events").orderBy(F.col("event_id").desc()).limit(150).select("event_id", "user_id")


@query("WITH a AS (SELECT n_regionkey AS operator, n_nationkey AS part, CAST([0, 1, 2, 3][(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1) % 4 + 1] AS INTEGER) AS worker FROM nation) SELECT operator, part, worker AS from_worker, CAST((worker + 1) % 5 AS INTEGER) AS to_worker FROM a WHERE part % 2 = 0")
def moved_partitions(spark: SparkSession, d: str) -> DataFrame:
    a = round_robin_assignment(spark, d)
    new = a.withColumn("worker", F.when(F.col("part") % 2 == 0, F.pmod(F.col("worker") + 1, F.lit(5))).otherwise(F.col("worker")).cast("int"))
    return elasticity.moved_partitions(a, new)


@query(f"WITH RECURSIVE {_HOURS}, o AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY hour) AS rn FROM h), r(name, rn, strikes, wait) AS (SELECT name, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o WHERE rn = 1 UNION ALL SELECT o.name, o.rn, CASE WHEN n > 6 THEN least(strikes + 1, 5) ELSE strikes END, CASE WHEN n > 6 THEN CAST(30 * pow(2, least(strikes + 1, 5)) AS BIGINT) ELSE greatest(wait - 10, 0) END FROM r JOIN o ON o.name = r.name AND o.rn = r.rn + 1) SELECT name, arg_max(strikes, rn) AS strikes, arg_max(wait, rn) AS wait FROM r GROUP BY name")
def scale_down_strikes(spark: SparkSession, d: str) -> DataFrame:
    """A correction doubles the wait before the next scale-down; quiet hours count it down."""
    init = F.struct(F.lit(0).cast("long").alias("strikes"), F.lit(0).cast("long").alias("wait"))

    def step(s, r):
        strikes = F.when(r["n"] > 6, F.least(s["strikes"] + 1, F.lit(5).cast("long"))).otherwise(s["strikes"])
        wait = F.when(r["n"] > 6, (F.lit(30) * F.pow(F.lit(2.0), strikes)).cast("long")).otherwise(F.greatest(s["wait"] - 10, F.lit(0).cast("long")))
        return F.struct(strikes.alias("strikes"), wait.alias("wait"))

    f = series.fold(hourly(spark, d), ["name"], ["hour"], ["n"], init, step)
    return f.select("name", "folded.strikes", "folded.wait")


@query(f"WITH {_HOURS}, k AS (SELECT name, total, row_number() OVER (PARTITION BY name ORDER BY hour DESC) AS r FROM h) SELECT name, CAST(s AS INTEGER) AS step, round(avg(total), 6) AS predicted FROM k, (SELECT unnest(range(1, 4)) AS s) WHERE r <= 10 GROUP BY ALL")
def forecast_mean10(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast(hourly(spark, d), "name", "hour", "total", "mean10", 3).withColumn("predicted", F.round("predicted", 6))


@query()
def forecast_seasonal(spark: SparkSession, d: str) -> DataFrame:
    """Online seasonal model of each series; the tests hold it against series whose course is known."""
    return forecast.forecast(hourly(spark, d), "name", "hour", "total", "snarimax", 6).withColumn("predicted", F.round("predicted", 6))


@query()
def forecast_auto_regression(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast(hourly(spark, d), "name", "hour", "total", "ar4", 6).withColumn("predicted", F.round("predicted", 6))


@query(f"WITH {_HOURS}, k AS (SELECT name, total, row_number() OVER (PARTITION BY name ORDER BY hour DESC) AS r FROM h), q AS (SELECT name, quantile_cont(total, 0.75) AS v FROM k WHERE r <= 24 GROUP BY name) SELECT name, CAST(s AS INTEGER) AS step, round(v, 6) AS predicted FROM q, (SELECT unnest(range(1, 4)) AS s)")
def forecast_quantile(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast(hourly(spark, d), "name", "hour", "total", "quantile75", 3).withColumn("predicted", F.round("predicted", 6))


def _streamed(spark: SparkSession, d: str, plan) -> DataFrame:
    """Runs a streaming aggregate over the events to its end; the last batch holds the complete result."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.repartitionByRange(4, "ts").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = plan(stream).writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


@query("SELECT CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1")
def streaming_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: balances.bucket_stream(s, "ts", "1 hour", "2 hours")).select(F.unix_seconds("start").alias("start"), "n")


@query("SELECT CAST((epoch_us(ts) // 3600000000 - k) * 3600 AS BIGINT) AS start, round(avg(value), 6) AS mean FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1")
def streaming_sliding_mean(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: balances.sliding_stream(s, "ts", "value", "3 hours", "1 hour", "4 hours")).select(F.unix_seconds("start").alias("start"), F.round("mean", 6).alias("mean"))


@query("WITH " + b.SQL_RES + " SELECT epoch, t_id FROM ser WHERE epoch = 1 ORDER BY t_id")
def sequencer_aborted(spark: SparkSession, d: str) -> DataFrame:
    """Sorted losers of the current epoch."""
    return tx.conflicts(b.live_accesses(b.requests(spark, d))).filter("epoch = 1").orderBy("t_id")


@query("SELECT CAST(CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id % 6 END AS INTEGER) AS part, count(*) AS n FROM events GROUP BY 1")
def route_requests(spark: SparkSession, d: str) -> DataFrame:
    """Ingress routing: a null key has no partition."""
    key = F.when(F.col("user_id") % 9 != 0, F.col("user_id"))
    return table(spark, d, "events").select(partitioning.partition_of(key, 6).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
