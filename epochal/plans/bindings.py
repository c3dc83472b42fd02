"""The supplied tables in the roles of a request log, access sets, state and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transactions as tx
from ..storage import table

WORKERS = 8
EPOCH = 100


def requests(spark: SparkSession, d: str) -> DataFrame:
    """``(request_id, worker, key, function, arg, ts_ms, other, t_id, epoch)`` from ``events``."""
    e = table(spark, d, "events")
    n = e.agg(F.countDistinct("user_id").alias("n"))
    r = e.select(F.col("event_id").alias("request_id"), F.pmod("user_id", F.lit(WORKERS)).alias("worker"), F.col("user_id").alias("key"), F.col("event_type").alias("function"), F.col("value").alias("arg"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    r = r.crossJoin(F.broadcast(n)).withColumn("other", F.pmod(F.col("key") * 7 + 3, F.col("n"))).drop("n")  # one row of one number
    return tx.sequence(r, "worker", ["request_id"], WORKERS, EPOCH)


def accesses(req: DataFrame) -> DataFrame:
    """Reads and writes that each request's function makes."""
    f, k, o = F.col("function"), F.col("key"), F.col("other")
    touch = lambda key, mode: F.struct(key.alias("key"), F.lit(mode).alias("mode"))
    own_r, own_w = F.array(touch(k, "r")), F.array(touch(k, "w"))
    other = F.when(k != o, F.array(touch(o, "r"), touch(o, "w"))).otherwise(F.array().cast("array<struct<key:bigint,mode:string>>"))
    sets = F.when(f.isin("click", "view"), own_r).when(f == "purchase", F.concat(own_r, own_w, other)).when(f == "signup", F.concat(own_r, own_w)).otherwise(own_w)
    a = req.select("epoch", "t_id", F.explode(sets).alias("x")).select("epoch", "t_id", F.lit("accounts").alias("operator"), F.pmod("x.key", F.lit(4)).cast("int").alias("part"), "x.key", "x.mode")
    return a


def logic_aborts(req: DataFrame) -> DataFrame:
    return req.filter(F.col("function") == "error").select("epoch", "t_id")


def live_accesses(req: DataFrame) -> DataFrame:
    return tx.without_logic_aborts(accesses(req), logic_aborts(req))


def writes(req: DataFrame) -> DataFrame:
    """Written values: the request's argument in whole cents."""
    a = accesses(req).filter("mode = 'w'").join(req.select("t_id", "arg", "request_id"), "t_id")
    return a.select("epoch", "t_id", "operator", "part", "key", F.round(F.col("arg") * 100).cast("long").alias("value"), F.col("request_id"))


def client_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_in"), F.col("user_id").alias("key"))


def output(spark: SparkSession, d: str) -> DataFrame:
    """Replies derived from the requests: some missing, some twice."""
    r = client_requests(spark, d).filter("request_id % 50 <> 0")
    copies = F.when(F.col("request_id") % 500 == 1, F.sequence(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.lit(0)))
    return r.select("request_id", F.explode(copies).alias("copy"), "ts_in").select("request_id", (F.col("ts_in") + 5 + F.col("request_id") % 97 + F.col("copy") * 3).alias("ts_out"))


#: DuckDB twins of the above, as common table expressions.
SQL_REQ = """
n AS (SELECT count(DISTINCT user_id) AS n FROM events),
seq AS (SELECT event_id AS request_id, user_id % 8 AS worker, user_id AS key, event_type AS function, value AS arg, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, (user_id * 7 + 3) % (SELECT n FROM n) AS other,
               row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS i FROM events),
req AS (SELECT request_id, worker, key, function, arg, ts_ms, other, worker + 1 + i * 8 AS t_id, i // 100 AS epoch FROM seq)"""
SQL_ACC = SQL_REQ + """,
acc0 AS (SELECT epoch, t_id, key, 'r' AS mode, function FROM req WHERE function IN ('click', 'view', 'purchase', 'signup')
         UNION ALL SELECT epoch, t_id, key, 'w', function FROM req WHERE function NOT IN ('click', 'view')
         UNION ALL SELECT epoch, t_id, other, 'r', function FROM req WHERE function = 'purchase' AND other <> key
         UNION ALL SELECT epoch, t_id, other, 'w', function FROM req WHERE function = 'purchase' AND other <> key),
acc_all AS (SELECT epoch, t_id, 'accounts' AS operator, CAST(key % 4 AS INTEGER) AS part, key, mode, function FROM acc0),
acc AS (SELECT epoch, t_id, operator, part, key, mode FROM acc_all WHERE function <> 'error')"""
SQL_RES = SQL_ACC + """,
res AS (SELECT epoch, operator, part, key, min(t_id) FILTER (mode = 'w') AS w, min(t_id) FILTER (mode = 'r') AS r FROM acc GROUP BY ALL),
ser AS (SELECT DISTINCT a.epoch, a.t_id FROM acc a JOIN res USING (epoch, operator, part, key) WHERE w < a.t_id)"""
SQL_WRITES = SQL_RES + """,
wr AS (SELECT a.epoch, a.t_id, a.operator, a.part, a.key, CAST(round(q.arg * 100) AS BIGINT) AS value FROM acc_all a JOIN req q USING (t_id) WHERE a.mode = 'w')"""
SQL_OUT = """
cr AS (SELECT event_id AS request_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_in, user_id AS key FROM events),
outp AS (SELECT request_id, ts_in + 5 + request_id % 97 + c * 3 AS ts_out FROM cr, (SELECT unnest([0, 1]) AS c) WHERE request_id % 50 <> 0 AND (c = 0 OR request_id % 500 = 1))"""
