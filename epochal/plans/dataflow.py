"""Queries over the transactional core: sequencing, placement, conflicts, commit, snapshots, chains, elasticity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elasticity, partitioning
from ..operators import transactions as tx
from ..storage import table
from . import bindings as b
from .registry import query


@query("WITH " + b.SQL_RES + """
SELECT q.epoch, count(*) AS processed, count(*) FILTER (function = 'error') AS logic_aborts, count(s.t_id) AS concurrency_aborts, count(*) FILTER (function <> 'error' AND s.t_id IS NULL) AS committed
FROM req q LEFT JOIN ser s USING (t_id) GROUP BY q.epoch""")
def epoch_commit_stats(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    return tx.epoch_stats(req, b.logic_aborts(req), tx.conflicts(b.live_accesses(req)))


@query("WITH " + b.SQL_REQ + " SELECT request_id, worker, t_id, epoch FROM req")
def seq_tid_multiworker(spark: SparkSession, d: str) -> DataFrame:
    return b.requests(spark, d).select("request_id", "worker", "t_id", "epoch")


@query("SELECT DISTINCT user_id % 8 AS worker, CAST(dense_rank() OVER (ORDER BY user_id % 8) AS BIGINT) AS sid FROM events")
def sequencer_ids(spark: SparkSession, d: str) -> DataFrame:
    return tx.sequencer_ids(table(spark, d, "events").select(F.pmod("user_id", F.lit(8)).alias("worker")).distinct())


@query("WITH " + b.SQL_REQ + " SELECT worker, epoch, count(*) AS n, min(t_id) AS first_t_id, max(t_id) AS last_t_id FROM req GROUP BY worker, epoch")
def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    return b.requests(spark, d).groupBy("worker", "epoch").agg(F.count("*").alias("n"), F.min("t_id").alias("first_t_id"), F.max("t_id").alias("last_t_id"))


@query("WITH " + b.SQL_REQ + " SELECT epoch, max(t_id) AS t_counter, count(*) AS sequence_size, count(DISTINCT worker) AS workers FROM req GROUP BY epoch")
def epoch_counter_sync(spark: SparkSession, d: str) -> DataFrame:
    return b.requests(spark, d).groupBy("epoch").agg(F.max("t_id").alias("t_counter"), F.count("*").alias("sequence_size"), F.countDistinct("worker").alias("workers"))


@query("WITH " + b.SQL_REQ + """,
wal AS (SELECT request_id, t_id + 8 * (t_id % 3) AS t_id, worker FROM req WHERE request_id % 7 = 0 AND (t_id // 8) % 3 = 0),
fresh AS (SELECT q.request_id, q.worker, row_number() OVER (PARTITION BY q.worker ORDER BY q.request_id) AS j FROM req q LEFT JOIN wal USING (request_id) WHERE wal.request_id IS NULL),
slots AS (SELECT w AS worker, w + 1 + s * 8 AS t_id FROM (SELECT unnest(range(8)) AS w), (SELECT unnest(range((SELECT max(t_id) // 8 + count(*) + 10 FROM req))) AS s)),
free AS (SELECT worker, t_id, row_number() OVER (PARTITION BY worker ORDER BY t_id) AS j FROM slots WHERE (worker, t_id) NOT IN (SELECT (worker, t_id) FROM wal))
SELECT request_id, t_id, true AS reused FROM wal UNION ALL SELECT request_id, t_id, false FROM fresh JOIN free USING (worker, j)""")
def wal_replay_reuse(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    wal = req.filter("request_id % 7 = 0 AND floor(t_id / 8) % 3 = 0").select("request_id", (F.col("t_id") + 8 * (F.col("t_id") % 3)).alias("t_id"))
    new = tx.replay(req.select("request_id", "worker"), wal, "worker", ["request_id"], 8)
    return new.join(wal.select("request_id", F.lit(True).alias("in_wal")), "request_id", "left").select("request_id", "t_id", F.coalesce("in_wal", F.lit(False)).alias("reused"))


@query("WITH " + b.SQL_REQ + ", e AS (SELECT request_id, t_id, epoch FROM req UNION ALL SELECT request_id, t_id + 1, epoch + 1 FROM req WHERE request_id % 5 = 0) SELECT request_id, arg_max(t_id, epoch) AS t_id FROM e WHERE epoch >= 3 GROUP BY request_id")
def wal_load_last_wins(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d).select("request_id", "t_id", "epoch")
    log = req.unionByName(req.filter("request_id % 5 = 0").select("request_id", (F.col("t_id") + 1).alias("t_id"), (F.col("epoch") + 1).alias("epoch")))
    return log.filter("epoch >= 3").groupBy("request_id").agg(F.max_by("t_id", "epoch").alias("t_id"))


@query("WITH " + b.SQL_RES + """, c AS (SELECT q.worker, q.t_id, 0 AS late FROM req q JOIN ser s USING (t_id) WHERE q.epoch = 2), f AS (SELECT worker, t_id, 1 AS late FROM req WHERE epoch = 3)
SELECT worker, t_id FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY late, t_id) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM f)) WHERE n <= 100""")
def reschedule_losers(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    lost = tx.conflicts(b.live_accesses(req)).filter("epoch = 2")
    carried = req.filter("epoch = 2").join(lost.select("t_id"), "t_id", "left_semi").select("worker", "t_id")
    return tx.reschedule(carried, req.filter("epoch = 3").select("worker", "t_id"), 100)


@query("SELECT CAST(p_partkey % 16 AS INTEGER) AS part, count(*) AS n, count(DISTINCT CAST(p_partkey AS VARCHAR)) AS digit_keys FROM part GROUP BY 1")
def part_hash_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(partitioning.partition_of(F.col("p_partkey").cast("string"), 16).alias("part"), "p_partkey").groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("digit_keys"))


@query("SELECT CAST(c_nationkey % 5 AS INTEGER) AS part, count(*) AS n FROM customer GROUP BY 1")
def part_composite_counts(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select(partitioning.composite_partition(key, ":", 0, 5).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT CAST(CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END AS INTEGER) AS part, count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1")
def part_range_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = partitioning.range_partition(table(spark, d, "part"), "p_size", [(0, 10), (11, 25), (26, 40), (41, 60)])
    return p.groupBy("part").agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of a graph: an operator for each region, a partition for each nation."""
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("operator"), F.col("n_nationkey").alias("part"))


_SQL_ROBIN = "a AS (SELECT n_regionkey AS operator, n_nationkey AS part, CAST([0, 1, 2, 3][(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1) % 4 + 1] AS INTEGER) AS worker FROM nation)"


@query(f"WITH {_SQL_ROBIN} SELECT * FROM a")
def round_robin_assignment(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.round_robin(_parts(spark, d), ["operator", "part"], [0, 1, 2, 3])


@query(f"WITH {_SQL_ROBIN} SELECT operator, part, worker FROM a WHERE worker <> 1 UNION ALL SELECT operator, part, CAST([0, 2, 3][(row_number() OVER (ORDER BY operator, part) - 1) % 3 + 1] AS INTEGER) FROM a WHERE worker = 1")
def reassign_lost_worker(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.reassign(round_robin_assignment(spark, d), ["operator", "part"], [1]).select("operator", "part", "worker")


@query("SELECT n_regionkey AS operator, n_nationkey AS part FROM nation WHERE n_nationkey >= 20")
def shadow_partitions(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.shadows(_parts(spark, d), 20)


@query("WITH " + b.SQL_ACC + " SELECT epoch, operator, part, mode, count(*) AS accesses, count(DISTINCT key) AS keys, count(DISTINCT t_id) AS transactions FROM acc_all GROUP BY ALL")
def read_write_sets(spark: SparkSession, d: str) -> DataFrame:
    return b.accesses(b.requests(spark, d)).groupBy("epoch", "operator", "part", "mode").agg(F.count("*").alias("accesses"), F.countDistinct("key").alias("keys"), F.countDistinct("t_id").alias("transactions"))


@query("WITH " + b.SQL_RES + " SELECT * FROM res")
def reservations_min(spark: SparkSession, d: str) -> DataFrame:
    return tx.reservations(b.live_accesses(b.requests(spark, d)))


@query("WITH " + b.SQL_RES + " SELECT * FROM ser")
def conflicts_serializable(spark: SparkSession, d: str) -> DataFrame:
    return tx.conflicts(b.live_accesses(b.requests(spark, d)))


@query("WITH " + b.SQL_RES + " SELECT DISTINCT a.epoch, a.t_id FROM acc a JOIN res USING (epoch, operator, part, key) WHERE a.mode = 'w' AND w < a.t_id")
def conflicts_snapshot_isolation(spark: SparkSession, d: str) -> DataFrame:
    return tx.conflicts(b.live_accesses(b.requests(spark, d)), "snapshot")


@query("WITH " + b.SQL_RES + """
SELECT DISTINCT epoch, t_id FROM (SELECT epoch, operator, part, a.t_id, bool_or(mode = 'w' AND coalesce(w < a.t_id, false)) AS waw, bool_or(mode = 'w' AND coalesce(r < a.t_id, false)) AS war, bool_or(mode = 'r' AND coalesce(w < a.t_id, false)) AS raw
FROM acc a JOIN res USING (epoch, operator, part, key) GROUP BY ALL) WHERE waw OR (war AND raw)""")
def conflicts_reordering(spark: SparkSession, d: str) -> DataFrame:
    return tx.conflicts(b.live_accesses(b.requests(spark, d)), "reordering")


@query("WITH " + b.SQL_ACC + " SELECT epoch, count(*) AS accesses, count(DISTINCT t_id) AS transactions FROM acc GROUP BY epoch")
def logic_abort_removal(spark: SparkSession, d: str) -> DataFrame:
    return b.live_accesses(b.requests(spark, d)).groupBy("epoch").agg(F.count("*").alias("accesses"), F.countDistinct("t_id").alias("transactions"))


@query("WITH " + b.SQL_RES + ", lg AS (SELECT epoch, t_id FROM req WHERE function = 'error') SELECT epoch, t_id FROM (SELECT * FROM ser UNION SELECT * FROM lg) EXCEPT SELECT epoch, t_id FROM lg")
def reschedule_set(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    lost, logic = tx.conflicts(b.live_accesses(req)), b.logic_aborts(req)
    return lost.unionByName(logic).distinct().join(logic, ["epoch", "t_id"], "left_anti")


@query("WITH " + b.SQL_RES + ", mine AS (SELECT DISTINCT epoch, operator, part, key, t_id FROM acc JOIN ser USING (epoch, t_id)), l AS (SELECT *, lag(t_id) OVER (PARTITION BY epoch, operator, part, key ORDER BY t_id) AS depends_on FROM mine) SELECT DISTINCT epoch, t_id, depends_on FROM l WHERE depends_on IS NOT NULL")
def fallback_dependencies(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    a = b.live_accesses(req)
    return tx.fallback_dependencies(a, tx.conflicts(a))


_LOSERS = b.SQL_RES + ", mine AS (SELECT DISTINCT epoch, operator, part, key, t_id FROM acc JOIN ser USING (epoch, t_id)), dep AS (SELECT DISTINCT a.epoch, a.t_id, o.t_id AS depends_on FROM mine a JOIN mine o USING (epoch, operator, part, key) WHERE o.t_id < a.t_id)"


@query("WITH " + _LOSERS + " SELECT * FROM dep")
def fallback_all_dependencies(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    a = b.live_accesses(req)
    return tx.all_dependencies(a, tx.conflicts(a))


@query("WITH RECURSIVE " + b.SQL_RES + """, mine AS (SELECT DISTINCT epoch, operator, part, key, t_id FROM acc JOIN ser USING (epoch, t_id)),
l AS (SELECT DISTINCT t_id, lag(t_id) OVER (PARTITION BY epoch, operator, part, key ORDER BY t_id) AS p FROM mine), v AS (SELECT DISTINCT epoch, t_id FROM mine WHERE t_id IN (SELECT p FROM l) OR t_id IN (SELECT t_id FROM l WHERE p IS NOT NULL)),
r(t_id, level) AS (SELECT t_id, 0 FROM v UNION SELECT l.t_id, r.level + 1 FROM r JOIN l ON l.p = r.t_id) SELECT epoch, r.t_id, CAST(max(level) AS INTEGER) AS level FROM r JOIN v USING (t_id) GROUP BY ALL""")
def fallback_levels(spark: SparkSession, d: str) -> DataFrame:
    return tx.fallback_levels(fallback_dependencies(spark, d))


@query()
def fallback_components(spark: SparkSession, d: str) -> DataFrame:
    """Of all epochs; without SQL, the tests hold it against union-find."""
    return tx.fallback_components(fallback_dependencies(spark, d))


@query("WITH " + b.SQL_RES + ", s AS (SELECT q.epoch, count(*) AS processed, count(s.t_id) AS aborts FROM req q LEFT JOIN ser s USING (t_id) GROUP BY q.epoch) SELECT epoch, round(aborts / processed, 6) AS abort_rate, aborts / processed > 0.1 AS fallback FROM s")
def fallback_trigger(spark: SparkSession, d: str) -> DataFrame:
    return tx.fallback_triggered(epoch_commit_stats(spark, d)).select("epoch", F.round("abort_rate", 6).alias("abort_rate"), "fallback")


@query("WITH " + b.SQL_ACC + """, sec AS (SELECT t_id, operator, part, CASE WHEN t_id % 10 = 0 THEN key + 1 ELSE key END AS key FROM acc), k AS (SELECT DISTINCT t_id, operator, part, key FROM acc), k2 AS (SELECT DISTINCT * FROM sec),
ch AS (SELECT coalesce(k.t_id, k2.t_id) AS t_id, coalesce(k.operator, k2.operator) AS operator, coalesce(k.part, k2.part) AS part, coalesce(k.key, k2.key) AS key FROM k FULL JOIN k2 USING (t_id, operator, part, key) WHERE k.t_id IS NULL OR k2.t_id IS NULL)
SELECT DISTINCT t_id FROM ch WHERE (part, key) IN (SELECT (CAST(user_id % 4 AS INTEGER), user_id) FROM events WHERE user_id % 2 = 0)""")
def fallback_rw_drift(spark: SparkSession, d: str) -> DataFrame:
    first = b.live_accesses(b.requests(spark, d))
    second = first.withColumn("key", F.when(F.col("t_id") % 10 == 0, F.col("key") + 1).otherwise(F.col("key")))
    state = table(spark, d, "events").filter("user_id % 2 = 0").select(F.lit("accounts").alias("operator"), F.pmod("user_id", F.lit(4)).cast("int").alias("part"), F.col("user_id").alias("key")).distinct()
    return tx.rw_drift(first, second, state)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Call trees: an order calls its lines; lines with even quantity call two more."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("t_id"), F.lit("r").alias("call"), F.lit(None).cast("string").alias("parent"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("t_id"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("call"), F.lit("r").alias("parent")).distinct()
    deep = lines.filter("call IN ('l2', 'l4', 'l6')").select("t_id", F.explode(F.array(*[F.concat("call", F.lit(x)) for x in ("a", "b")])).alias("call2"), F.col("call").alias("parent")).select("t_id", F.col("call2").alias("call"), "parent")
    return o.unionByName(lines).unionByName(deep)


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS t_id, 'r' AS call, NULL AS parent FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'l' || l_linenumber, 'r' FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'l' || l_linenumber || x, 'l' || l_linenumber FROM lineitem, (SELECT unnest(['a', 'b']) AS x) WHERE l_linenumber IN (2, 4, 6)),
f AS (SELECT t_id, parent AS call, count(*) AS fan FROM c WHERE parent IS NOT NULL GROUP BY ALL),
s(t_id, call, share) AS (SELECT t_id, call, CAST(1 AS DOUBLE) FROM c WHERE parent IS NULL UNION ALL SELECT c.t_id, c.call, s.share / f.fan FROM s JOIN f ON f.t_id = s.t_id AND f.call = s.call JOIN c ON c.t_id = s.t_id AND c.parent = s.call)
SELECT s.t_id, count(*) AS leaves, round(sum(share), 6) AS share FROM s LEFT JOIN f ON f.t_id = s.t_id AND f.call = s.call WHERE f.fan IS NULL GROUP BY s.t_id""")
def chain_ack_shares(spark: SparkSession, d: str) -> DataFrame:
    return tx.ack_shares(_calls(spark, d)).select("t_id", "leaves", F.round("share", 6).alias("share"))


@query("""WITH s AS (SELECT user_id AS t_id, event_id // 100 AS round, event_id % 100 AS ordinal, CASE WHEN event_type = 'error' AND value > 150 THEN 'E' || event_id END AS error, CASE WHEN event_type <> 'view' THEN event_type || event_id END AS response FROM events),
a AS (SELECT t_id, arg_min(error, (round, ordinal)) FILTER (error IS NOT NULL) AS error, arg_max(response, (round, ordinal)) FILTER (response IS NOT NULL) AS response FROM s GROUP BY t_id) SELECT *, coalesce(error, response) AS reply FROM a""")
def chain_reply_policy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("t_id"), F.floor(F.col("event_id") / 100).alias("round"), (F.col("event_id") % 100).alias("ordinal"), F.when((F.col("event_type") == "error") & (F.col("value") > 150), F.concat(F.lit("E"), "event_id")).alias("error"), F.when(F.col("event_type") != "view", F.concat("event_type", "event_id")).alias("response"))
    return tx.chain_replies(s)


@query("WITH " + b.SQL_WRITES + " SELECT operator, part, key, arg_max(value, t_id) AS value FROM wr WHERE t_id NOT IN (SELECT t_id FROM ser) AND t_id NOT IN (SELECT t_id FROM req WHERE function = 'error') GROUP BY ALL")
def commit_last_writer(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    aborted = tx.conflicts(b.live_accesses(req)).unionByName(b.logic_aborts(req))
    return tx.last_writes(b.writes(req), aborted)


@query("WITH " + b.SQL_WRITES + """, lw AS (SELECT key, arg_max(value, t_id) AS v FROM wr WHERE t_id NOT IN (SELECT t_id FROM ser) AND t_id NOT IN (SELECT t_id FROM req WHERE function = 'error') GROUP BY ALL)
SELECT 'accounts' AS operator, CAST(k % 4 AS INTEGER) AS part, k AS key, coalesce(v, CAST(1000000 AS BIGINT)) AS value FROM (SELECT unnest(range((SELECT n FROM n))) AS k) LEFT JOIN lw ON lw.key = k""")
def commit_state(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").agg(F.countDistinct("user_id").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("key"))
    state = users.select(F.lit("accounts").alias("operator"), F.pmod("key", F.lit(4)).cast("int").alias("part"), "key", F.lit(1_000_000).cast("long").alias("value"))
    return tx.commit(state, commit_last_writer(spark, d))


_DELTA = b.SQL_WRITES + ", dl AS (SELECT epoch // 4 AS snapshot_id, operator, part, key, arg_max(value, t_id) AS value FROM wr GROUP BY ALL)"


@query("WITH " + _DELTA + " SELECT * FROM dl")
def snapshot_deltas(spark: SparkSession, d: str) -> DataFrame:
    return tx.deltas(b.writes(b.requests(spark, d)), 4)


@query("WITH " + _DELTA + " SELECT operator, part, key, arg_max(value, snapshot_id) AS value FROM dl WHERE snapshot_id <= 2 GROUP BY ALL")
def snapshot_merge_at_id(spark: SparkSession, d: str) -> DataFrame:
    return tx.merge_snapshots(snapshot_deltas(spark, d), 2)


@query("WITH " + _DELTA + " SELECT operator, part, key, arg_max(value, snapshot_id) AS value, CAST(1 AS BIGINT) AS snapshot_id FROM dl WHERE snapshot_id <= 1 GROUP BY operator, part, key UNION ALL SELECT operator, part, key, value, snapshot_id FROM dl WHERE snapshot_id > 1")
def snapshot_compaction(spark: SparkSession, d: str) -> DataFrame:
    return tx.compact(snapshot_deltas(spark, d), 1).select("operator", "part", "key", "value", "snapshot_id")


@query("WITH " + b.SQL_OUT + " SELECT request_id, min(ts_out) AS ts FROM outp WHERE request_id % 11 <> 0 GROUP BY request_id")
def exactly_once_dedupe(spark: SparkSession, d: str) -> DataFrame:
    out = b.output(spark, d).withColumnRenamed("ts_out", "ts")
    return tx.exactly_once(out, out.filter("request_id % 11 = 0"))


@query("WITH " + b.SQL_RES + """, dn AS (SELECT q.worker, q.request_id, s.t_id IS NULL AS done FROM req q LEFT JOIN ser s USING (t_id)), o AS (SELECT worker, min(request_id) FILTER (NOT done) AS open, max(request_id) FILTER (done) AS max_finished FROM dn GROUP BY worker)
SELECT worker, max(request_id) AS committed, max(max_finished) AS max_finished FROM dn JOIN o USING (worker) WHERE open IS NULL OR request_id < open GROUP BY worker""")
def offset_watermarks(spark: SparkSession, d: str) -> DataFrame:
    req = b.requests(spark, d)
    lost = tx.conflicts(b.live_accesses(req)).select("t_id", F.lit(True).alias("lost"))
    done = req.join(lost, "t_id", "left").select("worker", "request_id", F.col("lost").isNull().alias("done"))
    return tx.offset_prefix(done, "worker", "request_id", "done")


@query("WITH " + b.SQL_REQ + " SELECT function AS operator, CAST(key % 4 AS INTEGER) AS part, count(*) AS calls, round(sum(arg), 4) AS total_ms, round(sum(arg) / count(*), 6) AS avg_ms FROM req WHERE arg > 0 GROUP BY ALL")
def operator_epoch_stats(spark: SparkSession, d: str) -> DataFrame:
    r = b.requests(spark, d).filter("arg > 0").groupBy(F.col("function").alias("operator"), F.pmod("key", F.lit(4)).cast("int").alias("part"))
    return r.agg(F.count("*").alias("calls"), F.sum("arg").alias("t")).select("operator", "part", "calls", F.round("t", 4).alias("total_ms"), F.round(F.col("t") / F.col("calls"), 6).alias("avg_ms"))


@query("SELECT c_custkey AS key, CAST(c_custkey % 4 AS INTEGER) AS old_part, CAST(c_custkey % 6 AS INTEGER) AS new_part FROM customer WHERE c_custkey % 4 <> c_custkey % 6")
def rehash_plan(spark: SparkSession, d: str) -> DataFrame:
    return elasticity.rehash(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), 4, 6)


@query("""WITH m AS (SELECT c_custkey AS key, CAST(c_custkey % 4 AS INTEGER) AS old_part, CAST(c_custkey % 6 AS INTEGER) AS new_part FROM customer WHERE c_custkey % 4 <> c_custkey % 6),
r AS (SELECT *, (row_number() OVER (PARTITION BY old_part ORDER BY key) - 1) // 200 AS batch FROM m) SELECT old_part, batch, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM r GROUP BY ALL""")
def migration_batches(spark: SparkSession, d: str) -> DataFrame:
    m = elasticity.batches(rehash_plan(spark, d), 200)
    return m.groupBy("old_part", "batch").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("SELECT o_custkey AS key FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def migration_catchup(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")).distinct()
    return elasticity.catch_up(now, table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key")))


@query("WITH " + b.SQL_REQ + " SELECT request_id, CAST(key % 4 AS INTEGER) AS old_part, CAST(key % 6 AS INTEGER) AS part FROM req WHERE epoch >= 5")
def migration_redirect(spark: SparkSession, d: str) -> DataFrame:
    return b.requests(spark, d).filter("epoch >= 5").select("request_id", partitioning.partition_of("key", 4).alias("old_part"), partitioning.partition_of("key", 6).alias("part"))


_LOADS = "h AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS hour, count(*) AS tps, CAST(round(sum(value)) AS BIGINT) AS peak FROM events GROUP BY 1)"


def _hours(spark: SparkSession, d: str) -> DataFrame:
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, d, "events").groupBy(h.alias("hour")).agg(F.count("*").alias("tps"), F.round(F.sum("value")).cast("long").alias("peak"))


@query("WITH " + _LOADS + """ SELECT hour, CASE WHEN conf < 0.25 OR peak < 1.15 * tps * 60 OR peak <= 4 * 500 THEN CAST(0 AS BIGINT) ELSE least(CAST(ceil(peak / 500.0) AS BIGINT) - 4, 4) END AS added
FROM (SELECT *, (hour % 10) / 10.0 AS conf FROM h)""")
def predictive_scale_up(spark: SparkSession, d: str) -> DataFrame:
    h = _hours(spark, d).withColumns({"confidence": (F.col("hour") % 10) / 10.0, "now": F.col("tps") * 60})
    return elasticity.scale_up(h, "peak", "now", "confidence", workers=4, capacity=500.0).select("hour", "added")


@query("WITH " + _LOADS + " SELECT hour, coalesce((SELECT max(k) FROM (SELECT unnest(range(1, 7)) AS k) WHERE peak < 500 * (8 - k) * 0.9), 0) AS removed FROM h")
def predictive_scale_down(spark: SparkSession, d: str) -> DataFrame:
    return elasticity.scale_down(_hours(spark, d), "peak", workers=8, capacity=500.0).select("hour", "removed")


@query("SELECT l_suppkey % 20 AS worker, count(*) AS backlog FROM lineitem GROUP BY 1 ORDER BY backlog, worker LIMIT 5")
def scale_down_victims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(20)).alias("worker")).agg(F.count("*").alias("backlog")).orderBy("backlog", "worker").limit(5)


@query("WITH " + b.SQL_REQ + " SELECT worker, round(count(*) * avg(arg) / 2000 / 1000, 9) AS seconds FROM req GROUP BY worker")
def migration_time(spark: SparkSession, d: str) -> DataFrame:
    g = b.requests(spark, d).groupBy("worker").agg(F.count("*").alias("keys"), F.avg("arg").alias("epoch_ms"))
    return g.select("worker", F.round(elasticity.migration_seconds("keys", "epoch_ms", 2000), 9).alias("seconds"))


@query("SELECT CAST(c_custkey % 4 AS INTEGER) AS old_part, CAST(c_custkey % 6 AS INTEGER) AS part, count(*) AS n FROM customer GROUP BY ALL")
def part_update_counts(spark: SparkSession, d: str) -> DataFrame:
    """Where the keys of each partition go when the number of partitions changes; keys placed before are placed anew."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), partitioning.partition_of("c_custkey", 4).alias("part"))
    return partitioning.update_partitions(keys, 6).groupBy("old_part", "part").agg(F.count("*").alias("n"))


@query("WITH " + b.SQL_REQ + " SELECT epoch, max(last) AS counter, max(t) AS t_counter, sum(n) AS requests, count(*) = 8 AS complete FROM (SELECT epoch, worker, max(request_id) AS last, max(t_id) AS t, count(*) AS n FROM req GROUP BY ALL) GROUP BY epoch")
def migration_barriers(spark: SparkSession, d: str) -> DataFrame:
    """What the workers agree on at a barrier: the highest offset and counter of any, once all have reported."""
    w = b.requests(spark, d).groupBy("epoch", "worker").agg(F.max("request_id").alias("last"), F.max("t_id").alias("t"), F.count("*").alias("n"))
    return tx.barrier(w, b.WORKERS)


_STATS = b.SQL_WRITES + """,
rq AS (SELECT q.epoch, q.worker, count(*) AS total_txns, count(*) FILTER (function = 'error') AS logic_aborts, count(s.t_id) AS concurrency_aborts, greatest(max(ts_ms) - min(ts_ms), 1) AS epoch_latency, round(sum(arg), 4) AS func_time, max(request_id) AS last_offset, count(DISTINCT function) AS functions FROM req q LEFT JOIN ser s USING (t_id) GROUP BY ALL),
ac AS (SELECT epoch, t_id % 8 AS w, count(*) FILTER (mode = 'r') AS reads, count(*) FILTER (mode = 'w') AS writes, count(DISTINCT key) AS key_counts, count(DISTINCT part) AS partitions FROM acc_all GROUP BY ALL),
tot AS (SELECT worker, count(*) AS all_txns FROM req GROUP BY 1)"""


@query("WITH " + _STATS + """ SELECT rq.epoch, rq.worker, total_txns, logic_aborts, concurrency_aborts, total_txns - logic_aborts - concurrency_aborts AS committed_lock_free, CASE WHEN concurrency_aborts > 0.1 * total_txns THEN concurrency_aborts ELSE 0 END AS committed_fallback,
total_txns - logic_aborts - CASE WHEN concurrency_aborts > 0.1 * total_txns THEN 0 ELSE concurrency_aborts END AS committed_txns, round(concurrency_aborts / total_txns, 6) AS local_abort_rate, epoch_latency, (total_txns - logic_aborts - CASE WHEN concurrency_aborts > 0.1 * total_txns THEN 0 ELSE concurrency_aborts END) * 1000 // epoch_latency AS epoch_throughput,
func_time, round(func_time / epoch_latency, 6) AS cpu_utilization, total_txns AS input_rate, all_txns - sum(total_txns) OVER (PARTITION BY rq.worker ORDER BY rq.epoch) AS queue_backlog, total_txns = 0 AS empty_epoch, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes, coalesce(key_counts, 0) AS key_counts, coalesce(partitions, 0) AS partitions, functions, last_offset
FROM rq JOIN tot USING (worker) LEFT JOIN ac ON ac.epoch = rq.epoch AND ac.w = (rq.worker + 1) % 8""")
def worker_epoch_stats(spark: SparkSession, d: str) -> DataFrame:
    """All counters of each worker's epochs that the run's tables tell; those of a phase's wall time need a clock."""
    req = b.requests(spark, d)
    lost = tx.conflicts(b.live_accesses(req)).select("t_id", F.lit(1).alias("lost"))
    acc = b.accesses(req).withColumn("worker", F.pmod(F.col("t_id") - 1, F.lit(b.WORKERS)))
    return tx.worker_stats(req.join(lost, "t_id", "left"), acc)


@query("WITH " + _DELTA + ", p AS (SELECT snapshot_id, operator, part, count(*) AS keys, sum(length(CAST(value AS VARCHAR)) + 8) AS bytes FROM dl GROUP BY ALL) SELECT snapshot_id, count(*) AS parts, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) = 4 AS complete FROM p GROUP BY snapshot_id")
def snapshot_completion(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot is complete once every partition has reported; its size is that of all deltas."""
    return tx.snapshot_sizes(snapshot_deltas(spark, d), F.length(F.col("value").cast("string")) + 8, 4)


@query("WITH done AS (SELECT worker, max(id) AS id FROM (SELECT user_id % 8 AS worker, event_id % 40 AS id FROM events WHERE event_id % 8 <> 3 OR event_id % 40 < 30) GROUP BY 1), last AS (SELECT min(id) AS id FROM done), " + _SQL_ROBIN + " SELECT operator, part, CAST([0, 1, 3][(row_number() OVER (ORDER BY operator, part) - 1) % 3 + 1] AS INTEGER) AS worker, id AS snapshot_id FROM a, last")
def rebalance_from_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All partitions dealt anew to the workers that are left, from the last snapshot that every worker has completed."""
    done = table(spark, d, "events").filter("event_id % 8 <> 3 OR event_id % 40 < 30").select(F.pmod("user_id", F.lit(8)).alias("worker"), (F.col("event_id") % 40).alias("snapshot_id"))
    last = done.groupBy("worker").agg(F.max("snapshot_id").alias("id")).agg(F.min("id").alias("snapshot_id"))
    return partitioning.round_robin(_parts(spark, d), ["operator", "part"], [0, 1, 3]).crossJoin(F.broadcast(last))  # one row


@query("SELECT coalesce(a.name, b.name) AS name, a.name IS NULL AS added, coalesce(a.p <> b.p, false) AS moved FROM (SELECT n_name AS name, n_regionkey AS p FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 9 ELSE n_regionkey END AS p FROM nation) b ON a.name = b.name WHERE a.name IS NULL OR a.p <> b.p")
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("partitions"))
    new = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") == 3, 9).otherwise(F.col("n_regionkey")).alias("partitions"))
    return elasticity.graph_changes(old, new)


@query(f"WITH {_SQL_ROBIN} SELECT operator, string_agg(part || ':' || worker, ',' ORDER BY part) AS parts FROM a GROUP BY operator")
def placement(spark: SparkSession, d: str) -> DataFrame:
    m = partitioning.placement_map(round_robin_assignment(spark, d))
    return m.select("operator", F.array_join(F.transform(F.array_sort(F.map_entries("parts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("parts"))
