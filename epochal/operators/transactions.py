"""Sequencing, conflict detection, commit and fallback, as plans over request and access rows.

Requests are rows ``(worker, offset, ...)``; sequencing adds ``t_id`` and
``epoch``. Accesses are rows ``(epoch, t_id, operator, part, key, mode)`` with
mode ``r`` or ``w``. Everything is partitioned by worker, by key or by
transaction; nothing is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .components import components

KEY = ["epoch", "operator", "part", "key"]


# --- sequencing ---------------------------------------------------------------


def sequencer_ids(workers: DataFrame) -> DataFrame:
    """Adds ``sid``: the rank of the worker id, from 1. One row a worker."""
    return workers.withColumn("sid", F.row_number().over(Window.orderBy("worker")).cast("long"))


#: Rows of a key that one task should number.
PLACE_ROWS = 1 << 20


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column | str], rows: int = PLACE_ROWS, offsets: bool = False) -> DataFrame:
    """Adds the sums (name: value) over a key's rows before each row in ``order``, whose first column is a number.

    The first column's range is cut into buckets of about ``rows`` rows; rows are
    summed up in their bucket and shifted by the prefix sums of the buckets'
    totals, so that no task sorts all rows of a hot key. ``offsets``: the first
    column counts up without large gaps, as a log's offsets do; then each bucket
    holds ``rows`` numbers, and its range need not be looked up.
    """
    first = F.col(order[0]).try_cast("double")
    values = {f"__v{i}": F.col(v) if isinstance(v, str) else v for i, v in enumerate(sums.values())}
    d = df.withColumns(values)
    if offsets:
        bucket = F.floor(first / rows)
    else:
        stats = df.agg(F.min(first).alias("__lo"), F.max(first).alias("__hi"), F.count("*").alias("__n"))
        d = d.crossJoin(F.broadcast(stats))  # one row of three numbers
        bucket = F.floor((first - F.col("__lo")) * F.ceil(F.col("__n") / rows) / (F.col("__hi") - F.col("__lo") + 1))
    d = d.withColumn("__b", F.coalesce(bucket, F.lit(-(1 << 60))).cast("long")).drop("__lo", "__hi", "__n")
    totals = d.groupBy(*keys, "__b").agg(*[F.sum(v).alias(v) for v in values])
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0))
    totals = totals.select(*keys, "__b", *[so_far(v, upto(*keys).orderBy("__b")).alias(f"{v}_") for v in values])
    d = d.withColumns({v: so_far(v, upto(*keys, "__b").orderBy(*order)) for v in values}).join(totals, [*keys, "__b"])
    return d.select(*df.columns, *[(F.col(v) + F.col(f"{v}_")).alias(name) for name, v in zip(sums, values)])


def place(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int = PLACE_ROWS, offsets: bool = False) -> DataFrame:
    """Adds ``out``: a row's place, from 0, among its key's rows in ``order``."""
    return running(df, keys, order, {out: F.lit(1).cast("long")}, rows, offsets)


def sequence(requests: DataFrame, worker: str, order: list[str], n_workers: int, epoch_size: int) -> DataFrame:
    """Adds ``t_id = sid + i * n_workers`` and ``epoch = i div epoch_size``, with ``i`` the place in the worker's log."""
    d = place(requests, [worker], order, "__i", offsets=True)
    return d.withColumns({"t_id": F.col(worker) + 1 + F.col("__i") * n_workers, "epoch": F.floor(F.col("__i") / epoch_size)}).drop("__i")


def replay(requests: DataFrame, wal: DataFrame, worker: str, order: list[str], n_workers: int) -> DataFrame:
    """Known request ids keep the t_id of the log; others get the worker's next ids that the log doesn't hold.

    The free ids are found by counting: the j-th new request of a worker gets the
    j-th slot not taken, which a join of the slots' cumulative gaps gives.
    """
    known = requests.join(wal.select("request_id", "t_id"), "request_id", "left")
    fresh = known.filter("t_id IS NULL").drop("t_id").withColumn("j", F.row_number().over(Window.partitionBy(worker).orderBy(*order)).cast("long") - 1)
    taken = wal.withColumn(worker, F.pmod(F.col("t_id") - 1, F.lit(n_workers))).select(worker, F.floor((F.col("t_id") - 1) / n_workers).alias("slot"))
    by = Window.partitionBy(worker).orderBy("slot")
    # Before the m-th taken slot (from 0) lie slot - m free ones.
    gaps = taken.withColumn("free_before", F.col("slot") - (F.row_number().over(by) - 1))
    gaps = gaps.groupBy(worker, "free_before").agg(F.count("*").alias("n"))
    marks = fresh.select(worker, F.col("j").alias("at"), F.lit(0).alias("n"), F.struct("request_id", "j").alias("req")).unionByName(gaps.select(worker, F.col("free_before").alias("at"), "n", F.lit(None).cast(fresh.select(F.struct("request_id", "j")).schema[0].dataType).alias("req")))
    upto = Window.partitionBy(worker).orderBy("at", F.col("req").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("skip", F.sum("n").over(upto)).filter("req IS NOT NULL").select(worker, F.col("req.request_id").alias("request_id"), (F.col(worker) + 1 + (F.col("req.j") + F.col("skip")) * n_workers).alias("t_id"))
    return known.filter("t_id IS NOT NULL").unionByName(fresh.drop("j").join(placed, [worker, "request_id"]).select(*known.columns))


def reschedule(carried: DataFrame, fresh: DataFrame, epoch_size: int) -> DataFrame:
    """The next epoch's items of a worker: losers in t_id order, then new ones, ``epoch_size`` at most."""
    both = carried.withColumn("late", F.lit(0)).unionByName(fresh.withColumn("late", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("worker").orderBy("late", "t_id"))
    return both.withColumn("n", n).filter(F.col("n") <= epoch_size).drop("n", "late")


def offset_prefix(done: DataFrame, part: str, offset: str, finished: str) -> DataFrame:
    """Per input partition the last offset before the first unfinished one, and the highest finished one."""
    first_open = F.min(F.when(~F.col(finished), F.col(offset)))
    a = done.groupBy(part).agg(first_open.alias("open"), F.max(F.when(F.col(finished), F.col(offset))).alias("max_finished"))
    return done.join(a, part).filter(F.col("open").isNull() | (F.col(offset) < F.col("open"))).groupBy(part).agg(F.max(offset).alias("committed"), F.first("max_finished").alias("max_finished"))


# --- conflicts ----------------------------------------------------------------


def without_logic_aborts(accesses: DataFrame, aborted: DataFrame) -> DataFrame:
    return accesses.join(aborted.select("t_id").distinct(), "t_id", "left_anti")


def reservations(accesses: DataFrame) -> DataFrame:
    """Least writer ``w`` and least reader ``r`` of each key of an epoch."""
    return accesses.groupBy(*KEY).agg(F.min(F.when(F.col("mode") == "w", F.col("t_id"))).alias("w"), F.min(F.when(F.col("mode") == "r", F.col("t_id"))).alias("r"))


def conflicts(accesses: DataFrame, mode: str = "serializable") -> DataFrame:
    """``(epoch, t_id)`` of transactions to abort: ``serializable``, ``snapshot`` or ``reordering``.

    A key's least writer and reader come from a window over the key, so the
    accesses are shuffled once for the keys.
    """
    by_key = Window.partitionBy(*KEY)
    least = lambda m: F.min(F.when(F.col("mode") == m, F.col("t_id"))).over(by_key)
    a = accesses.withColumns({"w": least("w"), "r": least("r")})
    late = lambda c: F.coalesce(F.col(c) < F.col("t_id"), F.lit(False))
    if mode == "serializable":
        return a.filter(late("w")).select("epoch", "t_id").distinct()
    if mode == "snapshot":
        return a.filter((F.col("mode") == "w") & late("w")).select("epoch", "t_id").distinct()
    if mode != "reordering":
        raise ValueError(f"unknown mode {mode}")
    is_w = F.col("mode") == "w"
    found = a.groupBy("epoch", "operator", "part", "t_id").agg(F.bool_or(is_w & late("w")).alias("waw"), F.bool_or(is_w & late("r")).alias("war"), F.bool_or(~is_w & late("w")).alias("raw"))
    return found.filter("waw OR (war AND raw)").select("epoch", "t_id").distinct()


def epoch_stats(requests: DataFrame, logic: DataFrame, concurrency: DataFrame) -> DataFrame:
    """Per epoch: processed, logic and concurrency aborts, committed."""
    la, ca = logic.select("t_id", F.lit(1).alias("la")).distinct(), concurrency.select("t_id", F.lit(1).alias("ca")).distinct()
    d = requests.join(la, "t_id", "left").join(ca, "t_id", "left")
    la, ca = F.coalesce("la", F.lit(0)), F.coalesce("ca", F.lit(0))
    return d.groupBy("epoch").agg(F.count("*").alias("processed"), F.sum(la).cast("long").alias("logic_aborts"), F.sum(F.when(la == 0, ca).otherwise(0)).cast("long").alias("concurrency_aborts"), F.sum(F.when((la == 0) & (ca == 0), 1).otherwise(0)).cast("long").alias("committed"))


def worker_stats(requests: DataFrame, accesses: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Counters of each worker's epochs, from ``requests`` (with ``lost`` for losers) and the ``accesses`` of its transactions."""
    k = ["epoch", "worker"]
    logic, lost = F.count_if(F.col("function") == "error"), F.count("lost")
    q = requests.groupBy(*k).agg(F.count("*").alias("total_txns"), logic.alias("logic_aborts"), lost.alias("concurrency_aborts"), F.greatest(F.max("ts_ms") - F.min("ts_ms"), F.lit(1)).alias("epoch_latency"), F.round(F.sum("arg"), 4).alias("func_time"), F.max("request_id").alias("last_offset"), F.countDistinct("function").alias("functions"))
    a = accesses.groupBy(*k).agg(F.count_if(F.col("mode") == "r").alias("reads"), F.count_if(F.col("mode") == "w").alias("writes"), F.countDistinct("key").alias("key_counts"), F.countDistinct("part").alias("partitions"))
    n, ca = F.col("total_txns"), F.col("concurrency_aborts")
    by_worker = Window.partitionBy("worker")
    d = q.join(a, k, "left").na.fill(0, ["reads", "writes", "key_counts", "partitions"])
    d = d.withColumns({"committed_lock_free": n - F.col("logic_aborts") - ca, "committed_fallback": F.when(ca > threshold * n, ca).otherwise(F.lit(0)), "local_abort_rate": F.round(ca / n, 6), "cpu_utilization": F.round(F.col("func_time") / F.col("epoch_latency"), 6), "input_rate": n, "empty_epoch": n == 0})
    d = d.withColumn("committed_txns", F.col("committed_lock_free") + F.col("committed_fallback"))
    backlog = F.sum("total_txns").over(by_worker) - F.sum("total_txns").over(by_worker.orderBy("epoch"))  # a row an epoch
    return d.withColumns({"epoch_throughput": F.floor(F.col("committed_txns") * 1000 / F.col("epoch_latency")), "queue_backlog": backlog})


def barrier(reports: DataFrame, n_workers: int) -> DataFrame:
    """Per epoch, the largest offset and counter of all workers' reports, and whether each has sent one."""
    return reports.groupBy("epoch").agg(F.max("last").alias("counter"), F.max("t").alias("t_counter"), F.sum("n").alias("requests"), (F.count("*") == n_workers).alias("complete"))


# --- commit, deltas, snapshots ---------------------------------------------------


def last_writes(writes: DataFrame, aborted: DataFrame | None = None, by: tuple[str, ...] = ("t_id", "round", "ordinal")) -> DataFrame:
    """The committed value of each key: the last write of the transactions that are not aborted."""
    if aborted is not None:
        writes = writes.join(aborted.select("t_id").distinct(), "t_id", "left_anti")
    order = [F.col(c) for c in by if c in writes.columns]
    return writes.groupBy("operator", "part", "key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def commit(state: DataFrame, written: DataFrame) -> DataFrame:
    """State after the writes: a full outer join, new values winning; a null value is a tombstone."""
    k = ["operator", "part", "key"]
    new = written.select(*k, F.col("value").alias("new"), F.lit(True).alias("hit"))
    both = state.join(new, k, "full_outer")
    return both.select(*k, F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value")).filter("value IS NOT NULL")


def deltas(writes: DataFrame, window: int) -> DataFrame:
    """Last value of each key in each snapshot window of ``window`` epochs."""
    return writes.groupBy((F.floor(F.col("epoch") / window)).alias("snapshot_id"), "operator", "part", "key").agg(F.max_by("value", "t_id").alias("value"))


def merge_snapshots(deltas: DataFrame, upto: int | None = None) -> DataFrame:
    """State at a snapshot id: the value of the largest id, in numeric order."""
    d = deltas if upto is None else deltas.filter(F.col("snapshot_id") <= upto)
    return d.groupBy("operator", "part", "key").agg(F.max_by("value", "snapshot_id").alias("value"))


def compact(deltas: DataFrame, upto: int) -> DataFrame:
    """Deltas up to an id replaced by one of that id; later ones unchanged."""
    old = merge_snapshots(deltas, upto).withColumn("snapshot_id", F.lit(upto).cast("long"))
    return old.unionByName(deltas.filter(F.col("snapshot_id") > upto))


def snapshot_sizes(deltas: DataFrame, size: Column, n_parts: int) -> DataFrame:
    """Per snapshot: partitions, keys and bytes stored, and whether all partitions are there."""
    p = deltas.groupBy("snapshot_id", "operator", "part").agg(F.count("*").alias("keys"), F.sum(size).alias("bytes"))
    return p.groupBy("snapshot_id").agg(F.count("*").alias("parts"), F.sum("keys").alias("keys"), F.sum("bytes").alias("bytes"), (F.count("*") == n_parts).alias("complete"))


def exactly_once(replies: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """One reply a request: the first by time; requests already answered are left out."""
    if sent is not None:
        replies = replies.join(sent.select("request_id").distinct(), "request_id", "left_anti")
    others = [c for c in replies.columns if c != "request_id"]
    first = replies.groupBy("request_id").agg(F.min(F.struct("ts", *[c for c in others if c != "ts"])).alias("x"))
    return first.select("request_id", "x.*")


# --- fallback --------------------------------------------------------------------


def fallback_dependencies(accesses: DataFrame, losers: DataFrame) -> DataFrame:
    """``(epoch, t_id, depends_on)``: for each key, a loser waits for the next smaller loser on it.

    Waiting for the next smaller one implies waiting for all smaller ones, so a
    hot key costs a chain, not all pairs. ``all_dependencies`` has all pairs.
    """
    mine = accesses.join(losers, ["epoch", "t_id"], "left_semi").select(*KEY, "t_id").distinct()
    before = F.lag("t_id").over(Window.partitionBy(*KEY).orderBy("t_id"))
    return mine.withColumn("depends_on", before).filter("depends_on IS NOT NULL").select("epoch", "t_id", "depends_on").distinct()


def all_dependencies(accesses: DataFrame, losers: DataFrame) -> DataFrame:
    """``(epoch, t_id, depends_on)``: every smaller loser that accessed a key of the loser's. A report; runs need the chain only."""
    mine = accesses.join(losers, ["epoch", "t_id"], "left_semi").select(*KEY, "t_id").distinct()
    other = mine.withColumnRenamed("t_id", "depends_on")
    return mine.join(other, KEY).filter("depends_on < t_id").select("epoch", "t_id", "depends_on").distinct()


def fallback_levels(dependencies: DataFrame) -> DataFrame:
    """``(epoch, t_id, level)``: 0 for a loser that waits for none, else one more than the highest of those it waits for.

    Each step settles the losers all of whose dependencies are settled; a step is
    a written table, and there are as many as the longest chain has links.
    """
    d = saved(dependencies.select("epoch", "t_id", "depends_on").distinct(), "waits")
    ends = d.select("epoch", F.col("depends_on").alias("t_id")).unionByName(d.select("epoch", "t_id")).distinct()
    done = saved(ends.join(d, ["epoch", "t_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    while not (left := saved(d.join(done.select("epoch", "t_id"), ["epoch", "t_id"], "left_anti"), "waits")).isEmpty():
        known = done.select("epoch", F.col("t_id").alias("depends_on"), "level")
        ready = left.join(known, ["epoch", "depends_on"], "left").groupBy("epoch", "t_id").agg((F.max("level") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        done, d = saved(done.unionByName(ready.filter("open = 0").drop("open")), "levels"), left
    return done


def fallback_components(dependencies: DataFrame) -> DataFrame:
    """``(t_id, component)``: transactions that must be re-run in one order."""
    return components(dependencies.select(F.col("t_id").alias("a"), F.col("depends_on").alias("b")), "fallback").select(F.col("v").alias("t_id"), F.col("root").alias("component"))


def fallback_triggered(stats: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Whether an epoch re-runs its losers at once; a negative threshold always does."""
    return stats.withColumn("abort_rate", F.col("concurrency_aborts") / F.col("processed")).withColumn("fallback", F.col("abort_rate") > threshold)


def rw_drift(first: DataFrame, second: DataFrame, state: DataFrame) -> DataFrame:
    """Transactions whose key set changed between runs on a key that is in the committed state."""
    k = ["t_id", "operator", "part", "key"]
    a, b = first.select(*k).distinct().withColumn("in_a", F.lit(1)), second.select(*k).distinct().withColumn("in_b", F.lit(1))
    changed = a.join(b, k, "full_outer").filter("in_a IS NULL OR in_b IS NULL")
    return changed.join(state.select("operator", "part", "key"), ["operator", "part", "key"], "left_semi").select("t_id").distinct()


# --- chains --------------------------------------------------------------------------


def ack_shares(calls: DataFrame) -> DataFrame:
    """Completion share of each call: the parent's share over its fan-out, level by level until no call is left.

    ``calls (t_id, call, parent)`` with a null parent at the root. A call's
    leaves and shares are those of the calls that call no others.
    """
    calls = saved(calls, "calls")
    fan = calls.filter("parent IS NOT NULL").groupBy("t_id", F.col("parent").alias("call")).agg(F.count("*").alias("fan"))
    calls = saved(calls.join(fan, ["t_id", "call"], "left"), "calls")
    level = calls.filter("parent IS NULL").select("t_id", "call", F.lit(1.0).alias("share"), "fan")
    below = calls.filter("parent IS NOT NULL").select("t_id", "call", "parent", F.col("fan").alias("own_fan"))
    done = None
    while True:
        leaves = level.filter("fan IS NULL").select("t_id", "share")
        done = leaves if done is None else done.unionByName(leaves)
        inner = level.filter("fan IS NOT NULL").select("t_id", F.col("call").alias("parent"), (F.col("share") / F.col("fan")).alias("share"))
        level = saved(inner.join(below, ["t_id", "parent"]).select("t_id", "call", "share", F.col("own_fan").alias("fan")), "level")  # read at the end, too
        if level.isEmpty():
            return done.groupBy("t_id").agg(F.count("*").alias("leaves"), F.sum("share").alias("share"))


def chain_replies(steps: DataFrame) -> DataFrame:
    """The reply of each transaction: the first error, else the last response that is not null."""
    at = F.struct("round", "ordinal")
    return steps.groupBy("t_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"), F.max_by("response", F.when(F.col("response").isNotNull(), at)).alias("response")).withColumn("reply", F.coalesce("error", "response"))
