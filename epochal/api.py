"""User functions on keyed operators: registration, a serial runner, and epochs on Spark.

A function is registered on an operator and takes ``(ctx, *params)``. ``ctx``
reads and writes the state of its own key and calls functions on other keys. An
exception anywhere in a request's chain aborts the request. Values and
parameters are JSON.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import transactions as tx
from .operators.partitioning import composite_partition, partition_of
from .storage import saved, shared_dir


class UnknownFunction(LookupError):
    """A call names an operator or function that the graph doesn't have."""


@dataclass
class Operator:
    name: str
    n_partitions: int = 4
    composite: tuple[str, int] | None = None
    functions: dict[str, Callable] = field(default_factory=dict)

    def register(self, f: Callable) -> Callable:
        self.functions[f.__name__] = f
        return f

    def partition(self, key):
        return composite_partition(key, *self.composite, self.n_partitions) if self.composite else partition_of(key, self.n_partitions)


@dataclass
class Graph:
    name: str
    operators: dict[str, Operator] = field(default_factory=dict)

    def add_operators(self, *ops: Operator) -> Graph:
        self.operators |= {o.name: o for o in ops}
        return self

    def function(self, operator: str, name: str) -> Callable:
        try:
            return self.operators[operator].functions[name]
        except KeyError:
            raise UnknownFunction(f"{operator}.{name}") from None

    def partition_column(self):
        """Partition of rows with ``operator`` and ``key``."""
        c = F.lit(None).cast("int")
        for o in self.operators.values():
            c = F.when(F.col("operator") == o.name, o.partition("key")).otherwise(c)
        return c


class Context:
    """What a function sees: its key's value, and calls it makes."""

    def __init__(self, operator: str, key: str, value: Any, scan: Callable[[], dict] | None = None):
        self.operator, self.key = operator, key
        self._value, self._scan = value, scan
        self.wrote = self.read = self.scanned = False
        self.calls: list[tuple[str, str, str, list]] = []
        self.inserts: dict[str, Any] = {}

    def get(self) -> Any:
        self.read = True
        return json.loads(self._value) if self._value is not None else None

    def put(self, value: Any) -> None:
        self.wrote, self._value = True, json.dumps(value)

    def call_remote_async(self, operator: str, function: str, key: Any, params: Iterable = ()) -> None:
        self.calls.append((operator, str(key), function, list(params)))

    def batch_insert(self, rows: dict) -> None:
        self.inserts |= {str(k): v for k, v in rows.items()}

    @property
    def data(self) -> dict:
        """All committed keys of the key's partition; every one counts as read."""
        if self._scan is None:
            raise NeedsScan
        self.read = self.scanned = True
        return self._scan()


class NeedsScan(BaseException):
    """A function asks for its partition, which this pass hasn't got; not an error of the function."""


class LocalRunner:
    """Serial execution, one request after another, each all or nothing: the reference for the distributed runs."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.state: dict[tuple[str, str], str] = {}

    def init_data(self, operator: str, rows: dict) -> None:
        self.state |= {(operator, str(k)): json.dumps(v) for k, v in rows.items()}

    def get_state(self, operator: str, key: Any) -> Any:
        v = self.state.get((operator, str(key)))
        return json.loads(v) if v is not None else None

    def send_event(self, operator: str, key: Any, function: str, params: Iterable = ()) -> tuple[Any, str | None]:
        """Response and error of one request; its writes are kept if there is no error."""
        buffer: dict[tuple[str, str], str] = {}
        queue, response = [(operator, str(key), function, list(params))], None
        while queue:
            later = []
            for op, k, f, p in queue:
                value = buffer.get((op, k), self.state.get((op, k)))
                ctx = Context(op, k, value, lambda op=op: {x[1]: json.loads(v) for x, v in self.state.items() if x[0] == op})
                try:
                    r = self.graph.function(op, f)(ctx, *p)
                except Exception as e:  # a user function's error aborts its request
                    return None, f"{type(e).__name__}: {e}"
                if r is not None:
                    response = r
                if ctx.wrote:
                    buffer[op, k] = ctx._value
                self.state |= {(op, x): json.dumps(v) for x, v in ctx.inserts.items()}
                later += ctx.calls
            queue = later
        self.state |= buffer
        return response, None

    def send_batch(self, events: Iterable[tuple]) -> list[tuple[Any, str | None]]:
        """Responses and errors of ``(operator, key, function, params)``, in their order."""
        return [self.send_event(*e) for e in events]


REPLY = "t_id long, response string, error string"
STEP = "kind string, t_id long, round int, ordinal string, operator string, key string, function string, params string, value string"


@dataclass
class Epoch:
    """Outcome of an epoch: the new state, replies, requests that wait for the next one, accesses, and the keys that changed."""

    state: DataFrame
    replies: DataFrame
    rescheduled: DataFrame
    accesses: DataFrame
    changes: DataFrame


class Session:
    """Runs epochs of requests ``(t_id, operator, key, function, params)`` over state ``(operator, part, key, value)``."""

    def __init__(self, spark: SparkSession, graph: Graph, mode: str = "serializable", threshold: float = 0.1, max_rounds: int = 64):
        self.spark, self.graph, self.mode, self.threshold, self.max_rounds = spark, graph, mode, threshold, max_rounds

    def state_of(self, rows: DataFrame) -> DataFrame:
        return rows.select("operator", self.graph.partition_column().alias("part"), "key", "value")

    def _steps(self, messages: DataFrame, state: DataFrame) -> DataFrame:
        """Runs every chain against the state, each request seeing its own writes only; all steps of all rounds."""
        graph = self.graph

        def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for pdf in parts:
                out = []
                for m in pdf.itertuples(index=False):
                    own = m.own if isinstance(m.own, str) else m.value if isinstance(m.value, str) else None
                    rows = getattr(m, "rows", None)
                    scan = (lambda r=rows: {x["key"]: json.loads(x["value"]) for x in r}) if rows is not None else None
                    ctx = Context(m.operator, m.key, own, scan)
                    row = (m.t_id, m.round, m.ordinal, m.operator, m.key)
                    try:
                        r = graph.function(m.operator, m.function)(ctx, *json.loads(m.params))
                    except NeedsScan:
                        out.append(("scan", *row, m.function, m.params, m.own))
                        continue
                    except Exception as e:  # a user function's error aborts its request
                        out.append(("error", *row, None, None, f"{type(e).__name__}: {e}"))
                        continue
                    if ctx.read:
                        out.append(("r", *row, None, None, None))
                    if ctx.scanned:
                        out += [("r", *row[:4], x["key"], None, None, None) for x in rows if x["key"] != m.key]
                    if ctx.wrote:
                        out.append(("w", *row, None, None, ctx._value))
                    out += [("insert", *row[:4], k, None, None, json.dumps(v)) for k, v in ctx.inserts.items()]
                    if r is not None:
                        out.append(("response", *row, None, None, json.dumps(r)))
                    for i, (op, k, f, p) in enumerate(ctx.calls):
                        out.append(("call", m.t_id, m.round + 1, f"{m.ordinal}.{i:04d}", op, k, f, json.dumps(p), None))
                yield pd.DataFrame(out, columns=["kind", "t_id", "round", "ordinal", "operator", "key", "function", "params", "value"])

        done, writes = None, self.spark.createDataFrame([], "t_id long, operator string, key string, own string")
        call = ["t_id", "round", "ordinal", "operator", "key", "function", "params"]
        part = self.graph.partition_column()
        for _ in range(self.max_rounds):
            held = messages.join(state.select("operator", "key", "value"), ["operator", "key"], "left").join(writes, ["t_id", "operator", "key"], "left")
            steps = saved(held.select(*call, "value", "own").mapInPandas(run, STEP), "steps")
            if not (scans := steps.filter("kind = 'scan'")).isEmpty():
                # Functions that ask for their partition run again, with its committed rows.
                asked = scans.select(*call, F.col("value").alias("own"), part.alias("part"))
                wanted = state.join(asked.select("operator", "part").distinct(), ["operator", "part"], "left_semi")
                rows = wanted.groupBy("operator", "part").agg(F.collect_list(F.struct("key", "value")).alias("rows"))  # what the function asks for
                again = asked.join(rows, ["operator", "part"], "left").join(state.select("operator", "key", "value"), ["operator", "key"], "left")
                again = again.select(*call, "value", "own", F.coalesce("rows", F.array().cast("array<struct<key:string,value:string>>")).alias("rows"))
                steps = steps.filter("kind <> 'scan'").unionByName(saved(again.mapInPandas(run, STEP), "scans"))
            done = steps if done is None else done.unionByName(steps)
            calls = steps.filter("kind = 'call'")
            if calls.isEmpty():
                return done.filter("kind <> 'call'")
            messages = calls.select(*call)
            own = done.filter("kind = 'w'").groupBy("t_id", "operator", "key").agg(F.max_by("value", F.struct("round", "ordinal")).alias("own"))
            writes = own
        raise RuntimeError(f"a chain takes more than {self.max_rounds} rounds")

    def run_epoch(self, requests: DataFrame, state: DataFrame, number: int = 0) -> Epoch:
        first = requests.select("t_id", F.lit(0).alias("round"), F.lit("0").alias("ordinal"), "operator", "key", "function", "params")
        steps = saved(self._steps(first, state), "epoch")
        errors = steps.filter("kind = 'error'").groupBy("t_id").agg(F.min_by("value", F.struct("round", "ordinal")).alias("error"))
        acc = steps.filter("kind IN ('r', 'w')").select(F.lit(number).cast("long").alias("epoch"), "t_id", "operator", self.graph.partition_column().alias("part"), "key", F.col("kind").alias("mode")).distinct()
        acc = saved(tx.without_logic_aborts(acc, errors), "accesses")
        lost = saved(tx.conflicts(acc, self.mode), "lost")
        total, n_lost = requests.count(), lost.count()
        out = errors.select("t_id", F.lit(True).alias("x")).unionByName(lost.select("t_id", F.lit(True).alias("x")))
        kept = steps.join(out, "t_id", "left_anti")
        part = self.graph.partition_column()
        written = saved(tx.last_writes(kept.filter("kind = 'w'").select("operator", part.alias("part"), "key", "t_id", "round", "ordinal", "value")), "written")
        # Bulk inserts take part in no conflict and stay even if their request is re-run; a write of the key wins.
        inserted = tx.last_writes(steps.filter("kind = 'insert'").select("operator", part.alias("part"), "key", "t_id", "round", "ordinal", "value"))
        changes = [inserted.join(written, ["operator", "part", "key"], "left_anti").unionByName(written)]
        replies = kept.filter("kind = 'response'").groupBy("t_id").agg(F.max_by("value", F.struct("round", "ordinal")).alias("response"))
        silent = requests.select("t_id").join(out, "t_id", "left_anti").join(replies, "t_id", "left")  # a function that returns nothing is answered, too
        replies = silent.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select("t_id", F.lit(None).cast("string").alias("response"), "error"))
        losers = requests.join(lost.select("t_id"), "t_id", "left_semi")
        if n_lost and n_lost > self.threshold * total:
            more, losers, rerun = self._fallback(losers, tx.commit(state, changes[0]), acc, lost)
            changes.append(rerun)
            replies = replies.unionByName(more)
        stamped = [c.withColumn("step", F.lit(i)) for i, c in enumerate(changes)]
        changed = stamped[0] if len(stamped) == 1 else stamped[0].unionByName(stamped[1])
        changed = saved(changed.groupBy("operator", "part", "key").agg(F.max_by("value", "step").alias("value")), "changes")
        return Epoch(tx.commit(state, changed), saved(replies, "replies"), saved(losers, "losers"), acc, changed)

    def _fallback(self, losers: DataFrame, state: DataFrame, acc: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Re-runs the losers in t_id order, component by component, each over the keys it touched before.

        Replies, losers that wait, and changed keys. A loser that now touches another existing key waits for the next epoch.
        """
        graph = self.graph
        comp = tx.fallback_components(tx.fallback_dependencies(acc, lost))
        comp = saved(lost.select("t_id").distinct().join(comp, "t_id", "left").select("t_id", F.coalesce("component", "t_id").alias("component")), "components")
        keys = acc.join(comp, "t_id").select(F.col("component").alias("of"), "operator", "key").distinct()
        held = keys.join(state.select("operator", "key", "value"), ["operator", "key"], "left")
        todo = losers.join(comp, "t_id").select("component", "t_id", "operator", "key", "function", "params")

        def run(requests: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            runner = LocalRunner(graph)
            known = {(r.operator, r.key) for r in cells.itertuples()}
            runner.state = {(r.operator, r.key): r.value for r in cells.itertuples() if isinstance(r.value, str)}
            out = []
            for m in requests.sort_values("t_id").itertuples():
                before = dict(runner.state)
                response, error = runner.send_event(m.operator, m.key, m.function, json.loads(m.params))
                new = {k: v for k, v in runner.state.items() if before.get(k) != v}
                if any(k not in known for k in new):
                    runner.state = before
                    out.append(("drift", m.t_id, m.operator, m.key, None))
                    continue
                out += [("w", m.t_id, k[0], k[1], v) for k, v in new.items()]
                out.append(("error" if error else "response", m.t_id, m.operator, m.key, error or (json.dumps(response) if response is not None else None)))
            return pd.DataFrame(out, columns=["kind", "t_id", "operator", "key", "value"])

        ran = saved(todo.groupBy("component").cogroup(held.groupBy("of")).applyInPandas(run, "kind string, t_id long, operator string, key string, value string"), "fallback")
        waits = ran.filter("kind = 'drift'").select("t_id")
        w = ran.filter("kind = 'w'").select("operator", graph.partition_column().alias("part"), "key", "t_id", "value")
        replies = ran.filter("kind IN ('response', 'error')").select("t_id", F.when(F.col("kind") == "response", F.col("value")).alias("response"), F.when(F.col("kind") == "error", F.col("value")).alias("error"))
        return replies, losers.join(waits, "t_id", "left_semi"), tx.last_writes(w)

    def epochs(self, requests: DataFrame, state: DataFrame, epoch_size: int, compact_every: int = 8) -> Iterator[Epoch]:
        """All requests in epochs of ``epoch_size``, losers first in the next one, until none waits.

        An epoch's least request commits, so this ends. Epochs write the keys
        they change; every ``compact_every`` epochs the whole state is written.
        """
        bounds = requests.agg(F.min("t_id"), F.max("t_id")).first()
        low, last = (bounds[0] - 1, bounds[1]) if bounds[0] is not None else (0, 0)
        carried = None
        for n in count():
            fresh = requests.filter((F.col("t_id") > low) & (F.col("t_id") <= low + epoch_size))
            if low >= last and (carried is None or carried.isEmpty()):
                return
            e = self.run_epoch(saved(fresh if carried is None else carried.unionByName(fresh), "batch"), state, n)
            if n % compact_every == compact_every - 1:
                e.state = saved(e.state, "state")
            state, carried, low = e.state, e.rescheduled, min(low + epoch_size, last)
            yield e

    def run(self, requests: DataFrame, state: DataFrame, epoch_size: int) -> tuple[DataFrame, DataFrame]:
        """Final state and replies of all requests."""
        path = f"{shared_dir(self.spark)}/run-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], REPLY).write.parquet(f"{path}/epoch=-1")
        for n, e in enumerate(self.epochs(requests, state, epoch_size)):
            e.replies.write.parquet(f"{path}/epoch={n}")
            state = e.state
        return saved(state, "state"), self.spark.read.schema(REPLY).parquet(path).select("t_id", "response", "error")


def serial_winners_then_losers(runner: LocalRunner, requests: list[tuple], aborted: set[int]) -> dict[int, tuple]:
    """An epoch in the order that the protocol is equal to: winners by t_id, then losers by t_id."""
    order = defaultdict(list)
    for r in sorted(requests):
        order[r[0] in aborted].append(r)
    return {r[0]: runner.send_event(*r[1:]) for r in order[False] + order[True]}
