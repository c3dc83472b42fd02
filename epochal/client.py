"""A client that gathers requests and runs them as epochs, and the published form of a graph."""

from __future__ import annotations

import asyncio
import json
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import Future
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Graph, Session
from .storage import saved

REQUEST = "request_id string, t_id long, operator string, key string, function string, params string"


@dataclass
class Response:
    """What a request came to: its value or error, and the milliseconds from sending to the end of its batch."""

    request_id: str
    value: Any
    error: str | None
    latency_ms: float


class Client:
    """Sends events to a graph; ``flush`` runs all that are waiting and advances the state."""

    def __init__(self, spark: SparkSession, graph: Graph, epoch_size: int = 1000, **options):
        self.spark, self.graph, self.epoch_size = spark, graph, epoch_size
        self.session = Session(spark, graph, **options)
        self.state: DataFrame | None = None
        self._waiting: list[tuple] = []
        self._sent: dict[str, float] = {}
        self._done: dict[str, Response] = {}
        self._futures: dict[str, Future] = {}
        self._next = 1

    def init_data(self, operator: str, rows: dict) -> None:
        new = self.session.state_of(self.spark.createDataFrame([(operator, str(k), json.dumps(v)) for k, v in rows.items()], "operator string, key string, value string"))
        self.state = saved(new if self.state is None else self.state.unionByName(new), "state")

    def send_event(self, operator: str, key: Any, function: str, params: Iterable = ()) -> str:
        """Queues a request and returns its id; unknown functions are refused at once."""
        self.graph.function(operator, function)
        request_id = uuid.uuid4().hex
        self._waiting.append((request_id, self._next, operator, str(key), function, json.dumps(list(params))))
        self._sent[request_id] = time.monotonic()
        self._next += 1
        return request_id

    def submit(self, operator: str, key: Any, function: str, params: Iterable = ()) -> Future:
        """As ``send_event``, with a future of the response; it is done once the batch has run."""
        future: Future = Future()
        self._futures[self.send_event(operator, key, function, params)] = future
        return future

    def send_batch(self, events: Iterable[tuple]) -> list[str]:
        """Queues ``(operator, key, function, params)`` and returns their ids."""
        return [self.send_event(*e) for e in events]

    def update(self, graph: Graph) -> list[tuple]:
        """Takes a changed graph: rows of operators with another number of partitions are placed anew. Returns those."""
        changes = spec_changes(graph_spec(self.graph), graph_spec(graph))
        if changes["added"]:
            raise ValueError(f"an update may not add operators: {changes['added']}")
        self.flush()
        self.graph = self.session.graph = graph
        if self.state is not None and changes["moved"]:
            self.state = saved(self.session.state_of(self.state), "state")
        return changes["moved"]

    def close(self) -> None:
        self.flush()

    def flush(self) -> None:
        if not self._waiting:
            return
        first = self._waiting[0][1] - 1
        rows = self.spark.createDataFrame(self._waiting, REQUEST).withColumn("t_id", F.col("t_id") - first)
        self.state, replies = self.session.run(rows.drop("request_id"), self.state, self.epoch_size)
        now, found = time.monotonic(), {r["t_id"]: r for r in replies.collect()}  # the client's own requests
        for w in self._waiting:
            r = found.get(w[1] - first)
            value = json.loads(r["response"]) if r is not None and r["response"] is not None else None
            self._done[w[0]] = Response(w[0], value, r["error"] if r is not None else None, 1000 * (now - self._sent.pop(w[0])))
            if w[0] in self._futures:
                self._futures.pop(w[0]).set_result(self._done[w[0]])
        self._waiting = []

    def get(self, request_id: str) -> Response:
        if request_id not in self._done:
            self.flush()
        return self._done[request_id]


class AsyncClient:
    """A client for coroutines: responses of all requests that wait at one time come from one run of epochs."""

    def __init__(self, client: Client):
        self.client, self._run = client, None

    async def send_event(self, operator: str, key: Any, function: str, params: Iterable = ()) -> Response:
        future = self.client.submit(operator, key, function, params)
        if self._run is None:
            self._run = asyncio.ensure_future(self._flush())
        await self._run
        return future.result()

    async def _flush(self) -> None:
        await asyncio.sleep(0)  # lets the other coroutines send theirs
        self._run = None
        self.client.flush()


def graph_spec(graph: Graph) -> str:
    """Operators, partition counts and function names as JSON."""
    return json.dumps({"name": graph.name, "operators": {n: {"partitions": o.n_partitions, "composite": o.composite, "functions": sorted(o.functions)} for n, o in sorted(graph.operators.items())}}, sort_keys=True)


def spec_changes(old: str, new: str) -> dict[str, list]:
    """New operators, which an update may not bring, and changed partition counts, which move state."""
    a, b = json.loads(old)["operators"], json.loads(new)["operators"]
    return {"added": sorted(set(b) - set(a)), "moved": sorted((n, a[n]["partitions"], b[n]["partitions"]) for n in set(a) & set(b) if a[n]["partitions"] != b[n]["partitions"])}
