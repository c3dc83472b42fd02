"""Requests as a stream: a micro-batch is run in epochs until each of its requests has its reply.

A batch leaves the keys that it changed; every ``compact_every`` batches the
whole state is written, and a state is the last whole one with the changes
behind it. A batch may be replayed after a failure: it reads the version before
it and overwrites its own files, so replaying changes nothing, and every request
gets one reply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Graph, Session
from ..operators import transactions as tx

STATE = "operator string, part int, key string, value string"
REPLY = "request_id string, response string, error string"


class StreamingSession:
    """Under ``path``: ``state/<batch>`` (whole), ``changes/batch=<batch>``, ``sequenced/batch=<batch>``, ``replies/batch=<batch>``."""

    def __init__(self, spark: SparkSession, graph: Graph, path: str, epoch_size: int = 10_000, compact_every: int = 10, **options):
        self.spark, self.path, self.epoch_size, self.compact_every = spark, path, epoch_size, compact_every
        self.session = Session(spark, graph, **options)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def init_data(self, rows: DataFrame) -> None:
        self.session.state_of(rows).write.mode("overwrite").parquet(f"{self.path}/state/-1")

    def state(self, batch: int) -> DataFrame:
        """The state after a batch."""
        whole = batch
        while whole > -1 and not self._exists(f"{self.path}/state/{whole}/_SUCCESS"):  # ``compact_every`` steps at most
            whole -= 1
        old = self.spark.read.schema(STATE).parquet(f"{self.path}/state/{whole}")
        if whole == batch:
            return old
        new = self.spark.read.schema(STATE + ", batch long").option("basePath", f"{self.path}/changes").parquet(*[f"{self.path}/changes/batch={n}" for n in range(whole + 1, batch + 1)])
        return tx.commit(old, new.groupBy("operator", "part", "key").agg(F.max_by("value", "batch").alias("value")))

    def replies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/replies")

    def _epoch(self, batch: DataFrame, number: int) -> None:
        """Requests ``(request_id, operator, key, function, params)``; of rows that repeat an id, one is run."""
        one = batch.dropDuplicates(["request_id"]).withColumn("log", F.lit(0))
        tx.place(one, ["log"], ["request_id"], "t_id").withColumn("t_id", F.col("t_id") + 1).drop("log").write.mode("overwrite").parquet(f"{self.path}/sequenced/batch={number}")
        todo = self.spark.read.schema("t_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)).parquet(f"{self.path}/sequenced/batch={number}")
        replies = self.spark.createDataFrame([], f"t_id long, request_id {dict(batch.dtypes)['request_id']}, response string, error string").drop("t_id")
        changes, old = None, self.state(number - 1)
        state = old
        for n, e in enumerate(self.session.epochs(todo.drop("request_id"), old, self.epoch_size)):
            replies = replies.unionByName(todo.select("t_id", "request_id").join(e.replies, "t_id").select("request_id", "response", "error"))
            new = e.changes.withColumn("n", F.lit(n))
            changes, state = new if changes is None else changes.unionByName(new), e.state
        replies.write.mode("overwrite").parquet(f"{self.path}/replies/batch={number}")
        if changes is None:
            changes = old.limit(0).withColumn("n", F.lit(0))
        changes.groupBy("operator", "part", "key").agg(F.max_by("value", "n").alias("value")).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        if number % self.compact_every == self.compact_every - 1:
            state.write.mode("overwrite").parquet(f"{self.path}/state/{number}")

    def start(self, requests: DataFrame) -> StreamingQuery:
        return requests.writeStream.foreachBatch(self._epoch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
