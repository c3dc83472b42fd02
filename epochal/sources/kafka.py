"""Request and reply topics, where Spark's Kafka connector is on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id long, key string, function string, params string"


def requests(spark: SparkSession, servers: str, graph_operators: list[str], per_trigger: int = 1000) -> DataFrame:
    """A stream over the operators' topics, at most ``per_trigger`` records a batch."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(graph_operators)).option("maxOffsetsPerTrigger", per_trigger).load()
    body = F.from_json(F.col("value").cast("string"), REQUEST)
    return raw.select(F.col("topic").alias("operator"), F.col("partition"), F.col("offset"), body.alias("r")).select("operator", "partition", "offset", "r.*")


def in_order(records: DataFrame, n_partitions: int) -> DataFrame:
    """Records of a batch, each partition's by offset, with the partition that owns the key.

    ``owner`` is null for a record without key; ``forwarded`` tells that another
    partition than the owner's got the record.
    """
    from ..operators.partitioning import partition_of

    owner = partition_of("key", n_partitions)
    d = records.withColumn("owner", owner).withColumn("forwarded", F.coalesce(F.col("owner") != F.col("partition"), F.lit(False)))
    return d.repartition("partition").sortWithinPartitions("partition", "offset")


def next_offsets(records: DataFrame) -> DataFrame:
    """Where each partition is read on from: behind the last record that has been taken."""
    return records.groupBy("operator", "partition").agg((F.max("offset") + 1).alias("offset"))


def reply_rows(replies: DataFrame, operator: str) -> DataFrame:
    """Key and value for an operator's output topic."""
    return replies.select(F.lit(f"{operator}--OUT").alias("topic"), F.col("request_id").cast("string").alias("key"), F.to_json(F.struct("response", "error")).alias("value"))


def write_replies(replies: DataFrame, servers: str, operator: str, sent: DataFrame | None = None) -> None:
    """Sends replies, one a request, without those that were ``sent`` before a failure."""
    if sent is not None:
        replies = replies.join(sent.select("request_id").distinct(), "request_id", "left_anti")
    reply_rows(replies.dropDuplicates(["request_id"]), operator).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
