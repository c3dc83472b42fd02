"""Access to keyed state: point reads, partition scans, membership, bulk inserts, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["operator", "key"]


def get(requests: DataFrame, state: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Each request's own last write of its key, else the committed value, else null."""
    d = requests.join(state.select(*KEY, F.col("value").alias("committed")), KEY, "left")
    if own is None:
        return d.withColumnRenamed("committed", "value")
    last = own.groupBy("t_id", *KEY).agg(F.max_by("value", "ordinal").alias("own"))
    return d.join(last, ["t_id", *KEY], "left").withColumn("value", F.coalesce("own", "committed")).drop("own", "committed")


def get_all(requests: DataFrame, state: DataFrame, scope: str = "partition") -> DataFrame:
    """Committed rows of a request's partition, or of the whole operator; every key counts as read."""
    on = ["operator", "part"] if scope == "partition" else ["operator"]
    return requests.select("t_id", *on).join(state, on)


def exists(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state.select(*KEY), KEY, "left_semi")


def batch_insert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Bulk upsert without isolation: new rows win."""
    both = state.withColumn("new", F.lit(0)).unionByName(rows.withColumn("new", F.lit(1)))
    return both.groupBy("operator", "part", "key").agg(F.max_by("value", "new").alias("value"))


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State without the keys."""
    return state.join(keys.select(*KEY), KEY, "left_anti")
