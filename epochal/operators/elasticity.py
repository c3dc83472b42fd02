"""Moving state between partitions, and deciding how many workers to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import partition_of


def rehash(keys: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose partition changes."""
    return keys.withColumns({"old_part": partition_of("key", old), "new_part": partition_of("key", new)}).filter("old_part <> new_part")


def batches(moves: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``: ``size`` keys of a partition at a time."""
    return moves.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("old_part").orderBy("key")) - 1) / size))


def catch_up(now: DataFrame, sent: DataFrame) -> DataFrame:
    """Keys that came up while others were sent."""
    return now.join(sent, "key", "left_anti")


def moved_partitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions that keep their number and change their worker."""
    return old.withColumnRenamed("worker", "from_worker").join(new.withColumnRenamed("worker", "to_worker"), ["operator", "part"]).filter("from_worker <> to_worker")


def scale_up(df: DataFrame, peak: str, now: str, confidence: str, workers: int, capacity: float, spike: float = 1.15, least: float = 0.25) -> DataFrame:
    """Adds ``added``: workers for the forecast peak, if it is trusted and a spike; at most doubling them."""
    need = F.ceil(F.col(peak) / capacity) - workers
    idle = (F.col(confidence) < least) | (F.col(peak) < spike * F.col(now)) | (F.col(peak) <= workers * capacity)
    return df.withColumn("added", F.when(idle, F.lit(0)).otherwise(F.least(need, F.lit(workers))).cast("long"))


def scale_down(df: DataFrame, peak: str, workers: int, capacity: float, slack: float = 0.9, floor: int = 2) -> DataFrame:
    """Adds ``removed``: the most workers that can go with the peak below ``slack`` of what stays; ``floor`` stay."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(workers - floor)), lambda k: F.col(peak) < capacity * (workers - k) * slack)
    return df.withColumn("removed", F.coalesce(F.array_max(fits), F.lit(0)).cast("long"))


def migration_seconds(keys, epoch_ms, batch: int) -> Column:
    return F.col(keys) * F.col(epoch_ms) / batch / 1000


def graph_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New operators and changed partition counts."""
    a, b = old.withColumnRenamed("partitions", "p0"), new.withColumnRenamed("partitions", "p1")
    both = a.join(b, "name", "full_outer")
    return both.select("name", F.col("p0").isNull().alias("added"), F.coalesce(F.col("p0") != F.col("p1"), F.lit(False)).alias("moved")).filter("added OR moved")
