"""Placement of keys on partitions and of partitions on workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_partition(key, n: int) -> Column:
    """Whole numbers and digit strings by their value, other strings by hash; a null key has no partition."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.coalesce(key.try_cast("bigint"), F.xxhash64(key)), F.lit(n)).cast("int")


def partition_of(key, n: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNotNull(), hash_partition(key, n))


def composite_partition(key, delimiter: str, field: int, n: int) -> Column:
    """Partition of one field (from 0) of a delimited key, so that keys sharing it are together."""
    key = F.col(key) if isinstance(key, str) else key
    return partition_of(F.split_part(key, F.lit(delimiter), F.lit(field + 1)), n)


def update_partitions(df: DataFrame, n: int, key: str = "key", part: str = "part") -> DataFrame:
    """Every key's partition after a change of their number; the one before in ``old_part``."""
    return df.withColumnRenamed(part, f"old_{part}").withColumn(part, partition_of(key, n))


def range_partition(df: DataFrame, key: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Adds ``part``: the index of the inclusive range that holds the key; fails on a miss."""
    bounds = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ranges])
    hit = F.array_position(F.transform(bounds, lambda r: F.col(key).between(r["lo"], r["hi"])), True)
    return df.withColumn("part", F.when(hit > 0, hit - 1).otherwise(F.raise_error(F.concat(F.lit("no range for key "), F.col(key).cast("string")))).cast("int"))


def round_robin(parts: DataFrame, order: list[str], workers: list[int]) -> DataFrame:
    """Adds ``worker``: partitions in order, dealt to the workers in turn (least loaded first, all starting empty)."""
    i = F.row_number().over(Window.orderBy(*order)) - 1  # one row a partition of the graph
    return parts.withColumn("worker", F.element_at(F.array(*map(F.lit, workers)), (F.pmod(i, F.lit(len(workers))) + 1).cast("int")))


def reassign(assigned: DataFrame, order: list[str], lost: list[int]) -> DataFrame:
    """Partitions of lost workers, dealt in turn to the survivors in id order."""
    survivors = [r["worker"] for r in assigned.select("worker").distinct().filter(~F.col("worker").isin(lost)).orderBy("worker").collect()]  # one row a worker
    moved = round_robin(assigned.filter(F.col("worker").isin(lost)).drop("worker"), order, survivors)
    return assigned.filter(~F.col("worker").isin(lost)).unionByName(moved)


def shadows(parts: DataFrame, active: int) -> DataFrame:
    """Partitions beyond the active count."""
    return parts.filter(F.col("part") >= active)


def placement_map(assigned: DataFrame) -> DataFrame:
    """Operator -> map from partition to worker."""
    return assigned.groupBy("operator").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "worker")))).alias("parts"))
