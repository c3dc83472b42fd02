"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import inspect
import sys
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, saved, shared_dir, table  # noqa: F401

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that one Python group should hold.
BLOCK_BYTES = 6 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes that the plan reads: for Parquet scans, the size of the files. None where Catalyst can't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of groups so that each holds about ``block_bytes``; it grows with the input.

    Text in Parquet expands about twice. Without a known size, four groups a
    shuffle partition.
    """
    size, n = plan_bytes(df), shuffle_partitions(df.sparkSession)
    return max(n, -(-2 * size // block_bytes)) if size is not None else 4 * n


def words(text) -> F.Column:
    """All words of a text column as an array (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value, body):
    """``body(value)`` with ``value`` computed once, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def distributed_rank(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``keys``, in hash order of ``order[0]``.

    A key's rows are dealt to hash buckets, ranked there, and shifted by the
    prefix sums of the bucket counts, so that no task holds a whole hot key.
    Equal rows may take each other's ranks. Null keys form a key of their own.
    """
    b = f"__{out}_bucket"
    k = [f"__{out}_{i}" for i in range(len(keys))]
    df = df.withColumns({b: F.pmod(F.xxhash64(F.col(order[0]), F.lit(17)), F.lit(buckets)).cast("int"), **{x: F.struct(y) for x, y in zip(k, keys)}})
    counts = df.groupBy(*k, b).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*k, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    here = Window.partitionBy(*k, b).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(here))
    return ranked.join(counts, [*k, b]).withColumn(out, F.col(out) + F.col("__before") - 1).drop(*k, b, "__before")


# --- memory of Python workers -------------------------------------------------

#: Bytes of text that one step of a batch function works on at once.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of a batch with about ``limit`` bytes in ``column`` each, a row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield batch.slice(int(a), int(b - a))


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task, and beside the JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(f):
    """``f``, a function of a group or of a task's batches, with ``release`` at its end."""

    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def task(*args):
            try:
                yield from f(*args)
            finally:
                release()

        return task

    @wraps(f)
    def group(*args):
        try:
            return f(*args)
        finally:
            release()

    group.__signature__ = inspect.signature(f)
    return group


# --- 64-bit hashes in numpy -------------------------------------------------
#
# Strings are hashed by sums of their symbols times random 64-bit numbers, one
# for each place (a multilinear hash), and windows of numbers by trees of such
# sums. Unlike polynomials modulo 2**64, neither has words that agree whatever
# the random numbers are (Thue-Morse words do so there).

_M = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the entropy of 64-bit sums over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _M
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Hashes:
    """A family of hashes, drawn from a seed."""

    TABLE = 4096

    def __init__(self, seed: int):
        self.seed = np.uint64(seed)
        self.table = self._draw(np.arange(self.TABLE))

    def _draw(self, place: np.ndarray) -> np.ndarray:
        return mix(mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.seed) ^ self.seed)

    def places(self, n: int) -> np.ndarray:
        """The random numbers of the first ``n`` places; those beyond the table are drawn again each time."""
        return self.table[:n] if n <= self.TABLE else np.r_[self.table, self._draw(np.arange(self.TABLE, n))]

    def strings(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 22) -> np.ndarray:
        """Hashes of the byte strings ``data[start:end]``, of a byte at least each; ``step`` bytes or one string at a time."""
        size = end - start
        part = np.cumsum(size) // step
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(size)] if len(size) else [0]
        out = np.empty(len(size), np.uint64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            n = size[a:b]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum()))
            value = self.places(int(n.max()))[at - np.repeat(first, n)]
            at += np.repeat(start[a:b] - first, n)
            value *= data[at].astype(np.uint64) + np.uint64(1)
            out[a:b] = np.add.reduceat(value, first)
        return mix(out + size.astype(np.uint64) * self.seed)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * (self.table[0] | np.uint64(1)) + mix(b ^ self.table[1]))

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all windows of ``length`` numbers, by start: a tree of windows of 1, 2, 4, ... numbers."""
        if len(values) < length:
            return np.zeros(0, np.uint64)
        h, have = mix(values ^ self.seed), 1
        while have < length:
            step = min(have, length - have)
            h, have = self.pairs(h[: len(h) - step], h[step:]), have + step
        return h

    def sequences(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of whole runs of numbers ``values[start:end]``, a few numbers each."""
        out = mix((end - start).astype(np.uint64) * self.table[2])
        for k in range(int((end - start).max()) if len(start) else 0):
            more = np.flatnonzero(start + k < end)
            out[more] = self.pairs(out[more], values[start[more] + k])
        return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
