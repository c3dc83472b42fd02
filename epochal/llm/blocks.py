"""Texts in blocks, and packed messages between blocks and hash buckets.

Operators that look for repeats in all texts deal the documents out to blocks of
some megabytes. A block finds its fingerprints with numpy, combines equal ones,
and sends each hash bucket one packed message; a bucket compares the messages of
all blocks and answers each block with one packed message. A fingerprint that is
everywhere costs one entry a block, whatever its number of occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, plan_bytes, shuffle_partitions

MESSAGE = "dst int, src int, kind int, data binary"
_ARROW = pa.schema([("dst", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Bytes of messages that one bucket should gather.
BUCKET_BYTES = 16 << 20


def as_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, together: bool = True) -> tuple[DataFrame, int]:
    """``(blk, ord, id, text)``: ``ord`` is the id, or for null ids a number behind all usual ids that depends on the text.

    Rows that share an id lie in one block, unless they needn't be ``together``: then only equal rows do.
    """
    n = block_count(docs, block_bytes)
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2)
    order = F.coalesce(F.col(id_col).cast("long"), late)
    d = docs.select(order.alias("ord"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by = ["ord"] if together else ["ord", "text"]
    return d.select(F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("blk"), "ord", "id", "text"), n


def bucket_count(docs: DataFrame, bytes_per_text_byte: float) -> int:
    size, n = plan_bytes(docs), shuffle_partitions(docs.sparkSession)
    return max(n, int(2 * size * bytes_per_text_byte) // BUCKET_BYTES) if size is not None else n


def raw(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its rows (one more than rows)."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks != 1 else a.chunk(0)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else ([],) * 4, _ARROW)], schema=_ARROW)


def deal(to: np.ndarray, src: int, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """A message for each value of ``to``, with its entries of ``arrays`` in their order."""
    if not len(to):
        return []
    by = np.argsort(to, kind="stable")
    to = to[by]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    arrays = [a[by] for a in arrays]
    return [(int(to[a]), src, kind, pack(*(x[a:b] for x in arrays))) for a, b in zip(cuts[:-1], cuts[1:])]


def gather(table: pa.Table, kind: int, *kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of all messages of a kind, concatenated, and each entry's sender."""
    parts, src = [], []
    for s, k, d in zip(table.column("src").to_pylist(), table.column("kind").to_pylist(), table.column("data")):
        if k == kind:
            parts.append(unpack(d.as_buffer(), *kinds))
            src.append(np.full(len(parts[-1][0]), s, np.int32))
    if not parts:
        return [np.zeros(0, k) for k in kinds], np.zeros(0, np.int32)
    return [np.concatenate(x) for x in zip(*parts)], np.concatenate(src)


def passed_on(table: pa.Table, kind: int) -> list[tuple[int, int, int, bytes]]:
    """Messages of a kind that go to block ``src`` as they are."""
    return [(s, s, k, d.as_py()) for s, k, d in zip(table.column("src").to_pylist(), table.column("kind").to_pylist(), table.column("data")) if k == kind]


def same_as_previous(*sorted_arrays: np.ndarray) -> np.ndarray:
    n = len(sorted_arrays[0])
    out = np.zeros(n, bool)
    if n > 1:
        out[1:] = np.logical_and.reduce([a[1:] == a[:-1] for a in sorted_arrays])
    return out


def in_sorted(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values
