"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` distinct vectors, a sample of fixed size in hash order, are the
pivots. A vector is represented by its ``PREFIX`` nearest pivots in order. The
vectors are dealt to shards; each shard keeps an inverted file: for each pivot,
the vectors that have it in their prefix, with its position. A query adds up,
over its own pivots' lists, what each match takes off the footrule distance

    sum over pivots of | position in x - position in q |   (PREFIX where absent),

so the vectors nearest by footrule come out without looking at the rest. The
``CANDIDATES`` nearest of each shard are ranked again by the exact cosine in
double precision. Queries meet every shard, in blocks.

Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no
part, nor do those without id or of a length other than the commonest. Rows that
repeat id and vector count once. An id with several vectors is found by the
nearest of them, and asks with the least. Of the copies of one vector the
``k + 1`` with the smallest ids are indexed, which gives the same results as all
of them. A query is never its own neighbour; rows that repeat its id aren't
either. Of equal scores the smaller id comes first. Fewer vectors than asked for
give all there are; an empty table an empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, saved

PIVOTS = 2048
PREFIX = 128
CANDIDATES = 1536
SHARD_ROWS = 32768
QUERY_ROWS = 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is larger than all
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    d = d.filter(F.forall("v", fine)).filter(F.exists("v", lambda x: x != 0))
    widths = d.groupBy(F.size("v").alias("w")).count().orderBy(F.col("count").desc(), "w").limit(1).collect()
    return d.filter(F.size("v") == (widths[0]["w"] if widths else 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten(), np.float64) for c in column.chunks]) if column.num_chunks else np.zeros(0)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def first_of_each(ids: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` places of ``order`` whose ids differ."""
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest(vectors: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, candidates: int = CANDIDATES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of the rows that ``query_filter`` (a condition on ``id``) names."""
    d = usable(vectors, id_col, vec_col).distinct()
    h = F.xxhash64("v", F.lit(7)).alias("h")
    least = d.select(h).distinct().orderBy("h").limit(pivots)
    chosen = d.select(h, "v").join(F.broadcast(least), "h").groupBy("h").agg(F.first("v").alias("v")).orderBy("h").collect()  # PIVOTS rows
    anchors = unit(np.array([r["v"] for r in chosen])) if chosen else np.zeros((1, 1))
    m = min(prefix, len(anchors))

    @released
    def permute(batches):
        for b in batches:
            x = matrix(pa.chunked_array([b.column(1)]), b.num_rows)
            near = unit(x) @ anchors.T
            top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < near.shape[1] else np.tile(np.arange(m), (len(x), 1))
            order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
            perm = np.take_along_axis(top, order, 1).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in perm], pa.binary())], names=["id", "v", "perm"])

    # Of the copies of one vector, the k + 1 smallest ids: no query can have another among its k nearest, as ties go to smaller ids.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    once = d.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("id", "v")
    form = "id long, v array<double>, perm binary"
    indexed = saved(once.mapInArrow(permute, form), "permutations")
    queries = saved(d.filter(query_filter).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(permute, form), "questions")
    n, q = indexed.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // QUERY_ROWS))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stored = indexed.select("*", shard.cast("int").alias("s"), each(blocks).alias("b"), F.lit(False).alias("asks"))
    asked = queries.select("*", each(shards).alias("s"), block.cast("int").alias("b"), F.lit(True).alias("asks"))
    both = stored.unionByName(asked).withColumn("cell", (F.col("s") * blocks + F.col("b")).cast("long"))

    @released
    def search(t: pa.Table) -> pa.Table:
        asks = np.asarray(t.column("asks"), bool)
        ids, x = np.asarray(t.column("id"), np.int64), matrix(t.column("v"), t.num_rows)
        perm = np.frombuffer(b"".join(t.column("perm").to_pylist()), np.uint16).reshape(t.num_rows, m)
        own = np.flatnonzero(~asks)
        own = own[np.argsort(ids[own], kind="stable")]
        ids_x, data, px = ids[own], unit(x[own]) if len(own) else x[:0], perm[own]
        size = len(own)
        flat = px.ravel()
        by = np.argsort(flat, kind="stable")
        post, at = (by // m).astype(np.int32), (by % m).astype(np.int32)
        heads = np.searchsorted(flat[by], np.arange(len(anchors) + 1))
        del flat, by
        out = ([], [], [])
        for r in np.flatnonzero(asks) if size else []:
            lists = [(heads[p], heads[p + 1], i) for i, p in enumerate(perm[r].tolist())]
            who = np.concatenate([post[a:b] for a, b, _ in lists])
            gain = np.concatenate([(m - i) + (m - at[a:b]) - np.abs(at[a:b] - i) for a, b, i in lists])
            score = np.bincount(who, gain, size).astype(np.int64) * size - np.arange(size)  # ties: smaller id
            c = min(size, candidates + 1)
            found = np.argpartition(-score, c - 1)[:c] if c < size else np.arange(size)
            found = found[ids_x[found] != ids[r]]
            q = unit(x[r : r + 1])[0]
            cosine = (data[found] * q).sum(axis=1)
            best = first_of_each(ids_x[found], np.lexsort((ids_x[found], -cosine)), k)
            out[0].extend([int(ids[r])] * len(best))
            out[1].extend(ids_x[found[best]].tolist())
            out[2].extend(cosine[best].tolist())
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    hits = both.groupBy("cell").applyInArrow(search, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may stand for several vectors
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
