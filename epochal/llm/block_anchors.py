"""Substring dedup by fixed-block anchors, on words.

Every document's words are cut into non-overlapping reference blocks of
``ANCHOR`` words, which are indexed. Every rolling window of ``ANCHOR`` words
of every document probes the index. As ``LENGTH >= 2 * ANCHOR - 1``, a repeated
window of ``LENGTH`` words holds a whole reference block in each of its places,
so each of its places holds a hit. Hits are extended to windows of ``LENGTH``
words; those that occur twice or more are the exact repeats, and runs of them
the maximal ones. Probes carry 32 bits besides the bucket, so a false hit costs
only work. Windows are compared by 96 bits of two independent hashes besides the
bucket, each a tree over the words' 64-bit hashes, which are multilinear: no two
words or windows agree by their structure.

A word counts as removed when any window over it occurs elsewhere, in the same
document or another. Null text has no words. Null ids and repeated rows are
documents of their own. Texts with fewer words than a window keep all. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import MESSAGE, as_blocks, bucket_count, deal, gather, in_sorted, messages, same_as_previous
from .common import Hashes, released
from .words import Words

LENGTH = 35
ANCHOR = 18
_ANCHORS, _ONE, _TWO = Hashes(0xC2B2AE3D27D4EB4F), Hashes(0x165667B19E3779F9), Hashes(0xD6E8FEB86659FD93)


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a probe, in one number."""
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per document: id, n_words, n_removed, n_spans (runs of removed words), kept_sha256 of the kept words joined by spaces."""
    if length < 2 * anchor - 1:
        raise ValueError("a window must hold a whole reference block wherever it starts")
    blocks, _ = as_blocks(docs, id_col, text_col, together=False)
    buckets = bucket_count(docs, 1.0)

    @released
    def probe(t: pa.Table) -> pa.Table:
        w = Words(t.column("text"))
        h, at = w.windows(anchor, _ANCHORS), np.flatnonzero(w.inside(anchor))
        key, ref = _key(h[at], buckets), (at - w.first[w.row[at]]) % anchor == 0
        by = np.argsort(key, kind="stable")
        key, ref = key[by], ref[by]
        new = ~same_as_previous(key)
        heads = np.flatnonzero(new)
        if not len(heads):
            return messages([])
        is_ref = np.add.reduceat(ref.astype(np.int64), heads) > 0
        many = np.diff(np.r_[heads, len(key)]) > 1
        key = key[heads]
        return messages(deal((key >> np.uint64(32)).astype(np.int32), t.column("blk")[0].as_py(), 0, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), is_ref.astype(np.uint8) | (many.astype(np.uint8) << 1)))

    @released
    def match(t: pa.Table) -> pa.Table:
        (key, flags), src = gather(t, 0, np.uint32, np.uint8)
        by = np.argsort(key, kind="stable")
        s = key[by]
        heads = np.flatnonzero(~same_as_previous(s))
        if not len(heads):
            return messages([])
        size = np.diff(np.r_[heads, len(s)])
        f = np.bitwise_or.reduceat(flags[by], heads)
        hit = ((f & 1) > 0) & ((size > 1) | ((f & 2) > 0))
        hit = np.repeat(hit, size)
        b = t.column("dst")[0].as_py()
        return messages(deal(src[by][hit], b, 1, s[hit]))

    @released
    def extend(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows or not m.num_rows:
            return messages([])
        (low,), b = gather(m, 1, np.uint32)
        hits = np.sort((b.astype(np.uint64) << np.uint64(32)) | low)
        w = Words(t.column("text"))
        h = w.windows(anchor, _ANCHORS)
        live = np.r_[0, np.cumsum(w.inside(anchor) & in_sorted(_key(h, buckets), hits))]
        at = np.flatnonzero(w.inside(length))
        at = at[live[at + length - anchor + 1] > live[at]]
        if not len(at):
            return messages([])
        one, two, bucket = prints(w, at)
        by = np.lexsort((two, one))
        one, two, bucket = one[by], two[by], bucket[by]
        heads = np.flatnonzero(~same_as_previous(one, two))
        many = np.diff(np.r_[heads, len(one)]) > 1
        return messages(deal(bucket[heads], t.column("blk")[0].as_py(), 2, one[heads], two[heads], many.astype(np.uint8)))

    def prints(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """96 bits of each window from ``at``, and its bucket."""
        two = w.windows(length, _TWO)[at]
        return w.windows(length, _ONE)[at], two.astype(np.uint32), ((two >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)

    @released
    def decide(t: pa.Table) -> pa.Table:
        (one, two, many), src = gather(t, 2, np.uint64, np.uint32, np.uint8)
        by = np.lexsort((two, one))
        x, y = one[by], two[by]
        heads = np.flatnonzero(~same_as_previous(x, y))
        if not len(heads):
            return messages([])
        size = np.diff(np.r_[heads, len(x)])
        hit = np.repeat((size > 1) | (np.maximum.reduceat(many[by], heads) > 0), size)
        return messages(deal(src[by][hit], t.column("dst")[0].as_py(), 3, x[hit], y[hit]))

    @released
    def remove(t: pa.Table, m: pa.Table) -> pa.Table:
        w = Words(t.column("text"))
        gone = np.zeros(len(w.start) + 1, np.int64)
        if m.num_rows:
            (one, two), bucket = gather(m, 3, np.uint64, np.uint32)
            at = np.flatnonzero(w.inside(length) & in_sorted(w.windows(length, _ONE), np.sort(one)))
            mine, also, where = prints(w, at)
            # Repeats and the block's windows in one order; a window takes part when a repeat is equal to it.
            x, y, z = np.r_[one, mine], np.r_[two, also], np.r_[bucket, where]
            told = np.arange(len(x)) < len(one)
            by = np.lexsort((~told, z, y, x))
            group = np.cumsum(~same_as_previous(x[by], y[by], z[by])) - 1
            found = told[by][np.flatnonzero(np.r_[True, group[1:] != group[:-1]])][group] if len(group) else told
            hit = by[found & ~told[by]] - len(one)
            np.add.at(gone, at[hit], 1)
            np.add.at(gone, at[hit] + length, -1)
        gone = np.cumsum(gone)[:-1] > 0
        n_words, n_removed, spans, shas = [], [], [], []
        data = w.data.tobytes()
        for r in range(t.num_rows):
            a, z = int(w.first[r]), int(w.first[r + 1])
            g = gone[a:z]
            ws = data[w.off[r] : w.off[r + 1]].split()
            k = int(g.sum())
            if k:
                ws = [x for x, y in zip(ws, g.tolist()) if not y]
            n_words.append(z - a)
            n_removed.append(k)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
            shas.append(hashlib.sha256(b" ".join(ws)).hexdigest())
        return pa.Table.from_arrays([t.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=[id_col, "n_words", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[id_col]
    out = f"`{id_col}` {kind}, n_words long, n_removed long, n_spans long, kept_sha256 string"
    hits = blocks.groupBy("blk").applyInArrow(probe, MESSAGE).groupBy("dst").applyInArrow(match, MESSAGE)
    windows = blocks.groupBy("blk").cogroup(hits.groupBy("dst")).applyInArrow(extend, MESSAGE)
    repeats = windows.groupBy("dst").applyInArrow(decide, MESSAGE)
    return blocks.groupBy("blk").cogroup(repeats.groupBy("dst")).applyInArrow(remove, out)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(list_aggregate(list_slice(ws, i, i + 34), 'string_agg', ' ')) AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(generate_series(0, 34)) AS k)),
e AS (SELECT doc_id, ws[i] AS x, i FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w)),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.p = e.i WHERE c.p IS NULL GROUP BY e.doc_id),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS DISTINCT FROM p - 1 AS first FROM c) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
"""
