"""Substring dedup by prefix-free parsing, on bytes.

A rolling hash over grams of ``GRAM`` bytes sets the triggers: a gram is a
trigger when its hash is the least (the leftmost of equal ones) of ``REACH``
successive grams. So a trigger depends on nearby bytes only, and equal texts are
cut alike wherever they stand. Every window of ``LENGTH`` bytes belongs to the
trigger of its first ``REACH`` grams. The windows of one trigger form a phrase:
the bytes from its first window's start to its last window's end. Phrases
overlap, and none is a proper prefix of another with the same windows.

1. Parse: each block cuts its texts into phrases and keeps the first place of
   each distinct phrase (the dictionary); other places are repeats already.
2. The parses of all blocks meet in buckets and are sorted by the bytes that any
   window of a phrase holds (the context after its trigger), then by phrase, then
   by place in the corpus (document id, offset). This is the parse's suffix order
   to a depth of one phrase, which is enough: a window lies in one phrase. Within
   a run of equal phrases all but the first place are repeats. A context with one
   distinct phrase needs no more: none of its windows occurs elsewhere.
3. Each block sorts the suffixes of its dictionary's phrases that share a context
   with others, by prefix doubling to a depth of ``LENGTH`` bytes. A class of
   equal windows is a run of the suffix array; the parse's first places give it
   in corpus order: the first stays, the others are repeats.
4. The blocks' orders are merged: of each class its first place goes to a bucket
   chosen by the window's bytes, and the classes that several blocks hold keep
   their first place there.

Suffixes are compared to a depth of ``LENGTH`` bytes only, which is all that
dedup asks for; a longer order would give the same removals. A window or phrase
that is everywhere costs one entry a block, and a context that very many phrases
share is dealt out by their windows, so no task holds all of either. Between
blocks, phrases and windows are told by fingerprints of 64 bits besides those of
bucket and context, which come from other hashes; within a block windows are
compared by their bytes.

A byte is removed when some window of ``LENGTH`` bytes over it also starts
earlier: in a document with a smaller id, or further left in its own. Null text
is empty; null ids come after all others, ordered by text; repeated rows with
one id are ordered by text. Texts shorter than a window stay whole; a text is
never cut, and a task holds some ten 8-byte numbers for each byte of its longest.
Ids must be whole numbers. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import MESSAGE, as_blocks, bucket_count, deal, gather, messages, passed_on, raw, same_as_previous
from .common import Hashes, mix, released

LENGTH = 100
GRAM = 16
REACH = 64
#: Bytes of text in a block; a task holds some ten 8-byte numbers a byte.
BLOCK = 5 << 19
_GRAMS, _ONE, _TWO = Hashes(0x9E3779B97F4A7C15), Hashes(0xD6E8FEB86659FD93), Hashes(0xA0761D6478BD642F)
_DEALT, _COVERED, _DETAIL, _WINDOW = 0, 1, 2, 3
_PLACE = (np.int64, np.uint32, np.uint32)  # order of the document, start, end


class Octets:
    """Hashes of byte strings of eight bytes or more, from the mixed values of all eight successive bytes."""

    def __init__(self, data: np.ndarray):
        key = data.astype(np.uint64) if len(data) >= 8 else np.zeros(0, np.uint64)
        for wide in (1, 2, 4):
            key = (key[:-wide] << np.uint64(8 * wide)) | key[wide:]
        self.mixed = mix(key ^ np.uint64(0x5851F42D4C957F2D))

    def spans(self, hashes: Hashes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes from ``start``."""
        h = size.astype(np.uint64) * hashes.table[-1] + self.mixed[start + size - 8] * (hashes.table[-2] | np.uint64(1))
        wide = int(size.max()) if len(size) else 0
        for k, r in enumerate(hashes.places(wide // 8)):
            longer = np.flatnonzero(size > 8 * k + 8)
            if len(longer) == len(h):
                h += self.mixed[start + 8 * k] * (r | np.uint64(1))
            else:
                h[longer] += self.mixed[start[longer] + 8 * k] * (r | np.uint64(1))
        return mix(h)

    def windows(self, hashes: Hashes, length: int) -> np.ndarray:
        """Hashes of all windows of ``length`` bytes, by start."""
        m = max(0, len(self.mixed) + 8 - length)
        h = np.zeros(m, np.uint64)
        for k, r in zip([*range(0, length - 8, 8), length - 8], hashes.table):
            h += self.mixed[k : k + m] * (r | np.uint64(1))
        return mix(h)


class Text:
    """The texts of a block, in order of document and text."""

    def __init__(self, t: pa.Table, length: int):
        order = np.asarray(t.column("ord"), np.int64)
        texts = t.column("text")
        by = np.argsort(order, kind="stable")
        if len(order) > 1 and (order[by][1:] == order[by][:-1]).any():
            s = texts.to_pylist()
            by = np.array(sorted(range(len(order)), key=lambda i: (order[i], s[i] is not None, s[i] or "")))
        self.table = t.take(pa.array(by))
        self.order = order[by]
        self.data, self.off = raw(self.table.column("text"))
        self.row_starts = np.flatnonzero(np.r_[True, self.order[1:] != self.order[:-1]]) if len(self.order) else np.zeros(0, int)
        # Rows with the same id count as one text when places are named, so that a place is unique.
        self.base = self.off[self.row_starts]
        self.length = length

    def base_of(self, order: np.ndarray) -> np.ndarray:
        return self.base[np.searchsorted(self.order[self.row_starts], order)]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order key and offset under it, of places in the block's bytes."""
        row = np.searchsorted(self.base, at, "right") - 1
        return self.order[self.row_starts][row], at - self.base[row]

    def starts(self) -> np.ndarray:
        """Starts of all windows that lie in one text."""
        n = len(self.data)
        ok = np.zeros(n + 1, np.int8)
        size = np.diff(self.off)
        long = size >= self.length
        np.add.at(ok, self.off[:-1][long], 1)
        np.add.at(ok, self.off[1:][long] - self.length + 1, -1)
        return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def phrases(x: Text, gram: int = GRAM, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, context hash, phrase hash and bucket hash of each phrase of a block."""
    at = x.starts()
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    octets = Octets(x.data)
    g = octets.windows(_GRAMS, gram)
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    step, have = 1, 1
    while have < reach:  # minima of 2, 4, ... successive grams
        step = min(have, reach - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    trigger = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, trigger[1:] != trigger[:-1]]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(at)] - 1
    start, end, t = at[heads], at[tails] + x.length, trigger[heads]
    common = np.full(len(t), x.length - reach + 1)
    context, bucket = octets.spans(_ONE, t, common), octets.spans(_TWO, t, common)
    phrase = octets.spans(_TWO, start, end - start)
    return start, end, context, phrase, bucket


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places of the suffixes at ``starts`` in the order of their first ``length`` bytes, equal ones alike, by prefix doubling."""
    wide = min(8, length)
    key = np.zeros(max(0, len(data) - wide + 1), np.uint64)
    for k in range(wide):
        key = (key << np.uint64(8)) | data[k : k + len(key)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while 2 * wide <= length:
        n = max(0, len(data) - 2 * wide + 1)
        rank = np.unique(rank[:n] * np.uint64(len(rank) + 1) + rank[wide : wide + n], return_inverse=True)[1].astype(np.uint64)
        wide *= 2
    return np.unique(rank[starts] * np.uint64(len(rank) + 1) + rank[starts + length - wide], return_inverse=True)[1]


def _strings(x: Text, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all given places, one after another."""
    return x.data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left)."""
    if gram + reach - 1 > length:
        raise ValueError("a window must hold the grams that choose its trigger")
    if gram < 8:
        raise ValueError("a gram has eight bytes at least")
    blocks, _ = as_blocks(docs, id_col, text_col, BLOCK)
    buckets = bucket_count(docs, 1.0)

    @released
    def parse(t: pa.Table) -> pa.Table:
        x, me = Text(t, length), t.column("blk")[0].as_py()
        start, end, context, phrase, bucket = phrases(x, gram, reach)
        order, off = x.place(start)
        by = np.lexsort((start, phrase, context))
        again = np.zeros(len(by), bool)
        again[by] = same_as_previous(context[by], phrase[by])
        first = ~again
        size = (end - start).astype(np.uint32)
        out = deal((bucket[first] % np.uint64(buckets)).astype(np.int32), me, _DEALT, (context[first] >> np.uint64(32)).astype(np.uint32), phrase[first], order[first], off[first].astype(np.uint32), size[first])
        if again.any():
            out += deal(np.full(int(again.sum()), me % buckets, np.int32), me, _COVERED, order[again], off[again].astype(np.uint32), size[again])
        return messages(out)

    @released
    def compare(t: pa.Table) -> pa.Table:
        (context, phrase, order, off, size), src = gather(t, _DEALT, np.uint32, np.uint64, np.int64, np.uint32, np.uint32)
        by = np.lexsort((phrase, context))
        c, p = context[by], phrase[by]
        same = same_as_previous(c, p)
        heads = np.flatnonzero(~same)
        covered, detail = np.zeros(len(by), bool), np.zeros(len(by), bool)
        if len(heads):
            n = np.diff(np.r_[heads, len(by)])
            first = heads.copy()
            runs = np.flatnonzero(n > 1)  # equal phrases of several blocks: the first place
            if len(runs):
                inside = np.repeat(n > 1, n)
                i = np.flatnonzero(inside)
                group = np.repeat(np.arange(len(heads)), n)[i]
                j = np.lexsort((off[by[i]], order[by[i]], group))
                lead = np.flatnonzero(~same_as_previous(group[j]))
                first[runs] = i[j[lead]]
            covered[by] = True
            covered[by[first]] = False
            of = np.cumsum(~same_as_previous(c[heads])) - 1
            distinct = np.bincount(of)[of]
            detail[by[first[distinct > 1]]] = True
        me = t.column("dst")[0].as_py()
        out = deal(src[covered], me, _COVERED, order[covered], off[covered], size[covered])
        out += deal(src[detail], me, _DETAIL, order[detail], off[detail], size[detail])
        return messages(out + passed_on(t, _COVERED))

    @released
    def expand(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows or not m.num_rows:
            return messages([])
        me = t.column("blk")[0].as_py()
        out = [(me % buckets, me, k, d) for _, _, k, d in passed_on(m, _COVERED)]
        (order, off, size), _ = gather(m, _DETAIL, *_PLACE)
        if not len(order):
            return messages(out)
        x = Text(t, length)
        start, size = x.base_of(order) + off.astype(np.int64), size.astype(np.int64)
        by = np.argsort(start)
        start, size = start[by], size[by]
        # The dictionary's phrases, one after another, and the windows in them.
        text, n = _strings(x, start, size), size - length + 1
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rank = suffix_ranks(text, np.repeat(np.cumsum(size) - size, n) + step, length)
        at = np.repeat(start, n) + step
        del text, step
        by = np.lexsort((at, rank))  # the suffix array, its runs of equal windows in corpus order
        lead = ~same_as_previous(rank[by])
        first, again = np.sort(at[by[lead]]), np.sort(at[by[~lead]])
        del rank, at, by
        order, off = x.place(again)
        out += deal(np.full(len(again), me % buckets, np.int32), me, _COVERED, order, off.astype(np.uint32), np.full(len(again), length, np.uint32))
        octets, size = Octets(x.data), np.full(len(first), length)
        h, b = octets.spans(_ONE, first, size), (octets.spans(_TWO, first, size) % np.uint64(buckets)).astype(np.int32)
        order, off = x.place(first)
        return messages(out + deal(b, me, _WINDOW, h, order, off.astype(np.uint32)))

    @released
    def decide(t: pa.Table) -> pa.Table:
        me, out = t.column("dst")[0].as_py(), passed_on(t, _COVERED)
        (h, order, off), src = gather(t, _WINDOW, np.uint64, np.int64, np.uint32)
        by = np.argsort(h, kind="stable")
        i = same_as_previous(h[by])
        i[:-1] |= i[1:]
        i = by[i]
        j = i[np.lexsort((off[i], order[i], h[i]))]
        again = np.sort(j[same_as_previous(h[j])])  # all places of a window but the first
        return messages(out + deal(src[again], me, _COVERED, order[again], off[again], np.full(len(again), length, np.uint32)))

    @released
    def remove(t: pa.Table, m: pa.Table) -> pa.Table:
        x = Text(t, length)
        gone = np.zeros(len(x.data) + 1, np.int32)
        if m.num_rows:
            (order, off, size), _ = gather(m, _COVERED, *_PLACE)
            at = x.base_of(order) + off.astype(np.int64)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + size.astype(np.int64), -1)
        gone = np.cumsum(gone)[:-1] > 0
        n_bytes, n_removed, spans, shas = [], [], [], []
        for a, z in zip(x.off[:-1].tolist(), x.off[1:].tolist()):
            g, d = gone[a:z], x.data[a:z]
            k = int(g.sum())
            n_bytes.append(z - a)
            n_removed.append(k)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
            shas.append(hashlib.sha256(d[~g] if k else d).hexdigest())
        return pa.Table.from_arrays([x.table.column("id").combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[id_col]
    out = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = blocks.groupBy("blk").applyInArrow(parse, MESSAGE).groupBy("dst").applyInArrow(compare, MESSAGE)
    windows = blocks.groupBy("blk").cogroup(found.groupBy("dst")).applyInArrow(expand, MESSAGE)
    repeats = windows.groupBy("dst").applyInArrow(decide, MESSAGE)
    return blocks.groupBy("blk").cogroup(repeats.groupBy("dst")).applyInArrow(remove, out)


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS gram FROM (SELECT doc_id, x, unnest(generate_series(1, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS z FROM s GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM u),
p AS (SELECT d.doc_id, string_agg(substr(x, CAST(2 * y + 1 AS BIGINT), CAST(2 * (a - 1 - y) AS BIGINT)), '' ORDER BY a) AS kept, max(z) AS z, CAST(sum(z - a + 1) AS BIGINT) AS n, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE kept || substr(x, CAST(2 * z + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""
