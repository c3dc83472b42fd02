"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct 3-word shingles. Sizes fall into bands so
that linked documents lie in the same band or the next; a joint band is two
successive ones. Within a joint band, linked sets differ in ``d`` shingles at
most, ``d`` the total size over 19 for a similarity of 0.9. The sketch of a set
has ``k`` chunks: every shingle is dealt to a chunk by hash and XORs its own 64
random bits into it. Two sketches differ in no more chunks than the sets differ
in shingles, so of ``k = d + 1 + s`` chunks at least ``s + 1`` are equal
(pigeonhole). A set leaves out chunks of fewer than ``m`` shingles if those are
``s`` at most; an equal chunk is left out by both or none, so one equal chunk
remains. Equal chunks make candidates.

Sets that are equal form a class and take part once. Equal chunks make a star
from the least class, not all pairs: first within a task, so that a chunk that
is everywhere costs one entry a task, then in the chunk's bucket. The stars'
components are the candidate groups. Passages that many documents share can make
them large, so they are thinned before any text is moved: every set has a parity sketch of about
two bits a shingle (``SKETCH_BITS`` at most), a pair of sets whose sketches'
Hamming distance exceeds the difference that linked sets may have is out, as the
distance is a lower bound of the symmetric difference, and the components of the
remaining pairs are the groups to verify, with the sets' hashes, from texts that a
filter of bits picks out before they are joined: pair by pair, or by products of blocks of the group's incidence matrix. Groups of more classes
than ``THIN`` or ``CHUNK`` are thinned and verified in pairs of hash parts of
that size, each a group of its own, so no group must fit in one task. A verified
part gives its components as stars and each class's number of links.

Documents without words have an empty set, no links, and their own component;
null text likewise. Repeated rows are copies of each other. A null id belongs to
a component but never names it unless all its ids are null. Extra columns are
ignored. Texts may be of any length. Words and shingles are compared by 64-bit
hashes without common structure, sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, bucket_count, deal, gather, in_sorted, messages, pack, same_as_previous
from .common import Hashes, discard, mix, released, saved, shuffle_partitions, slices
from .words import Words
from ..operators.components import components

SHINGLE = 3
NUMERATOR, DENOMINATOR = 90, 100
CHUNK = 256
THIN = 2048
#: Classes on each side of one product of sketches.
SQUARE = 512
SKETCH_BITS = 4096
#: Differences a spare group of ``sparse_sketch``.
SPARE = 8
#: Chunks that a task gathers before it reduces them to stars.
POSTS = 1 << 19
#: Bytes of text whose shingles are worked on at once.
STEP = 1 << 19
_SEQUENCE = Hashes(0xE7037ED1A0B428DB)


def band_edges(limit: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    """Least sizes of the bands, past ``limit``."""
    t = [1]
    while t[-1] <= limit:
        t.append(max(t[-1] + 1, t[-1] * den // num + 1))
    t += [max(t[-1] + 1, t[-1] * den // num + 1)]
    t += [max(t[-1] + 1, t[-1] * den // num + 1)]
    return np.array(t, np.int64)


def shingle_sets(column: pa.ChunkedArray | pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' distinct shingles: row and hash, sorted by both, and the set sizes."""
    w = Words(column, lower=True)
    rows = len(w.off) - 1
    h, at = w.windows(n, _SEQUENCE), np.flatnonzero(w.inside(n))
    row, h = w.row[at], h[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = _SEQUENCE.sequences(w.hash, w.first[short], w.first[short + 1])
        row, h = np.r_[row, short.astype(np.int32)], np.r_[h, whole]
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = ~same_as_previous(row, h)
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=rows)


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set, in two numbers (0 for an empty set)."""
    heads = np.flatnonzero(~same_as_previous(row))
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        s = np.zeros(len(size), np.uint64)
        if len(heads):
            s[row[heads]] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), heads) + size[row[heads]].astype(np.uint64))
        out.append(s.view(np.int64))
    return out[0], out[1]


def sketch(row: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every chunk that the rows post, in both of their joint bands."""
    if not len(row):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    edges = band_edges(int(size.max()), num, den)
    band = np.searchsorted(edges, size, "right") - 1
    bits, deal_by = mix(h ^ np.uint64(0x632BE59BD9B4E019)), mix(h ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(33)
    rows, keys = [], []
    for joint in (band, band - 1):
        real = (joint >= 0) & (size > 0)
        j = np.where(real, joint, 0)
        d = 2 * (edges[j + 2] - 1) * (den - num) // (den + num)
        real &= d > 0  # else only equal sets are linked
        s = np.where(d >= 3, 2 + d // 80, 0)
        least = np.where(d >= 3, 2, 1)
        k = np.where(real, d + 1 + s, 0)
        base = np.cumsum(k) - k
        use = real[row]
        slot = base[row[use]] + (deal_by[use] % np.maximum(k[row[use]], 1).astype(np.uint64)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        ordered = slot[by]
        heads = np.flatnonzero(~same_as_previous(ordered))
        total = int(k.sum())
        chunk, count = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        if len(heads):
            chunk[ordered[heads]] = np.bitwise_xor.reduceat(bits[use][by], heads)
        of = np.repeat(np.arange(len(k)), k)
        small = count < least[of]
        few = np.bincount(of[small], minlength=len(k)) <= s
        post = ~(small & few[of])
        number = np.arange(total) - base[of]
        key = mix(chunk + mix((j[of].astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)))
        rows.append(of[post])
        keys.append(key[post])
    return np.concatenate(rows), np.concatenate(keys)


def sparse_sketch(row: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``sketch``, for similarities below 0.9, where plain chunks would hold few shingles.

    A band meets itself and each band that its sets can be linked with on their
    own, with that pair's ``d``. Shingles are dealt to ``g = d // 2 + 1 + t`` groups
    of three pieces, and a chunk is two pieces of a group, so it holds twice the
    shingles of one of ``d + 1`` chunks. With ``x`` groups of two differences or
    more and ``y`` of one, which keep no and one equal chunk, ``3g - 3x - 2y`` of
    the ``3g`` chunks are equal, and that is ``2g - d`` at least, as ``2x + y <=
    d`` and ``x + y <= g``; ``s`` is that less one. A set leaves out its smallest
    chunks: those of fewer shingles than its chunk of rank ``s + 1``, so ``s`` at
    most. Of two sets, the one that leaves out larger chunks leaves out every
    equal chunk that the other does, so of ``s + 1`` equal chunks one remains in
    both.
    """
    if not len(row):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    edges = band_edges(int(size.max()), num, den)
    last = edges[1:] - 1
    reach = np.searchsorted(edges, last * den // num, "right") - 1
    band = np.searchsorted(edges, size, "right") - 1
    bits, deal_by = mix(h ^ np.uint64(0x632BE59BD9B4E019)), mix(h ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(33)
    rows, keys = [], []
    widest = int((reach - np.arange(len(reach)))[: int(band.max()) + 1].max())
    for low, gap in [(band - back, x) for x in range(widest + 1) for back in ({0, x})]:
        real = (size > 0) & (low >= 0)
        lo = np.where(real, low, 0)
        hi = lo + gap
        real &= hi <= reach[lo]
        d = (last[lo] + np.minimum(last[np.minimum(hi, len(last) - 1)], last[lo] * den // num)) * (den - num) // (den + num)
        real &= d > 0  # else only equal sets are linked
        g = d // 2 + 1 - (-d // SPARE)
        s = 2 * g - d - 1
        k = np.where(real, 3 * g, 0)
        base = np.cumsum(k) - k
        total = int(k.sum())
        if not total:
            continue
        use = real[row]
        slot = base[row[use]] + (deal_by[use] % np.maximum(k[row[use]], 1).astype(np.uint64)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        ordered = slot[by]
        heads = np.flatnonzero(~same_as_previous(ordered))
        piece, count = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        piece[ordered[heads]] = np.bitwise_xor.reduceat(bits[use][by], heads)
        two = lambda x, f: f(x.reshape(-1, 3), np.roll(x.reshape(-1, 3), -1, axis=1)).ravel()
        chunk, count = two(piece, np.bitwise_xor), two(count, np.add)
        of = np.repeat(np.arange(len(k)), k)
        ranked = count[np.lexsort((count, of))]
        least = ranked[np.minimum(base + s, total - 1)]
        post = count >= least[of]
        place = (lo[of].astype(np.uint64) << np.uint64(40)) | np.uint64(gap << 32) | (np.arange(total) - base[of]).astype(np.uint64)
        rows.append(of[post])
        keys.append(mix(chunk + mix(place))[post])
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.uint64))


def pack_posts(key: np.ndarray, s: np.ndarray) -> bytes:
    """A message of chunks: 40 bits of each key, and the sets in runs, the heads marked by bits.

    Besides the bucket, 40 bits tell keys apart: a chance hit costs only work.
    """
    head = ~same_as_previous(s)
    return pack(np.array([len(key)], np.uint32), (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(24)).astype(np.uint8), np.packbits(head), s[head])


def post_keys(data) -> np.ndarray:
    """The keys of a message of chunks."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return (np.frombuffer(data, np.uint32, n, 4).astype(np.uint64) << np.uint64(8)) | np.frombuffer(data, np.uint8, n, 4 + 4 * n)


def post_sets(data, some: np.ndarray) -> np.ndarray:
    """The sets of some places of a message of chunks."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    bits = -(-n // 8)
    run = np.cumsum(np.unpackbits(np.frombuffer(data, np.uint8, bits, 4 + 5 * n), count=n), dtype=np.int32) - 1
    return np.frombuffer(data, np.int64, -1, 4 + 5 * n + bits)[run[some]]


def reduce_posts(key: np.ndarray, s: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Messages of chunks ``key`` of sets ``s``: each chunk's least set goes to the chunk's bucket, the others hang on it at once."""
    by = np.lexsort((s, key))
    again, ordered = same_as_previous(key[by]), s[by]
    to = ordered[np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))]
    edge = to != ordered
    pairs = np.unique(np.stack([to[edge], ordered[edge]]), axis=1) if edge.any() else np.zeros((2, 0), np.int64)
    del to, edge, ordered
    first = np.sort(by[~again])  # in the order of sets, so that a set's chunks are a run
    del by, again
    dst = (mix(key[first]) % np.uint64(buckets)).astype(np.int32)
    at = np.argsort(dst, kind="stable")
    dst, first = dst[at], first[at]
    cuts = np.flatnonzero(np.r_[~same_as_previous(dst), True])
    out = [(int(dst[a]), 0, 0, pack_posts(key[first[a:b]], s[first[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
    return out + deal((mix(pairs[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), 0, 1, pairs[0], pairs[1])


def meet(t: pa.Table) -> pa.Table:
    """A bucket's stars: each chunk's least set and every other one. Sets are read for the chunks of two messages or more only, few of all."""
    posts = [x.as_buffer() for k, x in zip(t.column("kind").to_pylist(), t.column("data")) if k == 0]
    key = np.concatenate([np.zeros(0, np.uint64), *map(post_keys, posts)])
    key.sort()
    twice = np.unique(key[same_as_previous(key)])
    del key
    keys, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for x in posts if len(twice) else ():
        k = post_keys(x)
        some = np.flatnonzero(in_sorted(k, twice))
        if len(some):
            keys.append(k[some])
            sets.append(post_sets(x, some))
    key, c = np.concatenate(keys), np.concatenate(sets)
    by = np.lexsort((c, key))
    key, c = key[by], c[by]
    again = same_as_previous(key)
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(key)))) if len(key) else np.zeros(0, int)
    edge = again & (c[lead] != c)
    (a, b), _ = gather(t, 1, np.int64, np.int64)
    pairs = np.unique(np.stack([np.r_[c[lead][edge], a], np.r_[c[edge], b]]), axis=1)
    return pa.Table.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])


def parity_sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray, bits: int = SKETCH_BITS) -> pa.Array:
    """A row's sketch: bit ``b`` is the parity of its shingles that hash to ``b``; twice as many bits as shingles, a power of two."""
    wide = np.minimum(bits, np.exp2(np.ceil(np.log2(np.maximum(2 * size, 128)))).astype(np.int64))
    ends = np.r_[0, np.cumsum(wide)]
    place = ends[row] + (mix(h ^ np.uint64(0x3C79AC492BA7B653)) % wide[row].astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(place, minlength=int(ends[-1])) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(data)])


def near_pairs(size: np.ndarray, sketches: list, left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)`` of sets that may be linked by size and by their sketches' distance; ``left`` as in ``links_of``.

    Of sketches of two widths the wider is folded: the parities of the places
    that agree modulo the narrower width are added up.
    """
    width = np.array([8 * len(x) for x in sketches])
    out = []
    for bits in np.unique(width).tolist():
        most = int(size[width == bits].max())
        use = np.flatnonzero((width >= bits) & (size * num <= most * den))
        m = np.empty((len(use), bits), np.float32)
        for k, i in enumerate(use.tolist()):
            x = np.unpackbits(np.frombuffer(sketches[i], np.uint8)).reshape(-1, bits)
            m[k] = x[0] if len(x) == 1 else np.bitwise_xor.reduce(x, axis=0)
        cut = int((use < left).sum()) if left else len(use)
        a, b = (slice(0, cut), slice(cut, None)) if left else (slice(None), slice(None))
        ones, n, w = m.sum(axis=1), size[use], width[use]
        distance = ones[a][:, None] + ones[b][None, :] - 2 * (m[a] @ m[b].T)
        ok = distance * (den + num) <= (den - num) * (n[a][:, None] + n[b][None, :])
        ok &= np.minimum(w[a][:, None], w[b][None, :]) == bits
        ok &= np.minimum(n[a][:, None], n[b][None, :]) * den >= np.maximum(n[a][:, None], n[b][None, :]) * num
        i, j = np.nonzero(ok)
        i, j = use[a][i], use[b][j]
        out.append((i, j) if left else (i[i < j], j[i < j]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def united(ids: np.ndarray, links: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The links of ``stars`` over all of ``links`` among ``ids``."""
    by = np.argsort(ids, kind="stable")
    i, j = (by[np.searchsorted(ids, np.array([v for x in links for v in x[k]], np.int64), sorter=by)] for k in (0, 1))
    return stars(ids, i, j)


def squares(g: int, left: int, side: int = SQUARE):
    """The pairs of ``near_pairs`` in blocks of ``side`` places: the places of a block's two sides, and how many are of its first (0: there is one only)."""
    blocks = lambda lo, hi: [np.arange(x, min(x + side, hi)) for x in range(lo, hi, side)]
    if left:
        yield from ((np.r_[a, b], len(a)) for a in blocks(0, left) for b in blocks(left, g))
        return
    every = blocks(0, g)
    for k, a in enumerate(every):
        yield a, 0
        yield from ((np.r_[a, b], len(a)) for b in every[k + 1 :])


def links_of(sets: list[np.ndarray], left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs ``(i, j)`` among sets: all pairs if ``left`` is 0, else the first ``left`` against the others."""
    size = np.array([len(x) for x in sets], np.int64)
    g = len(sets)
    if g == 2:
        i, j = np.array([0]), np.array([1])
    else:
        row = np.repeat(np.arange(g), size)
        i, j = near_pairs(size, [x.as_buffer() for x in parity_sketches(row, np.concatenate(sets), size)], left, num, den)
    if len(i) <= 2 * g:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
        ok = den * both >= num * (size[i] + size[j] - both)
        return i[ok], j[ok]
    used = np.zeros(g, bool)
    used[i] = used[j] = True
    row = np.repeat(np.arange(g), np.where(used, size, 0))
    col = np.unique(np.concatenate([x for x, y in zip(sets, used) if y]), return_inverse=True)[1]
    n = np.bincount(col)
    keep = n[col] > 1  # a shingle of one set is in no intersection
    row, col = row[keep], np.cumsum(n > 1)[col[keep]] - 1
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    wide = int(col[-1]) + 1 if len(col) else 0
    a, b = (slice(0, left), slice(left, g)) if left else (slice(0, g), slice(0, g))
    both = np.zeros((a.stop - a.start, b.stop - b.start), np.float64)
    step = max(1024, (1 << 22) // max(g, 1))
    for at in range(0, wide, step):
        lo, hi = np.searchsorted(col, (at, at + step))
        m = np.zeros((g, min(step, wide - at)), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        both += m[a] @ m[b].T
    both = both[i, j - left]
    ok = den * both >= num * (size[i] + size[j] - both)
    return i[ok], j[ok]


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """The components of pairs of places ``(i, j)`` as links: each component's least id and every other one."""
    root = list(range(len(ids)))  # by rank of the ids, so that a root is a least id
    by = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by] = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = len(ids) - 1
    for a, b in zip(rank[i].tolist(), rank[j].tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            left -= 1
            if not left:
                break
    ordered = ids[by].tolist()
    links = [(ordered[find(x)], ordered[x]) for x in range(len(ids)) if root[x] != x]
    return [a for a, _ in links], [b for _, b in links]


def by_bucket(posts: DataFrame, buckets: int) -> DataFrame:
    """Each bucket as a partition: by a hash of their numbers, some tasks would get many buckets, and hold and sort them at once."""
    return posts.repartitionById(buckets, "dst")


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose number in ``column`` is among ``ids`` (one column), and one in seventy of the others.

    To be joined with the ids, so that few texts are moved. The ids are told by
    two of 16 to 32 bits an id, in a table of 32 MB at most; with more than 16
    million ids, more other rows remain.
    """
    places = lambda c, bits: F.array(*[F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in (5, 6)])
    bits = 1 << min(28, max(10, (16 * ids.count()).bit_length()))
    p = ids.select(F.explode(places(F.col(ids.columns[0]), bits)).alias("p"))
    marks = p.groupBy(F.shiftright("p", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS int))")).alias("mark")).toArrow()
    table = np.zeros(bits >> 5, np.uint32)
    table[np.asarray(marks.column("word"))] = np.asarray(marks.column("mark"), np.int64).astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @released
    def pick(batches):
        for b in batches:
            at = np.asarray(b.column(b.num_columns - 1).flatten(), np.int64).reshape(-1, 2)
            found = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
            yield from pa.Table.from_batches([b]).filter(pa.array(found.all(axis=1))).drop_columns([b.schema.names[-1]]).to_batches()

    return rows.withColumn("__places", places(F.col(column), bits)).mapInArrow(pick, rows.schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUMERATOR, den: int = DENOMINATOR, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """Per document: id, n_shingles, component_id (least id reachable by links), n_links."""
    spark = docs.sparkSession
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), late).alias("ord"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    dense = 10 * num >= 9 * den
    chunks_of = sketch if dense else sparse_sketch
    buckets = bucket_count(docs, 0.7 if dense else 1.4)

    @released
    def describe(batches):
        for t in (x for b in batches for x in slices(b, "text", STEP)):
            row, h, size = shingle_sets(t.column("text"), shingle)
            s1, s2 = signatures(row, h, size)
            yield pa.RecordBatch.from_arrays([t.column("ord"), t.column("id"), pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), parity_sketches(row, h, size)], names=["ord", "id", "n", "s1", "s2", "sketch"])

    @released
    def post(batches):
        """A task's stars: of equal sets one posts its chunks."""
        seen, held, n = set(), [], 0

        def reduced():
            key, s = np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held])
            held.clear()
            return messages(reduce_posts(key, s, buckets)).to_batches()

        for t in (x for b in batches for x in slices(b, "text", STEP)):
            row, h, size = shingle_sets(t.column("text"), shingle)
            s1, s2 = signatures(row, h, size)
            once = np.zeros(len(size), bool)
            for i, s in enumerate(zip(s1.tolist(), s2.tolist())):
                if size[i] and s not in seen:
                    seen.add(s)
                    once[i] = True
            use = once[row]
            r, key = chunks_of(row[use], h[use], np.where(once, size, 0), num, den)
            by = np.argsort(r, kind="stable")
            held.append((key[by], s1[r[by]]))
            n += len(key)
            if n >= POSTS:
                yield from reduced()
                n = 0
        if held:
            yield from reduced()

    described = saved(texts.mapInArrow(describe, f"ord long, id {kind}, n long, s1 long, s2 long, sketch binary"), "sets")
    classes = described.filter("n > 0").groupBy("s1", "s2").agg(F.min("ord").alias("rep"), F.min("id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = saved(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    posts = by_bucket(texts.select("text").mapInArrow(post, MESSAGE), buckets)
    groups = components(posts.groupBy("dst").applyInArrow(released(meet), "a long, b long"), "candidates")

    # Written, as ``least`` below, so that the joins can split a hot group. Sets that agree in 64 bits only are candidates more.
    members = saved(groups.join(classes, groups["v"] == classes["s1"]).select("root", "c", "s1", "s2", "rep", "copies", "n"), "members")
    discard(groups)
    first = members.select(F.col("rep").alias("ord"), "s1", "s2", "c", "root")
    sketches = saved(described.filter("n > 0").select("ord", "s1", "s2", "n", "sketch").join(first, ["ord", "s1", "s2"]).select("c", "root", "n", "sketch"), "sketches")

    @released
    def sets(batches):
        for t in (x for b in batches for x in slices(b, "text", STEP)):
            row, h, size = shingle_sets(t.column("text"), shingle)
            s1, s2 = signatures(row, h, size)
            good = (np.asarray(t.column("s1"), np.int64) == s1) & (np.asarray(t.column("s2"), np.int64) == s2)  # rows that repeat an id may hold another text
            ends = np.r_[0, np.cumsum(size)].astype(np.int32) * 8
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("c", "root", "copies")), pa.array(size, pa.int64()), data], names=["c", "root", "copies", "n", "data"]).filter(pa.array(good))

    def dealt(rows: DataFrame, parts, payload: int) -> DataFrame:
        """Each group's pairs of parts, and the task that works on each; ``payload``: bytes that all rows send once."""
        sizes = saved(rows.groupBy("root").agg(F.count("*").alias("g"), F.sum("n").alias("weight")), "sizes")
        d = rows.join(sizes, "root").withColumn("parts", F.ceil(parts).cast("int")).drop("g", "weight")
        own = F.pmod(F.xxhash64("c", F.lit(3)), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
        d = d.withColumn("part", own).withColumn("p", F.explode(pairs)).withColumns({"i": F.col("p.i").cast("long"), "j": F.col("p.j").cast("long")})
        tasks = max(shuffle_partitions(spark), payload // (8 << 20))
        # A group's pairs of parts are numbered, so that they go to different tasks.
        number = F.col("i") * F.col("parts") - F.floor(F.col("i") * (F.col("i") - 1) / 2) + F.col("j") - F.col("i")
        return d.withColumn("task", F.pmod(F.pmod(F.xxhash64("root"), F.lit(int(tasks))) + number, F.lit(int(tasks)))).drop("p", "parts")

    def blocks_of(t: pa.Table):
        """Places of each pair of parts in a task, each class once, by class, and how many of them are of the first part (0: there is one only)."""
        key = np.stack([np.asarray(t.column(x), np.int64) for x in ("c", "part", "j", "i", "root")])
        by = np.lexsort(key)
        root, i, j = key[4][by], key[3][by], key[2][by]
        cuts = np.flatnonzero(np.r_[~same_as_previous(root, i, j), True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = by[lo:hi]
            at = at[np.r_[True, key[0][at][1:] != key[0][at][:-1]]]
            at = at[np.argsort(key[1][at], kind="stable")]
            two = key[3][at[0]] != key[2][at[0]]
            left = int((key[1][at] == key[3][at]).sum()) if two else 0
            if len(at) > 1 and not (two and left in (0, len(at))):
                yield at, left

    def pair_table(a: list, b: list, links: list) -> pa.Table:
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    @released
    def thin(t: pa.Table) -> pa.Table:
        c, n, sketch = np.asarray(t.column("c"), np.int64), np.asarray(t.column("n"), np.int64), t.column("sketch")
        a, b = [], []
        for at, left in blocks_of(t):
            links = []
            for part, first in squares(len(at), left):
                some = at[part]
                links.append(stars(c[some], *near_pairs(n[some], [sketch[int(r)].as_buffer() for r in some], first, num, den)))
            links = links[0] if len(links) == 1 else united(c[at], links)
            a += links[0]
            b += links[1]
        return pair_table(a, b, [0] * len(a))

    total, weight = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    near = dealt(sketches, F.col("g") / THIN, total * 40 + weight // 4).groupBy("task").applyInArrow(thin, "a long, b long, links long")
    near = components(near.select("a", "b"), "near")
    wanted = saved(near.withColumnRenamed("v", "c").join(members.drop("root", "n"), "c"), "wanted")
    discard(near, members, sketches)
    # A merge join, else two Python functions run in one stage, and the executor keeps twice as many workers.
    chosen = among(texts.select("ord", "text"), "ord", wanted.select("rep")).join(wanted.hint("merge"), F.col("ord") == F.col("rep")).select("c", "s1", "s2", "root", "copies", "text")
    prepared = saved(chosen.mapInArrow(sets, "c long, root long, copies long, n long, data binary"), "shingles")

    @released
    def verify(t: pa.Table) -> pa.Table:
        ids, copies, data = np.asarray(t.column("c"), np.int64), np.asarray(t.column("copies"), np.int64), t.column("data")
        a, b, deg = [], [], []
        for at, left in blocks_of(t):
            c = ids[at]
            x, y = links_of([np.frombuffer(data[int(r)].as_buffer(), np.uint64) for r in at], left, num, den)
            links = np.bincount(x, copies[at][y], len(at)) + np.bincount(y, copies[at][x], len(at))
            some = np.flatnonzero(links)
            a += c[some].tolist()
            b += [None] * len(some)
            deg += links[some].astype(np.int64).tolist()
            p, q = stars(c, x, y)
            a += p
            b += q
            deg += [0] * len(p)
        return pair_table(a, b, deg)

    weight = prepared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    work = dealt(prepared, F.greatest(F.col("g") / chunk, F.col("weight") / (chunk * 4096)), weight * 8)
    verified = saved(work.groupBy("task").applyInArrow(verify, "a long, b long, links long"), "links")
    discard(prepared, wanted)
    roots = components(verified.filter("b IS NOT NULL").select("a", "b"), "linked")
    degree = verified.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    labelled = classes.join(roots, classes["c"] == roots["v"], "left").join(degree, classes["c"] == degree["a"], "left")
    labelled = labelled.select("s1", "s2", F.coalesce("root", "c").alias("root"), "least", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    labelled = saved(labelled, "labels")
    least = saved(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labelled = labelled.join(least, "root").select("s1", "s2", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    own_set = [F.when(F.col("n") > 0, F.col(s)).alias(s) for s in ("s1", "s2")]
    out = described.select("id", "n", *own_set).join(labelled, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_aggregate(list_slice(ws, i, i + 2), 'string_agg', ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
r(v, u) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, coalesce(k, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = w.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) d ON d.a = w.doc_id
"""
