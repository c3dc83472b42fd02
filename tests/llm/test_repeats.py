"""Byte and word dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np

from epochal.llm import block_anchors, prefix_free


def brute_bytes(rows, length):
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else 1 << 62, r[1] is not None, r[1] or ""))
    seen, out = set(), []
    for r in order:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(rows, length):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    n = Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, docs):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_bytes(docs, rows):
    got = prefix_free.repeated_bytes(docs).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 100)
    assert sum(r.n_removed for r in got) > 1000


def test_bytes_with_short_windows(docs, rows):
    got = prefix_free.repeated_bytes(docs, length=20, gram=8, reach=12).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 20)


def test_bytes_with_long_windows(docs, rows):
    got = prefix_free.repeated_bytes(docs, length=300, gram=16, reach=200).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 300)


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_words_and_bytes_of_equal_polynomials(spark):
    """Thue-Morse words and their complements agree in any polynomial hash modulo 2**64."""
    texts = [" ".join(["same"] * 20 + [thue_morse(n, a, b)] + ["tail"] * 20) for n in (1024, 4096) for a, b in ("ab", "ba")]
    rows = list(enumerate(texts)) + [(9, texts[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = block_anchors.repeated_words(d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 35) and {r.doc_id for r in got if r.n_removed} == {0, 9}
    assert Counter(map(tuple, prefix_free.repeated_bytes(d).collect())) == brute_bytes(rows, 100)
    long = [(i, thue_morse(4096, *x)) for i, x in enumerate(("ab", "ba", "ab"))]
    got = prefix_free.repeated_bytes(spark.createDataFrame(long, "doc_id long, text string"), length=2100, gram=16, reach=64).collect()
    assert Counter(map(tuple, got)) == brute_bytes(long, 2100)


def test_suffix_ranks():
    data = np.frombuffer(b"abracadabra abracadabra banana bandana", np.uint8)
    for length in (1, 3, 8, 11, 16):
        starts = np.arange(len(data) - length + 1)
        words = [data[i : i + length].tobytes() for i in starts]
        order = {w: i for i, w in enumerate(sorted(set(words)))}
        assert prefix_free.suffix_ranks(data, starts, length).tolist() == [order[w] for w in words]


def test_bytes_null_ids_come_last(spark):
    t = "abcdefghij" * 3 + "the quick brown fox jumps over the lazy dog and more of it to fill one hundred and twenty bytes"
    d = spark.createDataFrame([(None, t), (5, t), (7, t + "x")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in prefix_free.repeated_bytes(d).collect()}
    assert got == {5: 0, 7: len(t), None: len(t)}


def test_words(docs, rows):
    got = block_anchors.repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 35)
    assert sum(r.n_removed for r in got) > 300


def test_words_with_short_windows(docs, rows):
    got = block_anchors.repeated_words(docs, length=5, anchor=3).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 5)


def test_empty_and_clashing_columns(empty, clash, rows):
    assert prefix_free.repeated_bytes(empty).collect() == block_anchors.repeated_words(empty).collect() == []
    assert Counter(map(tuple, prefix_free.repeated_bytes(clash).collect())) == brute_bytes(rows, 100)
    assert block_anchors.repeated_words(clash).count() == len(rows)
