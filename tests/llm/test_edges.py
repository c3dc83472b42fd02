"""Nulls in every column, repeated rows, long texts, ties and clashing columns, against plain Python; each pipeline stage too."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from epochal.llm import block_anchors, bpe_codec, mixing, ordinal, parity_join, prefix_free, rules, sharding
from test_repeats import brute_bytes, brute_words
from test_search import brute_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd():
    """Null ids, sources and texts; ids with several texts; equal rows; a text of two megabytes; spaces of all kinds."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(400_000)
    body = prose(200)
    rows = [(1, long, "en", "a", 1), (2, long[:500_000] + " end", "en", "a", 1), (None, body, None, None, None), (None, body, None, None, None), (None, body + " more", "en", "b", 2), (None, None, None, None, None), (3, None, "en", "b", 0), (3, body, "en", "b", 0), (3, prose(90), "en", "b", 0), (4, prose(90), "en", "b", 0), (4, body.upper(), "en", "b", 0), (5, "", "en", "b", 0), (6, "   \x1c\x85 ", "en", "c", 0), (7, "x" * 300_000, "en", "c", 0), (8, "a1b2c3" * 20_000, "en", "c", 0)]
    return rows + [rows[8], rows[2]]


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    from pyspark.sql import functions as F

    names = ["blk", "ord", "id", "size", "kept", "n_words", "shard", "slot", "r", "g", "key", "range", "at", "target", "taken", "c", "root", "place", "group", "best", "row", "passes"]
    return spark.createDataFrame(odd, SCHEMA).repartition(4).withColumns({n: F.lit(7) for n in names})


def test_repeats_of_odd_rows(odd, odd_docs):
    got = block_anchors.repeated_words(odd_docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(odd, 35)
    assert Counter(map(tuple, prefix_free.repeated_bytes(odd_docs).collect())) == brute_bytes(odd, 100)


def test_join_of_odd_rows(odd, odd_docs):
    """A null id names no component unless all its ids are null."""
    got = parity_join.near_duplicates(odd_docs).collect()
    some = [(r[0] if r[0] is not None else 1 << 40, *r[1:]) for r in odd]
    plain = lambda i: None if i == 1 << 40 else i
    want = Counter((plain(i), n, plain(c) if n else plain(i), k) for (i, n, c, k), times in brute_components(some).items() for _ in range(times))
    assert Counter(map(tuple, got)) == want


def test_rules_of_odd_rows(odd, odd_docs):
    got = rules.apply_policy(rules.ledger(odd_docs)).collect()
    want = Counter()
    for r in odd:
        w = WORD.findall(r[1] or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        want[r[0], len(w), sum(map(len, w)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.base_failed and r.kept for r in got)


def test_mix_of_odd_rows_is_the_same_again(odd, odd_docs):
    got = Counter((r.doc_id, r.size, r.source, r.taken) for r in mixing.mix_plan(odd_docs).collect())
    assert got == Counter((r.doc_id, r.size, r.source, r.taken) for r in mixing.mix_plan(odd_docs.repartition(7)).collect())
    assert Counter((i, n, s) for (i, n, s, _), k in got.items() for _ in range(k)) == Counter((r[0], len(WORD.findall(r[1] or "")), r[3]) for r in odd)


def test_shards_of_odd_rows(odd, odd_docs):
    got = sharding.shard_documents(odd_docs, 5).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16) for r in odd)
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.get(s, 0) for s in range(5)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(per.get(s, 0))) for s in range(5))


def test_encoding_of_odd_rows(odd, odd_docs):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    e = bpe_codec.codec(path, P.PATTERN)
    want = Counter((r[0], hashlib.sha256(np.array(e.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd)
    got = bpe_codec.encode_documents(odd_docs, path, P.PATTERN, chunk=1000, keep_ids=False).collect()
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_cuts_change_no_token():
    """Random texts over the characters that matter to the split pattern, cut at every safe boundary."""
    P = pytest.importorskip("public_tokenizers")
    path, rng = P.path("byte_bpe_50k.tiktoken"), random.Random(3)
    e = bpe_codec.codec(path, P.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Z", "é", "1", "٣", "'", "'s", "'re", " ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", ".", "!?", "日"]) for _ in range(rng.randint(1, 14)))
        assert bpe_codec.encode(text, path, P.PATTERN, 1).tolist() == e.encode_ordinary(text), repr(text)


def test_classifier_trains_on_an_id_once(spark):
    rows = [(1, f"good words number {i}") for i in range(500)] + [(2, "bad"), (None, "x"), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, grade int")
    sizes = []
    import unittest.mock

    with unittest.mock.patch.object(ordinal, "train", lambda rows, grades, n: sizes.append(len(rows)) or ordinal.Model({}, [0.0, 1.0])):
        ordinal.fit(d, grades)
        ordinal.fit(d, grades, max_rows=2)
    assert sizes == [3, 2]
    model = ordinal.Model({}, [0.0, 1.0])
    assert ordinal.score_documents(d, model).count() == len(rows)


def test_ordinal_model_against_a_plain_sum():
    """Scores and tail probabilities of a fitted model, by an independent sum over bins."""
    import zlib

    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    texts, grades = [], []
    for _ in range(600):
        g = rng.randrange(3)
        texts.append(" ".join(rng.choice(vocab[20 * g : 20 * g + 30]) for _ in range(25)))
        grades.append(g)
    model = ordinal.train([ordinal.features(t) for t in texts], np.array(grades))
    right = 0
    for t, g in zip(texts[:200], grades):
        bins = {ordinal.SHAPES + zlib.crc32(w.encode()) % (ordinal.BINS - ordinal.SHAPES) for w in set(t.split())}
        shapes = {b for b in ordinal.features(t).tolist() if b < ordinal.SHAPES}
        score = sum(model.weights.get(b, 0.0) for b in bins | shapes)
        assert model.score(t) == pytest.approx(score)
        tails = model.tails(np.array([score]))[0]
        assert tails == pytest.approx([1 / (1 + np.exp(c - score)) for c in model.thresholds]) and tails[0] >= tails[1]
        right += round(tails.sum()) == g
    assert right >= 170 and model.thresholds == sorted(model.thresholds)


def test_each_stage_of_the_pipeline(spark, odd, odd_docs):
    """Columns stay, and what goes is what the stage's rule names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd_docs, "")
        rows = out.collect()
        if name != "encode":
            assert out.columns == odd_docs.columns and dict(out.dtypes)["text"] == "string"
        kept[name] = Counter((r.doc_id, r.text) for r in rows) if name != "encode" else len(rows)
        assert stage(spark, odd_docs.limit(0), "").collect() == []
    given = Counter((r[0], r[1]) for r in odd)
    assert kept["encode"] == len(odd) and kept["personal_data"] == given  # no personal data here
    assert not kept["quality_rules"] - given and not kept["near_duplicates"] - given
    n = lambda w, c: kept["near_duplicates"][w, c]
    body = next(r[1] for r in odd if r[0] is None and r[1] and not r[1].endswith("more"))
    assert n(3, body) + n(4, body.upper()) + n(None, body) + n(None, body + " more") == 1 and n(None, None) == 1 and n(3, None) == 1
    assert kept["source_mix"].keys() <= given.keys()
