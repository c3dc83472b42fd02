"""The pipeline and its near-duplicate stage against brute force over five-word shingles."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from test_search import LOWER, WORD, brute_components

from epochal.llm import mixing, parity_join, rules, surrogates
from epochal.llm.queries import surrogate_key

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five_word_roots(texts):
    """Per text, the least place of its group: linked are sets of five-word shingles of similarity 0.8."""
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_stage_links_five_word_shingles_at_four_fifths(spark):
    """Seven changed words in 320: 0.80 by five words, but 0.88 by three."""
    base = [f"w{i}" for i in range(320)]
    text = lambda n: " ".join(f"e{n}x{i}" if i % 40 == 20 and i < 40 * n else w for i, w in enumerate(base))
    rows = [(1, text(0)), (2, text(7)), (3, " ".join(f"v{i}" for i in range(320))), (4, text(0).replace("w", "u")), (5, text(8).replace("w", "u"))]
    assert five_word_roots([t for _, t in rows]) == [0, 0, 2, 3, 4]
    assert {x[2] for x in brute_components(rows)} == {1, 2, 3, 4, 5}
    out = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_pipeline_against_five_word_brute_force(spark, rows, tmp_path):
    extra = rows + [(500 + i, f"{r[1]} Write to who.{i:02d}@mail1.example.com now", "en", "s2", 0) for i, r in enumerate(rows[5:12])]
    docs = spark.createDataFrame(extra, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in rules.apply_policy(rules.ledger(docs)).filter("kept").collect()}
    kept = sorted((r for r in dict.fromkeys(extra) if r[0] in good), key=lambda r: r[0])
    root = five_word_roots([r[1] for r in kept])
    assert {x[0] for x in brute_components(kept) if x[2] == x[0]} > {kept[i][0] for i in root}
    clean = [(r[0], surrogates.rewrite(r[1], {}, surrogate_key(spark))[0], *r[2:]) for i, r in enumerate(kept) if root[i] == i]
    text = {r[0]: r[1] for r in clean}
    want = Counter()
    for r in mixing.mix_plan(spark.createDataFrame(clean, SCHEMA)).collect():
        want[r.doc_id, hashlib.sha256(text[r.doc_id].encode()).hexdigest()] += r.passes
    assert Counter((r.doc_id, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()) == +want and len(want) > 10


def test_stage_keeps_one_row_of_each_group(spark):
    """Null ids are in groups too, and a repeated id's clean text stays when its other text is a copy."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (7, a, "y"), (7, b, "z"), (None, c, "u"), (None, c, "v"), (None, c + " more", "w"), (None, a, "t"), (8, d, "p"), (8, d, "q"), (None, "", "e"), (None, "", "f"), (9, "", "g"), (9, "", "h"), (9, None, "i")]
    out = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(3), "")
    assert out.columns == ["doc_id", "text", "__row"]
    got = Counter((r.doc_id, r.text and r.text.replace(" more", "")) for r in out.collect())
    assert got == Counter({(1, a): 1, (7, b): 1, (None, c): 1, (8, d): 1, (None, ""): 2, (9, ""): 1, (9, None): 1})


def test_sparse_sketches_of_linked_sets_meet():
    """Every pair at 0.8 shares a chunk; of unlike sets, few do (the dense sketch posts empty chunks here)."""
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sets, linked = [], []
    for n in [1, 2, 4, 5, 9, 10, 20, 45, 100, 300, 1000] * 6:
        both = new(n)
        odd = n // 4  # union n + n // 4
        cut = int(rng.integers(0, odd + 1))
        sets += [np.sort(np.r_[both, new(cut)]), np.sort(np.r_[both, new(odd - cut)])]
        linked.append(len(sets) - 2)
    size = np.array([len(x) for x in sets])
    row, h = np.repeat(np.arange(len(sets)), size).astype(np.int32), np.concatenate(sets)
    meets = {}
    for name in ("sketch", "sparse_sketch"):
        r, key = getattr(parity_join, name)(row, h, size, 80, 100)
        of = [set(key[r == i]) for i in range(len(sets))]
        meets[name] = sum(bool(of[i] & of[j]) for i in range(len(sets)) for j in range(i) if i // 2 != j // 2)
        if name == "sparse_sketch":
            assert all(of[i] & of[i + 1] for i in linked if len(set(sets[i]) ^ set(sets[i + 1])))
            assert (of[-1] and len(of[-1]) < 2000)
    assert meets["sparse_sketch"] < meets["sketch"]


def test_sparse_sketches_of_sets_with_a_common_passage_rarely_meet():
    """A sixth of the shingles in common is no candidate, else a corpus' common passages make one large group."""
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 63, 34, dtype=np.uint64)
    sets = [np.sort(np.r_[common, rng.integers(0, 1 << 63, 166, dtype=np.uint64)]) for _ in range(100)]
    r, key = parity_join.sparse_sketch(np.repeat(np.arange(100), 200).astype(np.int32), np.concatenate(sets), np.full(100, 200), 80, 100)
    of = [set(key[r == i]) for i in range(100)]
    assert sum(bool(of[i] & of[j]) for i in range(100) for j in range(i)) < 400  # of 4950 pairs


def test_sparse_sketches_of_every_spread_of_differences_meet():
    """Sets that differ in as many shingles as 0.8 allows, or fewer, dealt anyhow."""
    rng = np.random.default_rng(9)
    for n in (5, 6, 8, 9, 13, 18, 27, 40, 81):
        for odd in {1, n // 8, n // 4} - {0}:
            for _ in range(60):
                x = rng.integers(0, 1 << 63, n + odd, dtype=np.uint64)
                cut = int(rng.integers(0, odd + 1))
                sets = [np.sort(x[: n + cut]), np.sort(np.r_[x[:n], x[n + cut :]])]
                size = np.array([len(s) for s in sets])
                r, key = parity_join.sparse_sketch(np.repeat([0, 1], size).astype(np.int32), np.concatenate(sets), size, 80, 100)
                assert set(key[r == 0]) & set(key[r == 1])


def test_texts_are_picked_by_bits_before_they_are_joined(spark):
    rows = spark.range(3000).selectExpr("id AS ord", "CAST(id AS STRING) AS text")
    got = {x.ord for x in parity_join.among(rows, "ord", spark.range(0, 3000, 30).toDF("v")).collect()}
    assert set(range(0, 3000, 30)) <= got and len(got) < 400
    assert parity_join.among(rows, "ord", spark.range(0).toDF("v")).collect() == []


def test_squares_cover_every_pair_once():
    for g, left in ((1, 0), (10, 0), (11, 4), (8, 3)):
        pairs = []
        for at, first in parity_join.squares(g, left, 3):
            pairs += [tuple(sorted((int(a), int(b)))) for x, a in enumerate(at) for b in at[max(first, x + 1) :] if not first or x < first]
        want = [(a, b) for b in range(g) for a in range(b) if not left or a < left <= b]
        assert sorted(pairs) == sorted(want)


def test_posted_chunks_are_told_as_before_they_were_packed():
    rng = np.random.default_rng(10)
    s = np.repeat(rng.integers(-(1 << 62), 1 << 62, 70), rng.integers(1, 40, 70))
    key = rng.integers(0, 1 << 64, len(s), dtype=np.uint64)
    data = parity_join.pack_posts(key, s)
    assert len(data) < 8 * len(s)  # 14 bytes a chunk before
    assert (parity_join.post_keys(data) == key >> np.uint64(24)).all()
    some = np.flatnonzero(rng.random(len(s)) < 0.3)
    assert (parity_join.post_sets(data, some) == s[some]).all()


def test_a_bucket_finds_its_stars_in_little_memory():
    """Chunks that are met by no other take some 16 bytes each, not 52 as before: with two buckets at once that stopped an executor."""
    rng = np.random.default_rng(11)
    n, rows, want = 1 << 16, [], {}
    common = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    for _ in range(8):
        s = np.sort(np.repeat(rng.integers(0, 1 << 62, n // 16), 16))
        key = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        at = rng.choice(n, 40, replace=False)
        key[at] = common
        for k, c in zip(common.tolist(), s[at].tolist()):
            want.setdefault(k, set()).add(c)
        rows += parity_join.reduce_posts(key, s, 1)
    table = parity_join.messages(rows)
    parity_join.meet(table)
    tracemalloc.start()
    got = parity_join.meet(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    want = {(min(c), x) for c in want.values() for x in c if x != min(c)}
    assert want <= pairs and len(pairs) <= len(want) + 3  # keys are told by 40 bits
    assert peak < 30 * 8 * n


def test_a_bucket_of_posts_is_a_partition(spark):
    """As many partitions as buckets, each with one: by a hash of their numbers seven lay in one, and were sorted together."""
    rows = spark.range(64).selectExpr("CAST(id AS INT) AS dst", "0 AS src", "0 AS kind", "CAST(NULL AS BINARY) AS data")
    got = parity_join.by_bucket(rows, 64).selectExpr("spark_partition_id() AS p", "dst").collect()
    assert sorted(x.p for x in got) == list(range(64))
