"""Rules, mixing and sharding against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from epochal.llm import mixing, rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_measurements(docs, rows):
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    got = rules.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == want


def test_policies_and_ablation(docs):
    ledger = rules.ledger(docs)
    judged = rules.apply_policy(ledger).collect()
    assert all(r.kept == (r.fail_bits == 0) and r.base_failed == bool(r.fail_bits & rules.BASE) for r in judged)
    base = rules.apply_policy(ledger, "base-1").filter("kept").count()
    table = {r.rule: r for r in rules.ablation(ledger).collect()}
    assert base >= sum(r.kept for r in judged)
    for name, bit in rules.BIT.items():
        assert table[name].n_failed == sum(bool(r.fail_bits & bit) for r in judged)
        assert table[name].n_kept_without == sum(r.fail_bits & ~bit == 0 for r in judged)


def test_ablation_query(spark, duck):
    from epochal.llm import queries

    got = sorted(tuple(r) for r in queries.rule_ablation(spark, "/root/testdata/sf0.001").select("rule", "n_failed", "n_failed_alone", "n_kept_without", "policy").collect())
    assert got == sorted(duck.sql(f"SELECT rule, n_failed, n_failed_alone, n_kept_without, policy FROM ({queries.ORACLES['rule_ablation']})").fetchall()) and len(got) == len(rules.RULES)


def test_rules_need_no_python(spark, empty, clash, rows):
    plan = rules.apply_policy(rules.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert rules.apply_policy(rules.ledger(empty)).collect() == []
    assert rules.ledger(clash).count() == len(rows)


def test_mix_targets_and_takes(docs, rows):
    got = mixing.mix_plan(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    sources = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in sources if s not in capped)
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / free for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert r.taken == r.passes * r.size and r.passes <= 3
        taken[r.source] += r.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s) / 2 + 1e-6
    again = Counter((r.doc_id, r.taken) for r in mixing.mix_plan(docs.repartition(2)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)


def test_mix_edges(spark, empty, clash, rows):
    assert mixing.mix_plan(empty).collect() == []
    assert mixing.mix_plan(clash).count() == len(rows)
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken) for r in mixing.mix_plan(none).collect()} == {(1, 0), (2, 0)}


def check_shards(got, n, k):
    per = Counter(r.shard for r in got)
    assert len(got) == n and max(per.values()) - min(per.get(s, 0) for s in range(k)) <= 1
    for s in range(k):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per.get(s, 0)))


def test_shards_are_even_and_keep_groups(docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    check_shards(got, len(rows), 4)
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    assert max(map(len, where.values())) == 1


def test_shards_split_only_what_does_not_fit(spark):
    texts = ["hot"] * 100 + [f"pair {i // 2}" for i in range(100)] + [f"own {i}" for i in range(101)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sharding.shard_documents(d, 7).collect()
    check_shards(got, 301, 7)
    where = defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert len(where["hot"]) == 3
    assert sum(len(w) > 1 for t, w in where.items() if t.startswith("pair")) <= 5


def test_full_shards_exchange(spark):
    """All documents in pairs: no unlinked document leaves room, so shards can only swap."""
    d = spark.createDataFrame([(i, f"pair {i // 2}") for i in range(2000)], "doc_id long, text string")
    got = sharding.shard_documents(d, 10).collect()
    check_shards(got, 2000, 10)
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    assert sum(len(w) == 1 for w in where.values()) >= 800


def test_flows_fill_what_leaves():
    flow = sharding.settle_flows([[0, 50, 0], [40, 0, 0], [30, 0, 0]], [0, 5, -10])
    assert flow[1][0] + flow[2][0] <= flow[0][1] <= 5 + flow[1][0] and flow[2][0] >= 10 and flow[1][0] >= 20
    assert sharding.settle_flows([[0, 3], [0, 0]], [0, 0]) == [[0, 0], [0, 0]]


def test_shards_against_plain_counts(docs, rows, clash):
    """Size, checksum, group and law of every row; the same rows give the same shards again."""
    import zlib

    for d in (docs, clash):
        got = sharding.shard_documents(d, 4).collect()
        check_shards(got, len(rows), 4)
        text = lambda r: (r[1] or "").encode()
        copies = Counter(map(text, rows))
        assert Counter((r.doc_id, r.size, r.text_crc32, r.group_size) for r in got) == Counter((r[0], len(text(r)) + 16, zlib.crc32(text(r)), copies[text(r)]) for r in rows)
    again = sharding.shard_documents(docs.repartition(2), 4).collect()
    assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.size, r.shard, r.slot) for r in got)


def test_shard_edges(empty, clash, rows):
    assert sharding.shard_documents(empty).collect() == []
    got = sharding.shard_documents(clash).collect()
    check_shards(got, len(rows), 40)
    sizes = Counter((r.doc_id, r.size) for r in got)
    assert sizes == Counter((r[0], len((r[1] or "").encode()) + 16) for r in rows)
