"""Conflict detection, sequencing, commit and fallback on hand-made rows."""

import random

import pytest

from epochal.operators import partitioning
from epochal.operators import transactions as tx

ACC = "epoch long, t_id long, operator string, part int, key string, mode string"


def acc(spark, *rows):
    return spark.createDataFrame([(0, t, "o", 0, k, m) for t, k, m in rows], ACC)


def aborted(df, mode="serializable"):
    return {r.t_id for r in tx.conflicts(df, mode).collect()}


@pytest.mark.parametrize(
    "rows, serializable, snapshot, reordering",
    [
        ([(1, "k", "w"), (5, "k", "r")], {5}, set(), set()),
        ([(1, "k", "w"), (5, "k", "w")], {5}, {5}, {5}),
        ([(1, "a", "w"), (5, "b", "w")], set(), set(), set()),
        ([(1, "k", "w"), (3, "k", "r"), (5, "k", "r")], {3, 5}, set(), set()),
        ([(1, "a", "r"), (1, "b", "w"), (5, "b", "r"), (5, "a", "w")], {5}, set(), {5}),
        ([(1, "a", "r"), (5, "a", "w")], set(), set(), set()),
    ],
)
def test_abort_sets(spark, rows, serializable, snapshot, reordering):
    a = acc(spark, *rows)
    assert aborted(a) == serializable
    assert aborted(a, "snapshot") == snapshot
    assert aborted(a, "reordering") == reordering


def test_random_epochs_match_definitions(spark):
    rng = random.Random(1)
    rows = list({(e, t, "o", k % 2, str(k), rng.choice("rw")) for e in range(20) for t in range(1, 8) for k in rng.sample(range(6), 2)})
    a = spark.createDataFrame(rows, ACC)
    w, r = {}, {}
    for e, t, _, p, k, m in rows:
        d = w if m == "w" else r
        d[e, k] = min(d.get((e, k), t), t)
    late = lambda d, e, k, t: d.get((e, k), t) < t
    serial = {(e, t) for e, t, _, _, k, _ in rows if late(w, e, k, t)}
    snap = {(e, t) for e, t, _, _, k, m in rows if m == "w" and late(w, e, k, t)}
    dr = set()
    for e, t, p in {(e, t, p) for e, t, _, p, _, _ in rows}:
        own = [(k, m) for e2, t2, _, p2, k, m in rows if (e2, t2, p2) == (e, t, p)]
        waw = any(m == "w" and late(w, e, k, t) for k, m in own)
        war = any(m == "w" and late(r, e, k, t) for k, m in own)
        raw = any(m == "r" and late(w, e, k, t) for k, m in own)
        if waw or (war and raw):
            dr.add((e, t))
    got = lambda mode: {(x.epoch, x.t_id) for x in tx.conflicts(a, mode).collect()}
    assert got("serializable") == serial
    assert got("snapshot") == snap
    assert got("reordering") == dr
    with pytest.raises(ValueError):
        tx.conflicts(a, "other")


def test_ids_interleave_and_epochs_hold(spark):
    d = spark.createDataFrame([(w, o) for w in range(3) for o in range(7)], "worker long, offset long")
    rows = tx.sequence(d, "worker", ["offset"], 3, 4).collect()
    assert len({r.t_id for r in rows}) == 21
    assert {r.t_id for r in rows if r.worker == 1} == {2 + 3 * i for i in range(7)}
    assert max(sum(1 for r in rows if r.worker == 0 and r.epoch == e) for e in (0, 1)) == 4


def test_replay_reuses_known_ids_and_skips_taken_ones(spark):
    d = spark.createDataFrame([(i, 0) for i in range(5)], "request_id long, worker long")
    wal = spark.createDataFrame([(3, 1), (99, 2)], "request_id long, t_id long")
    got = {r.request_id: r.t_id for r in tx.replay(d, wal, "worker", ["request_id"], 1).collect()}
    assert got == {3: 1, 0: 3, 1: 4, 2: 5, 4: 6}


def test_losers_come_first(spark):
    c = spark.createDataFrame([(0, 9), (0, 4)], "worker long, t_id long")
    f = spark.createDataFrame([(0, 10), (0, 11)], "worker long, t_id long")
    assert sorted(r.t_id for r in tx.reschedule(c, f, 3).collect()) == [4, 9, 10]


def test_last_write_of_a_transaction_wins_and_aborts_drop_out(spark):
    w = spark.createDataFrame([("o", 0, "k", 1, 0, "a", "old"), ("o", 0, "k", 1, 0, "b", "new"), ("o", 0, "k", 2, 0, "a", "lost")], "operator string, part int, key string, t_id long, round int, ordinal string, value string")
    a = spark.createDataFrame([(2,)], "t_id long")
    assert [r.value for r in tx.last_writes(w, a).collect()] == ["new"]


def test_commit_merges_and_deletes(spark):
    s = spark.createDataFrame([("o", 0, "a", "1"), ("o", 0, "b", "2")], "operator string, part int, key string, value string")
    w = spark.createDataFrame([("o", 0, "b", None), ("o", 0, "c", "3")], "operator string, part int, key string, value string")
    assert {(r.key, r.value) for r in tx.commit(s, w).collect()} == {("a", "1"), ("c", "3")}


def test_snapshots_merge_in_numeric_order(spark):
    d = spark.createDataFrame([(2, "o", 0, "k", "two"), (10, "o", 0, "k", "ten")], "snapshot_id long, operator string, part int, key string, value string")
    assert tx.merge_snapshots(d).first().value == "ten"
    assert tx.merge_snapshots(d, 9).first().value == "two"
    assert {r.snapshot_id for r in tx.compact(d, 5).collect()} == {5, 10}


def test_fallback_components(spark):
    a = acc(spark, (1, "x", "w"), (2, "x", "w"), (3, "x", "r"), (3, "y", "w"), (4, "y", "w"), (9, "z", "w"))
    losers = spark.createDataFrame([(0, t) for t in (2, 3, 4, 9)], "epoch long, t_id long")
    deps = tx.fallback_dependencies(a, losers)
    assert {(r.t_id, r.depends_on) for r in deps.collect()} == {(3, 2), (4, 3)}
    assert {(r.t_id, r.component) for r in tx.fallback_components(deps).collect()} == {(2, 2), (3, 2), (4, 2)}


def test_partitioners(spark):
    d = spark.createDataFrame([("42",), ("-3",), (None,), ("abc",), ("7:9:x",)], "key string")
    got = d.select("key", partitioning.partition_of("key", 5).alias("p"), partitioning.composite_partition("key", ":", 1, 5).alias("c")).collect()
    p = {r.key: r.p for r in got}
    assert p["42"] == 2 and p["-3"] == 2 and p[None] is None and 0 <= p["abc"] < 5
    assert {r.key: r.c for r in got}["7:9:x"] == 4
    assert [r.part for r in partitioning.range_partition(spark.createDataFrame([(5,), (20,)], "k int"), "k", [(0, 9), (10, 20)]).orderBy("k").collect()] == [0, 1]
    with pytest.raises(Exception, match="no range"):
        partitioning.range_partition(spark.createDataFrame([(50,)], "k int"), "k", [(0, 9)]).collect()
