"""User functions: the serial runner, epochs on Spark against it, and the streaming session across a restart."""

import json
import random

import pytest

from epochal.api import Graph, LocalRunner, Operator, Session, UnknownFunction, serial_winners_then_losers
from epochal.operators import transactions as tx
from epochal.sources import files
from epochal.streaming.session import StreamingSession

REQ = "t_id long, operator string, key string, function string, params string"


def bank():
    accounts = Operator("accounts", 4)

    @accounts.register
    def deposit(ctx, amount):
        ctx.put((ctx.get() or 0) + amount)
        return ctx.get()

    @accounts.register
    def transfer(ctx, other, amount):
        left = ctx.get() - amount
        if left < 0:
            raise ValueError("not enough")
        ctx.put(left)
        ctx.call_remote_async("accounts", "deposit", other, [amount])

    @accounts.register
    def read(ctx):
        return ctx.get()

    return Graph("bank").add_operators(accounts)


def test_local_runner_keeps_totals_and_aborts_whole_requests():
    r = LocalRunner(bank())
    r.init_data("accounts", {i: 5 for i in range(4)})
    assert r.send_event("accounts", 0, "transfer", [1, 3]) == (8, None)
    assert r.send_event("accounts", 0, "transfer", [1, 3])[1].startswith("ValueError")
    assert [r.get_state("accounts", i) for i in range(4)] == [2, 8, 5, 5]
    assert r.send_event("accounts", 0, "nothing")[1].startswith("UnknownFunction")
    with pytest.raises(UnknownFunction):
        bank().function("x", "y")


def requests(n, seed=3, keys=6):
    rng = random.Random(seed)
    out = []
    for t in range(1, n + 1):
        a, b = rng.sample(range(keys), 2)
        out.append((t, "accounts", str(a), *(("transfer", [b, 4]) if rng.random() < 0.7 else ("deposit", [1]))))
    return out


def initial(spark, session, keys=6):
    return session.state_of(spark.createDataFrame([("accounts", str(i), "10") for i in range(keys)], "operator string, key string, value string"))


def test_epoch_equals_serial_order_of_winners_then_losers(spark):
    graph = bank()
    s = Session(spark, graph, threshold=-1.0)
    reqs = requests(14)
    df = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in reqs], REQ)
    e = s.run_epoch(df, initial(spark, s))
    got = {r.key: json.loads(r.value) for r in e.state.collect()}
    lost = {r.t_id for r in tx.conflicts(e.accesses).collect()}
    local = LocalRunner(graph)
    local.init_data("accounts", {i: 10 for i in range(6)})
    replies = serial_winners_then_losers(local, reqs, lost)
    assert lost and got == {k: json.loads(v) for (_, k), v in local.state.items()}
    assert {r.t_id for r in e.replies.collect() if r.error} == {t for t, x in replies.items() if x[1]}


def test_rescheduled_requests_finish_in_later_epochs(spark):
    s = Session(spark, bank(), threshold=1.0)
    reqs = [(t, "accounts", "0", "deposit", [1]) for t in range(1, 5)]
    df = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in reqs], REQ)
    state, replies = s.run(df, initial(spark, s, 1), 4)
    assert json.loads(state.first().value) == 14
    assert sorted(r.t_id for r in replies.collect()) == [1, 2, 3, 4]


def serial(reqs, keys):
    local = LocalRunner(bank())
    local.init_data("accounts", {i: 10 for i in range(keys)})
    return local, {r[0]: local.send_event(*r[1:]) for r in reqs}


def test_every_request_has_one_reply(spark, tmp_path):
    """One conflict in forty is below the threshold of a re-run: the loser waits for the next epoch, and is not lost."""
    reqs = [(t, "accounts", str(t if t != 40 else 1), "deposit", [1]) for t in range(1, 41)]
    rows = [(r[0], *r[1:4], json.dumps(r[4])) for r in reqs]
    state, replies = Session(spark, bank()).run(spark.createDataFrame(rows, REQ), initial(spark, Session(spark, bank()), 1), 40)
    assert sorted(r.t_id for r in replies.collect()) == list(range(1, 41))
    assert {r.key: json.loads(r.value) for r in state.collect()}["1"] == 2
    session = StreamingSession(spark, bank(), f"{tmp_path}/run")
    session.init_data(spark.createDataFrame([("accounts", "0", "10")], "operator string, key string, value string"))
    schema = REQ.replace("t_id", "request_id")
    session._epoch(spark.createDataFrame(rows + rows[:3], schema), 0)  # three requests come twice
    assert sorted(r.request_id for r in session.replies().collect()) == list(range(1, 41))
    assert {r.key: json.loads(r.value) for r in session.state(0).collect()} == {"0": 10, **{str(i): 1 + (i == 1) for i in range(1, 40)}}
    session._epoch(spark.createDataFrame([], schema), 1)
    assert session.replies().count() == 40 and session.state(1).count() == 40


def test_stream_restart_gives_each_request_one_reply(spark, tmp_path):
    reqs = requests(12, keys=4)
    rows = [(r[0], *r[1:4], json.dumps(r[4])) for r in reqs]
    schema = REQ.replace("t_id", "request_id")
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows[:6], schema).coalesce(1).write.parquet(src)
    session = StreamingSession(spark, bank(), f"{tmp_path}/run", compact_every=2)
    session.init_data(spark.createDataFrame([("accounts", str(i), "10") for i in range(4)], "operator string, key string, value string"))
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    session.start(stream()).awaitTermination()
    before = {r.key: r.value for r in session.state(0).collect()}
    session._epoch(spark.createDataFrame(rows[:6], schema), 0)  # a replay of the batch
    assert {r.key: r.value for r in session.state(0).collect()} == before
    spark.createDataFrame(rows[6:], schema).coalesce(1).write.mode("append").parquet(src)
    session.start(stream()).awaitTermination()
    assert sorted(r.request_id for r in session.replies().collect()) == [r[0] for r in rows]
    total = sum(json.loads(r.value) for r in session.state(1).collect())
    errors = {r.request_id for r in session.replies().collect() if r.error}
    deposits = sum(1 for r in rows if r[3] == "deposit" and r[0] not in errors)
    assert total == 40 + deposits
    assert session._exists(f"{tmp_path}/run/state/1") and not session._exists(f"{tmp_path}/run/state/0")


def shop():
    items = Operator("items", 2)

    @items.register
    def fill(ctx, rows):
        ctx.batch_insert(rows)
        return len(rows)

    @items.register
    def total(ctx):
        ctx.put(sum(v for k, v in ctx.data.items() if k != ctx.key))
        return ctx.get()

    return Graph("shop").add_operators(items)


def test_bulk_inserts_and_partition_scans_in_functions(spark):
    """Keys of one partition (even numbers) are inserted, then summed up by a function that scans it."""
    reqs = [(1, "items", "0", "fill", [{"2": 5, "4": 6, "1": 100}]), (2, "items", "8", "total", []), (3, "items", "9", "total", [])]
    local = LocalRunner(shop())
    assert local.send_batch([r[1:] for r in reqs[:1]]) == [(3, None)]
    s = Session(spark, shop())
    state = s.state_of(spark.createDataFrame([("items", "6", "7")], "operator string, key string, value string"))
    df = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in reqs], REQ)
    state, replies = s.run(df, state, 1)
    assert {r.t_id: (r.response, r.error) for r in replies.collect()} == {1: ("3", None), 2: ("18", None), 3: ("100", None)}
    assert {r.key: json.loads(r.value) for r in state.collect()} == {"1": 100, "2": 5, "4": 6, "6": 7, "8": 18, "9": 100}
    e = s.run_epoch(df.filter("t_id > 1"), s.state_of(spark.createDataFrame([("items", "6", "7"), ("items", "3", "1")], "operator string, key string, value string")))
    assert {(r.t_id, r.key, r["mode"]) for r in e.accesses.collect()} == {(2, "6", "r"), (2, "8", "r"), (2, "8", "w"), (3, "3", "r"), (3, "9", "r"), (3, "9", "w")}


def test_wal_and_snapshot_files(spark, tmp_path):
    w = spark.createDataFrame([(0, 1, 10), (1, 2, 20), (1, 1, 30)], "epoch long, request_id long, t_id long")
    files.write_wal(w, f"{tmp_path}/wal")
    files.write_wal(w.filter("epoch = 1"), f"{tmp_path}/wal")
    assert {(r.request_id, r.t_id) for r in files.read_wal(spark, f"{tmp_path}/wal").collect()} == {(1, 30), (2, 20)}
    d = spark.createDataFrame([(2, "o", 0, "k", "a"), (10, "o", 0, "k", "b")], "snapshot_id long, operator string, part int, key string, value string")
    files.write_deltas(d, f"{tmp_path}/deltas")
    assert tx.merge_snapshots(files.read_deltas(spark, f"{tmp_path}/deltas")).first().value == "b"
    assert files.read_deltas(spark, f"{tmp_path}/deltas", 5).count() == 1


def test_snapshot_log_and_csv(spark, tmp_path):
    (tmp_path / "log.txt").write_text("noise\nWorker: 1 | Completed snapshot: 7 | started at: 10.5 | ended at: 10.758\n")
    r = files.snapshot_log(spark, f"{tmp_path}/log.txt").first()
    assert (r.worker, r.snapshot_id, r.ms) == (1, 7, 0.258)
    (tmp_path / "req.csv").write_text("request_id,timestamp,op\n2,20,read 1\n1,10,transfer 1->2\n")
    assert [r.request_id for r in files.run_csv(spark, f"{tmp_path}/req.csv", files.REQUESTS).collect()] == [1, 2]
    (tmp_path / "t.csv").write_text("timestamp,total_throughput\n0,0.5\n")
    assert files.trace(spark, f"{tmp_path}/t.csv", 100.0).first().total_throughput == 50.0


def test_client_sends_and_receives(spark):
    from epochal.client import Client, graph_spec, spec_changes

    c = Client(spark, bank(), epoch_size=10)
    c.init_data("accounts", {0: 5, 1: 5})
    a, b = c.send_event("accounts", 0, "transfer", [1, 2]), c.send_event("accounts", 7, "read")
    with pytest.raises(UnknownFunction):
        c.send_event("accounts", 0, "nothing")
    assert c.get(a).value == 7 and c.get(a).error is None and c.get(a).latency_ms > 0 and c.get(b).value is None
    assert "ValueError" in c.get(c.send_event("accounts", 0, "transfer", [1, 99])).error
    bigger = Graph("bank").add_operators(Operator("accounts", 8), Operator("other"))
    assert spec_changes(graph_spec(bank()), graph_spec(bigger)) == {"added": ["other"], "moved": [("accounts", 4, 8)]}


def test_order_entry_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("3,6,n,s,t,c,st,z,0.1,20.5,7\n")
    r = files.tpcc_state(spark, f"{tmp_path}/d.csv", "district", 4).first()
    assert (r.key, r.part, json.loads(r.value)["d_next_o_id"]) == ("6:3", 2, 7)


def test_reply_rows(spark):
    from epochal.sources.kafka import reply_rows

    r = reply_rows(spark.createDataFrame([(1, "5", None)], "request_id long, response string, error string"), "accounts").first()
    assert (r.topic, r.key, json.loads(r.value)) == ("accounts--OUT", "1", {"response": "5"})


def test_futures_coroutines_and_updates(spark):
    import asyncio

    from epochal.client import AsyncClient, Client

    c = Client(spark, bank(), epoch_size=10)
    c.init_data("accounts", {i: 5 for i in range(4)})
    future = c.submit("accounts", 0, "transfer", [1, 2])
    ids = c.send_batch([("accounts", 2, "read", []), ("accounts", 3, "deposit", [4])])
    assert not future.done()
    assert [c.get(i).value for i in ids] == [5, 9] and future.result().value == 7

    async def both():
        a = AsyncClient(c)
        return await asyncio.gather(a.send_event("accounts", 0, "read"), a.send_event("accounts", 1, "transfer", [0, 100]))

    one, two = asyncio.run(both())
    assert one.value == 3 and "ValueError" in two.error
    assert c.update(Graph("bank").add_operators(Operator("accounts", 8, functions=bank().operators["accounts"].functions))) == [("accounts", 4, 8)]
    assert {r.key: (r.part, r.value) for r in c.state.collect()} == {"0": (0, "3"), "1": (1, "7"), "2": (2, "5"), "3": (3, "9")}
    with pytest.raises(ValueError):
        c.update(Graph("bank").add_operators(Operator("accounts", 8), Operator("new")))


def test_records_of_a_batch(spark, tmp_path):
    from epochal.sources import kafka

    rows = [("accounts", 1, 7, 1, "5"), ("accounts", 1, 3, 2, "4"), ("accounts", 0, 9, 3, None), ("accounts", 0, 2, 4, "8")]
    d = spark.createDataFrame(rows, "operator string, partition int, offset long, request_id long, key string")
    got = kafka.in_order(d, 4).collect()
    assert [r.offset for r in got if r.partition == 1] == [3, 7] and [r.offset for r in got if r.partition == 0] == [2, 9]
    assert {r.request_id: (r.owner, r.forwarded) for r in got} == {1: (1, False), 2: (0, True), 3: (None, False), 4: (0, False)}
    assert {(r.partition, r.offset) for r in kafka.next_offsets(d).collect()} == {(0, 10), (1, 8)}
    files.write_run_csv(spark.createDataFrame([(2, 20, "b"), (1, 10, "a")], files.REQUESTS), f"{tmp_path}/run")
    assert [r.op for r in files.run_csv(spark, f"{tmp_path}/run", files.REQUESTS).collect()] == ["a", "b"]
    files.write_json(d, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 4
