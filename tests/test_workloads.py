"""Admission, places, neighbourhoods and buckets against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from twins import DATA

from epochal.operators import series
from epochal.operators import transactions as tx
from epochal.operators import workloads as wl
from epochal.plans import registry


def serial_settle(demands, capacity):
    """All demands of a request, or none, in order; the least lacking resource of each request left out."""
    wants, left, out, why = defaultdict(Counter), dict(capacity), {}, {}
    for t, resource, amount in demands:
        wants[t][resource] += amount
    for t in sorted(wants):
        lacking = [r for r, x in wants[t].items() if left.get(r, 0) < x]
        out[t] = not lacking
        if lacking:
            why[t] = min(lacking)
        else:
            for r, x in wants[t].items():
                left[r] -= x
    return out, why


def test_settling_equals_the_serial_fold(spark):
    rng = random.Random(5)
    demands = [(t, f"r{rng.randrange(6)}", rng.randint(1, 5)) for t in range(1, 80) for _ in range(rng.randint(1, 3))] + [(200, "unknown", 1), (201, "r0", 0)]
    capacity = [(f"r{i}", rng.randint(0, 60)) for i in range(6)]
    d, c = spark.createDataFrame(demands, "t_id long, resource string, amount long"), spark.createDataFrame(capacity, "resource string, capacity long")
    done = wl.settle(d, c)
    out, why = serial_settle(demands, capacity)
    assert {r.t_id: r.admitted for r in done.collect()} == out and set(out.values()) == {True, False}
    assert {r.t_id: r.resource for r in wl.lacking(d, c, done).collect()} == why
    assert wl.settle(d.limit(0), c).collect() == []


def test_checkouts_and_reservations_equal_serial_folds(spark):
    from epochal.plans import workloads as plans

    d = f"{DATA}/sf0.001"
    demands = [tuple(r) for r in plans._demands(spark, d).collect()]
    out, why = serial_settle(demands, [tuple(r) for r in plans._stock_and_credit(spark, d).collect()])
    got = registry.QUERIES["cart_checkout_fold"](spark, d).collect()
    assert {r.t_id: (r.paid, r.reason) for r in got} == {t: (ok, f"no {why[t].split()[0]}" if t in why else None) for t, ok in out.items()}
    assert {r.reason for r in got} == {None, "no item", "no user"}
    orders = [(r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    capacity = [(f"{k}{i}", len(orders) * (most - i) // 5000) for k, n, most in (("hotel ", 50, 60), ("flight ", 70, 90)) for i in range(n)]
    out, _ = serial_settle([(t, f"{k}{c % n}", 1) for t, c in orders for k, n in (("hotel ", 50), ("flight ", 70))], capacity)
    got = {r.t_id: r.admitted for r in registry.QUERIES["hotel_flight_reservations"](spark, d).collect()}
    assert got == out and set(out.values()) == {True, False}


def test_places_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(50), i) for i in range(200)] + [(0, None, 500), (1, None, 501)]
    d = spark.createDataFrame(rows, "k int, x long, y int")
    got = tx.place(d, ["k"], ["x", "y"], "p", rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, tx.place(d, ["k"], ["x", "y"], "p", rows=7, offsets=True).collect()))
    for k in range(3):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {(r.x, r.y): r.p for r in got if r.k == k} == {m[1:]: i for i, m in enumerate(mine)}
    assert tx.place(spark.createDataFrame([], "k int, x long"), ["k"], ["x"], "p").collect() == []


@pytest.mark.parametrize("lat", [0, 59, 89.98])
def test_nearby_across_the_date_line_and_at_the_pole(spark, lat):
    rng = random.Random(3)
    around = lambda n: [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.3, 0.3))), (180 + rng.uniform(-0.8, 0.8) + 180) % 360 - 180) for i in range(n)]
    searches, hotels = around(30), around(60)
    got = wl.nearby(spark.createDataFrame(searches, "request_id long, lat double, lon double"), spark.createDataFrame(hotels, "hotel long, h_lat double, h_lon double"), 20.0, 4).collect()

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(x)))

    want = {(s[0], h[1]): i + 1 for s in searches for i, h in enumerate(sorted((km(s, h), h[0]) for h in hotels if km(s, h) < 20)[:4])}
    assert {(r.request_id, r.hotel): r["rank"] for r in got} == want and want


def test_greedy_buckets(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(300)) for k in (1, 2, None) for _ in range(60)]
    got = {(r.k, r.start): r.n for r in series.gap_buckets(spark.createDataFrame(rows, "k int, t long"), ["k"], "t", 25).collect()}
    want = Counter()
    for k in (1, 2, None):
        start = None
        for t in sorted(t for x, t in rows if x == k):
            if start is None or t - start > 25:
                start = t
            want[k, start] += 1
    assert got == want


def test_levels_of_a_chain_and_a_diamond(spark):
    links = [(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 4, 3), (1, 5, 4), (2, 9, 8)]
    got = {(r.epoch, r.t_id): r.level for r in tx.fallback_levels(spark.createDataFrame(links, "epoch long, t_id long, depends_on long")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 3, (2, 8): 0, (2, 9): 1}


def test_shares_of_deep_calls(spark):
    """No depth is too much: a chain of nine calls whose last one fans out."""
    chain = [(1, "c0", None)] + [(1, f"c{i}", f"c{i - 1}") for i in range(1, 9)] + [(1, f"d{i}", "c8") for i in range(4)] + [(2, "r", None)]
    got = {r.t_id: (r.leaves, r.share) for r in tx.ack_shares(spark.createDataFrame(chain, "t_id long, call string, parent string")).collect()}
    assert got == {1: (4, 1.0), 2: (1, 1.0)}


def test_seasonal_forecasts_follow_known_series():
    import numpy as np

    from epochal.operators.forecast import snarimax

    t = np.arange(400.0)
    wave = 50 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 24)
    assert np.abs(snarimax(wave[:376], 24, m=24) - wave[376:]).max() < 1.0
    assert np.abs(snarimax(3 * t[:60], 5, m=12) - 3 * t[60:65]).max() < 0.1
    for short in (np.zeros(0), np.array([4.0]), np.array([4.0, 4.0])):
        assert len(snarimax(short, 3)) == 3 and np.isfinite(snarimax(short, 3)).all()


def test_generated_order_entry_tables(spark, tmp_path):
    from epochal.functions.order_entry import order_entry, write_order_entry
    from epochal.sources import files

    size = dict(districts=2, customers=30, items=40, open_orders=9)
    tables = order_entry(spark, 3, **size)
    rows = {n: df.count() for n, df in tables.items()}
    assert {n: rows[n] for n in rows if n != "order_line"} == {"warehouse": 3, "district": 6, "item": 40, "history": 180, "new_order": 54, "order": 180, "customer": 180, "stock": 120}
    orders = tables["order"].collect()
    assert sum(r.o_ol_cnt for r in orders) == rows["order_line"] and all(5 <= r.o_ol_cnt <= 15 for r in orders)
    assert Counter((r.o_w_id, r.o_d_id) for r in orders) == {(w, d): 30 for w in (1, 2, 3) for d in (1, 2)}
    assert len({(r.o_w_id, r.o_d_id, r.o_c_id) for r in orders}) == len({(r.o_w_id, r.o_d_id, r.o_id) for r in orders}) == 180
    assert all((r.o_carrier_id is None) == (r.o_id > 21) for r in orders)
    write_order_entry({n: tables[n] for n in ("district", "stock", "order_line")}, str(tmp_path))
    for n in ("district", "stock", "order_line"):
        back = files.tpcc_csv(spark, f"{tmp_path}/{n}", n)
        assert back.select("key").distinct().count() == rows[n] and sorted(map(str, back.drop("key").collect())) == sorted(map(str, tables[n].collect()))
    assert {r.c_last for r in tables["customer"].select("c_last").filter("c_id = 1").collect()} == {"BARBARBAR"}


def test_auto_regression_against_normal_equations(spark):
    import numpy as np

    from epochal.plans.analytics import hourly

    series = defaultdict(list)
    for r in hourly(spark, f"{DATA}/sf0.001").orderBy("name", "hour").collect():
        series[r.name].append(float(r.total))
    got = {(r.name, r.step): r.predicted for r in registry.QUERIES["forecast_auto_regression"](spark, f"{DATA}/sf0.001").collect()}
    for name, v in series.items():
        y = np.array(v)
        x = np.array([[1.0, *y[t - 4 : t][::-1]] for t in range(4, len(y))])
        w = np.linalg.solve(x.T @ x, x.T @ y[4:])
        past = list(y)
        for step in range(1, 7):
            past.append(min(max(float(w @ [1.0, *past[-4:][::-1]]), 0.0), 1.5 * y.max()))
            assert got[name, step] == pytest.approx(past[-1], rel=1e-4, abs=1e-3)
    assert len(got) == 6 * len(series)


def test_settling_in_rounds_reads_less_each_time(spark, monkeypatch):
    """The rounds alone, without the last fold, equal the serial fold; what is settled isn't read again."""
    rng = random.Random(11)
    demands = [(t, f"r{rng.randrange(9)}", rng.randint(1, 5)) for t in range(1, 150) for _ in range(rng.randint(1, 3))]
    capacity = [(f"r{i}", rng.randint(0, 90)) for i in range(8)]
    real, sizes = wl.saved, []

    def saved(df, name):
        out = real(df, name)
        sizes.extend([out.count()] if name == "demands" else [])
        return out

    monkeypatch.setattr(wl, "saved", saved)
    monkeypatch.setattr(wl, "FOLD", 0)
    done = wl.settle(spark.createDataFrame(demands, "t_id long, resource string, amount long"), spark.createDataFrame(capacity, "resource string, capacity long"))
    out, _ = serial_settle(demands, capacity)
    assert sorted((r.t_id, r.admitted) for r in done.collect()) == sorted(out.items())
    assert sizes[-1] == 0 and sizes[1] < sizes[0] and sizes == sorted(sizes, reverse=True)


def _joined_rows(plan):
    """Rows out of the joins of an executed plan, all told."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _joined_rows(plan.plan())
    rows = plan.metrics().get("numOutputRows")
    own = rows.get().value() if "Join" in name and rows.isDefined() else 0
    return own + sum(_joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_nearby_compares_places_not_rows(spark):
    """Searches from one place and hotels at one place, repeated hotels and requests too, aren't all paired."""
    searches = [(i, 30.0 + i % 3 / 50, 10.0) for i in range(600)] + [(0, 30.06, 10.0), (7, None, 10.0)]
    hotels = [(i, 30.0 + i % 4 / 50, 10.01) for i in range(400)] + [(2, 30.04, 10.01), (2, 30.04, 10.01), (9, None, 10.0)]
    got = wl.nearby(spark.createDataFrame(searches, "request_id long, lat double, lon double"), spark.createDataFrame(hotels, "hotel long, h_lat double, h_lon double"), 5.0, 3)
    rows = got.collect()

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(x)))

    want = Counter()
    for r in {s[0] for s in searches}:
        near = sorted((km(s, h), h[0]) for s in searches for h in hotels if s[0] == r and s[1] is not None and h[1] is not None and km(s, h) < 5)
        want.update((r, h, i + 1) for i, (_, h) in enumerate(near[:3]))
    assert Counter((r.request_id, r.hotel, r["rank"]) for r in rows) == want and want
    assert _joined_rows(got._jdf.queryExecution().executedPlan()) < 5000  # of 240,000 pairs of rows
