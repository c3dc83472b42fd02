"""The ready-made graphs: one request after another, and in epochs on Spark, with the same outcome."""

import json

from epochal.api import LocalRunner, Session
from epochal.graphs import reservations, reviews, shop

REQ = "t_id long, operator string, key string, function string, params string"


def both(spark, graph, calls):
    """Replies and state of a serial run; an epoch a request on Spark must give the same."""
    local = LocalRunner(graph)
    want = local.send_batch(calls)
    s = Session(spark, graph)
    rows = [(i + 1, o, str(k), f, json.dumps(p)) for i, (o, k, f, p) in enumerate(calls)]
    empty = s.state_of(spark.createDataFrame([], "operator string, key string, value string"))
    state, replies = s.run(spark.createDataFrame(rows, REQ), empty, 5)
    got = {r.t_id: (json.loads(r.response) if r.response else None, r.error) for r in replies.collect()}
    assert len(got) == len(calls)
    return want, got, local, {(r.operator, r.key): json.loads(r.value) for r in state.collect()}


def test_shop(spark):
    calls = [("stock", "pen", "create_item", [2]), ("stock", "ink", "create_item", [5]), ("payment", "ann", "create_user", []), ("order", "o1", "create_order", ["ann"]), ("order", "o2", "create_order", ["ann"])]
    calls += [("stock", "pen", "add_stock", [10]), ("payment", "ann", "add_credit", [30]), ("order", "o1", "add_item", ["pen", 3]), ("order", "o2", "add_item", ["ink", 1]), ("stock", "cap", "find_item", [])]
    calls += [("order", "o1", "add_item", ["pen", 1])]
    want, got, local, state = both(spark, shop(), calls)
    assert [w[0] for w in want[:9]] == [got[i + 1][0] for i in range(9)] and want[9][1].startswith("Refused") and got[10][1].startswith("Refused")
    assert state == {k: json.loads(v) for k, v in local.state.items()} and state["order", "o1"]["total"] == 8
    assert local.send_batch([("order", "o1", "checkout", []), ("order", "o2", "checkout", []), ("order", "o1", "checkout", [])])[0] == ("paid", None)
    assert local.get_state("stock", "pen")["stock"] == 6 and local.get_state("payment", "ann")["credit"] == 22
    assert local.get_state("order", "o2")["paid"] is False and local.send_event("order", "o2", "find_order")[0]["items"] == {"ink": 1}


def test_reservations_and_reviews():
    r = LocalRunner(reservations())
    r.send_event("search", "all", "_create_many", [{f"h{i}": {"lat": 40 + i / 100, "lon": 3.0, "rate": i // 2, "price": 9 - i} for i in range(6)}])
    r.send_batch([("hotel", "h1", "create", [{"capacity": 1}]), ("flight", "f1", "create", [{"capacity": 5}]), ("user", "u", "create", [{"digest": "x"}])])
    assert r.send_event("search", "all", "nearby", [40.0, 3.0])[0] == ["h0", "h1", "h2", "h3", "h4"]
    assert [r.send_event("search", "all", "recommend", p)[0] for p in (["dis", 40.03, 3.0], ["rate"], ["price"])] == [["h3"], ["h4", "h5"], ["h5"]]
    assert "Refused" in r.send_event("search", "all", "recommend", ["luck"])[1]
    assert r.send_batch([("user", "u", "login", ["x"]), ("user", "u", "login", ["y"])]) == [(True, None), (False, None)]
    assert r.send_event("order", "1", "reserve", ["h1", "f1"]) == ("reserved", None)
    assert "full" in r.send_event("order", "2", "reserve", ["h1", "f1"])[1]
    assert r.get_state("flight", "f1")["capacity"] == 4 and r.get_state("order", "2") is None
    m = LocalRunner(reviews())
    m.send_batch([("user", "ann", "create", ["u1"]), ("movie", "Up", "create", ["m1"])])
    assert m.send_event("frontend", "7", "compose", ["ann", "Up", 9, "good"])[1] is None
    assert m.send_event("review", "7", "read")[0] == {"text": "good", "review_id": "review-7", "user": "u1", "movie": "m1", "rating": 9}


def test_routes_over_http():
    """The server over a client that runs one request after another."""
    import threading
    import urllib.error
    import urllib.request

    from epochal import rest
    from epochal.client import Response

    class Serial:
        def __init__(self, graph):
            self.graph, self.runner, self.done = graph, LocalRunner(graph), {}

        def send_event(self, operator, key, function, params=()):
            self.graph.function(operator, function)
            self.done[len(self.done)] = Response(str(len(self.done)), *self.runner.send_event(operator, key, function, params), 0.0)
            return len(self.done) - 1

        def get(self, i):
            return self.done[i]

    server = rest.server(Serial(shop()), routes=rest.SHOP)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode()), timeout=10) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    user, item = ask("/payment/create_user", [])[1], ask("/stock/item/create/7", [])[1]
    order = ask(f"/orders/create/{user}", [])[1]
    assert ask(f"/stock/add/{item}/3", []) == (200, 3) and ask(f"/orders/addItem/{order}/{item}/2", []) == (200, 14)
    assert ask(f"/orders/checkout/{order}", [])[0] == 400 and ask(f"/payment/add_funds/{user}/20", []) == (200, 20)
    assert ask(f"/orders/checkout/{order}", []) == (200, "paid") and ask(f"/stock/find/{item}") == (200, {"stock": 1, "price": 7})
    assert ask(f"/stock/{item}/add_stock", [4]) == (200, 5) and ask("/nothing")[0] == 404 and ask(f"/stock/{item}/burn", [])[0] == 404
    server.shutdown()
