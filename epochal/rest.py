"""A front end over HTTP: any function of a client's graph as a route, and named routes beside them.

``POST /<operator>/<key>/<function>`` with a JSON list of parameters runs the
function and answers with its value; ``GET`` does so without parameters. Named
routes give such a call a path of its own. An error of the function is status
400, an unknown route 404.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .api import UnknownFunction
from .client import Client

#: Routes of the shop: path with names in braces, and the call that it makes: operator, key, function, parameters.
SHOP = [
    ("/orders/create/{user}", ("order", "{new}", "create_order", ["{user}"])),
    ("/orders/find/{order}", ("order", "{order}", "find_order", [])),
    ("/orders/addItem/{order}/{item}/{n:int}", ("order", "{order}", "add_item", ["{item}", "{n}"])),
    ("/orders/checkout/{order}", ("order", "{order}", "checkout", [])),
    ("/stock/item/create/{price:int}", ("stock", "{new}", "create_item", ["{price}"])),
    ("/stock/find/{item}", ("stock", "{item}", "find_item", [])),
    ("/stock/add/{item}/{n:int}", ("stock", "{item}", "add_stock", ["{n}"])),
    ("/stock/subtract/{item}/{n:int}", ("stock", "{item}", "remove_stock", ["{n}"])),
    ("/payment/create_user", ("payment", "{new}", "create_user", [])),
    ("/payment/find_user/{user}", ("payment", "{user}", "find_user", [])),
    ("/payment/add_funds/{user}/{n:int}", ("payment", "{user}", "add_credit", ["{n}"])),
    ("/payment/pay/{user}/{n:int}", ("payment", "{user}", "pay", ["{n}"])),
]


class Routes:
    def __init__(self, routes: list[tuple[str, tuple]] = ()):
        self.routes = []
        for path, call in routes:
            numbers = set(re.findall(r"{(\w+):int}", path))
            pattern = re.sub(r"{(\w+)(:int)?}", lambda m: f"(?P<{m[1]}>{'[0-9]+' if m[2] else '[^/]+'})", path)
            self.routes.append((re.compile(pattern + "/?"), numbers, call))

    def call(self, path: str, body: list) -> tuple | None:
        """Operator, key, function and parameters of a path; None if it is no route."""
        for pattern, numbers, (operator, key, function, params) in self.routes:
            if m := pattern.fullmatch(path):
                given = {k: int(v) if k in numbers else v for k, v in m.groupdict().items()} | {"new": uuid.uuid4().hex}
                fill = lambda x, given=given: given.get(x[1:-1], x) if isinstance(x, str) and x.startswith("{") else x
                return operator, fill(key), function, [fill(p) for p in params]
        parts = path.strip("/").split("/")
        return (*parts, body) if len(parts) == 3 else None


def server(client: Client, port: int = 0, routes: list[tuple[str, tuple]] = ()) -> ThreadingHTTPServer:
    """A server that isn't running yet: ``serve_forever`` starts it. Requests go through the client one batch at a time."""
    table, one = Routes(routes), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body: list) -> None:
            call = table.call(self.path, body)
            status, value = 404, {"error": "no such route"}
            if call is not None:
                try:
                    with one:
                        r = client.get(client.send_event(*call))
                    status, value = (400, {"error": r.error}) if r.error else (200, r.value)
                except UnknownFunction as e:
                    value = {"error": f"no such function: {e}"}
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer([])

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self.answer(json.loads(raw) if raw else [])

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
