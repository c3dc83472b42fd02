"""Ready-made graphs of functions: a shop with carts, reservations of rooms and flights, and reviews put together from parts."""

from __future__ import annotations

import math

from .api import Graph, Operator
from .functions.columns import EARTH_KM


class Refused(Exception):
    """A function can't do what it is asked to; the whole request is undone."""


def _known(ctx, what: str):
    value = ctx.get()
    if value is None:
        raise Refused(f"no such {what}: {ctx.key}")
    return value


def _create_many(ctx, rows: dict) -> int:
    ctx.batch_insert(rows)
    return len(rows)


def _operator(name: str, partitions: int, *functions) -> Operator:
    o = Operator(name, partitions)
    for f in functions:
        o.register(f)
    return o


# --- a shop ------------------------------------------------------------------------


def shop(partitions: int = 4) -> Graph:
    """Operators ``stock``, ``payment`` and ``order``; a checkout takes all items and the credit, or nothing."""

    def create_item(ctx, price):
        ctx.put({"stock": 0, "price": price})
        return ctx.key

    def add_stock(ctx, amount):
        item = _known(ctx, "item")
        item["stock"] += amount
        ctx.put(item)
        return item["stock"]

    def remove_stock(ctx, amount):
        item = _known(ctx, "item")
        if item["stock"] < amount:
            raise Refused(f"item {ctx.key} has {item['stock']}, not {amount}")
        item["stock"] -= amount
        ctx.put(item)

    def price_for_order(ctx, order, amount):
        ctx.call_remote_async("order", "take_in", order, [ctx.key, amount, _known(ctx, "item")["price"]])

    def find_item(ctx):
        return _known(ctx, "item")

    def create_user(ctx):
        ctx.put({"credit": 0})
        return ctx.key

    def add_credit(ctx, amount):
        user = _known(ctx, "user")
        user["credit"] += amount
        ctx.put(user)
        return user["credit"]

    def pay(ctx, amount):
        user = _known(ctx, "user")
        if user["credit"] < amount:
            raise Refused(f"user {ctx.key} has {user['credit']}, not {amount}")
        user["credit"] -= amount
        ctx.put(user)

    def find_user(ctx):
        return _known(ctx, "user")

    def create_order(ctx, user):
        ctx.put({"user": user, "items": {}, "total": 0, "paid": False})
        return ctx.key

    def find_order(ctx):
        return _known(ctx, "order")

    def add_item(ctx, item, amount):
        _known(ctx, "order")
        ctx.call_remote_async("stock", "price_for_order", item, [ctx.key, amount])

    def take_in(ctx, item, amount, price):
        order = _known(ctx, "order")
        order["items"][item] = order["items"].get(item, 0) + amount
        order["total"] += amount * price
        ctx.put(order)
        return order["total"]

    def checkout(ctx):
        order = _known(ctx, "order")
        if order["paid"]:
            raise Refused(f"order {ctx.key} is paid")
        for item, amount in order["items"].items():
            ctx.call_remote_async("stock", "remove_stock", item, [amount])
        ctx.call_remote_async("payment", "pay", order["user"], [order["total"]])
        order["paid"] = True
        ctx.put(order)
        return "paid"

    many = _create_many
    return Graph("shop").add_operators(
        _operator("stock", partitions, create_item, add_stock, remove_stock, price_for_order, find_item, many),
        _operator("payment", partitions, create_user, add_credit, pay, find_user, many),
        _operator("order", partitions, create_order, find_order, add_item, take_in, checkout, many),
    )


# --- reservations -----------------------------------------------------------------------


def _km(a: dict, lat: float, lon: float) -> float:
    la, lb = math.radians(a["lat"]), math.radians(lat)
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(lon - a["lon"]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def reservations(partitions: int = 4, nearest: int = 5, radius_km: float = 10.0) -> Graph:
    """Operators ``hotel``, ``flight``, ``order``, ``user`` and ``search``; a reservation takes a room and a seat, or neither."""

    def create(ctx, value):
        ctx.put(value)
        return ctx.key

    def take_place(ctx):
        place = _known(ctx, ctx.operator)
        if place["capacity"] < 1:
            raise Refused(f"{ctx.operator} {ctx.key} is full")
        place["capacity"] -= 1
        ctx.put(place)

    def reserve(ctx, hotel, flight):
        ctx.put({"hotel": hotel, "flight": flight})
        ctx.call_remote_async("hotel", "take_place", hotel)
        ctx.call_remote_async("flight", "take_place", flight)
        return "reserved"

    def login(ctx, digest):
        return _known(ctx, "user")["digest"] == digest

    def nearby(ctx, lat, lon):
        """Of the places in this key's partition, the nearest within the radius."""
        near = sorted((d, k) for k, v in ctx.data.items() if (d := _km(v, lat, lon)) < radius_km)
        return [k for _, k in near[:nearest]]

    def recommend(ctx, by, lat=0.0, lon=0.0):
        """All of the best by distance, rate or price."""
        score = {"dis": lambda v: _km(v, lat, lon), "rate": lambda v: -v["rate"], "price": lambda v: v["price"]}.get(by)
        if score is None:
            raise Refused(f"no recommendation by {by}")
        rated = {k: score(v) for k, v in ctx.data.items()}
        return sorted(k for k, x in rated.items() if x == min(rated.values()))

    many = _create_many
    return Graph("reservations").add_operators(_operator("hotel", partitions, create, take_place, many), _operator("flight", partitions, create, take_place, many), _operator("order", partitions, reserve), _operator("user", partitions, create, login, many), _operator("search", 1, create, nearby, recommend, many))


# --- reviews ---------------------------------------------------------------------------------


def reviews(partitions: int = 4) -> Graph:
    """Operators ``frontend``, ``user``, ``movie`` and ``review``: a review is put together from parts that come by different ways."""

    def compose(ctx, user, title, rating, text):
        ctx.call_remote_async("user", "send_user", user, [ctx.key])
        ctx.call_remote_async("movie", "send_movie", title, [ctx.key, rating])
        ctx.call_remote_async("review", "part", ctx.key, ["text", text])
        ctx.call_remote_async("review", "part", ctx.key, ["review_id", f"review-{ctx.key}"])
        return ctx.key

    def create(ctx, value):
        ctx.put(value)
        return ctx.key

    def send_user(ctx, review):
        ctx.call_remote_async("review", "part", review, ["user", _known(ctx, "user")])

    def send_movie(ctx, review, rating):
        ctx.call_remote_async("review", "part", review, ["movie", _known(ctx, "movie")])
        ctx.call_remote_async("review", "part", review, ["rating", rating])

    def part(ctx, name, value):
        ctx.put({**(ctx.get() or {}), name: value})

    def read(ctx):
        return _known(ctx, "review")

    many = _create_many
    return Graph("reviews").add_operators(_operator("frontend", partitions, compose), _operator("user", partitions, create, send_user, many), _operator("movie", partitions, create, send_movie, many), _operator("review", partitions, part, read))
