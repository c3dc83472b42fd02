"""The classic workloads as declarative plans over keyed state."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_KM, haversine_km
from ..storage import discard, saved
from .transactions import running


#: Rows that ``settle`` folds in one task.
FOLD = 1 << 18


# --- accounts ------------------------------------------------------------------


def transfer_events(transfers: DataFrame) -> DataFrame:
    """A debit and a credit of one for each transfer ``(t_id, src, dst)``."""
    return transfers.select("t_id", F.explode(F.array(F.struct(F.col("src").alias("key"), F.lit(-1).alias("delta")), F.struct(F.col("dst").alias("key"), F.lit(1).alias("delta")))).alias("e")).select("t_id", "e.*")


def balances(opening: DataFrame, events: DataFrame) -> DataFrame:
    """Closing balance of each key."""
    change = events.groupBy("key").agg(F.sum("delta").alias("change"))
    return opening.join(change, "key", "left").select("key", (F.col("balance") + F.coalesce("change", F.lit(0))).alias("value"))


def overdrafts(opening: DataFrame, events: DataFrame) -> DataFrame:
    """Events after which a key's running balance is negative."""
    run = F.sum("delta").over(Window.partitionBy("key").orderBy("t_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("run", run).join(opening, "key").filter(F.col("balance") + F.col("run") < 0).select("t_id", "key")


# --- orders and payments ----------------------------------------------------------


def stock_fold(lines: DataFrame, stock: DataFrame, order: list[str]) -> DataFrame:
    """Stock after all lines of each item in order: below ten left it is filled up by 91."""

    def step(q: Column, r: Column) -> Column:
        return F.when(q >= r["qty"] + 10, q - r["qty"]).otherwise(q + 91 - r["qty"])

    rows = F.array_sort(F.collect_list(F.struct(*order, F.col("qty"))))
    g = lines.groupBy("item").agg(rows.alias("rows"), F.sum("qty").alias("ytd"), F.count("*").alias("order_cnt"), F.sum(F.col("remote").cast("long")).alias("remote_cnt"))
    return stock.join(g, "item").select("item", F.aggregate("rows", F.col("quantity"), step).alias("quantity"), "ytd", "order_cnt", "remote_cnt")


def allocate_ids(requests: DataFrame, by: str, order: list[str], first: str) -> DataFrame:
    """Next numbers of each district in commit order: the stored number and the counter after it."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long") - 1
    return requests.withColumn("o_id", F.col(first) + i).withColumn("d_next_o_id", F.col("o_id") + 1)


def middle_by_name(customers: DataFrame, by: list[str], order: list[str], pick: str) -> DataFrame:
    """Secondary index: of the customers with one name, sorted, the middle one."""
    g = customers.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, pick))).alias("k"))
    return g.select(*by, F.element_at("k", (F.floor((F.size("k") - 1) / 2) + 1).cast("int"))[pick].alias(pick), F.size("k").cast("long").alias("n"))


def prefixed_text(rows: DataFrame, key: str, order: str, text: str, limit: int) -> DataFrame:
    """Each row's text put before the last, cut to ``limit``: the reversed concatenation, cut once."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("t"))
    return g.select(key, F.substring(F.array_join(F.reverse(F.transform("t", lambda x: x[text])), "|"), 1, limit).alias("data"))


# --- reservations ---------------------------------------------------------------------


def nearby(searches: DataFrame, hotels: DataFrame, km: float, n: int) -> DataFrame:
    """The ``n`` nearest hotels within ``km`` of each search.

    Both sides are dealt to cells of latitude and longitude at least ``km`` high;
    a search meets the hotels of its own and the neighbouring cells: towards the
    poles, where meridians lie closer, of as many as its radius spans. Places are
    compared, not rows: searches from one place are answered once, and of hotels
    at one place only the ``n`` least can be among the nearest.
    """
    height = km / 111.0
    around = max(1, int(360 / height))
    row = lambda lat: F.floor(F.col(lat) / height)
    column = lambda lon: F.floor((lon + 180) * around / 360)
    ratio = F.lit(math.sin(km / EARTH_KM)) / F.cos(F.radians(F.col("lat")))
    reach = F.when(ratio < 1, F.degrees(F.asin(ratio)) + 1e-9).otherwise(F.lit(180.0))
    lon = F.col("lon")
    columns = F.array_distinct(F.transform(F.sequence(column(lon - reach), column(lon + reach)), lambda c: F.pmod(c, F.lit(around))))
    places = searches.select("lat", "lon").distinct()
    near = places.withColumn("row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: row("lat") + i))).withColumn("column", F.explode(columns))
    hotels = hotels.withColumn("rank", F.row_number().over(Window.partitionBy("h_lat", "h_lon").orderBy("hotel"))).filter(F.col("rank") <= n).drop("rank")
    pairs = near.join(hotels.withColumns({"row": row("h_lat"), "column": F.pmod(column(F.col("h_lon")), F.lit(around))}), ["row", "column"])
    pairs = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("h_lat"), F.col("h_lon"))).filter(F.col("km") < km)
    ranked = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("km", "hotel"))).filter(F.col("rank") <= n)
    best = ranked(pairs, "lat", "lon").groupBy("lat", "lon").agg(F.collect_list(F.struct("hotel", "km")).alias("best"))
    found = searches.join(best, ["lat", "lon"]).select("request_id", F.inline("best"))
    return ranked(found, "request_id").select("request_id", "hotel", "rank", "km")  # again, as a request may repeat


def admit(requests: DataFrame, key: str, order: str, capacity: str) -> DataFrame:
    """Requests that get one of a key's places, in order."""
    return requests.withColumn("admitted", F.row_number().over(Window.partitionBy(key).orderBy(order)) <= F.col(capacity))


def settle(demands: DataFrame, capacity: DataFrame) -> DataFrame:
    """``(t_id, admitted)``: requests that get all of their ``demands (t_id, resource, amount)``, in t_id order, or nothing.

    The result of the serial fold over ``capacity (resource, capacity)``, found
    in rounds. A request is in when its demands fit even if all undecided ones
    before it get theirs, and out when one doesn't fit beside those that are in.
    Each round settles the least undecided request at least, and all that don't
    hang on an undecided one; it is a written table without what the rounds after
    it needn't read: requests that are out, and resources that nobody waits for.
    What lies before the first that waits is summed up. The last ``FOLD`` rows
    are folded in order. Running sums are dealt to buckets, so a resource that
    all want needs no task of its own.
    """
    d = demands.groupBy("t_id", "resource").agg(F.sum("amount").alias("amount")).join(capacity, "resource", "left")
    d = saved(d.select("t_id", "resource", "amount", F.coalesce("capacity", F.lit(0)).alias("capacity"), F.lit(None).cast("boolean").alias("state")), "demands")
    done, kind = [], dict(d.dtypes)["t_id"]
    key = pa.int32() if kind == "int" else pa.int64()
    while d.count() > FOLD:
        sums = {"taken": F.when(F.col("state"), F.col("amount")).otherwise(0), "open": F.when(F.col("state").isNull(), F.col("amount")).otherwise(0)}
        r = running(d, ["resource"], ["t_id"], sums).filter("state IS NULL")
        left = F.col("capacity") - F.col("taken") - F.col("amount")
        out = r.groupBy("t_id").agg(F.bool_and(left - F.col("open") >= 0).alias("fits"), F.bool_or(left < 0).alias("lacks"))
        out = saved(out.filter("fits OR lacks").select("t_id", F.col("fits").alias("admitted")), "settled")
        done.append(out)
        now = saved(d.join(out, "t_id", "left").withColumn("state", F.coalesce("state", "admitted")).drop("admitted").filter("state IS NULL OR state"), "demands")
        waits = now.filter("state IS NULL").groupBy("resource").agg(F.min("t_id").alias("first"))
        later = F.when(F.col("state").isNull() | (F.col("t_id") > F.col("first")), F.col("t_id"))
        rest = now.join(waits, "resource").groupBy("resource", later.alias("later"), "capacity", "state").agg(F.min("t_id").alias("t_id"), F.sum("amount").alias("amount"))
        before, d = d, saved(rest.select("t_id", "resource", "amount", "capacity", "state"), "demands")
        discard(before, now)

    def fold(batches):
        """The rest in order; demands of requests that are in already are there, too."""
        wants, settled, left = defaultdict(list), set(), {}
        for b in batches:
            for t, resource, amount, most, state in zip(*(c.to_pylist() for c in b.columns)):
                wants[t].append((resource, amount or 0))
                left[resource] = most
                if state:
                    settled.add(t)
        out = {}
        for t in sorted(wants):
            ok = t in settled or all(left[r] >= x for r, x in wants[t])
            if t not in settled:
                out[t] = ok
            for r, x in wants[t] if ok else ():
                left[r] -= x
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()).cast(key), pa.array(list(out.values()), pa.bool_())], names=["t_id", "admitted"])

    done.append(saved(d.coalesce(1).mapInArrow(fold, f"t_id {kind}, admitted boolean"), "settled"))
    discard(d)
    return reduce(DataFrame.unionByName, done)


def lacking(demands: DataFrame, capacity: DataFrame, settled: DataFrame) -> DataFrame:
    """``(t_id, resource)``: the least resource that each request left out couldn't have."""
    d = demands.groupBy("t_id", "resource").agg(F.sum("amount").alias("amount")).join(capacity, "resource", "left").join(settled, "t_id")
    r = running(d, ["resource"], ["t_id"], {"taken": F.when(F.col("admitted"), F.col("amount")).otherwise(0)})
    short = r.filter(~F.col("admitted") & (F.coalesce("capacity", F.lit(0)) - F.col("taken") < F.col("amount")))
    return short.groupBy("t_id").agg(F.min("resource").alias("resource"))


# --- composition and carts --------------------------------------------------------------


def merge_attributes(rows: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row a key with an attribute a column, from rows of single attributes."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def cart_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order").agg(F.sum("qty").alias("items"), F.sum(F.col("qty") * F.col("price")).alias("total"))
