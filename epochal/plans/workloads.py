"""Queries of the workloads: accounts, orders and payments, reservations, reviews, carts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import analytics as an
from ..operators import workloads as wl
from ..storage import saved, table
from . import bindings as b
from .registry import query

OPENING = 1_000_000


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("key")).withColumn("balance", F.lit(OPENING).cast("long"))


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    r = b.requests(spark, d)
    return r.filter("function = 'purchase' AND key <> other").select("t_id", F.col("key").alias("src"), F.col("other").alias("dst"))


_BAL = "WITH " + b.SQL_REQ + ", ev AS (SELECT t_id, key, -1 AS delta FROM req WHERE function = 'purchase' AND key <> other UNION ALL SELECT t_id, other, 1 FROM req WHERE function = 'purchase' AND key <> other), bal AS (SELECT k AS key, 1000000 + coalesce((SELECT sum(delta) FROM ev WHERE ev.key = k), 0) AS value FROM (SELECT unnest(range((SELECT n FROM n))) AS k))"


@query(_BAL + " SELECT key, CAST(value AS BIGINT) AS value FROM bal")
def ycsb_final_balances(spark: SparkSession, d: str) -> DataFrame:
    return wl.balances(_users(spark, d), wl.transfer_events(_transfers(spark, d)))


@query(_BAL + " SELECT count(*) AS keys, CAST(sum(value) AS BIGINT) AS total, count(*) * 1000000 AS expected, sum(value) = count(*) * 1000000 AS consistent FROM bal")
def ycsb_conservation(spark: SparkSession, d: str) -> DataFrame:
    return an.conserved(ycsb_final_balances(spark, d), "value", OPENING)


@query(_BAL + ", o AS (SELECT key, value + CASE WHEN key % 10 = 3 THEN 1 ELSE 0 END AS value FROM bal WHERE key % 10 <> 7) SELECT key, CAST(b.value AS BIGINT) AS expected, CAST(o.value AS BIGINT) AS observed, CASE WHEN o.value IS NULL THEN 'missing' WHEN b.value IS NULL THEN 'unexpected' ELSE 'wrong' END AS problem FROM bal b FULL JOIN o USING (key) WHERE o.value IS NULL OR b.value IS NULL OR o.value <> b.value")
def ycsb_state_diff(spark: SparkSession, d: str) -> DataFrame:
    expected = ycsb_final_balances(spark, d)
    observed = expected.filter("key % 10 <> 7").withColumn("value", F.col("value") + F.when(F.col("key") % 10 == 3, 1).otherwise(0))
    return an.state_diff(expected, observed)


@query("WITH " + b.SQL_REQ + " SELECT key, count(*) AS updates, 1000000 + count(*) AS value FROM req WHERE function = 'signup' GROUP BY key")
def ycsb_update_counts(spark: SparkSession, d: str) -> DataFrame:
    return b.requests(spark, d).filter("function = 'signup'").groupBy("key").agg(F.count("*").alias("updates")).withColumn("value", F.col("updates") + OPENING)


@query(_BAL + ", rd AS (SELECT request_id, key FROM req WHERE function IN ('click', 'view')) SELECT request_id, key, CAST(value AS BIGINT) AS value FROM rd JOIN bal USING (key)")
def ycsb_point_reads(spark: SparkSession, d: str) -> DataFrame:
    return b.requests(spark, d).filter("function IN ('click', 'view')").join(ycsb_final_balances(spark, d), "key").select("request_id", "key", "value")


@query("WITH e AS (SELECT c_custkey AS key, o_orderkey AS t_id, -CAST(round(o_totalprice) AS BIGINT) AS delta, CAST(round(c_acctbal) AS BIGINT) * 1000 AS balance FROM orders JOIN customer ON o_custkey = c_custkey) SELECT t_id, key FROM (SELECT *, sum(delta) OVER (PARTITION BY key ORDER BY t_id) AS run FROM e) WHERE balance + run < 0")
def overdraft_aborts(spark: SparkSession, d: str) -> DataFrame:
    opening = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.round("c_acctbal").cast("long") * 1000).alias("balance"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("t_id"), F.col("o_custkey").alias("key"), (-F.round("o_totalprice").cast("long")).alias("delta"))
    return wl.overdrafts(opening, events)


_LINE_ORDER = ["t_id", "line", "supp", "price", "ship", "qty", "disc"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("t_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("ship"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_discount").alias("disc"))


_DEC = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(f"WITH t AS (SELECT l_orderkey, sum({_DEC}) AS amount, count(*) AS n, bool_and(s_nationkey = c_nationkey) AS all_local, any_value(c_nationkey) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey) SELECT l_orderkey AS t_id, CAST(n AS BIGINT) AS lines, all_local, CAST(CAST(amount AS DECIMAL(18,2)) * (900 * (1000 + 10 * (w % 10) + 2 * (w % 5))) AS DOUBLE) / 1000000 AS total FROM t")
def tpcc_new_order_totals(spark: SparkSession, d: str) -> DataFrame:
    """Lines gathered with warehouse (nation), district (region) and customer; total with discount and taxes."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("t_id"), F.col("c_nationkey").alias("w"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("from_w"))
    g = _lines(spark, d).join(o, "t_id").join(sup, "supp").groupBy("t_id").agg(F.sum(F.col("price").cast("decimal(18,2)")).alias("amount"), F.count("*").alias("lines"), F.bool_and(F.col("from_w") == F.col("w")).alias("all_local"), F.first("w").alias("w"))
    factor = F.lit(900) * (F.lit(1000) + 10 * (F.col("w") % 10) + 2 * (F.col("w") % 5))  # discount and taxes in millionths
    return g.select("t_id", "lines", "all_local", ((F.col("amount").cast("decimal(18,2)") * factor).cast("double") / 1_000_000).alias("total"))


@query("SELECT o_orderkey AS t_id, CAST(c_nationkey AS BIGINT) AS district, 3001 + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS o_id, 3001 + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS d_next_o_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 100 <> 0")
def tpcc_order_id_allocation(spark: SparkSession, d: str) -> DataFrame:
    """One in a hundred orders aborts and takes no number."""
    o = table(spark, d, "orders").filter("o_orderkey % 100 <> 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("o_orderkey").alias("t_id"), F.col("c_nationkey").cast("long").alias("district"), F.lit(3001).cast("long").alias("first"))
    return wl.allocate_ids(o, "district", ["t_id"], "first").select("t_id", "district", "o_id", "d_next_o_id")


@query("""WITH RECURSIVE l AS (SELECT l_partkey AS item, CAST(l_quantity AS BIGINT) AS qty, l_suppkey % 2 = 1 AS remote, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount) AS rn FROM lineitem),
r(item, rn, q) AS (SELECT p_partkey, CAST(0 AS BIGINT), CAST(p_size AS BIGINT) FROM part UNION ALL SELECT r.item, l.rn, CASE WHEN q >= qty + 10 THEN q - qty ELSE q + 91 - qty END FROM r JOIN l ON l.item = r.item AND l.rn = r.rn + 1)
SELECT r.item, arg_max(q, r.rn) AS quantity, any_value(a.ytd) AS ytd, any_value(a.c) AS order_cnt, any_value(a.rc) AS remote_cnt FROM r JOIN (SELECT item, CAST(sum(qty) AS BIGINT) AS ytd, count(*) AS c, count(*) FILTER (remote) AS rc FROM l GROUP BY item) a ON a.item = r.item GROUP BY r.item""")
def tpcc_stock_fold(spark: SparkSession, d: str) -> DataFrame:
    stock = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("long").alias("quantity"))
    return wl.stock_fold(_lines(spark, d).withColumn("remote", F.col("supp") % 2 == 1), stock, ["t_id", "line", "supp", "price", "ship"])


@query("SELECT l_orderkey AS t_id, l_partkey AS item, CASE WHEN p_partkey IS NULL THEN 'item missing' ELSE 'ok' END AS outcome, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 100 <> 7) ON l_partkey = p_partkey GROUP BY ALL")
def tpcc_missing_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of every order."""
    items = table(spark, d, "part").filter("p_partkey % 100 <> 7").select(F.col("p_partkey").alias("item"), F.lit("ok").alias("ok"))
    return _lines(spark, d).join(items, "item", "left").groupBy("t_id", "item", F.coalesce("ok", F.lit("item missing")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS warehouse, n_regionkey AS district, count(*) AS payments, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ytd FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def tpcc_payment_ytd(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.groupBy(F.col("c_nationkey").alias("warehouse"), F.col("n_regionkey").alias("district")).agg(F.count("*").alias("payments"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("ytd"))


@query("SELECT c_custkey AS customer, count(o_orderkey) AS payment_cnt, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS ytd, CAST(CAST(any_value(c_acctbal) AS DECIMAL(18,2)) - coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS balance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def tpcc_customer_payments(spark: SparkSession, d: str) -> DataFrame:
    paid = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    c = table(spark, d, "customer").join(paid, "c_custkey", "left")
    t = F.coalesce("t", F.lit(0).cast("decimal(28,2)"))
    return c.select(F.col("c_custkey").alias("customer"), F.coalesce("n", F.lit(0)).cast("long").alias("payment_cnt"), t.cast("double").alias("ytd"), (F.col("c_acctbal").cast("decimal(18,2)") - t).cast("double").alias("balance"))


@query("SELECT c_nationkey, c_mktsegment AS name, list_sort(list((c_name, c_custkey)))[(count(*) - 1) // 2 + 1][2] AS customer, count(*) AS n FROM customer GROUP BY ALL")
def tpcc_customer_by_name_middle(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("name"), "c_name", F.col("c_custkey").alias("customer"))
    return wl.middle_by_name(c, ["c_nationkey", "name"], ["c_name"], "customer")


@query("SELECT o_custkey AS customer, substr(string_agg(o_orderkey || ' ' || o_orderpriority, '|' ORDER BY o_orderkey DESC), 1, 500) AS data FROM orders GROUP BY 1")
def tpcc_bad_credit_data(spark: SparkSession, d: str) -> DataFrame:
    """The data as it is stored; a payment's reply shows the first 200 characters."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("entry"))
    return wl.prefixed_text(o, "customer", "o_orderkey", "entry", 500)


@query("SELECT o_custkey AS customer, max(o_orderkey) AS last_order, count(*) AS history FROM orders GROUP BY 1")
def tpcc_history_latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max("o_orderkey").alias("last_order"), F.count("*").alias("history"))


@query("SELECT l_orderkey AS t_id, printf('%d:%.2f', l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)) AS reply FROM lineitem GROUP BY 1")
def tpcc_reply_pack(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("t_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("t"))
    return g.select("t_id", F.format_string("%d:%.2f", "t_id", "t").alias("reply"))


_HOTEL = "ho AS (SELECT s_suppkey AS hotel, 30 + (s_suppkey * 37 % 1000) / 5000.0 AS h_lat, 10 + (s_suppkey * 91 % 1000) / 5000.0 AS h_lon FROM supplier), sr AS (SELECT event_id AS request_id, 30 + (event_id * 13 % 1000) / 5000.0 AS lat, 10 + (event_id * 29 % 1000) / 5000.0 AS lon FROM events WHERE event_type = 'view'), di AS (SELECT request_id, hotel, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(h_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(h_lat)) * pow(sin((radians(h_lon) - radians(lon)) / 2), 2)))) AS km FROM sr, ho)"


def _hotels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("hotel"), (F.lit(30) + (F.col("s_suppkey") * 37 % 1000) / F.lit(5000.0)).alias("h_lat"), (F.lit(10) + (F.col("s_suppkey") * 91 % 1000) / F.lit(5000.0)).alias("h_lon"))


def _searches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.select(F.col("event_id").alias("request_id"), (F.lit(30) + (F.col("event_id") * 13 % 1000) / F.lit(5000.0)).alias("lat"), (F.lit(10) + (F.col("event_id") * 29 % 1000) / F.lit(5000.0)).alias("lon"))


@query(f"WITH {_HOTEL} SELECT request_id, hotel, CAST(row_number() OVER (PARTITION BY request_id ORDER BY km, hotel) AS INTEGER) AS rank, round(km, 4) AS km FROM di WHERE km < 10 QUALIFY rank <= 5")
def hotel_nearby_top5(spark: SparkSession, d: str) -> DataFrame:
    return wl.nearby(_searches(spark, d), _hotels(spark, d), 10.0, 5).withColumn("km", F.round("km", 4))


@query(f"WITH {_HOTEL}, t AS (SELECT request_id, hotel FROM di WHERE km < 10 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY km, hotel) <= 5) SELECT DISTINCT request_id, hotel FROM t WHERE hotel IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def hotel_rates_semi(spark: SparkSession, d: str) -> DataFrame:
    rated = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("hotel"))
    return hotel_nearby_top5(spark, d).join(rated, "hotel", "left_semi").select("request_id", "hotel").distinct()


@query("SELECT p_type AS kind, p_partkey AS hotel, p_size AS rate FROM part QUALIFY rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) = 1")
def hotel_recommend_rate_ties(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("hotel"), F.col("p_size").alias("rate"))
    return an.extremes(p, ["kind"], "rate", largest=True)


@query("SELECT p_type AS kind, p_partkey AS hotel, p_retailprice AS price FROM part QUALIFY rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) = 1")
def hotel_recommend_price_ties(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("hotel"), F.col("p_retailprice").alias("price"))
    return an.extremes(p, ["kind"], "price")


@query("SELECT o_orderkey AS request_id, o_custkey AS hotel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 + o_custkey % 5 AS admitted FROM orders")
def hotel_capacity_admission(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("hotel"), (F.lit(3) + F.col("o_custkey") % 5).alias("capacity"))
    return wl.admit(o, "hotel", "request_id", "capacity").select("request_id", "hotel", "admitted")


@query("SELECT event_id AS request_id, sha256(CAST(user_id AS VARCHAR)) = sha256(CAST(CASE WHEN event_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR)) AS ok FROM events WHERE event_type = 'click'")
def user_login_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stored = e.select("user_id").distinct().withColumn("password", F.sha2(F.col("user_id").cast("string"), 256))
    given = e.filter("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", F.sha2(F.when(F.col("event_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string"), 256).alias("given"))
    return given.join(stored, "user_id").select("request_id", (F.col("given") == F.col("password")).alias("ok"))


@query("SELECT conv_id, max(text) FILTER (role = 'system') AS \"system\", max(text) FILTER (role = 'user') AS \"user\", max(text) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def review_compose_merge(spark: SparkSession, d: str) -> DataFrame:
    return wl.merge_attributes(table(spark, d, "conversations"), "conv_id", "role", "text", ["system", "user", "assistant"])


@query("SELECT l_orderkey AS \"order\", CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS items, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def cart_totals(spark: SparkSession, d: str) -> DataFrame:
    price = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    c = wl.cart_totals(_lines(spark, d).withColumnRenamed("t_id", "order").drop("price").join(price, "item"))
    return c.select("order", "items", F.col("total").cast("double").alias("total"))


@query("SELECT l_orderkey AS \"order\", l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ALL")
def cart_item_quantities(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(F.col("t_id").alias("order"), "item").agg(F.sum("qty").alias("qty"))


def _demands(spark: SparkSession, d: str) -> DataFrame:
    """What a checkout takes: stock of its items, and credit of its user in whole units."""
    o = table(spark, d, "orders")
    stock = _lines(spark, d).select("t_id", F.concat(F.lit("item "), F.col("item").cast("string")).alias("resource"), F.col("qty").alias("amount"))
    return stock.unionByName(o.select(F.col("o_orderkey").alias("t_id"), F.concat(F.lit("user "), F.col("o_custkey").cast("string")).alias("resource"), F.round("o_totalprice").cast("long").alias("amount")))


def _stock_and_credit(spark: SparkSession, d: str) -> DataFrame:
    stock = table(spark, d, "part").select(F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("resource"), (F.col("p_size") * 25).cast("long").alias("capacity"))
    return stock.unionByName(table(spark, d, "customer").select(F.concat(F.lit("user "), F.col("c_custkey").cast("string")).alias("resource"), F.greatest(F.lit(0), F.round("c_acctbal").cast("long") * 300).alias("capacity")))


@query()
def cart_checkout_fold(spark: SparkSession, d: str) -> DataFrame:
    """Checkouts of the whole run, in order, over stock and credit that they share: all of a cart is taken, or nothing.

    Without SQL, as each decision hangs on all before it; the tests hold it
    against a serial fold.
    """
    demands, capacity = _demands(spark, d), _stock_and_credit(spark, d)
    done = saved(wl.settle(demands, capacity), "checkouts")
    return done.join(wl.lacking(demands, capacity, done), "t_id", "left").select("t_id", F.col("admitted").alias("paid"), F.concat(F.lit("no "), F.split_part("resource", F.lit(" "), F.lit(1))).alias("reason"))


@query()
def hotel_flight_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Orders that get a room and a seat, or neither; the tests hold it against a serial fold."""
    o = table(spark, d, "orders")
    place = lambda kind, column: F.struct(F.concat(F.lit(kind), column.cast("string")).alias("resource"))
    demands = o.select(F.col("o_orderkey").alias("t_id"), F.explode(F.array(place("hotel ", F.col("o_custkey") % 50), place("flight ", F.col("o_custkey") % 70))).alias("x")).select("t_id", "x.resource", F.lit(1).cast("long").alias("amount"))
    n = o.agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("hotel ", 50, 60), ("flight ", 70, 90)], "kind string, k int, most int")
    capacity = kinds.crossJoin(n).select(F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.concat("kind", i.cast("string")).alias("resource"), F.floor(F.col("n") * (F.col("most") - i) / 5000).alias("capacity")))).alias("x")).select("x.*")  # 120 resources
    return wl.settle(demands, capacity)


@query("SELECT o_custkey AS \"user\", CAST(any_value(greatest(0, CAST(round(c_acctbal) AS BIGINT))) + sum(1 + o_orderkey % 9) AS BIGINT) AS credit, count(*) AS payments FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def cart_add_credit(spark: SparkSession, d: str) -> DataFrame:
    """Users as they were created, and the credit added to them since."""
    created = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.greatest(F.lit(0), F.round("c_acctbal").cast("long")).alias("balance"))
    added = table(spark, d, "orders").select(F.col("o_orderkey").alias("t_id"), F.col("o_custkey").alias("key"), (1 + F.col("o_orderkey") % 9).alias("delta"))
    n = added.groupBy("key").agg(F.count("*").alias("payments"))
    return wl.balances(created, added).join(n, "key").select(F.col("key").alias("user"), F.col("value").alias("credit"), "payments")


@query("SELECT l_orderkey AS t_id, l_partkey AS item, coalesce(p_size * 25, 0) AS stock, coalesce(p_size * 25, 0) >= CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS enough FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey, p_size")
def cart_find_stock(spark: SparkSession, d: str) -> DataFrame:
    """Stock of each order's items as it was created, and whether it is enough."""
    stock = table(spark, d, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") * 25).alias("stock"))
    g = _lines(spark, d).groupBy("t_id", "item").agg(F.sum("qty").alias("qty")).join(stock, "item", "left")
    return g.select("t_id", "item", F.coalesce("stock", F.lit(0)).alias("stock"), (F.coalesce("stock", F.lit(0)) >= F.col("qty")).alias("enough"))


_U = lambda seed, c="event_id": f"(CAST(CAST('0x' || substr(md5('{seed}:' || {c}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"
_NU = lambda a, x, y, c, seed, k="event_id": f"(((CAST(floor({_U(seed, k)} * {a + 1}) AS BIGINT) | (CAST(floor({_U(seed + 1, k)} * {y - x + 1}) AS BIGINT) + {x})) + {c}) % {y - x + 1} + {x})"


def _sql_zipf(u: str, n: int, theta: float) -> str:
    zeta, alpha, eta = fn.zipf_constants(n, theta)
    return f"CASE WHEN {u} * {zeta!r} < 1 THEN 0 WHEN {u} * {zeta!r} < {1 + 0.5**theta!r} THEN 1 ELSE least(CAST(floor({float(n)!r} * pow({eta!r} * {u} - {eta!r} + 1, {alpha!r})) AS BIGINT), {n - 1}) END"


@query(f"SELECT request_id, src, CASE WHEN src = dst THEN (dst + 1) % 1000 ELSE dst END AS dst FROM (SELECT event_id AS request_id, CAST(floor({_U(1)} * 1000) AS BIGINT) AS src, CAST({_sql_zipf(_U(2), 1000, 0.9)} AS BIGINT) AS dst FROM events)")
def generated_transfers(spark: SparkSession, d: str) -> DataFrame:
    """A transfer for each event: a uniform debtor and another, Zipf-distributed creditor."""
    n, i = 1000, F.col("event_id")
    g = table(spark, d, "events").select(i.alias("request_id"), F.floor(fn.uniform(1, i) * n).cast("long").alias("src"), fn.zipf(fn.uniform(2, i), n, 0.9).alias("dst"))
    return g.withColumn("dst", F.when(F.col("src") == F.col("dst"), F.pmod(F.col("dst") + 1, F.lit(n))).otherwise(F.col("dst")))


@query(f"SELECT CAST({_sql_zipf(_U(2), 100, 0.9)} AS BIGINT) AS rank, count(*) AS n FROM events GROUP BY 1")
def zipf_draws(spark: SparkSession, d: str) -> DataFrame:
    """How often the generator draws each rank."""
    return table(spark, d, "events").groupBy(fn.zipf(fn.uniform(2, F.col("event_id")), 100, 0.9).alias("rank")).agg(F.count("*").alias("n"))


@query(f"""SELECT request_id, function, w_id, d_id, c_id, lines, s[n // 100 + 1] || s[n // 10 % 10 + 1] || s[n % 10 + 1] AS c_last, rolls_back, by_name, [{_NU(8191, 1, 100_000, 7911, 13, "request_id || ':' || k")} FOR k IN range(1, lines + 1)].array_to_string(',') AS items
FROM (SELECT event_id AS request_id, CASE WHEN {_U(3)} < 0.52 THEN 'new_order' ELSE 'payment' END AS function, CAST(floor({_U(4)} * 10) AS BIGINT) + 1 AS w_id, CAST(floor({_U(5)} * 10) AS BIGINT) + 1 AS d_id, {_NU(1023, 1, 3000, 259, 6)} AS c_id, CAST(floor({_U(8)} * 11) AS BIGINT) + 5 AS lines, {_NU(255, 0, 999, 123, 9)} AS n, {_U(11)} < 0.01 AS rolls_back, {_U(12)} < 0.6 AS by_name,
['BAR', 'OUGHT', 'ABLE', 'PRI', 'PRES', 'ESE', 'ANTI', 'CALLY', 'ATION', 'EING'] AS s FROM events)""")
def generated_orders(spark: SparkSession, d: str) -> DataFrame:
    """For each event, a new order (52 %) or payment with skewed customers, names and 5 to 15 lines."""
    i = F.col("event_id")
    g = table(spark, d, "events").select(i.alias("request_id"), F.when(fn.uniform(3, i) < 0.52, "new_order").otherwise("payment").alias("function"), (F.floor(fn.uniform(4, i) * 10) + 1).alias("w_id"), (F.floor(fn.uniform(5, i) * 10) + 1).alias("d_id"), fn.non_uniform(1023, 1, 3000, 259, 6, i).alias("c_id"), (F.floor(fn.uniform(8, i) * 11) + 5).alias("lines"), fn.last_name(fn.non_uniform(255, 0, 999, 123, 9, i)).alias("c_last"), (fn.uniform(11, i) < 0.01).alias("rolls_back"), (fn.uniform(12, i) < 0.6).alias("by_name"))
    return g.withColumn("items", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("lines")), lambda k: fn.non_uniform(8191, 1, 100_000, 7911, 13, F.col("request_id"), k).cast("string")), ","))


@query(f"""SELECT event_id AS request_id, CASE WHEN {_U(21)} < 0.6 THEN 'search' WHEN {_U(21)} < 0.99 THEN 'recommend' WHEN {_U(21)} < 0.995 THEN 'login' ELSE 'reserve' END AS function, 37.7 + {_U(22)} AS lat, -122.5 + {_U(23)} AS lon, CAST(floor({_U(24)} * 100) AS BIGINT) AS hotel FROM events""")
def generated_hotel_requests(spark: SparkSession, d: str) -> DataFrame:
    """60 % searches, 39 % recommendations, half a percent each of logins and reservations."""
    i = F.col("event_id")
    u = fn.uniform(21, i)
    kind = F.when(u < 0.6, "search").when(u < 0.99, "recommend").when(u < 0.995, "login").otherwise("reserve")
    return table(spark, d, "events").select(i.alias("request_id"), kind.alias("function"), (F.lit(37.7) + fn.uniform(22, i)).alias("lat"), (F.lit(-122.5) + fn.uniform(23, i)).alias("lon"), F.floor(fn.uniform(24, i) * 100).alias("hotel"))


@query(f"SELECT event_id AS request_id, 'user' || CAST(floor({_U(31)} * 1000) AS BIGINT) AS \"user\", CAST(floor({_U(32)} * 1000) AS BIGINT) AS movie, CAST(floor({_U(33)} * 11) AS BIGINT) AS rating, sha256(CAST(event_id AS VARCHAR)) AS text FROM events")
def generated_reviews(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("request_id"), F.concat(F.lit("user"), F.floor(fn.uniform(31, i) * 1000).cast("string")).alias("user"), F.floor(fn.uniform(32, i) * 1000).alias("movie"), F.floor(fn.uniform(33, i) * 11).alias("rating"), F.sha2(i.cast("string"), 256).alias("text"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"""WITH r AS (SELECT event_id AS id, md5(CAST(event_id AS VARCHAR)) AS h, user_id, event_id % 200 AS movie, event_id % 11 AS rating, event_type FROM events WHERE event_type IN ('click', 'view'))
SELECT r.id AS request_id, {_UUID} AS review_id, c_name AS "user", p_name AS movie, rating, sha256(event_type || id) AS text FROM r LEFT JOIN customer ON c_custkey = user_id LEFT JOIN part ON p_partkey = movie""")
def review_parts(spark: SparkSession, d: str) -> DataFrame:
    """A review's five parts, each found by its own lookup, in one row a request: id, user, movie, rating, text."""
    e = table(spark, d, "events").filter("event_type IN ('click', 'view')").select(F.col("event_id").alias("request_id"), "user_id", (F.col("event_id") % 200).alias("movie_id"), (F.col("event_id") % 11).alias("rating"), "event_type")
    row = lambda df, name, value: df.select("request_id", F.lit(name).alias("part"), value.cast("string").alias("value"))
    users = e.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"))
    movies = e.join(table(spark, d, "part"), F.col("p_partkey") == F.col("movie_id"))
    parts = [row(e, "review_id", fn.derived_uuid("request_id")), row(users, "user", F.col("c_name")), row(movies, "movie", F.col("p_name")), row(e, "rating", F.col("rating")), row(e, "text", F.sha2(F.concat("event_type", F.col("request_id").cast("string")), 256))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    merged = wl.merge_attributes(rows, "request_id", "part", "value", ["review_id", "user", "movie", "rating", "text"])
    return merged.withColumn("rating", F.col("rating").cast("long"))


@query(f"WITH {_HOTEL}, k AS (SELECT hotel % 4 AS kind, hotel, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(h_lat) - radians(30.1)) / 2), 2) + cos(radians(30.1)) * cos(radians(h_lat)) * pow(sin((radians(h_lon) - radians(10.1)) / 2), 2)))), 6) AS km FROM ho) SELECT kind, hotel, km FROM k QUALIFY rank() OVER (PARTITION BY kind ORDER BY km) = 1")
def hotel_recommend_distance_ties(spark: SparkSession, d: str) -> DataFrame:
    """The hotels of each kind nearest to the city's centre, ties included."""
    km = fn.haversine_km(F.lit(30.1), F.lit(10.1), F.col("h_lat"), F.col("h_lon"))
    return an.extremes(_hotels(spark, d).select((F.col("hotel") % 4).alias("kind"), "hotel", F.round(km, 6).alias("km")), ["kind"], "km")


@query("SELECT l_orderkey AS t_id, string_agg(printf('%d:%.2f', l_partkey, p), ';' ORDER BY l_partkey, p) AS items FROM (SELECT l_orderkey, l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p FROM lineitem GROUP BY ALL) GROUP BY 1")
def tpcc_reply_items(spark: SparkSession, d: str) -> DataFrame:
    """A new order's reply: its items with their amounts, joined by semicolons."""
    g = _lines(spark, d).groupBy("t_id", "item").agg(F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("p"))
    g = g.groupBy("t_id").agg(F.sort_array(F.collect_list(F.struct("item", "p"))).alias("x"))
    return g.select("t_id", F.array_join(F.transform("x", lambda i: F.format_string("%d:%.2f", i["item"], i["p"])), ";").alias("items"))


@query("SELECT o_orderkey AS t_id, printf('%s|%s|%d|%.2f|%.2f', c_name, n_name, n_regionkey, c_acctbal, o_totalprice) AS reply FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def tpcc_payment_reply(spark: SparkSession, d: str) -> DataFrame:
    """A payment's reply, gathered from customer, warehouse (nation) and district (region)."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.select(F.col("o_orderkey").alias("t_id"), F.format_string("%s|%s|%d|%.2f|%.2f", "c_name", "n_name", "n_regionkey", "c_acctbal", "o_totalprice").alias("reply"))


@query("SELECT event_id AS request_id, o_orderkey AS \"order\", CASE WHEN o_orderkey IS NULL THEN 'no such order' ELSE o_orderstatus END AS reply, coalesce(n, 0) AS lines FROM events LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 3) ON o_orderkey = event_id % 2000 LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def tpcc_order_status(spark: SparkSession, d: str) -> DataFrame:
    """Point reads of orders and their lines; a missing order aborts the read."""
    ask = table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 2000).alias("o_orderkey"))
    o = table(spark, d, "orders").filter("o_orderkey % 10 <> 3").select("o_orderkey", "o_orderstatus")
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    found = o.join(n, "o_orderkey", "left").withColumn("order", F.col("o_orderkey"))
    return ask.join(found, "o_orderkey", "left").select("request_id", "order", F.coalesce("o_orderstatus", F.lit("no such order")).alias("reply"), F.coalesce("n", F.lit(0)).cast("long").alias("lines"))


@query("SELECT l_orderkey AS t_id, l_linenumber AS line, l_partkey AS item, CASE WHEN contains(p_name, 'widget') AND p_brand LIKE '%1%' THEN 'B' ELSE 'G' END AS brand, l_quantity * p_retailprice AS amount FROM lineitem JOIN part ON p_partkey = l_partkey")
def tpcc_item_brands(spark: SparkSession, d: str) -> DataFrame:
    """Items looked up for each line, with the flag that the item's and the stock's data decide together."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.contains("p_name", F.lit("widget")) & F.contains("p_brand", F.lit("1")), "B").otherwise("G").alias("brand"), "p_retailprice")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("t_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), "l_quantity")
    return li.join(p, "item").select("t_id", "line", "item", "brand", (F.col("l_quantity") * F.col("p_retailprice")).alias("amount"))


@query("SELECT o_orderkey AS t_id, coalesce(n, 0) AS items, CASE WHEN coalesce(n, 0) = 0 THEN 'no items' WHEN n <> q THEN 'lengths differ' ELSE 'ok' END AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_quantity > 2 THEN 1 END) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def tpcc_valid_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose lists of items and quantities are of one length, and not empty; here small quantities got lost."""
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("items"), F.collect_list(F.when(F.col("l_quantity") > 2, F.col("l_quantity"))).alias("quantities"))
    o = table(spark, d, "orders").select("o_orderkey").join(lists, "o_orderkey", "left")
    n, q = F.coalesce(F.size("items"), F.lit(0)), F.coalesce(F.size("quantities"), F.lit(0))
    n, q = F.greatest(n, F.lit(0)), F.greatest(q, F.lit(0))
    return o.select(F.col("o_orderkey").alias("t_id"), n.cast("long").alias("items"), F.when(n == 0, "no items").when(n != q, "lengths differ").otherwise("ok").alias("outcome"))


@query(_BAL + ", c AS (SELECT key, count(*) AS n FROM ev GROUP BY key) SELECT key, CAST(value AS BIGINT) AS value, n AS events FROM bal JOIN c USING (key)")
def streaming_state_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Transfers as a stream through keyed state; the last balance of each key equals the batch result."""
    import uuid

    from ..storage import shared_dir
    from ..streaming.balances import running_balances

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    wl.transfer_events(_transfers(spark, d)).select("key", F.col("delta").cast("long").alias("delta")).write.option("maxRecordsPerFile", 5000).parquet(f"{path}/in")
    stream = spark.readStream.schema("key long, delta long").option("maxFilesPerTrigger", 4).parquet(f"{path}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = running_balances(stream, OPENING).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("key").agg(F.max_by("value", "batch").alias("value"), F.max_by("events", "batch").alias("events"))
