"""Generated initial data of the order-entry workload: nine tables, from ranges and digests alone.

Every value is a function of its row's key and the seed, so that any task can
make any part, and again after a loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import TPCC
from .columns import derived_uuid, last_name, non_uniform, uniform

#: Sizes of the usual data set for each warehouse, but for the items, which all share (fixed values).
DISTRICTS, CUSTOMERS, ITEMS, OPEN_ORDERS = 10, 3000, 100_000, 900
START = "2020-01-01 00:00:00"


def _between(low: int, high: int, seed: int, *key) -> Column:
    return (F.floor(uniform(seed, *key) * (high - low + 1)) + low).cast("long")


def _text(n: int, seed: int, *key) -> Column:
    """``n`` hexadecimal digits."""
    return F.substring(F.concat(*[F.md5(F.concat_ws(":", F.lit(str(seed + i)), *[F.col(k).cast("string") for k in key]).cast("binary")) for i in range(-(-n // 32))]), 1, n)


def _original(text: Column, seed: int, *key) -> Column:
    """A tenth of the rows carries the mark of original goods."""
    return F.when(uniform(seed, *key) < 0.1, F.concat(F.lit("ORIGINAL"), F.substring(text, 9, 100))).otherwise(text)


def _address(prefix: str, seed: int, *key) -> dict[str, Column]:
    return {f"{prefix}_street_1": _text(16, seed, *key), f"{prefix}_street_2": _text(16, seed + 1, *key), f"{prefix}_city": _text(12, seed + 2, *key), f"{prefix}_state": F.upper(_text(2, seed + 3, *key)), f"{prefix}_zip": F.concat(F.lpad(_between(0, 9999, seed + 4, *key).cast("string"), 4, "0"), F.lit("11111"))}


def _each(df: DataFrame, name: str, n: int | Column) -> DataFrame:
    """A row for each number from 1 to ``n``."""
    return df.select("*", F.explode(F.sequence(F.lit(1).cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long"))).alias(name))


def order_entry(spark: SparkSession, warehouses: int, districts: int = DISTRICTS, customers: int = CUSTOMERS, items: int = ITEMS, open_orders: int = OPEN_ORDERS, seed: int = 100) -> dict[str, DataFrame]:
    """The tables by name, with the columns of their files. A district has one order a customer, the last ``open_orders`` of them open."""
    ids = lambda n, name: spark.range(1, n + 1).select(F.col("id").alias(name))
    s, out = seed, {}
    w = ids(warehouses, "w_id")
    out["warehouse"] = w.withColumns({"w_name": _text(8, s, "w_id"), **_address("w", s + 1, "w_id"), "w_tax": _between(0, 2000, s + 8, "w_id") / 10_000, "w_ytd": F.lit(300_000.0)})
    d = _each(w.withColumnRenamed("w_id", "d_w_id"), "d_id", districts)
    k = ("d_w_id", "d_id")
    out["district"] = d.withColumns({"d_name": _text(8, s + 10, *k), **_address("d", s + 11, *k), "d_tax": _between(0, 2000, s + 18, *k) / 10_000, "d_ytd": F.lit(30_000.0), "d_next_o_id": F.lit(customers + 1).cast("long")})
    i = ids(items, "i_id")
    out["item"] = i.withColumns({"i_im_id": _between(1, 10_000, s + 20, "i_id"), "i_name": _text(20, s + 21, "i_id"), "i_price": _between(100, 10_000, s + 22, "i_id") / 100, "i_data": _original(_text(40, s + 23, "i_id"), s + 25, "i_id")})
    k = ("s_w_id", "s_i_id")
    stock = i.withColumnRenamed("i_id", "s_i_id").withColumn("s_w_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(warehouses).cast("long"))))
    out["stock"] = stock.withColumns({"s_quantity": _between(10, 100, s + 30, *k), **{f"s_dist_{n:02d}": _text(24, s + 30 + n, *k) for n in range(1, 11)}, "s_ytd": F.lit(0.0), "s_order_cnt": F.lit(0).cast("long"), "s_remote_cnt": F.lit(0).cast("long"), "s_data": _original(_text(40, s + 41, *k), s + 43, *k)})
    c = _each(d.withColumnsRenamed({"d_w_id": "c_w_id", "d_id": "c_d_id"}), "c_id", customers)
    k = ("c_w_id", "c_d_id", "c_id")
    number = F.when(F.col("c_id") <= 1000, F.col("c_id") - 1).otherwise(non_uniform(255, 0, 999, 123, s + 50, *k))
    out["customer"] = c.withColumns({"c_first": _text(12, s + 52, *k), "c_middle": F.lit("OE"), "c_last": last_name(number), **_address("c", s + 53, *k), "c_phone": F.lpad(_between(0, 10**9, s + 58, *k).cast("string"), 16, "0"), "c_since": F.lit(START), "c_credit": F.when(uniform(s + 59, *k) < 0.1, "BC").otherwise("GC"), "c_credit_lim": F.lit(50_000.0), "c_discount": _between(0, 5000, s + 60, *k) / 10_000, "c_balance": F.lit(-10.0), "c_ytd_payment": F.lit(10.0), "c_payment_cnt": F.lit(1).cast("long"), "c_delivery_cnt": F.lit(0).cast("long"), "c_data": _text(300, s + 61, *k)})
    out["history"] = c.select(F.col("c_id").alias("h_c_id"), F.col("c_d_id").alias("h_c_d_id"), F.col("c_w_id").alias("h_c_w_id"), F.col("c_d_id").alias("h_d_id"), F.col("c_w_id").alias("h_w_id"), F.lit(START).alias("h_date"), F.lit(10.0).alias("h_amount"), _text(20, s + 75, *k).alias("h_data"))
    # A district's customers in random order: its orders' numbers are their places by digest.
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("c_w_id", "c_d_id").orderBy(derived_uuid(F.lit(s), *[F.col(x) for x in k]), "c_id"))  # a district's customers
    o = c.select(place.cast("long").alias("o_id"), F.col("c_id").alias("o_c_id"), F.col("c_d_id").alias("o_d_id"), F.col("c_w_id").alias("o_w_id"))
    k = ("o_w_id", "o_d_id", "o_id")
    is_open = F.col("o_id") > customers - open_orders
    out["order"] = o.withColumns({"o_entry_d": F.lit(START), "o_carrier_id": F.when(~is_open, _between(1, 10, s + 80, *k)), "o_ol_cnt": _between(5, 15, s + 81, *k), "o_all_local": F.lit(1)})
    out["new_order"] = o.filter(is_open).select(F.col("o_id").alias("no_o_id"), F.col("o_d_id").alias("no_d_id"), F.col("o_w_id").alias("no_w_id"))
    line = _each(out["order"].select(F.col("o_id").alias("ol_o_id"), F.col("o_d_id").alias("ol_d_id"), F.col("o_w_id").alias("ol_w_id"), "o_ol_cnt"), "ol_number", F.col("o_ol_cnt"))
    k, is_open = ("ol_w_id", "ol_d_id", "ol_o_id", "ol_number"), F.col("ol_o_id") > customers - open_orders
    out["order_line"] = line.withColumns({"ol_i_id": _between(1, items, s + 90, *k), "ol_supply_w_id": F.col("ol_w_id"), "ol_delivery_d": F.when(~is_open, START), "ol_quantity": F.lit(5).cast("long"), "ol_amount": F.when(is_open, _between(1, 999_999, s + 91, *k) / 100).otherwise(F.lit(0.0)), "ol_dist_info": _text(24, s + 92, *k)})
    return {name: out[name].select([x.split(" ")[0] for x in columns.split(", ")]) for name, columns in TPCC.items()}


def write_order_entry(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as files without header, as ``tpcc_csv`` reads them."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}")
