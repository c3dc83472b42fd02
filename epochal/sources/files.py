"""Readers and writers of a run's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = "request_id long, timestamp long, op string"
OUTPUT = "request_id long, response string, timestamp long"
TRACE = "timestamp long, total_throughput double"
#: A completed snapshot in a coordinator's log.
SNAPSHOT_LINE = r"Worker: (\d+) \| Completed snapshot: (\d+) \| started at: ([\d.]+) \| ended at: ([\d.]+)"
#: Columns of the header-less order-entry files, by table.
TPCC = {
    "warehouse": "w_id long, w_name string, w_street_1 string, w_street_2 string, w_city string, w_state string, w_zip string, w_tax double, w_ytd double",
    "district": "d_id long, d_w_id long, d_name string, d_street_1 string, d_street_2 string, d_city string, d_state string, d_zip string, d_tax double, d_ytd double, d_next_o_id long",
    "item": "i_id long, i_im_id long, i_name string, i_price double, i_data string",
    "history": "h_c_id long, h_c_d_id long, h_c_w_id long, h_d_id long, h_w_id long, h_date string, h_amount double, h_data string",
    "new_order": "no_o_id long, no_d_id long, no_w_id long",
    "order": "o_id long, o_c_id long, o_d_id long, o_w_id long, o_entry_d string, o_carrier_id long, o_ol_cnt long, o_all_local int",
    "order_line": "ol_o_id long, ol_d_id long, ol_w_id long, ol_number long, ol_i_id long, ol_supply_w_id long, ol_delivery_d string, ol_quantity long, ol_amount double, ol_dist_info string",
    "customer": "c_id long, c_d_id long, c_w_id long, c_first string, c_middle string, c_last string, c_street_1 string, c_street_2 string, c_city string, c_state string, c_zip string, c_phone string, c_since string, c_credit string, c_credit_lim double, c_discount double, c_balance double, c_ytd_payment double, c_payment_cnt long, c_delivery_cnt long, c_data string",
    "stock": "s_i_id long, s_w_id long, s_quantity long, " + ", ".join(f"s_dist_{i:02d} string" for i in range(1, 11)) + ", s_ytd double, s_order_cnt long, s_remote_cnt long, s_data string",
}


def run_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Client requests or outputs in time order."""
    return spark.read.schema(schema).option("header", True).csv(path).orderBy("timestamp")


#: Columns that make up a table's composite key.
TPCC_KEYS = {"warehouse": ["w_id"], "district": ["d_w_id", "d_id"], "item": ["i_id"], "history": ["h_c_w_id", "h_c_d_id", "h_c_id"], "new_order": ["no_w_id", "no_d_id", "no_o_id"], "order": ["o_w_id", "o_d_id", "o_id"], "order_line": ["ol_w_id", "ol_d_id", "ol_o_id", "ol_number"], "customer": ["c_w_id", "c_d_id", "c_id"], "stock": ["s_w_id", "s_i_id"]}


def tpcc_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A header-less order-entry file, typed, with its composite key."""
    return spark.read.schema(TPCC[name]).csv(path).withColumn("key", F.concat_ws(":", *[F.col(c).cast("string") for c in TPCC_KEYS[name]]))


def tpcc_state(spark: SparkSession, path: str, name: str, n: int) -> DataFrame:
    """The file as initial state of an operator: rows placed by the warehouse, the first field of the key."""
    from ..operators.partitioning import composite_partition

    d = tpcc_csv(spark, path, name)
    return d.select(F.lit(name).alias("operator"), composite_partition("key", ":", 0, n).alias("part"), "key", F.to_json(F.struct(*[c for c in d.columns if c != "key"])).alias("value"))


def trace(spark: SparkSession, path: str, peak: float | None = None) -> DataFrame:
    """A load trace; a normalised one is scaled to ``peak``."""
    t = spark.read.schema(TRACE).option("header", True).csv(path)
    return t.withColumn("total_throughput", F.col("total_throughput") * peak) if peak else t


def snapshot_log(spark: SparkSession, path: str) -> DataFrame:
    x = [F.regexp_extract("value", SNAPSHOT_LINE, i) for i in range(1, 5)]
    d = spark.read.text(path).select(*[c.alias(n) for c, n in zip(x, ("worker", "snapshot_id", "started", "ended"))]).filter("worker <> ''")
    return d.select(F.col("worker").cast("long"), F.col("snapshot_id").cast("long"), F.col("started").cast("double"), F.col("ended").cast("double")).withColumn("ms", F.round(F.col("ended") - F.col("started"), 3))


def write_wal(sequenced: DataFrame, path: str) -> None:
    """Request id and t_id by epoch, before the epoch runs; writing an epoch again replaces it."""
    sequenced.select("epoch", "request_id", "t_id").write.option("partitionOverwriteMode", "dynamic").partitionBy("epoch").mode("overwrite").parquet(path)


def read_wal(spark: SparkSession, path: str, first_epoch: int = 0) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("epoch") >= first_epoch).groupBy("request_id").agg(F.max_by("t_id", "epoch").alias("t_id"))


def write_deltas(deltas: DataFrame, path: str) -> None:
    deltas.write.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", "operator", "part").mode("overwrite").parquet(path)


def read_deltas(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Deltas up to an id; ids are numbers, so 10 comes after 2."""
    d = spark.read.parquet(path).withColumn("snapshot_id", F.col("snapshot_id").cast("long"))
    return d if upto is None else d.filter(F.col("snapshot_id") <= upto)


def log_requests(spark: SparkSession, path: str, schema: str, part: str, offset: str) -> DataFrame:
    """A request log: rows of each partition by offset."""
    return spark.read.schema(schema).parquet(path).repartition(part).sortWithinPartitions(part, offset)


def route(requests: DataFrame, n: int) -> DataFrame:
    """Adds the partition that owns each key; requests without key have none."""
    from ..operators.partitioning import partition_of

    return requests.withColumn("part", partition_of("key", n))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_csv(df: DataFrame, path: str) -> None:
    """Requests or outputs of a run as CSV files with a header, in time order."""
    df.orderBy("timestamp").write.mode("overwrite").option("header", True).csv(path)


def write_replies(replies: DataFrame, path: str, batch: int) -> None:
    """Replies of a batch; writing the batch again replaces it."""
    replies.write.mode("overwrite").parquet(f"{path}/batch={batch}")
